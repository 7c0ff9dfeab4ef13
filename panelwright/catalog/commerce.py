"""Commerce book: c01 to c58 and the operators shown on the star schema."""

from __future__ import annotations

from panelwright.catalog.book import BOOK
from panelwright.catalog.ctes import STAR, with_
from panelwright.operators.pairs import top_pairs
from panelwright.plans import commerce as P
from panelwright.sources.derived import Star

CUTOFF = "2001-06-01"
AS_OF = "2001-08-31"


def _add(name, plan, sql):
    BOOK.add(name, lambda spark, folder: plan(Star(spark, folder)), with_(STAR) + sql)


CUSTOMER_REVENUE = "x AS (SELECT customer_id, round(sum(net_revenue), 2) AS revenue FROM fin GROUP BY 1)"
MONTHLY = "m AS (SELECT strftime(order_date, '%Y-%m') AS month, round(sum(net_revenue), 2) AS revenue FROM fin GROUP BY 1)"
DONE = "done AS (SELECT * FROM fact_order WHERE status = 'completed')"


def _cte(name, plan, extra, sql):
    BOOK.add(name, lambda spark, folder: plan(Star(spark, folder)), with_(STAR, *extra) + sql)


_add("c01", P.revenue_by_month, "SELECT strftime(order_date, '%Y-%m') AS month, round(sum(net_revenue), 2) AS net_revenue FROM fin GROUP BY 1 ORDER BY 1")
_cte("c02", P.trailing_revenue, [MONTHLY], "SELECT month, revenue, round(avg(revenue) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_3m FROM m")
_add("c03", P.channel_rank_by_country, """
SELECT *, dense_rank() OVER (PARTITION BY country ORDER BY revenue DESC) AS channel_rank FROM (
  SELECT c.country, c.acquisition_channel, round(sum(f.net_revenue), 2) AS revenue
  FROM dim_customer c JOIN fin f USING (customer_id) GROUP BY 1, 2)""")
_cte("c04", P.customer_deciles, [CUSTOMER_REVENUE], "SELECT customer_id, revenue, CAST(ntile(10) OVER (ORDER BY revenue DESC, customer_id) AS INT) AS revenue_decile FROM x")
_cte("c05", P.repeat_rate, [DONE], "SELECT round(avg(CASE WHEN n >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS repeat_rate FROM (SELECT customer_id, count(*) AS n FROM done GROUP BY 1)")
_add("c06", P.return_rate_by_category, """
SELECT p.category, round(avg(CASE WHEN r.order_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS return_rate
FROM fact_order_item i JOIN dim_product p USING (product_id) LEFT JOIN fact_return r USING (order_id) GROUP BY 1""")
_add("c07", P.discount_buckets, """
SELECT CASE WHEN discount_pct = 0 THEN '0%' WHEN discount_pct <= 0.10::DOUBLE THEN '1-10%' WHEN discount_pct <= 0.20::DOUBLE THEN '11-20%' ELSE '21%+' END AS bucket,
       count(*) AS orders, round(avg(net_revenue), 6) AS avg_revenue FROM fin GROUP BY 1""")
_cte("c08", P.days_since_previous, [DONE], """
SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date,
       CAST(order_date - lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS INT) AS days_since_prev FROM done""")
_cte("c09", P.cohort_sizes, [DONE], "SELECT strftime(d, '%Y-%m') AS cohort_month, count(*) AS customers FROM (SELECT customer_id, min(order_date) AS d FROM done GROUP BY 1) GROUP BY 1")
_add("c10", P.top_product_by_category, """
SELECT category, product_id, sales, CAST(rn AS INT) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY sales DESC, product_id) AS rn FROM (
    SELECT p.category, p.product_id, round(sum(i.quantity * i.unit_price), 2) AS sales
    FROM fact_order_item i JOIN dim_product p USING (product_id) GROUP BY 1, 2)) WHERE rn = 1""")
_cte("c11", P.pareto_share, [CUSTOMER_REVENUE], """
SELECT round(avg(CASE WHEN running / total <= 0.8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_customers_before_80pct FROM (
  SELECT sum(revenue) OVER (ORDER BY revenue DESC) AS running, sum(revenue) OVER () AS total FROM x)""")
_add("c12", P.return_severity, "SELECT return_reason, count(*) AS returns, round(sum(refund_amount), 2) AS refunds, round(avg(refund_amount), 6) AS avg_refund FROM fact_return GROUP BY 1")
_add("c13", P.monthly_return_rate, """
SELECT strftime(o.order_date, '%Y-%m') AS month, round(avg(CASE WHEN r.order_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS return_rate
FROM fact_order o LEFT JOIN fact_return r USING (order_id) GROUP BY 1""")
_add("c14", P.discount_penetration, "SELECT discount_pct, count(*) AS orders, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM fact_order GROUP BY 1")
_add("c15", P.country_aov, "SELECT c.country, round(avg(f.net_revenue), 6) AS aov FROM dim_customer c JOIN fin f USING (customer_id) GROUP BY 1")
_add("c16", P.category_margin, "SELECT p.category, round(sum(i.quantity * (i.unit_price - p.unit_cost)), 2) AS margin_proxy FROM fact_order_item i JOIN dim_product p USING (product_id) GROUP BY 1")
_cte("c17", P.recency_rank, [DONE], """
SELECT customer_id, CAST(last_order AS VARCHAR) AS last_order, CAST(dense_rank() OVER (ORDER BY last_order DESC) AS INT) AS recency_rank
FROM (SELECT customer_id, max(order_date) AS last_order FROM done GROUP BY 1)""")
_cte("c18", lambda s: P.inactive_customers(s, CUTOFF), [DONE], f"SELECT count(*) AS inactive FROM (SELECT customer_id, max(order_date) AS d FROM done GROUP BY 1) WHERE d < DATE '{CUTOFF}'")
_add("c19", P.order_quartiles, """
SELECT order_id, r AS net_revenue, CAST(ntile(4) OVER (ORDER BY r, order_id) AS INT) AS quartile
FROM (SELECT order_id, round(net_revenue, 2) AS r FROM fin)""")
_add("c20", P.channel_returns, """
SELECT c.acquisition_channel, round(sum(f.net_revenue), 2) AS net_revenue, round(avg(f.returned), 6) AS return_rate
FROM dim_customer c JOIN fin f USING (customer_id) GROUP BY 1""")
_cte("c21", P.active_span, [DONE], "SELECT customer_id, CAST(max(order_date) - min(order_date) AS INT) AS active_span_days FROM done GROUP BY 1")

PAIRS = """
SELECT a.product_id AS p1, b.product_id AS p2, count(DISTINCT a.order_id) AS pair_orders
FROM fact_order_item a JOIN fact_order_item b ON a.order_id = b.order_id AND a.product_id < b.product_id
GROUP BY 1, 2 ORDER BY pair_orders DESC, p1, p2 LIMIT """
_add("c22", lambda s: top_pairs(s.items, "order_id", "product_id", 20), PAIRS + "20")
_add("c23", P.category_breadth, "SELECT i.order_id, count(DISTINCT p.category) AS category_breadth FROM fact_order_item i JOIN dim_product p USING (product_id) GROUP BY 1")
_cte("c24", P.new_customer_share, [DONE], """
SELECT strftime(order_date, '%Y-%m') AS month, round(avg(CASE WHEN rn = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS new_share FROM (
  SELECT order_date, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS rn FROM done) GROUP BY 1""")
_cte("c25", P.longest_gaps, [DONE], """
SELECT customer_id, CAST(max(gap) AS INT) AS max_gap_days FROM (
  SELECT customer_id, order_date - lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS gap FROM done)
GROUP BY 1 ORDER BY max_gap_days DESC NULLS LAST, customer_id LIMIT 25""")
_cte("c26", P.high_return_customers, [DONE], """
SELECT o.customer_id, count(*) AS orders, CAST(sum(CASE WHEN r.order_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS returned_orders
FROM done o LEFT JOIN fact_return r USING (order_id) GROUP BY 1 HAVING returned_orders >= 2""")
_add("c27", P.attach_rate, """
SELECT p.product_id, round(CAST(count(DISTINCT i.order_id) AS DOUBLE) / (SELECT count(DISTINCT order_id) FROM fact_order_item), 8) AS attach_rate
FROM fact_order_item i JOIN dim_product p USING (product_id) GROUP BY 1""")
_cte("c28", P.active_customers, [DONE], "SELECT strftime(order_date, '%Y-%m') AS month, count(DISTINCT customer_id) AS active_customers FROM done GROUP BY 1")
_cte("c29", P.revenue_growth, [MONTHLY], "SELECT month, revenue, round((revenue - prev) / prev, 6) AS growth FROM (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev FROM m)")
_add("c30", P.return_reason_rank, "SELECT return_reason, count(*) AS n, CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INT) AS rank FROM fact_return GROUP BY 1")
_add("c31", P.country_segments, "SELECT country, customer_segment, count(*) AS customers FROM dim_customer GROUP BY 1, 2")
_add("c32", P.channel_discount, "SELECT c.acquisition_channel, round(avg(o.discount_pct), 6) AS avg_discount FROM dim_customer c JOIN fact_order o USING (customer_id) GROUP BY 1")
_add("c33", P.high_value_share, "SELECT country, round(avg(CASE WHEN customer_segment = 'high_value' THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_high_value FROM dim_customer GROUP BY 1")
_add("c34", P.completed_share, "SELECT round(avg(CASE WHEN status = 'completed' THEN 1.0::DOUBLE ELSE 0 END), 6) AS completed_share FROM fact_order")
_add("c41", P.total_revenue, "SELECT round(sum(net_revenue), 2) AS view_revenue FROM fin")
_add("c42", P.monthly_category_trend, """
SELECT strftime(o.order_date, '%Y-%m') AS month, p.category, round(sum(i.quantity * i.unit_price), 2) AS gross_sales
FROM fact_order o JOIN fact_order_item i USING (order_id) JOIN dim_product p USING (product_id) GROUP BY 1, 2""")
_add("c43", P.customer_top_category, """
SELECT customer_id, category, sales FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY sales DESC, category) AS rn FROM (
    SELECT o.customer_id, p.category, round(sum(i.quantity * i.unit_price), 2) AS sales
    FROM fact_order o JOIN fact_order_item i USING (order_id) JOIN dim_product p USING (product_id) GROUP BY 1, 2)) WHERE rn = 1""")
_add("c44", P.channel_growth, """
SELECT *, round(revenue - lag(revenue) OVER (PARTITION BY acquisition_channel ORDER BY month), 2) AS abs_growth FROM (
  SELECT c.acquisition_channel, strftime(f.order_date, '%Y-%m') AS month, round(sum(f.net_revenue), 2) AS revenue
  FROM dim_customer c JOIN fin f USING (customer_id) GROUP BY 1, 2)""")
RFM = f"rfm AS (SELECT customer_id, CAST(DATE '{AS_OF}' - max(order_date) AS INT) AS recency, count(*) AS frequency FROM done GROUP BY 1)"
_cte("c45", lambda s: P.rfm_report(s, AS_OF), [DONE, RFM], "SELECT customer_id, recency AS recency_days, frequency FROM rfm")
_cte("c46", lambda s: P.rfm_scores(s, AS_OF), [DONE, RFM], """
SELECT *, CAST(ntile(5) OVER (ORDER BY recency DESC, customer_id) AS INT) AS r_score,
       CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INT) AS f_score FROM rfm""")
_cte("c47", P.top_decile, [CUSTOMER_REVENUE], "SELECT * FROM (SELECT *, CAST(ntile(10) OVER (ORDER BY revenue DESC, customer_id) AS INT) AS d FROM x) WHERE d = 1")
_add("c48", P.channel_economics, """
SELECT c.acquisition_channel, count(DISTINCT c.customer_id) AS customers, round(sum(f.net_revenue), 2) AS revenue,
       round(round(sum(f.net_revenue), 2) / count(DISTINCT c.customer_id), 6) AS revenue_per_customer
FROM dim_customer c JOIN fin f USING (customer_id) GROUP BY 1""")
_add("c51", P.median_order_revenue, "SELECT round(percentile_cont(0.5) WITHIN GROUP (ORDER BY round(net_revenue, 2)), 6) AS median_net_revenue FROM fin")
LATEST = """
SELECT * EXCLUDE (rn, order_date), CAST(order_date AS VARCHAR) AS order_date FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) AS rn FROM fact_order) WHERE rn <= """
_add("c52", lambda s: P.latest_orders(s, 3), LATEST + "3")
_add("c53", lambda s: P.latest_orders(s, 1), LATEST + "1")
_add("c55", P.returned_counts, "SELECT count(*) FILTER (WHERE returned = 1) AS returned_orders, count(*) FILTER (WHERE returned = 0) AS kept_orders FROM fin")
_add("c56", P.json_counts, "SELECT props ->> '$.k' AS campaign, count(*) AS n FROM events GROUP BY 1")
