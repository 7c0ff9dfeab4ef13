"""Derived job inputs once more, as SQL common table expressions for the check queries."""

from __future__ import annotations

STAR = """
dim_customer AS (
  SELECT c_custkey AS customer_id, make_date(2024, CAST(c_custkey % 12 + 1 AS INT), 1) AS signup_date,
         n_name AS country,
         (['organic','paid_search','affiliate','social'])[CAST(c_custkey % 4 + 1 AS INT)] AS acquisition_channel,
         (['consumer','high_value','business'])[CAST(c_custkey % 3 + 1 AS INT)] AS customer_segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
dim_product AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS subcategory,
         floor(p_retailprice * 0.6::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS unit_cost,
         p_retailprice AS list_price FROM part),
fact_order AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         (['web','ios','android'])[CAST(o_orderkey % 3 + 1 AS INT)] AS device,
         (['card','wallet'])[CAST(o_orderkey % 2 + 1 AS INT)] AS payment_method,
         ([0.0::DOUBLE,0.05::DOUBLE,0.10::DOUBLE,0.15::DOUBLE,0.25::DOUBLE])[CAST(o_orderkey % 5 + 1 AS INT)] AS discount_pct,
         4.5::DOUBLE AS shipping_fee,
         CASE WHEN o_orderstatus = 'O' THEN 'cancelled' ELSE 'completed' END AS status FROM orders),
fact_order_item AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
         floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS unit_price FROM lineitem),
fact_return AS (
  SELECT r.order_id, 1 AS returned, CAST(o.order_date + 3 AS DATE) AS return_date,
         (['damaged','changed_mind','wrong_item'])[CAST(r.order_id % 3 + 1 AS INT)] AS return_reason, refund_amount
  FROM (SELECT l_orderkey AS order_id,
               sum(CAST(l_quantity AS INT) * (floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)) AS refund_amount
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r
  JOIN fact_order o ON o.order_id = r.order_id AND o.status = 'completed'),
item_rollup AS (
  SELECT i.order_id, sum(i.quantity * i.unit_price) AS gross_revenue, sum(i.quantity * p.unit_cost) AS cogs,
         sum(i.quantity) AS units
  FROM fact_order_item i JOIN dim_product p USING (product_id) GROUP BY 1),
fin AS (
  SELECT o.*, coalesce(gross_revenue, 0) AS gross_revenue, coalesce(cogs, 0) AS cogs,
         CAST(coalesce(units, 0) AS BIGINT) AS units, coalesce(returned, 0) AS returned,
         coalesce(refund_amount, 0) AS refund_amount,
         CASE WHEN o.status = 'completed' THEN coalesce(gross_revenue, 0) + o.shipping_fee - coalesce(refund_amount, 0) ELSE 0 END AS net_revenue,
         CASE WHEN o.status = 'completed' THEN coalesce(gross_revenue, 0) - coalesce(cogs, 0) - coalesce(refund_amount, 0) ELSE 0 END AS gross_margin
  FROM fact_order o LEFT JOIN item_rollup i USING (order_id) LEFT JOIN fact_return r USING (order_id))
"""

_CLEANED = """
ranked_events AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_seq DESC) AS rn FROM raw_events),
clean_events AS (
  SELECT *, CASE WHEN is_reversal = 1 THEN -amount ELSE amount END AS signed_amount
  FROM ranked_events WHERE rn = 1 AND regexp_full_match(account_id, 'A[0-9]{8}'))
"""

EVENTS = """
raw_events AS (
  SELECT event_id, 1 AS ingest_seq, printf('A%08d', user_id) AS account_id, CAST(ts AS DATE) AS date, event_type AS region,
         (['payroll','procurement','tax','transfer'])[CAST(event_id % 4 + 1 AS INT)] AS category,
         value AS amount, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_reversal FROM events),""" + _CLEANED

# The whole event log: malformed accounts, reversals and corrections under the same event id.
EVENT_LOG = """
raw_base AS (
  SELECT event_id, 1 AS ingest_seq,
         CASE WHEN event_id % 1203 = 0 THEN 'bad-account' ELSE printf('A%08d', user_id) END AS account_id,
         CAST(ts AS DATE) AS date, event_type AS region,
         (['payroll','procurement','tax','transfer'])[CAST(event_id % 4 + 1 AS INT)] AS category,
         value AS amount, CASE WHEN event_id % 55 = 0 THEN 1 ELSE 0 END AS is_reversal FROM events),
raw_events AS (
  SELECT * FROM raw_base UNION ALL
  SELECT event_id, 2, account_id, date, region, category,
         floor(amount * 0.9::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE, is_reversal
  FROM raw_base WHERE event_id % 250 = 0),""" + _CLEANED

FIRMS = """
firm_master AS (
  SELECT printf('F%04d', CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT)) AS firm_id, c_name AS legal_name, 'R' || n_regionkey AS region_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
region_file AS (SELECT 'R' || r_regionkey AS region_code, r_name AS region_name FROM region),
quarterly AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, count(*) AS n,
         sum(o_totalprice) AS total, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day FROM orders GROUP BY 1, 2),
employment AS (SELECT customer AS firm_key, label AS quarter, CAST(n AS VARCHAR) AS employees, last_day AS correction_ts FROM quarterly),
financials AS (
  SELECT customer AS company_identifier, last_day AS period, CAST(CAST(round(total, 2) AS DECIMAL(20, 2)) AS VARCHAR) AS revenue, last_day AS correction_ts FROM quarterly),
adoption AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS adoption_date,
         CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'open' END AS status FROM orders WHERE o_orderpriority = '1-URGENT'),
master AS (SELECT firm_id, min(legal_name) AS legal_name, min_by(region_code, legal_name) AS region_code FROM firm_master GROUP BY 1),
region_clean AS (
  SELECT region_code, array_to_string(list_transform(string_split(lower(trim(region_name)), ' '),
         lambda w: upper(w[1]) || w[2:]), ' ') AS region FROM region_file),
emp_keyed AS (
  SELECT CASE WHEN regexp_replace(firm_key, '[^0-9]', '', 'g') = '' THEN NULL
              ELSE printf('F%04d', CAST(regexp_replace(firm_key, '[^0-9]', '', 'g') AS BIGINT)) END AS firm_id,
         CASE WHEN contains(quarter, 'Q') THEN replace(quarter, '-Q', 'Q')
              ELSE year(CAST(quarter AS DATE)) || 'Q' || quarter(CAST(quarter AS DATE)) END AS quarter,
         CAST(employees AS INT) AS employees, CAST(correction_ts AS DATE) AS correction_ts FROM employment),
fin_keyed AS (
  SELECT CASE WHEN regexp_replace(company_identifier, '[^0-9]', '', 'g') = '' THEN NULL
              ELSE printf('F%04d', CAST(regexp_replace(company_identifier, '[^0-9]', '', 'g') AS BIGINT)) END AS firm_id,
         CASE WHEN contains(period, 'Q') THEN replace(period, '-Q', 'Q')
              ELSE year(CAST(period AS DATE)) || 'Q' || quarter(CAST(period AS DATE)) END AS quarter,
         CAST(replace(replace(revenue, '$', ''), ',', '') AS DOUBLE) AS revenue_usd,
         CAST(correction_ts AS DATE) AS correction_ts FROM financials),
emp AS (SELECT firm_id, quarter, max_by(employees, (correction_ts, employees)) AS employees FROM emp_keyed
        WHERE firm_id IS NOT NULL AND quarter IS NOT NULL GROUP BY ALL),
fin_latest AS (SELECT firm_id, quarter, max_by(revenue_usd, (correction_ts, revenue_usd)) AS revenue_usd FROM fin_keyed
        WHERE firm_id IS NOT NULL AND quarter IS NOT NULL GROUP BY ALL),
adoption_keyed AS (
  SELECT CASE WHEN regexp_replace(entity_id, '[^0-9]', '', 'g') = '' THEN NULL
              ELSE printf('F%04d', CAST(regexp_replace(entity_id, '[^0-9]', '', 'g') AS BIGINT)) END AS firm_id,
         TRY_CAST(adoption_date AS DATE) AS adoption_date, status FROM adoption),
first_adoption AS (
  SELECT firm_id, min(adoption_date) AS adoption_date FROM adoption_keyed
  WHERE status = 'verified' AND adoption_date IS NOT NULL AND firm_id IN (SELECT firm_id FROM master) GROUP BY 1),
quarters AS (
  SELECT year(d) || 'Q' || quarter(d) AS quarter, last_day(d + INTERVAL 2 MONTH) AS last_day
  FROM (SELECT unnest(generate_series(date_trunc('quarter', min(o_orderdate)), date_trunc('quarter', max(o_orderdate)),
                                      INTERVAL 3 MONTH)) AS d FROM orders)),
panel AS (
  SELECT m.firm_id, q.quarter, r.region, e.employees, f.revenue_usd,
         CASE WHEN a.adoption_date <= q.last_day THEN 1 ELSE 0 END AS ai_adopted
  FROM master m, quarters q
  LEFT JOIN region_clean r ON r.region_code = m.region_code
  LEFT JOIN emp e ON e.firm_id = m.firm_id AND e.quarter = q.quarter
  LEFT JOIN fin_latest f ON f.firm_id = m.firm_id AND f.quarter = q.quarter
  LEFT JOIN first_adoption a ON a.firm_id = m.firm_id)
"""

VINTAGES = """
vintage_added AS (
  SELECT l_returnflag AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date,
         last_day(CAST(greatest(l_shipdate, o_orderdate) AS DATE)) AS vintage_date, sum(l_extendedprice) AS added
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
vintage_panel AS (
  SELECT series_id, observation_date, vintage_date,
         round(sum(added) OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date
                                ROWS UNBOUNDED PRECEDING), 2) / 1000000 AS value
  FROM vintage_added),
vp AS (
  SELECT series_id, observation_date, vintage_date, value FROM vintage_panel
  UNION ALL
  SELECT 'U', CAST(date_trunc('month', o_orderdate) AS DATE), last_day(CAST(date_trunc('month', o_orderdate) AS DATE)),
         CASE WHEN avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END) >= 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END
  FROM orders GROUP BY 2, 3)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"
