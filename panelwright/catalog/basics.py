"""Readers, cleaning rules, record selection, joins, aggregates, windows, calendars, contracts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.catalog.book import BOOK
from panelwright.catalog.ctes import EVENT_LOG, EVENTS, FIRMS, STAR, VINTAGES, with_
from panelwright.functions import cleaning as C
from panelwright.operators import calendar, contracts, joins, latest, ordered, sessions
from panelwright.operators.pairs import top_pairs
from panelwright.plans import commerce, events, firm_panel
from panelwright.runtime import stage_root
from panelwright.sources import tables as S
from panelwright.sources.derived import FirmFiles, Star, event_log, event_study_panel, firm_year, raw_events, vintage_source
from panelwright.sources.tables import Tables


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder below the shared stage folder."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def firms(spark: SparkSession, folder: str) -> firm_panel.FirmPanel:
    files = FirmFiles(spark, folder)
    days = files.tables.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return firm_panel.FirmPanel(files, days.select("a").scalar(), days.select("b").scalar())


def events_of(spark: SparkSession, folder: str) -> DataFrame:
    return raw_events(Tables(spark, folder))


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(Tables(spark, folder))


# -- sources and sinks ------------------------------------------------------------------

EVENT_COLUMNS = "event_id, ingest_seq, account_id, CAST(date AS VARCHAR) AS date, region, category, amount, is_reversal"
RAW_TEXT_ID = f"{with_(EVENT_LOG)}SELECT CAST(event_id AS VARCHAR) AS event_id, * EXCLUDE (event_id, date), CAST(date AS VARCHAR) AS date FROM raw_events"


def s01(spark, folder):
    raw = log_of(spark, folder).withColumn("event_id", F.col("event_id").cast("string"))
    out = fresh(spark, "csv")
    S.write_results({"events": raw}, out)
    return S.read_csv(spark, f"{out}/events", S.EVENT_SCHEMA)


def s02(spark, folder):
    raw = log_of(spark, folder).withColumn("event_id", F.col("event_id").cast("string"))
    out = fresh(spark, "csv-gz")
    raw.write.option("header", True).option("compression", "gzip").csv(out)
    return S.read_events(spark, out)


def s04(spark, folder):
    out = fresh(spark, "sorted")
    S.write_parquet(events.account_summary(events.clean_events(log_of(spark, folder))), out, ["account_id"])
    return spark.read.parquet(out)


def s05(spark, folder):
    clean = events.clean_events(log_of(spark, folder))
    out = fresh(spark, "results")
    results = {"account_summary": events.account_summary(clean), "daily": events.daily_region_summary(clean)}
    S.write_results(results, out)
    accounts, daily = (S.read_csv(spark, f"{out}/{name}", df.schema) for name, df in results.items())
    measures = ["n_events", "net_amount"]
    return accounts.select(F.lit("account").alias("part"), F.col("account_id").alias("key"), *measures).unionByName(
        daily.select(F.lit("daily").alias("part"), F.concat_ws("/", F.col("date").cast("string"), "region").alias("key"), *measures)
    )


def s06(spark, folder):
    daily = events.daily_region_summary(events.clean_events(log_of(spark, folder)))
    out = fresh(spark, "shards")
    # Two shards by parity of the event count; together they are the whole table.
    S.write_results({"even": daily.where(F.col("n_events") % 2 == 0), "odd": daily.where(F.col("n_events") % 2 == 1)}, out)
    return S.read_shards(spark, out, daily.schema)


def s08(spark, folder):
    """Publish the summary twice and read what a new session finds."""
    place = fresh(spark, "ltv")
    summary = commerce.customer_revenue(Star(spark, folder))
    S.publish(summary.limit(0), place)
    S.publish(summary, place)
    return S.published(spark, place)


def s09(spark, folder):
    """Write the vintage table as revision payloads (one per series and observation) and read them back."""
    source = vintage_source(Tables(spark, folder))
    key = ["series_id", "observation_date"]
    following = F.lead("vintage_date").over(Window.partitionBy(*key).orderBy("vintage_date"))
    history = source.withColumn("realtime_end", F.date_sub(following, 1))
    observation = F.struct(
        F.col("observation_date").cast("string").alias("date"),
        F.col("vintage_date").cast("string").alias("realtime_start"),
        F.col("realtime_end").cast("string").alias("realtime_end"),
        F.format_string("%.8f", "value").alias("value"),
    )
    # A payload holds one observation's revisions: at most one per calendar month.
    payload = history.groupBy(*key).agg(F.collect_list(observation).alias("observations"), F.count("*").alias("count"))
    out = fresh(spark, "revisions")
    payload.select("series_id", "count", "observations").write.json(out)
    return S.read_revision_json(spark, out).withColumn("value", F.round("value", 8))


BOOK.add("s01", s01, RAW_TEXT_ID)
BOOK.add("s02", s02, RAW_TEXT_ID)

def s03(spark, folder):
    t = Tables(spark, folder)
    counts = [getattr(t, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name in ALL_TABLES]
    return reduce(DataFrame.unionByName, counts)


ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)
BOOK.add("s03", s03, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ALL_TABLES))
ACCOUNT_ROWS = "SELECT account_id, count(*) AS n_events, round(sum(signed_amount), 2) AS net_amount FROM clean_events GROUP BY 1"
ACCOUNTS = with_(EVENTS) + ACCOUNT_ROWS
DAILY_ROWS = """
SELECT CAST(date AS VARCHAR) AS date, region, count(*) AS n_events, count(DISTINCT account_id) AS n_accounts,
       round(sum(amount), 2) AS gross_amount, round(sum(signed_amount), 2) AS net_amount
FROM clean_events GROUP BY ALL ORDER BY 1, 2"""
DAILY = with_(EVENTS) + DAILY_ROWS
BOOK.add("s04", s04, with_(EVENT_LOG) + ACCOUNT_ROWS)
BOOK.add("s05", s05, with_(EVENT_LOG) + """
SELECT 'account' AS part, account_id AS key, count(*) AS n_events, round(sum(signed_amount), 2) AS net_amount FROM clean_events GROUP BY 2
UNION ALL SELECT 'daily', CAST(date AS VARCHAR) || '/' || region, count(*), round(sum(signed_amount), 2) FROM clean_events GROUP BY 2""")
BOOK.add("s06", s06, with_(EVENT_LOG) + DAILY_ROWS)
BOOK.add("s07", lambda s, d: S.fingerprint(Tables(s, d).lineitem, sorted(Tables(s, d).lineitem.columns)), """
WITH text AS (SELECT [CAST(CAST(l_discount AS DECIMAL(38, 10)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(38, 10)) AS VARCHAR), CAST(l_linenumber AS VARCHAR),
        l_linestatus, CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(38, 10)) AS VARCHAR), l_returnflag,
        CAST(epoch_us(l_shipdate) AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_tax AS DECIMAL(38, 10)) AS VARCHAR)] AS f FROM lineitem),
hashed AS (SELECT md5(array_to_string(list_transform(f, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '')) AS h FROM text)
SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS high_sum,
       CAST(sum(CAST(CAST('0x' || substr(h, 17) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS low_sum FROM hashed""")
LTV = with_(STAR) + """
SELECT customer_id, round(sum(net_revenue), 2) AS revenue, count(*) AS orders, CAST(sum(returned) AS BIGINT) AS returned
FROM fin GROUP BY 1"""
BOOK.add("s08", s08, LTV)
BOOK.add("c58", s08, LTV)
BOOK.add("s09", s09, with_(VINTAGES) + """
SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(vintage_date AS VARCHAR) AS realtime_start,
       coalesce(CAST(CAST(lead(vintage_date) OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date) - 1 AS DATE) AS VARCHAR), '9999-12-31') AS realtime_end,
       round(value, 8) AS value FROM vintage_panel""")

# -- scalar cleaning -----------------------------------------------------------------------

DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def _firm_id_sql(column: str) -> str:
    digits = DIGITS.format(column)
    return f"CASE WHEN {digits} = '' THEN NULL ELSE printf('F%04d', CAST({digits} AS BIGINT)) END"


BOOK.add(
    "p01",
    lambda s, d: FirmFiles(s, d).employment.select("firm_key", C.norm_firm_id(F.col("firm_key")).alias("firm_id")),
    with_(FIRMS) + f"SELECT firm_key, {_firm_id_sql('firm_key')} AS firm_id FROM employment",
)
BOOK.add(
    "p02",
    lambda s, d: FirmFiles(s, d).financials.select("period", C.norm_quarter(F.col("period")).alias("quarter")),
    with_(FIRMS) + """SELECT period, CASE WHEN contains(period, 'Q') THEN replace(period, '-Q', 'Q')
      ELSE year(CAST(period AS DATE)) || 'Q' || quarter(CAST(period AS DATE)) END AS quarter FROM financials""",
)
BOOK.add(
    "p03",
    lambda s, d: FirmFiles(s, d).financials.select("revenue", C.parse_money(F.col("revenue")).alias("revenue_usd")),
    with_(FIRMS) + "SELECT revenue, CAST(replace(replace(revenue, '$', ''), ',', '') AS DOUBLE) AS revenue_usd FROM financials",
)
BOOK.add(
    "p04",
    lambda s, d: firms(s, d).master.join(firms(s, d).regions, "region_code").select("firm_id", "region"),
    with_(FIRMS) + "SELECT firm_id, region FROM master JOIN region_clean USING (region_code)",
)
BOOK.add(
    "p05",
    lambda s, d: FirmFiles(s, d).ai_adoption.select("adoption_date", C.parse_date(F.col("adoption_date")).alias("parsed")),
    with_(FIRMS) + "SELECT adoption_date, CAST(TRY_CAST(adoption_date AS DATE) AS VARCHAR) AS parsed FROM adoption",
)


def p06(spark, folder):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    spelled = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "dd/MM/yyyy"))
    spelled = F.when(k % 211 == 0, F.lit("n/a")).otherwise(spelled.otherwise(F.date_format(day, "MM-dd-yyyy")))
    rows = Tables(spark, folder).orders.select("o_orderkey", spelled.alias("spelled"))
    return rows.withColumn("published", C.parse_date_multi(F.col("spelled")))


BOOK.add("p06", p06, """
SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%m-%d-%Y') END AS spelled,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS published FROM orders""")
BOOK.add(
    "p07",
    lambda s, d: log_of(s, d).where(C.valid_account(F.col("account_id"))).select("event_id", "ingest_seq", "account_id"),
    with_(EVENT_LOG) + "SELECT event_id, ingest_seq, account_id FROM raw_events WHERE regexp_full_match(account_id, 'A[0-9]{8}')",
)
BOOK.add(
    "p08",
    lambda s, d: log_of(s, d).select(
        "event_id", "ingest_seq", C.signed_amount(F.col("amount"), F.col("is_reversal")).alias("signed_amount")
    ),
    with_(EVENT_LOG) + "SELECT event_id, ingest_seq, CASE WHEN is_reversal = 1 THEN -amount ELSE amount END AS signed_amount FROM raw_events",
)
BOOK.add(
    "p09",
    lambda s, d: Star(s, d).orders.select(
        "order_id", C.bucket(F.col("discount_pct"), [(0.0, "0%"), (0.10, "1-10%"), (0.20, "11-20%")], "21%+").alias("bucket")
    ),
    with_(STAR) + """SELECT order_id, CASE WHEN discount_pct = 0 THEN '0%' WHEN discount_pct <= 0.10::DOUBLE THEN '1-10%'
      WHEN discount_pct <= 0.20::DOUBLE THEN '11-20%' ELSE '21%+' END AS bucket FROM fact_order""",
)
BOOK.add(
    "p10",
    lambda s, d: Star(s, d).orders.select("order_id", C.month_key(F.col("order_date")).alias("month")),
    with_(STAR) + "SELECT order_id, strftime(order_date, '%Y-%m') AS month FROM fact_order",
)
BOOK.add(
    "p11",
    lambda s, d: Star(s, d).returns.join(Star(s, d).orders.select("order_id", "order_date"), "order_id").select(
        "order_id", C.days_between(F.col("return_date"), F.col("order_date")).alias("days")
    ),
    with_(STAR) + "SELECT r.order_id, CAST(r.return_date - o.order_date AS INT) AS days FROM fact_return r JOIN fact_order o USING (order_id)",
)
BOOK.add(
    "p12",
    lambda s, d: Star(s, d).financials.select("order_id", F.round("refund_amount", 2).alias("refund_amount"), "returned", "units"),
    with_(STAR) + "SELECT order_id, round(refund_amount, 2) AS refund_amount, returned, units FROM fin",
)
BOOK.add(
    "p13",
    lambda s, d: Tables(s, d).events.select("event_id", C.json_field(F.col("props"), "$.k").alias("k")),
    "SELECT event_id, props ->> '$.k' AS k FROM events",
)
FIRM_YEAR = """
firm_year AS (
  SELECT k AS firm_id, y AS year, CAST(last - min(first) OVER (PARTITION BY k) AS INT) AS age, floor(total * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS sales,
         CASE WHEN c_mktsegment = 'BUILDING' AND y >= 1998 THEN 1 ELSE 0 END AS treated_post, total / n / 100000 AS mediator, CAST(n AS DOUBLE) AS outcome
  FROM (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, sum(o_totalprice) AS total,
               max(year(o_orderdate) * 12 + month(o_orderdate)) AS last, min(year(o_orderdate) * 12 + month(o_orderdate)) AS first FROM orders GROUP BY ALL)
  LEFT JOIN customer ON c_custkey = k),
covariate AS (
  SELECT firm_id, year, CAST(c_nationkey AS INT) AS industry,
         floor(c_acctbal / 1000 * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE * (year - 1990) AS baseline_score
  FROM firm_year JOIN customer ON c_custkey = firm_id),
covariate_file AS (SELECT * FROM covariate)"""
BOOK.add(
    "p14",
    lambda s, d: firm_year(Tables(s, d))[0].select("firm_id", "year", F.round(F.log1p("sales"), 6).alias("log_sales")),
    with_(FIRM_YEAR) + "SELECT firm_id, year, round(ln(1 + sales), 6) AS log_sales FROM firm_year",
)


def p15(spark, folder):
    kept, dropped = joins.restrict(firm_year(Tables(spark, folder))[0], F.col("age") >= 18, "age below 18")
    return kept.agg(F.count("*").alias("rows")).select(F.lit("kept").alias("reason"), "rows").unionByName(dropped)


BOOK.add("p15", p15, with_(FIRM_YEAR) + "SELECT CASE WHEN age >= 18 THEN 'kept' ELSE 'age below 18' END AS reason, count(*) AS rows FROM firm_year GROUP BY 1")
BOOK.add(
    "p16",
    lambda s, d: Star(s, d).orders.select(
        "order_id",
        C.month_start(F.col("order_date")).alias("start"),
        C.month_end(F.col("order_date")).alias("end"),
        F.add_months("order_date", 3).alias("plus3"),
    ),
    with_(STAR) + """SELECT order_id, CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS start,
      CAST(last_day(order_date) AS VARCHAR) AS end, CAST(CAST(order_date + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS plus3 FROM fact_order""",
)

# -- record selection ---------------------------------------------------------------------------

BOOK.add(
    "d01",
    lambda s, d: latest.latest_by(events_of(s, d), ["event_id"], "ingest_seq"),
    with_(EVENTS) + f"SELECT {EVENT_COLUMNS} FROM ranked_events WHERE rn = 1",
)
BOOK.add(
    "d02",
    lambda s, d: firms(s, d).employment.select("firm_id", "quarter", "employees"),
    with_(FIRMS) + "SELECT firm_id, quarter, employees FROM emp",
)
BOOK.add("d03", lambda s, d: firms(s, d).master, with_(FIRMS) + "SELECT firm_id, legal_name, region_code FROM master")
BOOK.add(
    "d05",
    lambda s, d: Star(s, d).orders.dropDuplicates().select("order_id", "customer_id", "order_date", "status"),
    with_(STAR) + "SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, status FROM (SELECT DISTINCT * FROM fact_order)",
)
BOOK.add(
    "d06",
    lambda s, d: latest.latest_by(Star(s, d).orders.select("order_id", "customer_id", "order_date"), ["customer_id"], "order_date", "order_id"),
    with_(STAR) + """SELECT DISTINCT ON (customer_id) order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date FROM fact_order
      ORDER BY customer_id, fact_order.order_date DESC, order_id DESC""",
)
BOOK.add(
    "d08",
    lambda s, d: latest.dedup_report(events_of(s, d), ["event_id"]),
    with_(EVENTS) + "SELECT count(*) AS input_rows, count(DISTINCT event_id) AS unique_keys, count(*) - count(DISTINCT event_id) AS duplicates_removed FROM raw_events",
)

# -- joins -----------------------------------------------------------------------------------------

BOOK.add(
    "j01",
    lambda s, d: Star(s, d).items.join(Star(s, d).products, "product_id").select("order_id", "product_id", "category", "quantity"),
    with_(STAR) + "SELECT order_id, product_id, category, quantity FROM fact_order_item JOIN dim_product USING (product_id)",
)
BOOK.add(
    "j02",
    lambda s, d: Star(s, d).orders.join(Star(s, d).returns, "order_id", "left").select("order_id", "status", "return_reason"),
    with_(STAR) + "SELECT o.order_id, o.status, r.return_reason FROM fact_order o LEFT JOIN fact_return r USING (order_id)",
)


def j03(spark, folder):
    money = ["gross_revenue", "cogs", "refund_amount", "net_revenue", "gross_margin"]
    fin = Star(spark, folder).financials
    return fin.select("order_id", "customer_id", "status", "units", "returned", *[F.round(c, 2).alias(c) for c in money])


BOOK.add("j03", j03, with_(STAR) + """
SELECT order_id, customer_id, status, units, returned, round(gross_revenue, 2) AS gross_revenue, round(cogs, 2) AS cogs,
       round(refund_amount, 2) AS refund_amount, round(net_revenue, 2) AS net_revenue, round(gross_margin, 2) AS gross_margin FROM fin""")
BOOK.add(
    "j04",
    lambda s, d: top_pairs(Star(s, d).items, "order_id", "product_id", 100),
    with_(STAR) + """SELECT a.product_id AS p1, b.product_id AS p2, count(DISTINCT a.order_id) AS pair_orders
      FROM fact_order_item a JOIN fact_order_item b ON a.order_id = b.order_id AND a.product_id < b.product_id
      GROUP BY 1, 2 ORDER BY pair_orders DESC, p1, p2 LIMIT 100""",
)
BOOK.add(
    "j05",
    lambda s, d: joins.orphans(Star(s, d).items, Star(s, d).completed, "order_id").select("order_id", "product_id", "quantity"),
    with_(STAR) + "SELECT order_id, product_id, quantity FROM fact_order_item WHERE order_id NOT IN (SELECT order_id FROM fact_order WHERE status = 'completed')",
)
BOOK.add(
    "c36",
    lambda s, d: joins.orphans(Star(s, d).items, Star(s, d).orders, "order_id").agg(F.count("*").alias("orphan_items")),
    with_(STAR) + "SELECT count(*) AS orphan_items FROM fact_order_item i LEFT JOIN fact_order o USING (order_id) WHERE o.order_id IS NULL",
)
BOOK.add(
    "c37",
    lambda s, d: joins.orphans(Star(s, d).returns, Star(s, d).orders, "order_id").agg(F.count("*").alias("orphan_returns")),
    with_(STAR) + "SELECT count(*) AS orphan_returns FROM fact_return r LEFT JOIN fact_order o USING (order_id) WHERE o.order_id IS NULL",
)
for _name, _table, _view, _key in (
    ("c35", "orders", "fact_order", "order_id"),
    ("c39", "customers", "dim_customer", "customer_id"),
    ("c40", "products", "dim_product", "product_id"),
):
    BOOK.add(
        _name,
        lambda s, d, t=_table, k=_key: joins.duplicate_keys(getattr(Star(s, d), t), [k]).agg(
            F.count("*").alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows")
        ),
        with_(STAR) + f"SELECT count(*) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM {_view} GROUP BY {_key} HAVING n > 1)",
    )
BOOK.add(
    "c38",
    lambda s, d: Star(s, d).items.agg(
        F.sum(F.when((F.col("unit_price") < 0) | (F.col("quantity") <= 0), 1).otherwise(0)).alias("invalid_lines")
    ),
    with_(STAR) + "SELECT CAST(sum(CASE WHEN unit_price < 0 OR quantity <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_lines FROM fact_order_item",
)
BOOK.add(
    "j06",
    lambda s, d: firms(s, d).spine.select("firm_id", "quarter", "quarter_end"),
    with_(FIRMS) + "SELECT firm_id, quarter, CAST(last_day AS VARCHAR) AS quarter_end FROM master, quarters",
)
BOOK.add("j07", lambda s, d: firms(s, d).panel, with_(FIRMS) + "SELECT * FROM panel")
BOOK.add(
    "j08",
    lambda s, d: joins.lateral_top_n(
        Star(s, d).customers.select("customer_id", "country"),
        Star(s, d).orders.select("customer_id", "order_id", "order_date"),
        "customer_id",
        [F.col("order_date").desc(), F.col("order_id").desc()],
        3,
    ),
    with_(STAR) + """SELECT c.customer_id, c.country, x.order_id, CAST(x.order_date AS VARCHAR) AS order_date FROM dim_customer c
      CROSS JOIN LATERAL (SELECT order_id, order_date FROM fact_order o WHERE o.customer_id = c.customer_id
                          ORDER BY order_date DESC, order_id DESC LIMIT 3) x""",
)


def j09(spark, folder):
    star = Star(spark, folder)
    total = star.items.agg(F.sum("quantity")).scalar()
    units = commerce.product_sales(star).groupBy("category").agg(F.sum("units").alias("units"))
    return units.withColumn("unit_share", F.round(F.col("units").cast("double") / total, 6))


BOOK.add("j09", j09, with_(STAR) + """
SELECT category, CAST(sum(quantity) AS BIGINT) AS units,
       round(CAST(sum(quantity) AS DOUBLE) / (SELECT sum(quantity) FROM fact_order_item), 6) AS unit_share
FROM fact_order_item JOIN dim_product USING (product_id) GROUP BY 1""")


def _merged(spark, folder):
    outcomes, covariates = firm_year(Tables(spark, folder))
    keep = [F.abs("baseline_score"), F.col("baseline_score")]
    return outcomes, covariates, *joins.join_one_to_one(outcomes, covariates, ["firm_id", "year"], on_dup="report", keep=keep)


BOOK.add(
    "j10",
    lambda s, d: _merged(s, d)[2].select("firm_id", "year", "outcome", "industry", F.round("baseline_score", 6).alias("baseline_score")),
    with_(FIRM_YEAR) + """SELECT f.firm_id, f.year, f.outcome, c.industry, round(c.baseline_score, 6) AS baseline_score FROM firm_year f LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm_id, year ORDER BY abs(baseline_score), baseline_score) AS rn FROM covariate_file) WHERE rn = 1) c
      ON c.firm_id = f.firm_id AND c.year = f.year""",
)
BOOK.add(
    "j11",
    lambda s, d: joins.merge_covariates(
        *firm_year(Tables(s, d)), ["firm_id", "year"], "baseline_score"
    ).select("firm_id", "year", "outcome", "missing_covariate"),
    with_(FIRM_YEAR) + """SELECT f.firm_id, f.year, f.outcome, CASE WHEN c.firm_id IS NULL THEN 1 ELSE 0 END AS missing_covariate
      FROM firm_year f LEFT JOIN covariate c ON c.firm_id = f.firm_id AND c.year = f.year""",
)
BOOK.add(
    "j16",
    lambda s, d: joins.semi_filter(firms(s, d).adoption_keyed, firms(s, d).master, "firm_id"),
    with_(FIRMS) + "SELECT firm_id, CAST(adoption_date AS VARCHAR) AS adoption_date, status FROM adoption_keyed WHERE firm_id IN (SELECT firm_id FROM master)",
)

# -- aggregates ---------------------------------------------------------------------------------------

BOOK.add("a01", lambda s, d: events.daily_region_summary(events.clean_events(events_of(s, d))), DAILY)
BOOK.add("a02", lambda s, d: events.account_summary(events.clean_events(events_of(s, d))), ACCOUNTS)
BOOK.add("a03", lambda s, d: events.event_quality(events_of(s, d)), with_(EVENTS) + """
SELECT count(*) AS input_rows, count(DISTINCT event_id) AS unique_event_ids,
       count(*) - count(DISTINCT event_id) AS duplicates_removed,
       count(DISTINCT event_id) - (SELECT count(*) FROM clean_events) AS invalid_excluded,
       (SELECT count(*) FROM clean_events) AS clean_rows FROM raw_events""")
BOOK.add(
    "a04",
    lambda s, d: Star(s, d).orders.groupBy("device").agg(F.round(commerce.share(F.col("status") == "completed"), 6).alias("completed_share")),
    with_(STAR) + "SELECT device, round(avg(CASE WHEN status = 'completed' THEN 1.0::DOUBLE ELSE 0 END), 6) AS completed_share FROM fact_order GROUP BY 1",
)
BOOK.add(
    "a05",
    lambda s, d: Star(s, d).financials.groupBy("device").agg(
        F.count_if(F.col("returned") == 1).alias("returned_orders"), F.count_if(F.col("returned") == 0).alias("kept_orders")
    ),
    with_(STAR) + "SELECT device, count(*) FILTER (WHERE returned = 1) AS returned_orders, count(*) FILTER (WHERE returned = 0) AS kept_orders FROM fin GROUP BY 1",
)
BOOK.add(
    "a06",
    lambda s, d: Star(s, d).orders.groupBy("device").agg(F.countDistinct("customer_id").alias("customers")),
    with_(STAR) + "SELECT device, count(DISTINCT customer_id) AS customers FROM fact_order GROUP BY 1",
)
BOOK.add(
    "a07",
    lambda s, d: Star(s, d).orders.groupBy("customer_id").agg(F.count("*").alias("n")).where(F.col("n") >= 12),
    with_(STAR) + "SELECT customer_id, count(*) AS n FROM fact_order GROUP BY 1 HAVING n >= 12",
)
BOOK.add(
    "a08",
    lambda s, d: ordered.exact_percentiles(
        Star(s, d).financials.select("device", F.round("net_revenue", 2).alias("net_revenue")), ["device"], "net_revenue", {"p25": 0.25, "p50": 0.5, "p90": 0.9}
    ).select("device", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p90")]),
    with_(STAR) + "SELECT device, " + ", ".join(
        f"round(percentile_cont({q}) WITHIN GROUP (ORDER BY round(net_revenue, 2)), 4) AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p90", 0.9))
    ) + " FROM fin GROUP BY 1",
)
BOOK.add(
    "a09",
    lambda s, d: firm_panel.summary_stats(firms(s, d).panel, ["employees", "revenue_usd", "ai_adopted"]),
    with_(FIRMS) + " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 4) AS sd,
        CAST(min({v}) AS DOUBLE) AS min, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST({v} AS DOUBLE)), 6) AS p50, CAST(max({v}) AS DOUBLE) AS max FROM panel"""
        for v in ("employees", "revenue_usd", "ai_adopted")
    ),
)
BOOK.add(
    "a10",
    lambda s, d: commerce.discount_penetration(Star(s, d)),
    with_(STAR) + "SELECT discount_pct, count(*) AS orders, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM fact_order GROUP BY 1",
)
BOOK.add(
    "a11",
    lambda s, d: firms(s, d).first_adoption,
    with_(FIRMS) + "SELECT firm_id, CAST(adoption_date AS VARCHAR) AS adoption_date FROM first_adoption",
)

# -- windows ------------------------------------------------------------------------------------------------

def by_date():
    return [F.col("order_date"), F.col("order_id")]


BOOK.add(
    "w01",
    lambda s, d: ordered.row_number_by_key(Star(s, d).orders.select("customer_id", "order_id", "order_date"), "customer_id", by_date(), "rn"),
    with_(STAR) + "SELECT customer_id, order_id, CAST(order_date AS VARCHAR) AS order_date, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS rn FROM fact_order",
)
BOOK.add(
    "w02",
    lambda s, d: commerce.product_sales(Star(s, d))
    .groupBy("category", "subcategory")
    .agg(F.sum("units").alias("units"))
    .withColumn("rank", F.dense_rank().over(Window.partitionBy("category").orderBy(F.col("units").desc()))),
    with_(STAR) + """SELECT category, subcategory, units, CAST(dense_rank() OVER (PARTITION BY category ORDER BY units DESC) AS INT) AS rank FROM (
      SELECT category, subcategory, CAST(sum(quantity) AS BIGINT) AS units FROM fact_order_item JOIN dim_product USING (product_id) GROUP BY 1, 2)""",
)
BOOK.add(
    "w04",
    lambda s, d: ordered.global_ntile(Tables(s, d).orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 7, "tile"),
    "SELECT o_orderkey, o_totalprice, CAST(ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) AS INT) AS tile FROM orders",
)
BOOK.add(
    "w05",
    lambda s, d: ordered.lag_by_key(Star(s, d).orders.select("customer_id", "order_id", "order_date"), "customer_id", by_date(), "order_date", "previous"),
    with_(STAR) + """SELECT customer_id, order_id, CAST(order_date AS VARCHAR) AS order_date,
      CAST(lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS VARCHAR) AS previous FROM fact_order""",
)
BOOK.add("w06", lambda s, d: commerce.trailing_revenue(Star(s, d)).select("month", "rolling_3m"), with_(STAR) + """
SELECT month, round(avg(revenue) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_3m FROM (
  SELECT strftime(order_date, '%Y-%m') AS month, round(sum(net_revenue), 2) AS revenue FROM fin GROUP BY 1)""")


def w07(spark, folder):
    totals = commerce.customer_revenue(Star(spark, folder)).select("customer_id", "revenue")
    steps = ordered.cumulated(totals, "revenue", [F.col("revenue").desc(), F.col("customer_id")])
    return steps.select("customer_id", "revenue", F.round("running", 2).alias("running"), F.round("total", 2).alias("total"))


BOOK.add("w07", w07, with_(STAR) + """
SELECT customer_id, revenue, round(sum(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING), 2) AS running,
       round(sum(revenue) OVER (), 2) AS total FROM (SELECT customer_id, round(sum(net_revenue), 2) AS revenue FROM fin GROUP BY 1)""")
SESSIONS = """
SELECT event_id, user_id, new_session, CAST(sum(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_id FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800 * 1000000 THEN 0 ELSE 1 END AS new_session FROM events)"""


def w08(spark, folder):
    rows = Tables(spark, folder).events.select("event_id", "user_id", "ts")
    return sessions.sessionize(rows, "user_id", "ts", "event_id", 1800).drop("ts")


BOOK.add("w08", w08, SESSIONS)
BOOK.add("c50", w08, SESSIONS)
BOOK.add(
    "w09",
    lambda s, d: firms(s, d).panel.select("firm_id", "quarter", "ai_adopted"),
    with_(FIRMS) + "SELECT firm_id, quarter, ai_adopted FROM panel",
)
BOOK.add(
    "w10",
    lambda s, d: ordered.global_row_number(
        Tables(s, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"),
        [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")],
    ).select("l_orderkey", "l_linenumber", "l_extendedprice", "row_number", "n_rows"),
    """SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) AS row_number,
       count(*) OVER () AS n_rows FROM lineitem""",
)


def w16(spark, folder):
    # (firm, year) is unique, so one key's window holds at most one row per calendar year.
    lag = F.lag("outcome").over(Window.partitionBy("firm_id").orderBy("year"))
    return firm_year(Tables(spark, folder))[0].select("firm_id", "year", "outcome", lag.alias("lag_outcome"))


BOOK.add("w16", w16, with_(FIRM_YEAR) + "SELECT firm_id, year, outcome, lag(outcome) OVER (PARTITION BY firm_id ORDER BY year) AS lag_outcome FROM firm_year")
PANEL_ES = """
day_totals AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY ALL),
span AS (SELECT min(day) AS a, max(day) AS b FROM day_totals),
es_panel AS (
  SELECT u.user_id AS unit_id, CAST(p AS INT) AS period,
         CASE WHEN u.user_id % 4 <> 0 THEN CAST(10 + u.user_id % 8 AS DOUBLE) END AS treat_period,
         coalesce(t.total, 0) AS y, u.user_id % 4 <> 0 AS treated
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest(generate_series(1, CAST((SELECT b - a FROM span) AS BIGINT) + 1)) AS p) q
  LEFT JOIN day_totals t ON t.user_id = u.user_id AND t.day = (SELECT a FROM span) + CAST(p - 1 AS INT))"""
BOOK.add(
    "w17",
    lambda s, d: event_study_panel(Tables(s, d)).select("unit_id", "period", (F.col("period") - F.col("treat_period")).alias("event_time")),
    with_(PANEL_ES) + "SELECT unit_id, period, period - treat_period AS event_time FROM es_panel",
)

# -- sort, limit, union, calendars --------------------------------------------------------------------------

BOOK.add(
    "t01",
    lambda s, d: commerce.monthly_return_rate(Star(s, d)).orderBy(F.col("return_rate").desc(), "month"),
    with_(STAR) + """SELECT strftime(o.order_date, '%Y-%m') AS month, round(avg(CASE WHEN r.order_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS return_rate
      FROM fact_order o LEFT JOIN fact_return r USING (order_id) GROUP BY 1 ORDER BY return_rate DESC, month""",
)
BOOK.add(
    "t02",
    lambda s, d: Tables(s, d).orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
BOOK.add(
    "t03",
    lambda s, d: latest.top_n_per_group(
        Tables(s, d).orders.select("o_orderpriority", "o_orderkey", "o_totalprice"),
        ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5,
    ),
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
       ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""",
)
BOOK.add(
    "u01",
    lambda s, d: Star(s, d).orders.select("order_id", F.lit("order").alias("source")).unionByName(
        Star(s, d).returns.select("order_id", F.lit("return").alias("source"))
    ),
    with_(STAR) + "SELECT order_id, 'order' AS source FROM fact_order UNION ALL SELECT order_id, 'return' FROM fact_return",
)


def order_bounds(spark, folder):
    days = Star(spark, folder).orders.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    return days.select("a").scalar(), days.select("b").scalar()


RECURSIVE_DAYS = """WITH RECURSIVE dates AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS d, CAST(max(o_orderdate) AS DATE) AS last FROM orders
  UNION ALL SELECT CAST(d + 1 AS DATE), last FROM dates WHERE d < last) SELECT CAST(d AS VARCHAR) AS d FROM dates"""
SERIES_DAYS = """SELECT CAST(CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS d FROM orders"""
for _name, _sql in (("u02", RECURSIVE_DAYS), ("c49", RECURSIVE_DAYS), ("u03", SERIES_DAYS), ("c54", SERIES_DAYS)):
    BOOK.add(_name, lambda s, d: calendar.date_spine(s, *order_bounds(s, d)), _sql)


def u04(spark, folder):
    t = Tables(spark, folder)
    month = C.month_start(F.col("o_orderdate").cast("date"))
    sparse = t.orders.groupBy("o_orderpriority", month.alias("month")).agg(F.count("*").alias("n"))
    return calendar.month_spine(sparse, ["o_orderpriority"], "month").select("o_orderpriority", "month", "n")


BOOK.add("u04", u04, """
WITH sparse AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY ALL),
spine AS (SELECT o_orderpriority, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM sparse GROUP BY 1)
SELECT o_orderpriority, CAST(month AS VARCHAR) AS month, n FROM spine LEFT JOIN sparse USING (o_orderpriority, month)""")
BOOK.add(
    "u05",
    lambda s, d: calendar.month_end_vintages(s, *order_bounds(s, d)),
    """SELECT CAST(e AS VARCHAR) AS vintage_date FROM (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE)) AS e,
       CAST(max(o_orderdate) AS DATE) AS b FROM orders) WHERE e <= b""",
)

# -- contracts ------------------------------------------------------------------------------------------------

VERDICT = "SELECT '{0}' AS check, n = 0 AS passed, CAST(n AS BIGINT) AS n_violations FROM ({1})"


def verdicts(*parts: tuple[str, str]) -> str:
    return " UNION ALL ".join(VERDICT.format(name, f"SELECT {n}") if "SELECT" not in n else VERDICT.format(name, n) for name, n in parts)


BOOK.add(
    "q01",
    lambda s, d: contracts.report(
        contracts.check_unique(Star(s, d).orders, ["order_id"], "orders"),
        contracts.check_unique(firms(s, d).panel, ["firm_id", "quarter"], "panel"),
        contracts.check_unique(Tables(s, d).lineitem, ["l_orderkey", "l_linenumber"], "lineitem"),
    ),
    "WITH " + STAR.strip() + "," + FIRMS.strip() + "\n" + verdicts(
        ("orders", "SELECT count(*) - count(DISTINCT order_id) AS n FROM fact_order"),
        ("panel", "SELECT count(*) - count(DISTINCT (firm_id, quarter)) AS n FROM panel"),
        ("lineitem", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem"),
    ),
)
EXCLUSIONS = with_(FIRMS) + """
SELECT reason, count(*) AS rows FROM (
  SELECT CASE WHEN firm_id IS NULL THEN 'employment: no firm id' WHEN quarter IS NULL THEN 'employment: no quarter' END AS reason FROM emp_keyed
  UNION ALL SELECT CASE WHEN firm_id IS NULL THEN 'financials: no firm id' WHEN quarter IS NULL THEN 'financials: no quarter' END FROM fin_keyed
  UNION ALL SELECT CASE WHEN firm_id IS NULL THEN 'adoption: no firm id' WHEN status <> 'verified' THEN 'adoption: not verified'
    WHEN adoption_date IS NULL THEN 'adoption: bad date' WHEN firm_id NOT IN (SELECT firm_id FROM master) THEN 'adoption: unknown firm' END FROM adoption_keyed
  UNION ALL SELECT 'employment: superseded' FROM (SELECT row_number() OVER (PARTITION BY firm_id, quarter) AS rn FROM emp_keyed WHERE firm_id IS NOT NULL AND quarter IS NOT NULL) WHERE rn > 1
  UNION ALL SELECT 'financials: superseded' FROM (SELECT row_number() OVER (PARTITION BY firm_id, quarter) AS rn FROM fin_keyed WHERE firm_id IS NOT NULL AND quarter IS NOT NULL) WHERE rn > 1
  UNION ALL SELECT 'master: duplicate firm' FROM (SELECT row_number() OVER (PARTITION BY firm_id) AS rn FROM firm_master) WHERE rn > 1)
WHERE reason IS NOT NULL GROUP BY 1"""
BOOK.add("q02", lambda s, d: firms(s, d).exclusions, EXCLUSIONS)
BOOK.add("q03", lambda s, d: firms(s, d).quality, with_(FIRMS) + """
SELECT count(*) AS final_rows, count(*) - count(DISTINCT (firm_id, quarter)) AS duplicate_keys,
       count(DISTINCT firm_id) AS unique_firms, count(DISTINCT quarter) AS unique_quarters,
       (SELECT count(*) FROM (SELECT DISTINCT firm_id FROM emp_keyed) k WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.firm_id = k.firm_id)) AS unmatched_employment_keys,
       (SELECT count(*) FROM (SELECT DISTINCT firm_id FROM fin_keyed) k WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.firm_id = k.firm_id)) AS unmatched_financial_keys,
       (SELECT count(*) FROM (SELECT DISTINCT firm_id FROM adoption_keyed) k WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.firm_id = k.firm_id)) AS unmatched_adoption_keys
FROM panel""")


def q05(spark, folder):
    f = firms(spark, folder)
    firm_count = Tables(spark, folder).customer.agg(F.count("*")).scalar()
    spine_count = f.spine.agg(F.count("*")).scalar()
    return contracts.report(
        contracts.check_count(f.panel, spine_count, "panel rows"),
        contracts.check_distinct(f.panel, "firm_id", firm_count, "panel firms"),
        contracts.check_rows(f.panel, {"ai_adopted in 0, 1": contracts.check_domain("ai_adopted", [0, 1])}),
    )


BOOK.add("q05", q05, with_(FIRMS) + verdicts(
    ("panel rows", "SELECT abs(count(*) - (SELECT count(*) FROM master, quarters)) AS n FROM panel"),
    ("panel firms", "SELECT abs(count(DISTINCT firm_id) - (SELECT count(*) FROM customer)) AS n FROM panel"),
    ("ai_adopted in 0, 1", "SELECT count(*) FILTER (WHERE ai_adopted NOT IN (0, 1)) AS n FROM panel"),
))


def q06(spark, folder):
    raw = events_of(spark, folder)
    clean = events.clean_events(raw)
    daily, accounts = events.daily_region_summary(clean), events.account_summary(clean)
    star = Star(spark, folder)
    independent = star.completed.join(star.items, "order_id")
    return contracts.report(
        contracts.reconcile(daily, F.sum("n_events"), clean, F.count("*"), "daily events = clean rows"),
        contracts.reconcile(accounts, F.sum("n_events"), clean, F.count("*"), "account events = clean rows"),
        contracts.check_rows(daily, {"net above gross": F.col("net_amount") > F.col("gross_amount")}),
        contracts.reconcile(
            star.financials.where(F.col("status") == "completed"), F.sum(contracts.cents("gross_revenue")),
            independent, F.sum(F.col("quantity") * contracts.cents("unit_price")), "revenue = item total",
        ),
    )


BOOK.add("q06", q06, "WITH " + EVENTS.strip() + "," + STAR.strip() + """,
daily AS (SELECT date, region, count(*) AS n_events, sum(amount) AS gross, sum(signed_amount) AS net FROM clean_events GROUP BY ALL)
""" + verdicts(
    ("daily events = clean rows", "SELECT CASE WHEN (SELECT sum(n_events) FROM daily) = (SELECT count(*) FROM clean_events) THEN 0 ELSE 1 END AS n"),
    ("account events = clean rows", "SELECT CASE WHEN (SELECT sum(c) FROM (SELECT count(*) AS c FROM clean_events GROUP BY account_id)) = (SELECT count(*) FROM clean_events) THEN 0 ELSE 1 END AS n"),
    ("net above gross", "SELECT count(*) FILTER (WHERE round(net, 2) > round(gross, 2)) AS n FROM daily"),
    ("revenue = item total", """SELECT CASE WHEN (SELECT sum(CAST(gross_revenue AS DECIMAL(28, 2))) FROM fin WHERE status = 'completed') = (SELECT sum(quantity * CAST(unit_price AS DECIMAL(18, 2))) FROM fact_order JOIN fact_order_item USING (order_id) WHERE status = 'completed') THEN 0 ELSE 1 END AS n"""),
))


def q07(spark, folder):
    f = firms(spark, folder)
    status = F.when(F.col("quarter").endswith("Q3"), 0).otherwise(F.col("ai_adopted"))
    return contracts.report(
        contracts.check_monotone(f.panel, "firm_id", "quarter", "ai_adopted", "adoption"),
        contracts.check_monotone(f.panel.withColumn("ai_adopted", status), "firm_id", "quarter", "ai_adopted", "broken adoption"),
    )


BOOK.add("q07", q07, with_(FIRMS, "broken AS (SELECT firm_id, quarter, CASE WHEN quarter LIKE '%Q3' THEN 0 ELSE ai_adopted END AS s FROM panel)") + verdicts(
    ("adoption", "SELECT count(*) AS n FROM (SELECT ai_adopted < lag(ai_adopted) OVER (PARTITION BY firm_id ORDER BY quarter) AS fell FROM panel) WHERE fell"),
    ("broken adoption", "SELECT count(*) AS n FROM (SELECT s < lag(s) OVER (PARTITION BY firm_id ORDER BY quarter) AS fell FROM broken) WHERE fell"),
))
BOOK.add(
    "q08",
    lambda s, d: contracts.check_rows(
        events_of(s, d),
        {"account pattern": contracts.check_pattern("account_id", C.ACCOUNT_PATTERN), "region pattern": contracts.check_pattern("region", r"\A[a-z]+\z")},
    ),
    with_(EVENTS) + verdicts(
        ("account pattern", "SELECT count(*) FILTER (WHERE NOT regexp_full_match(account_id, 'A[0-9]{8}')) AS n FROM raw_events"),
        ("region pattern", "SELECT count(*) FILTER (WHERE NOT regexp_full_match(region, '[a-z]+')) AS n FROM raw_events"),
    ),
)


def q10(spark, folder):
    outcomes, covariates, merged, _ = _merged(spark, folder)
    fanned = outcomes.join(covariates, ["firm_id", "year"], "left")
    return contracts.report(
        contracts.check_join_fanout(outcomes, fanned, ["firm_id", "year"], "plain join"),
        contracts.check_join_fanout(outcomes, merged, ["firm_id", "year"], "one-to-one join"),
    )


BOOK.add("q10", q10, with_(FIRM_YEAR) + verdicts(
    ("plain join", "SELECT count(*) AS n FROM (SELECT firm_id, year FROM covariate_file GROUP BY ALL HAVING count(*) > 1)"),
    ("one-to-one join", "SELECT 0 AS n"),
))
