"""Job inputs derived from the supplied tables, mostly by renaming columns."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions.cleaning import (
    half_up,
    month_end,
    month_from_index,
    month_index,
    month_start,
    norm_firm_id,
    pick,
    quarter_label,
)
from panelwright.runtime import stage
from panelwright.sources.tables import Tables

# Fixed values of the commerce fixture.
DEVICES = ["web", "ios", "android"]
PAYMENTS = ["card", "wallet"]
DISCOUNTS = [0.0, 0.05, 0.10, 0.15, 0.25]
SHIPPING_FEE = 4.5
CHANNELS = ["organic", "paid_search", "affiliate", "social"]
SEGMENTS = ["consumer", "high_value", "business"]
RETURN_REASONS = ["damaged", "changed_mind", "wrong_item"]
EVENT_CATEGORIES = ["payroll", "procurement", "tax", "transfer"]


class Star:
    """Commerce star schema."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = Tables(spark, folder)

    @cached_property
    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        nation = self.tables.nation.select("n_nationkey", F.col("n_name").alias("country"))
        return self.tables.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            k.alias("customer_id"),
            F.make_date(F.lit(2024), (k % 12 + 1).cast("int"), F.lit(1)).alias("signup_date"),
            "country",
            pick(CHANNELS, k % 4).alias("acquisition_channel"),
            pick(SEGMENTS, k % 3).alias("customer_segment"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.tables.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("subcategory"),
            half_up(F.col("p_retailprice") * 0.6, 2).alias("unit_cost"),
            F.col("p_retailprice").alias("list_price"),
        )

    @staticmethod
    def _as_orders(orders: DataFrame) -> DataFrame:
        k = F.col("o_orderkey")
        return orders.select(
            k.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            pick(DEVICES, k % 3).alias("device"),
            pick(PAYMENTS, k % 2).alias("payment_method"),
            pick(DISCOUNTS, k % 5).alias("discount_pct"),
            F.lit(SHIPPING_FEE).alias("shipping_fee"),
            F.when(F.col("o_orderstatus") == "O", "cancelled").otherwise("completed").alias("status"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self._as_orders(self.tables.orders)

    @cached_property
    def completed(self) -> DataFrame:
        """Completed orders, filtered on the stored status so the filter reaches the Parquet scan."""
        stored = F.col("o_orderstatus")
        return self._as_orders(self.tables.orders.where(stored.isNull() | (stored != "O")))

    @cached_property
    def items(self) -> DataFrame:
        return self.tables.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        price = half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
        refunds = (
            self.tables.lineitem.where(F.col("l_returnflag") == "R")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.sum(F.col("l_quantity").cast("int") * price).alias("refund_amount"))
        )
        return refunds.join(self.completed.select("order_id", "order_date"), "order_id").select(
            "order_id",
            F.lit(1).alias("returned"),
            F.date_add("order_date", 3).alias("return_date"),
            pick(RETURN_REASONS, F.col("order_id") % 3).alias("return_reason"),
            "refund_amount",
        )

    @cached_property
    def financials(self) -> DataFrame:
        """One row per order with revenue, cost, refund and margin, from one scan of the lines; cancelled orders earn nothing."""
        price = half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
        quantity = F.col("l_quantity").cast("int")
        costs = self.products.select("product_id", "unit_cost", F.lit(True).alias("known"))
        lines = self.tables.lineitem.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), quantity.alias("quantity"),
            (quantity * price).alias("amount"), (F.col("l_returnflag") == "R").alias("back"),
        )
        known, back = F.col("known"), F.col("back")
        rollup = lines.join(costs, "product_id", "left").groupBy("order_id").agg(
            F.sum(F.when(known, F.col("amount"))).alias("gross"),
            F.sum(F.when(known, F.col("quantity") * F.col("unit_cost"))).alias("cost"),
            F.sum(F.when(known, F.col("quantity"))).alias("units"),
            F.sum(F.when(back, F.col("amount"))).alias("refund"),
            F.count(F.when(back, 1)).alias("lines_back"),
        )
        completed = F.col("status") == "completed"
        gross, cogs = F.coalesce("gross", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
        refund = F.coalesce(F.when(completed, F.col("refund")), F.lit(0.0))
        return self.orders.join(rollup, "order_id", "left").select(
            *self.orders.columns,
            gross.alias("gross_revenue"),
            cogs.alias("cogs"),
            F.coalesce("units", F.lit(0)).alias("units"),
            F.when(completed & (F.col("lines_back") > 0), 1).otherwise(0).alias("returned"),
            refund.alias("refund_amount"),
            F.when(completed, gross + F.col("shipping_fee") - refund).otherwise(0.0).alias("net_revenue"),
            F.when(completed, gross - cogs - refund).otherwise(0.0).alias("gross_margin"),
        )


def raw_events(t: Tables) -> DataFrame:
    """Events as an account log: users are accounts, errors take their amount back."""
    return t.events.select(
        "event_id",
        F.lit(1).alias("ingest_seq"),
        F.format_string("A%08d", F.col("user_id")).alias("account_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("region"),
        pick(EVENT_CATEGORIES, F.col("event_id") % 4).alias("category"),
        F.col("value").alias("amount"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_reversal"),
    )


def event_log(t: Tables) -> DataFrame:
    """The whole account log as it is ingested: some accounts malformed, some events reversed, some corrected.

    A correction repeats its event with the next sequence and nine tenths of the amount. Each event and its
    correction come from one row, so the table is read once.
    """
    k = F.col("event_id")
    ingests = F.when(k % 250 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    log = raw_events(t).withColumns(
        {
            "ingest_seq": F.explode(ingests),
            "account_id": F.when(k % 1203 == 0, F.lit("bad-account")).otherwise(F.col("account_id")),
            "is_reversal": F.when(k % 55 == 0, 1).otherwise(0),
        }
    )
    corrected = half_up(F.col("amount") * 0.9, 2)
    return log.withColumn("amount", F.when(F.col("ingest_seq") == 2, corrected).otherwise(F.col("amount")))


class FirmFiles:
    """Customers and their orders as firm files: columns renamed, keys, dates and money as text."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = Tables(spark, folder)

    @cached_property
    def firm_master(self) -> DataFrame:
        """Firms are known by the name that holds their number."""
        nation = self.tables.nation.select("n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region_code"))
        return self.tables.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            norm_firm_id(F.col("c_name")).alias("firm_id"), F.col("c_name").alias("legal_name"), "region_code"
        )

    @cached_property
    def regions(self) -> DataFrame:
        return self.tables.region.select(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("region_code"), F.col("r_name").alias("region_name")
        )

    @cached_property
    def _quarterly(self) -> DataFrame:
        """Orders by customer and quarter. Both files come from this table, so it is landed once."""
        day = F.col("o_orderdate").cast("date")
        return stage(
            self.tables.orders.groupBy(F.col("o_custkey").cast("string").alias("customer"), quarter_label(day).alias("label")).agg(
                F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max(day).cast("string").alias("last_day")
            )
        )

    @cached_property
    def employment(self) -> DataFrame:
        return self._quarterly.select(
            F.col("customer").alias("firm_key"),
            F.col("label").alias("quarter"),
            F.col("n").cast("string").alias("employees"),
            F.col("last_day").alias("correction_ts"),
        )

    @cached_property
    def financials(self) -> DataFrame:
        return self._quarterly.select(
            F.col("customer").alias("company_identifier"),
            F.col("last_day").alias("period"),
            F.round("total", 2).cast("decimal(20,2)").cast("string").alias("revenue"),
            F.col("last_day").alias("correction_ts"),
        )

    @cached_property
    def ai_adoption(self) -> DataFrame:
        return self.tables.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
            F.col("o_custkey").cast("string").alias("entity_id"),
            F.col("o_orderdate").cast("date").cast("string").alias("adoption_date"),
            F.when(F.col("o_orderstatus") == "F", "verified").otherwise("open").alias("status"),
        )


def event_study_panel(t: Tables) -> DataFrame:
    """User-day totals of the events, zero-filled to a balanced panel.

    Users with ``user_id % 4 <> 0`` are treated from period ``10 + user_id % 8``.
    """
    day = F.col("ts").cast("date")
    daily = t.events.groupBy(F.col("user_id").alias("unit_id"), day.alias("day")).agg(F.sum("value").alias("total"))
    bounds = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    first, last = bounds.select("first").scalar(), bounds.select("last").scalar()
    units = daily.select("unit_id").distinct()
    grid = units.select("unit_id", F.explode(F.sequence(F.lit(1), F.datediff(last, first) + 1)).alias("period"))
    observed = daily.select("unit_id", (F.datediff("day", first) + 1).alias("period"), "total")
    u = F.col("unit_id")
    treated = u % 4 != 0
    return grid.join(observed, ["unit_id", "period"], "left").select(
        "unit_id",
        "period",
        F.when(treated, (10 + u % 8).cast("double")).alias("treat_period"),
        F.coalesce("total", F.lit(0.0)).alias("y"),
        treated.alias("treated"),
        (u % 4).cast("int").alias("region"),
    )


def firm_year(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customer-year outcomes, and covariates of the customers.

    ``age`` is the time in months since a customer's first order; customers of one market segment
    count as treated from 1998.
    """
    day = F.col("o_orderdate").cast("date")
    yearly = t.orders.groupBy(F.col("o_custkey").alias("firm_id"), F.year(day).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.max(month_index(day)).alias("last"), F.min(month_index(day)).alias("first")
    )
    begun = F.min("first").over(Window.partitionBy("firm_id"))  # one row per calendar year
    segment = t.customer.select(F.col("c_custkey").alias("firm_id"), (F.col("c_mktsegment") == "BUILDING").alias("building"))
    outcomes = (
        yearly.withColumn("age", (F.col("last") - begun).cast("int"))
        .join(segment, "firm_id", "left")
        .select(
            "firm_id",
            "year",
            "age",
            half_up(F.col("total"), 2).alias("sales"),
            F.when(F.col("building") & (F.col("year") >= 1998), 1).otherwise(0).alias("treated_post"),
            (F.col("total") / F.col("n") / 100000).alias("mediator"),
            F.col("n").cast("double").alias("outcome"),
        )
    )
    customers = t.customer.select(
        F.col("c_custkey").alias("firm_id"),
        F.col("c_nationkey").cast("int").alias("industry"),
        F.col("c_acctbal").alias("balance"),
    )
    covariates = outcomes.select("firm_id", "year").join(customers, "firm_id")
    score = half_up(F.col("balance") / 1000, 3) * (F.col("year") - 1990)
    return outcomes, covariates.select("firm_id", "year", "industry", score.alias("baseline_score"))


def vintage_source(t: Tables) -> DataFrame:
    """Revised monthly series: order lines become known with the month end of their shipping, and not before their order.

    Series = return flag, observation = order month, value = revenue in millions known by the vintage.
    """
    orders = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    lines = t.lineitem.select(
        "l_orderkey", "l_returnflag", "l_extendedprice", F.col("l_shipdate").cast("date").alias("shipped")
    )
    monthly = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("l_returnflag").alias("series_id"),
            month_index(F.col("ordered")).alias("obs_idx"),
            month_index(F.greatest("shipped", "ordered")).alias("vintage_idx"),
        )
        .agg(F.sum("l_extendedprice").alias("added"))
    )
    # At most one row per calendar month and key, so the running window is small per key.
    known = Window.partitionBy("series_id", "obs_idx").orderBy("vintage_idx").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(
        "series_id",
        month_from_index(F.col("obs_idx")).alias("observation_date"),
        month_end(month_from_index(F.col("vintage_idx"))).alias("vintage_date"),
        (F.round(F.sum("added").over(known), 2) / 1_000_000).alias("value"),
    )


def indicator_source(t: Tables, name: str = "U") -> DataFrame:
    """0/1 series: 1 in months where at least a fifth of the orders is urgent, known at month end."""
    month = month_start(F.col("o_orderdate").cast("date"))
    urgent = F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))
    return t.orders.groupBy(month.alias("observation_date")).agg(
        F.when(urgent >= 0.2, 1.0).otherwise(0.0).alias("value")
    ).select(F.lit(name).alias("series_id"), "observation_date", month_end(F.col("observation_date")).alias("vintage_date"), "value")


def document_pages(t: Tables) -> DataFrame:
    """Pages as archive documents ``url, kind, body``: each as its html and as text lines.

    The number in a page's URL is the document id, its page id the revision; the order of that number gives the day.
    """
    days = t.orders.select(F.col("o_orderkey").alias("page_id"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    number = F.coalesce(F.regexp_extract("url", r"://[^/?#]*/[^?#]*?(\d+)", 1), F.lit(""))
    fields = t.pages.join(days, "page_id", "left").select(
        "url",
        "html",
        F.coalesce("day", F.lit("")).alias("day"),
        F.when(number != "", number).otherwise(F.col("page_id").cast("string")).alias("id"),
        F.regexp_extract("url", r"://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"://[^/?#]+/([a-z]+)/", 1).alias("section"),
        F.regexp_extract("html", r"(?s)<title>([^<]*)", 1).alias("title"),
        F.col("page_id").cast("string").alias("rev"),
    )
    tagged = F.format_string('<main data-id="%s" data-revision="%s"><span class="agency">%s</span><span class="doctype">%s</span><time>%s</time></main>', "id", "rev", "host", "section", "day")
    lines = F.format_string("Document ID: %s\nTitle: %s\nAgency: %s\nType: %s\nRevision: %s\nDate: %s", "id", "title", "host", "section", "rev", "day")
    both = F.array(
        F.struct(F.lit("html").alias("kind"), F.concat(tagged, "html").alias("body")),
        F.struct(F.lit("text").alias("kind"), lines.alias("body")),
    )
    return fields.select("url", F.explode(both).alias("d")).select("url", "d.kind", "d.body")


def corpus(t: Tables) -> DataFrame:
    """Documents with topic and template family."""
    family = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return t.documents.select("doc_id", "text", F.col("lang").alias("topic"), "source", family.alias("family"))


def sentiments(t: Tables) -> DataFrame:
    """Second label of the documents that have one. Kept apart, so texts are never shuffled to meet it."""
    return t.labels.select("doc_id", F.col("quality").cast("string").alias("sentiment"))
