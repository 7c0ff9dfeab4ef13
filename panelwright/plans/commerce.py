"""Commerce query book over the star schema.

Reports that rank or lag inside a customer first reduce to one row per customer and
calendar day or month, which bounds every window by the calendar, whatever a single
customer's share of the orders is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions.cleaning import bucket, days_between, json_field, month_key
from panelwright.operators.latest import top_n_per_group
from panelwright.operators.ordered import cumulated, exact_percentiles, global_ntile
from panelwright.sources.derived import Star



def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


# -- monthly revenue ---------------------------------------------------------------


def monthly_revenue(star: Star) -> DataFrame:
    return star.financials.groupBy(month_key(F.col("order_date")).alias("month")).agg(
        F.round(F.sum("net_revenue"), 2).alias("revenue")
    )


def revenue_by_month(star: Star) -> DataFrame:
    return monthly_revenue(star).withColumnRenamed("revenue", "net_revenue").orderBy("month")


def trailing_revenue(star: Star) -> DataFrame:
    # One row per calendar month: the unpartitioned window is bounded by the calendar.
    last3 = Window.orderBy("month").rowsBetween(-2, 0)
    return monthly_revenue(star).withColumn("rolling_3m", F.round(F.avg("revenue").over(last3), 6))


def revenue_growth(star: Star) -> DataFrame:
    previous = F.lag("revenue").over(Window.orderBy("month"))
    return (
        monthly_revenue(star)
        .withColumn("prev", previous)
        .select("month", "revenue", F.round(F.try_divide(F.col("revenue") - F.col("prev"), F.col("prev")), 6).alias("growth"))
    )


def monthly_category_trend(star: Star) -> DataFrame:
    per_product = (
        star.items.join(star.orders.select("order_id", "order_date"), "order_id")
        .groupBy(month_key(F.col("order_date")).alias("month"), "product_id")
        .agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("sales"))
    )
    return (
        per_product.join(star.products.select("product_id", "category"), "product_id")
        .groupBy("month", "category")
        .agg(F.round(F.sum("sales"), 2).alias("gross_sales"))
    )


# -- customers ---------------------------------------------------------------------


def customer_revenue(star: Star) -> DataFrame:
    return star.financials.groupBy("customer_id").agg(
        F.round(F.sum("net_revenue"), 2).alias("revenue"),
        F.count("*").alias("orders"),
        F.sum("returned").alias("returned"),
    )


def with_customer(star: Star, per_customer: DataFrame) -> DataFrame:
    """Adds the customer attributes to a table that has one row per customer."""
    return per_customer.join(star.customers, "customer_id")


def channel_rank_by_country(star: Star) -> DataFrame:
    totals = (
        with_customer(star, customer_revenue(star))
        .groupBy("country", "acquisition_channel")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    )
    rank = F.dense_rank().over(Window.partitionBy("country").orderBy(F.col("revenue").desc()))
    return totals.withColumn("channel_rank", rank)


def customer_deciles(star: Star) -> DataFrame:
    base = customer_revenue(star).select("customer_id", "revenue")
    return global_ntile(base, [F.col("revenue").desc(), F.col("customer_id")], 10, "revenue_decile")


def top_decile(star: Star) -> DataFrame:
    return customer_deciles(star).withColumnRenamed("revenue_decile", "d").where(F.col("d") == 1)


def pareto_share(star: Star, limit: float = 0.8) -> DataFrame:
    """Share of customers whose running revenue share (peers included) stays within ``limit``."""
    by_value = customer_revenue(star).groupBy("revenue").agg(F.count("*").alias("customers"))
    steps = cumulated(by_value.withColumn("amount", F.col("revenue") * F.col("customers")), "amount", [F.col("revenue").desc()])
    inside = F.col("running") / F.col("total") <= limit
    return steps.agg(
        F.round(F.sum(F.when(inside, F.col("customers")).otherwise(0)) / F.sum("customers"), 6).alias(
            "share_customers_before_80pct"
        )
    )


def completed_per_customer(star: Star) -> DataFrame:
    return star.completed.groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order")
    )


def repeat_rate(star: Star) -> DataFrame:
    return completed_per_customer(star).agg(F.round(share(F.col("orders") >= 2), 6).alias("repeat_rate"))


def cohort_sizes(star: Star) -> DataFrame:
    return completed_per_customer(star).groupBy(month_key(F.col("first_order")).alias("cohort_month")).agg(
        F.count("*").alias("customers")
    )


def recency_rank(star: Star) -> DataFrame:
    last = completed_per_customer(star).select("customer_id", "last_order")
    # Distinct days are bounded by the calendar; the rank is computed on them and joined back.
    days = last.select("last_order").distinct()
    ranked = days.withColumn("recency_rank", F.dense_rank().over(Window.orderBy(F.col("last_order").desc())))
    return last.join(ranked, "last_order").select("customer_id", "last_order", "recency_rank")


def inactive_customers(star: Star, cutoff: str) -> DataFrame:
    stale = F.col("last_order") < F.lit(cutoff).cast("date")
    return completed_per_customer(star).agg(F.count(F.when(stale, 1)).alias("inactive"))


def active_span(star: Star) -> DataFrame:
    return completed_per_customer(star).select(
        "customer_id", days_between(F.col("last_order"), F.col("first_order")).alias("active_span_days")
    )


def _customer_days(star: Star) -> DataFrame:
    """One row per customer and order day with the day before it. Bounded by the calendar per customer."""
    days = star.completed.groupBy("customer_id", "order_date").agg(
        F.count("*").alias("n"), F.min("order_id").alias("first_order_id")
    )
    previous = F.lag("order_date").over(Window.partitionBy("customer_id").orderBy("order_date"))
    return days.withColumn("gap", days_between(F.col("order_date"), previous))


def days_since_previous(star: Star) -> DataFrame:
    """Per completed order the days since the customer's order before it (same-day orders: 0)."""
    days = _customer_days(star).select("customer_id", "order_date", "first_order_id", "gap")
    orders = star.completed.select("order_id", "customer_id", "order_date")
    first_of_day = F.col("order_id") == F.col("first_order_id")
    return orders.join(days, ["customer_id", "order_date"]).select(
        "order_id",
        "customer_id",
        "order_date",
        F.when(first_of_day, F.col("gap")).otherwise(0).alias("days_since_prev"),
    )


def longest_gaps(star: Star, n: int = 25) -> DataFrame:
    same_day = F.max(F.when(F.col("n") > 1, 0))
    return (
        _customer_days(star)
        .groupBy("customer_id")
        .agg(F.greatest(F.max("gap"), same_day).alias("max_gap_days"))
        .orderBy(F.col("max_gap_days").desc_nulls_last(), "customer_id")
        .limit(n)
    )


def new_customer_share(star: Star) -> DataFrame:
    """Monthly share of completed orders that are the customer's first."""
    orders = star.completed.groupBy(month_key(F.col("order_date")).alias("month")).agg(F.count("*").alias("orders"))
    first = cohort_sizes(star).withColumnRenamed("cohort_month", "month")
    return orders.join(first, "month", "left").select(
        "month", F.round(F.coalesce("customers", F.lit(0)) / F.col("orders"), 6).alias("new_share")
    )


def active_customers(star: Star) -> DataFrame:
    return star.completed.groupBy(month_key(F.col("order_date")).alias("month")).agg(
        F.countDistinct("customer_id").alias("active_customers")
    )


def rfm_base(star: Star, as_of: str) -> DataFrame:
    return completed_per_customer(star).select(
        "customer_id",
        days_between(F.lit(as_of).cast("date"), F.col("last_order")).alias("recency"),
        F.col("orders").alias("frequency"),
    )


def rfm_report(star: Star, as_of: str) -> DataFrame:
    return rfm_base(star, as_of).withColumnRenamed("recency", "recency_days")


def rfm_scores(star: Star, as_of: str) -> DataFrame:
    recency = global_ntile(rfm_base(star, as_of), [F.col("recency").desc(), F.col("customer_id")], 5, "r_score")
    return global_ntile(recency, [F.col("frequency"), F.col("customer_id")], 5, "f_score")


def customer_top_category(star: Star) -> DataFrame:
    per_product = (
        star.items.join(star.orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id", "product_id")
        .agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("sales"))
    )
    by_category = (
        per_product.join(star.products.select("product_id", "category"), "product_id")
        .groupBy("customer_id", "category")
        .agg(F.round(F.sum("sales"), 2).alias("sales"))
    )
    best = F.min_by(F.struct("category", "sales"), F.struct(-F.col("sales"), F.col("category")))
    return by_category.groupBy("customer_id").agg(best.alias("b")).select("customer_id", "b.category", "b.sales")


def high_return_customers(star: Star) -> DataFrame:
    orders = star.completed.select("order_id", "customer_id")
    returned = star.returns.select("order_id", F.lit(1).alias("hit"))
    return (
        orders.join(returned, "order_id", "left")
        .groupBy("customer_id")
        .agg(F.count("*").alias("orders"), F.count("hit").alias("returned_orders"))
        .where(F.col("returned_orders") >= 2)
    )


# -- channels, countries, segments ------------------------------------------------------


def country_aov(star: Star) -> DataFrame:
    return (
        with_customer(star, customer_revenue(star))
        .groupBy("country")
        .agg(F.round(F.sum("revenue") / F.sum("orders"), 6).alias("aov"))
    )


def channel_returns(star: Star) -> DataFrame:
    return (
        with_customer(star, customer_revenue(star))
        .groupBy("acquisition_channel")
        .agg(
            F.round(F.sum("revenue"), 2).alias("net_revenue"),
            F.round(F.sum("returned") / F.sum("orders"), 6).alias("return_rate"),
        )
    )


def channel_economics(star: Star) -> DataFrame:
    return (
        with_customer(star, customer_revenue(star))
        .groupBy("acquisition_channel")
        .agg(F.count("*").alias("customers"), F.round(F.sum("revenue"), 2).alias("revenue"))
        .withColumn("revenue_per_customer", F.round(F.col("revenue") / F.col("customers"), 6))
    )


def channel_growth(star: Star) -> DataFrame:
    per_customer = star.financials.groupBy("customer_id", month_key(F.col("order_date")).alias("month")).agg(
        F.sum("net_revenue").alias("revenue")
    )
    monthly = (
        with_customer(star, per_customer)
        .groupBy("acquisition_channel", "month")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    )
    previous = F.lag("revenue").over(Window.partitionBy("acquisition_channel").orderBy("month"))
    return monthly.withColumn("abs_growth", F.round(F.col("revenue") - previous, 2))


def channel_discount(star: Star) -> DataFrame:
    per_customer = star.orders.groupBy("customer_id").agg(
        F.sum("discount_pct").alias("discount"), F.count("*").alias("orders")
    )
    return (
        with_customer(star, per_customer)
        .groupBy("acquisition_channel")
        .agg(F.round(F.sum("discount") / F.sum("orders"), 6).alias("avg_discount"))
    )


def country_segments(star: Star) -> DataFrame:
    return star.customers.groupBy("country", "customer_segment").agg(F.count("*").alias("customers"))


def high_value_share(star: Star) -> DataFrame:
    return star.customers.groupBy("country").agg(
        F.round(share(F.col("customer_segment") == "high_value"), 6).alias("share_high_value")
    )


# -- orders, discounts, returns --------------------------------------------------------


def discount_buckets(star: Star) -> DataFrame:
    band = bucket(F.col("discount_pct"), [(0.0, "0%"), (0.10, "1-10%"), (0.20, "11-20%")], "21%+")
    return star.financials.groupBy(band.alias("bucket")).agg(
        F.count("*").alias("orders"), F.round(F.avg("net_revenue"), 6).alias("avg_revenue")
    )


def discount_penetration(star: Star) -> DataFrame:
    counts = star.orders.groupBy("discount_pct").agg(F.count("*").alias("orders"))
    # One row per discount level.
    total = F.sum("orders").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("share", F.round(F.col("orders").cast("double") / total, 6))


def completed_share(star: Star) -> DataFrame:
    return star.orders.agg(F.round(share(F.col("status") == "completed"), 6).alias("completed_share"))


def order_quartiles(star: Star) -> DataFrame:
    base = star.financials.select("order_id", F.round("net_revenue", 2).alias("net_revenue"))
    return global_ntile(base, [F.col("net_revenue"), F.col("order_id")], 4, "quartile")


def median_order_revenue(star: Star) -> DataFrame:
    base = star.financials.select(F.round("net_revenue", 2).alias("net_revenue"))
    return exact_percentiles(base, [], "net_revenue", {"median_net_revenue": 0.5}).select(
        F.round("median_net_revenue", 6).alias("median_net_revenue")
    )


def return_severity(star: Star) -> DataFrame:
    return star.returns.groupBy("return_reason").agg(
        F.count("*").alias("returns"),
        F.round(F.sum("refund_amount"), 2).alias("refunds"),
        F.round(F.avg("refund_amount"), 6).alias("avg_refund"),
    )


def return_reason_rank(star: Star) -> DataFrame:
    counts = star.returns.groupBy("return_reason").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("n").desc())))  # one row per reason


def monthly_return_rate(star: Star) -> DataFrame:
    returned = star.returns.select("order_id", F.lit(1).alias("hit"))
    return (
        star.orders.join(returned, "order_id", "left")
        .groupBy(month_key(F.col("order_date")).alias("month"))
        .agg(F.round(F.count("hit") / F.count("*"), 6).alias("return_rate"))
    )


def returned_counts(star: Star) -> DataFrame:
    return star.financials.agg(
        F.count_if(F.col("returned") == 1).alias("returned_orders"),
        F.count_if(F.col("returned") == 0).alias("kept_orders"),
    )


def total_revenue(star: Star) -> DataFrame:
    return star.financials.agg(F.round(F.sum("net_revenue"), 2).alias("view_revenue"))


def latest_orders(star: Star, n: int) -> DataFrame:
    order = [F.col("order_date").desc(), F.col("order_id").desc()]
    return top_n_per_group(star.orders, ["customer_id"], order, n)


# -- products -----------------------------------------------------------------------


def product_sales(star: Star) -> DataFrame:
    per_product = star.items.groupBy("product_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("sales"), F.sum("quantity").alias("units")
    )
    return per_product.join(star.products, "product_id")


def return_rate_by_category(star: Star) -> DataFrame:
    returned = star.returns.select("order_id", F.lit(1).alias("hit"))
    per_product = (
        star.items.join(returned, "order_id", "left")
        .groupBy("product_id")
        .agg(F.count("hit").alias("hits"), F.count("*").alias("lines"))
    )
    return (
        per_product.join(star.products.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.round(F.sum("hits") / F.sum("lines"), 6).alias("return_rate"))
    )


def top_product_by_category(star: Star) -> DataFrame:
    sales = product_sales(star).withColumn("sales", F.round("sales", 2))
    best = F.min_by(F.struct("product_id", "sales"), F.struct(-F.col("sales"), F.col("product_id")))
    return (
        sales.groupBy("category")
        .agg(best.alias("b"))
        .select("category", "b.product_id", "b.sales", F.lit(1).alias("rn"))
    )


def category_margin(star: Star) -> DataFrame:
    margin = F.col("sales") - F.col("units") * F.col("unit_cost")
    return product_sales(star).groupBy("category").agg(F.round(F.sum(margin), 2).alias("margin_proxy"))


def category_breadth(star: Star) -> DataFrame:
    return (
        star.items.join(star.products.select("product_id", "category"), "product_id")
        .groupBy("order_id")
        .agg(F.countDistinct("category").alias("category_breadth"))
    )


def attach_rate(star: Star) -> DataFrame:
    total = star.items.agg(F.countDistinct("order_id")).scalar()
    per_product = star.items.groupBy("product_id").agg(F.countDistinct("order_id").alias("orders"))
    known = star.products.select("product_id")
    return per_product.join(known, "product_id", "left_semi").select(
        "product_id", F.round(F.col("orders").cast("double") / total, 8).alias("attach_rate")
    )


# -- events -------------------------------------------------------------------------


def json_counts(star: Star, path: str = "$.k") -> DataFrame:
    return star.tables.events.groupBy(json_field(F.col("props"), path).alias("campaign")).agg(F.count("*").alias("n"))
