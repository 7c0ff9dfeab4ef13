"""Balanced firm x quarter panel from five messy files."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.cleaning import norm_firm_id, norm_label, norm_quarter, parse_date, parse_money
from panelwright.operators.calendar import panel_spine
from panelwright.operators.joins import semi_filter
from panelwright.operators.latest import first_by, latest_by
from panelwright.operators.ordered import exact_percentiles

KEY = ["firm_id", "quarter"]


class FirmPanel:
    """``first_day`` and ``last_day`` bound the quarters of the panel."""

    def __init__(self, files, first_day: Column, last_day: Column):
        self.files = files
        self.first_day = first_day
        self.last_day = last_day

    @cached_property
    def master(self) -> DataFrame:
        return first_by(self.files.firm_master, ["firm_id"], [F.col("legal_name"), F.col("region_code")])

    @cached_property
    def regions(self) -> DataFrame:
        return self.files.regions.select("region_code", norm_label(F.col("region_name")).alias("region"))

    @cached_property
    def employment_keyed(self) -> DataFrame:
        return self.files.employment.select(
            norm_firm_id(F.col("firm_key")).alias("firm_id"),
            norm_quarter(F.col("quarter")).alias("quarter"),
            F.col("employees").try_cast("int").alias("employees"),
            parse_date(F.col("correction_ts")).alias("correction_ts"),
        )

    @cached_property
    def financials_keyed(self) -> DataFrame:
        return self.files.financials.select(
            norm_firm_id(F.col("company_identifier")).alias("firm_id"),
            norm_quarter(F.col("period")).alias("quarter"),
            parse_money(F.col("revenue")).alias("revenue_usd"),
            parse_date(F.col("correction_ts")).alias("correction_ts"),
        )

    @cached_property
    def adoption_keyed(self) -> DataFrame:
        return self.files.ai_adoption.select(
            norm_firm_id(F.col("entity_id")).alias("firm_id"),
            parse_date(F.col("adoption_date")).alias("adoption_date"),
            "status",
        )

    @staticmethod
    def _keyed(df: DataFrame) -> DataFrame:
        return df.where(F.col("firm_id").isNotNull() & F.col("quarter").isNotNull())

    @cached_property
    def employment(self) -> DataFrame:
        return latest_by(self._keyed(self.employment_keyed), KEY, "correction_ts", "employees")

    @cached_property
    def financials(self) -> DataFrame:
        return latest_by(self._keyed(self.financials_keyed), KEY, "correction_ts", "revenue_usd")

    @cached_property
    def first_adoption(self) -> DataFrame:
        verified = self.adoption_keyed.where((F.col("status") == "verified") & F.col("adoption_date").isNotNull())
        first = verified.groupBy("firm_id").agg(F.min("adoption_date").alias("adoption_date"))
        return semi_filter(first, self.master, "firm_id")

    @cached_property
    def spine(self) -> DataFrame:
        return panel_spine(self.master.select("firm_id", "region_code"), "firm_id", self.first_day, self.last_day)

    @cached_property
    def panel(self) -> DataFrame:
        adopted = F.coalesce(F.col("adoption_date") <= F.col("quarter_end"), F.lit(False))
        return (
            self.spine.join(self.regions, "region_code", "left")
            .join(self.first_adoption, "firm_id", "left")
            .join(self.employment.select(*KEY, "employees"), KEY, "left")
            .join(self.financials.select(*KEY, "revenue_usd"), KEY, "left")
            .select(*KEY, "region", "employees", "revenue_usd", adopted.cast("int").alias("ai_adopted"))
        )

    # -- ledgers ----------------------------------------------------------------------

    @staticmethod
    def _superseded(df: DataFrame, reason: str) -> DataFrame:
        per_key = df.groupBy(*KEY).agg(F.count("*").alias("n"))
        return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(F.lit(reason).alias("reason"), "rows")

    @cached_property
    def exclusions(self) -> DataFrame:
        """Every row that does not reach the panel, by the first reason that applies."""

        def tagged(df: DataFrame, reason: Column) -> DataFrame:
            named = df.select(reason.alias("reason")).where(F.col("reason").isNotNull())
            return named.groupBy("reason").agg(F.count("*").alias("rows"))

        def keyed_reason(source: str) -> Column:
            return F.when(F.col("firm_id").isNull(), f"{source}: no firm id").when(
                F.col("quarter").isNull(), f"{source}: no quarter"
            )

        known = self.master.select("firm_id", F.lit(True).alias("known"))
        adoption_reason = (
            F.when(F.col("firm_id").isNull(), "adoption: no firm id")
            .when(F.col("status") != "verified", "adoption: not verified")
            .when(F.col("adoption_date").isNull(), "adoption: bad date")
            .when(F.col("known").isNull(), "adoption: unknown firm")
        )
        master_rows = self.files.firm_master.groupBy("firm_id").agg(F.count("*").alias("n"))
        parts = [
            tagged(self.employment_keyed, keyed_reason("employment")),
            tagged(self.financials_keyed, keyed_reason("financials")),
            tagged(self.adoption_keyed.join(known, "firm_id", "left"), adoption_reason),
            self._superseded(self._keyed(self.employment_keyed), "employment: superseded"),
            self._superseded(self._keyed(self.financials_keyed), "financials: superseded"),
            master_rows.agg(F.sum(F.col("n") - 1).alias("rows")).select(
                F.lit("master: duplicate firm").alias("reason"), "rows"
            ),
        ]
        return reduce(DataFrame.unionByName, parts).where(F.col("rows") > 0)

    @cached_property
    def quality(self) -> DataFrame:
        """One row: panel size, duplicate keys, keys without a master record."""
        per_key = self.panel.groupBy(*KEY).agg(F.count("*").alias("n"))
        sizes = per_key.agg(
            F.sum("n").alias("final_rows"),
            F.sum(F.col("n") - 1).alias("duplicate_keys"),
            F.countDistinct("firm_id").alias("unique_firms"),
            F.countDistinct("quarter").alias("unique_quarters"),
        )

        def unmatched(df: DataFrame) -> Column:
            strangers = df.select("firm_id").distinct().join(self.master.select("firm_id"), "firm_id", "left_anti")
            return strangers.agg(F.count("*")).scalar()

        return sizes.select(
            "*",
            unmatched(self.employment_keyed).alias("unmatched_employment_keys"),
            unmatched(self.financials_keyed).alias("unmatched_financial_keys"),
            unmatched(self.adoption_keyed).alias("unmatched_adoption_keys"),
        )


def summary_stats(df: DataFrame, variables: list[str]) -> DataFrame:
    """``variable, n, mean, sd, min, p50, max`` with the exact median."""
    pairs = ", ".join(f"'{v}', cast({v} as double)" for v in variables)
    long = df.selectExpr(f"stack({len(variables)}, {pairs}) as (variable, value)")
    moments = long.groupBy("variable").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 4).alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    median = exact_percentiles(long, ["variable"], "value", {"p50": 0.5})
    return moments.join(median, "variable").select(
        "variable", "n", "mean", "sd", "min", F.round("p50", 6).alias("p50"), "max"
    )
