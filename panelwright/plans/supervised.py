"""Supervised forecasting origins built from snapshots only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelwright.functions.cleaning import month_index
from panelwright.operators.latest import first_by
from panelwright.operators.series import ffill_limit, label, lags, transform_series
from panelwright.plans import vintage
from panelwright.runtime import stage


@dataclass(frozen=True)
class Protocol:
    """Evaluation protocol. Targets map a series to its transform."""

    targets: dict[str, str]
    predictors: tuple[str, ...]
    vintage_start: str
    vintage_end: str
    recession_indicator: str | None = None
    horizons: tuple[int, ...] = (1, 3, 6, 12)
    lags: int = 12
    max_staleness: int = 3
    min_train: int = 72
    truth_modes: tuple[str, ...] = ("first_release", "latest")
    leaderboard_truth: str = "first_release"
    baseline: str = "naive_last"
    seed: int = 1729


# The published monthly protocol.
US_MONTHLY = Protocol(
    targets={"CPIAUCSL": "yoy_pct", "UNRATE": "level", "INDPRO": "yoy_pct"},
    predictors=("PAYEMS", "FEDFUNDS", "GS10", "GS2", "PCEPI", "PPIACO", "HOUST", "RSAFS", "M2SL", "UMCSENT"),
    vintage_start="2006-01-31",
    vintage_end="2026-07-31",
    recession_indicator="USREC",
)

MULTIVARIATE_PREDICTORS = 5


class Supervised:
    """Feature rows and origins of one panel under one protocol.

    ``rows``: one row per target, cutoff and month with the transformed target ``y``, the
    feature array ``x``, the multivariate block ``mv`` and one label per horizon.
    A (target, cutoff) group is a monthly series, so it is bounded by the calendar.
    """

    def __init__(self, panel: DataFrame, protocol: Protocol):
        self.panel = panel
        self.protocol = protocol
        self.group = Window.partitionBy("target", "cutoff_idx").orderBy("month_idx")

    @cached_property
    def monthly(self) -> DataFrame:
        """Wide monthly panel per cutoff; predictors are carried forward for a few months."""
        p = self.protocol
        series = sorted({*p.targets, *p.predictors})
        used = self.panel.where(F.col("series_id").isin(series))
        snap = vintage.snapshots(used, p.vintage_start, p.vintage_end)
        # All series of the panel set the month range of a snapshot, the used ones fill it.
        span = vintage.observation_spans(self.panel, p.vintage_start, p.vintage_end)
        spine = span.select("cutoff_idx", F.explode(F.sequence("lo", "hi")).alias("month_idx"))
        wide = snap.groupBy("cutoff_idx", month_index(F.col("observation_date")).alias("month_idx")).agg(
            *[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in series]
        )
        window = Window.partitionBy("cutoff_idx").orderBy("month_idx")
        whole = Window.partitionBy("cutoff_idx")
        return spine.join(wide, ["cutoff_idx", "month_idx"], "left").select(
            "cutoff_idx",
            "month_idx",
            *[
                (ffill_limit(f"`{t}`", window, p.max_staleness) if t in p.predictors else F.col(f"`{t}`")).alias(f"raw_{t}")
                for t in p.targets
            ],
            *[ffill_limit(f"`{s}`", window, p.max_staleness).alias(f"pred_{s}") for s in p.predictors],
            *[(F.count(f"`{s}`").over(whole) > 0).alias(f"has_{s}") for s in p.predictors],
        )

    @cached_property
    def rows(self) -> DataFrame:
        p = self.protocol
        stacked = self.monthly.select(
            "*", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"raw_{t}").alias("raw")) for t in p.targets])).alias("_t")
        ).select("_t.target", "_t.raw", *[c for c in self.monthly.columns if not c.startswith("raw_")])
        y = transform_series(stacked, ["target", "cutoff_idx"], "month_idx", "raw", p.targets, "target", "y")
        none = F.array().cast("array<double>")

        def where_present(s: str, values: list) -> Column:
            return F.when(F.col(f"has_{s}"), F.array(*values)).otherwise(none)

        features = [F.array(*lags("y", self.group, 1, p.lags))]
        features += [where_present(s, lags(f"pred_{s}", self.group, 0, p.lags - 1)) for s in p.predictors]
        block = [F.array("y")] + [where_present(s, [F.col(f"pred_{s}")]) for s in p.predictors[:MULTIVARIATE_PREDICTORS]]
        built = y.select(
            "target",
            "cutoff_idx",
            "month_idx",
            "y",
            F.concat(*features).alias("x"),
            F.concat(*block).alias("mv"),
            *[label("y", self.group, h).alias(f"label_{h}") for h in self.all_horizons],
        )
        whole = Window.partitionBy("target", "cutoff_idx")
        origin = F.max(F.when(F.col("y").isNotNull(), F.col("month_idx"))).over(whole)
        # Read for the origins and again for the chosen rows, so written once.
        return stage(
            built.withColumn("origin_idx", origin)
            .where(F.col("month_idx") <= F.col("origin_idx"))
            .withColumn("x_complete", ~F.exists("x", lambda v: v.isNull()))
            .withColumn("mv_complete", ~F.exists("mv", lambda v: v.isNull()))
        )

    @property
    def all_horizons(self) -> list[int]:
        """Configured horizons and horizon 1, which decides whether an origin qualifies."""
        return sorted({1, *self.protocol.horizons})

    @cached_property
    def candidates(self) -> DataFrame:
        """One row per target and cutoff: origin and which horizons have enough data."""
        p = self.protocol
        at_origin = F.col("month_idx") == F.col("origin_idx")
        sizes = self.rows.groupBy("target", "cutoff_idx", "origin_idx").agg(
            F.max(F.when(at_origin, F.col("x_complete"))).alias("x_ready"),
            F.count(F.when(F.col("mv_complete"), 1)).alias("n_mv"),
            *[
                F.count(F.when(F.col("x_complete") & F.col(f"label_{h}").isNotNull(), 1)).alias(f"n_train_{h}")
                for h in self.all_horizons
            ],
        )
        ready = F.col("x_ready") & (F.col("n_mv") >= p.min_train)
        return sizes.select(
            "*", *[(ready & (F.col(f"n_train_{h}") >= p.min_train)).alias(f"ready_{h}") for h in self.all_horizons]
        )

    @cached_property
    def first_vintages(self) -> DataFrame:
        """First cutoff that qualifies at horizon 1 per target and origin. The origin counts as seen
        from then on, even where a longer horizon lacks data at that cutoff."""
        seen = self.candidates.where(F.col("ready_1"))
        return first_by(seen, ["target", "origin_idx"], [F.col("cutoff_idx")])

    @cached_property
    def origins(self) -> DataFrame:
        """``target, cutoff_idx, origin_idx, horizon, target_idx, n_train`` of every forecast to make."""
        per_horizon = F.array(
            *[
                F.struct(F.lit(h).alias("horizon"), F.col(f"ready_{h}").alias("ready"), F.col(f"n_train_{h}").alias("n_train"))
                for h in self.protocol.horizons
            ]
        )
        return (
            self.first_vintages.select("target", "cutoff_idx", "origin_idx", F.explode(per_horizon).alias("h"))
            .where("h.ready")
            .select(
                "target", "cutoff_idx", "origin_idx", "h.horizon",
                (F.col("origin_idx") + F.col("h.horizon")).alias("target_idx"), "h.n_train",
            )
        )

    @cached_property
    def selected_rows(self) -> DataFrame:
        """Feature rows of the chosen cutoffs with the horizons to forecast."""
        wanted = self.first_vintages.select("target", "cutoff_idx", *[f"ready_{h}" for h in self.protocol.horizons])
        return self.rows.join(wanted, ["target", "cutoff_idx"])
