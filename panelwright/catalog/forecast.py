"""Vintage tables, supervised origins, forecasts and their evaluation."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.catalog.book import BOOK
from panelwright.catalog.ctes import VINTAGES, with_
from panelwright.catalog.forecast_sql import FORECASTS, SUPERVISED, TRUTH, layer
from panelwright.functions.cleaning import month_end, month_from_index, month_index
from panelwright.operators import calendar, series
from panelwright.plans import evaluation as E
from panelwright.plans import models, vintage
from panelwright.plans.supervised import Protocol, Supervised
from panelwright.runtime import stage, stage_root
from panelwright.sources.derived import indicator_source, vintage_source
from panelwright.sources.tables import Tables

PROTOCOL = Protocol(
    targets={"R": "yoy_pct", "A": "level"},
    predictors=("N",),
    recession_indicator="U",
    vintage_start="",
    vintage_end="",
    horizons=(1, 3),
    lags=3,
    max_staleness=3,
    min_train=24,
)


def panel_of(spark, folder) -> DataFrame:
    t = Tables(spark, folder)
    return vintage.vintage_panel(vintage_source(t).unionByName(indicator_source(t)))


def bounds_of(panel: DataFrame) -> tuple[str, str]:
    """First and last vintage of a panel."""
    low, high = panel.agg(F.min("vintage_date").cast("string"), F.max("vintage_date").cast("string")).first()
    return low, high


class Run:
    """One evaluation over one folder and all its vintages. The panel is small next to the lines it
    sums up and is read by truth, regimes and snapshots, so it is written once."""

    def __init__(self, spark, folder, timed: bool = False):
        self.timed = timed
        self.panel = stage(panel_of(spark, folder))
        first, last = bounds_of(self.panel)
        self.protocol = replace(PROTOCOL, vintage_start=first, vintage_end=last)

    data = cached_property(lambda self: Supervised(self.panel, self.protocol))
    forecasts = cached_property(lambda self: (models.timed_forecasts if self.timed else models.baseline_forecasts)(self.data))
    truth = cached_property(lambda self: vintage.truth_series(self.panel, PROTOCOL.targets))
    latest = cached_property(lambda self: self.truth.where(F.col("truth_mode") == "latest"))
    ledger = cached_property(lambda self: stage(E.score_ledger(self.forecasts, self.panel, self.protocol)))
    paired = cached_property(lambda self: stage(E.paired_relative_cells(self.ledger)))
    board = cached_property(lambda self: E.build_leaderboard(self.paired, PROTOCOL.leaderboard_truth))
    dm = cached_property(lambda self: E.dm_table(self.ledger, max(PROTOCOL.horizons)))


def supervised(spark, folder) -> Supervised:
    return Run(spark, folder).data


def dated(df: DataFrame) -> DataFrame:
    """Month indexes as dates."""
    names = {"origin_idx": "origin_date", "target_idx": "target_date", "month_idx": "month"}
    out = df
    if "cutoff_idx" in df.columns:
        out = out.withColumn("vintage_date", month_end(month_from_index(F.col("cutoff_idx")))).drop("cutoff_idx")
    for index, date in names.items():
        if index in df.columns:
            out = out.withColumn(date, month_from_index(F.col(index))).drop(index)
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


VP = with_(VINTAGES)
D = "CAST({0} AS VARCHAR) AS {0}".format

# -- vintage tables -------------------------------------------------------------------------------

BOOK.add("v01", panel_of, VP + f"SELECT series_id, {D('observation_date')}, {D('vintage_date')}, value FROM vp")
BOOK.add("v02", lambda s, d: vintage.vintages(panel_of(s, d)), VP + "SELECT CAST(v AS VARCHAR) AS vintage_date FROM (SELECT DISTINCT vintage_date AS v FROM vp)")


def v03(spark, folder):
    panel = stage(panel_of(spark, folder))
    return dated(vintage.snapshots(panel, *bounds_of(panel)))


SNAPSHOTS = layer("supervised") + "SELECT series_id, CAST(obs AS VARCHAR) AS observation_date, CAST(cutoff AS VARCHAR) AS vintage_date, value FROM snap"
BOOK.add("v03", v03, SNAPSHOTS)
for _name, _mode, _fn in (("v04", "first_release", "min_by"), ("v05", "latest", "max_by")):
    BOOK.add(
        _name,
        lambda s, d, m=_mode: vintage.truth(panel_of(s, d), m),
        VP + f"SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, value FROM (SELECT series_id, observation_date, {_fn}(value, vintage_date) AS value FROM vp GROUP BY 1, 2)",
    )


def history_of(spark, folder) -> DataFrame:
    """Closed validity intervals of the vintage table."""
    key = ["series_id", "observation_date"]
    panel = stage(vintage_source(Tables(spark, folder)))
    following = F.lead("vintage_date").over(Window.partitionBy(*key).orderBy("vintage_date"))
    return panel.select(
        *key,
        F.col("vintage_date").alias("realtime_start"),
        F.coalesce(F.date_sub(following, 1), F.to_date(F.lit("9999-12-31"))).alias("realtime_end"),
        "value",
    )


def over_history(build, spark, folder, days: str = "month ends") -> DataFrame:
    """``build`` over the revision intervals for month ends, for the 8th and 23rd of each month, or for both."""
    history = stage(history_of(spark, folder))
    first, last = history.agg(F.min("realtime_start").cast("string"), F.max("realtime_start").cast("string")).first()
    ends = vintage.month_ends(spark, first, last)
    inside = ends.select(F.explode(F.array(*[F.date_add(F.trunc("cutoff", "month"), d) for d in (7, 22)])).alias("cutoff"))
    return build(history, {"month ends": ends, "inside": inside, "both": ends.union(inside)}[days])


HISTORY = """
history AS (
  SELECT series_id, observation_date, vintage_date AS realtime_start,
         coalesce(CAST(lead(vintage_date) OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date) - 1 AS DATE), DATE '9999-12-31') AS realtime_end,
         value FROM vintage_panel),
cut AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(vintage_date)), date_trunc('month', max(vintage_date)), INTERVAL 1 MONTH)) AS DATE)) AS cutoff FROM vintage_panel),
hsnap AS (
  SELECT series_id, observation_date, cutoff AS vintage_date, value FROM (
    SELECT h.*, cutoff, row_number() OVER (PARTITION BY series_id, observation_date, cutoff ORDER BY realtime_start DESC) AS rn
    FROM history h JOIN cut ON realtime_start <= cutoff AND cutoff <= realtime_end) WHERE rn = 1 AND value IS NOT NULL),
initial AS (
  SELECT series_id, observation_date, min(realtime_start) AS vintage_date, min_by(value, realtime_start) AS value FROM history WHERE value IS NOT NULL GROUP BY 1, 2)"""
PANEL_TEXT = f"SELECT series_id, {D('observation_date')}, {D('vintage_date')}, value FROM "
BOOK.add("v06", lambda s, d: vintage.initial_release(history_of(s, d)), with_(VINTAGES, HISTORY) + PANEL_TEXT + "initial")
_INSIDE = "inside AS (SELECT CAST(date_trunc('month', cutoff) AS DATE) + unnest([7, 22]) AS cutoff FROM cut)"
HISTORY_INSIDE = HISTORY.replace("hsnap AS (", _INSIDE + ",\nhsnap AS (").replace("FROM history h JOIN cut ON", "FROM history h JOIN ({days}) ON")
_DAYS = {"month ends": "SELECT * FROM cut", "inside": "SELECT * FROM inside", "both": "SELECT * FROM cut UNION ALL SELECT * FROM inside"}
for _name, _days in (("v07", "both"), ("j12", "inside")):
    BOOK.add(
        _name,
        lambda s, d, days=_days: over_history(vintage.snapshot_from_history, s, d, days),
        with_(VINTAGES, HISTORY_INSIDE.replace("{days}", _DAYS[_days])) + PANEL_TEXT + "hsnap",
    )
BOOK.add(
    "v08",
    lambda s, d: over_history(vintage.build_vintage_panel, s, d, "both"),
    with_(VINTAGES, HISTORY_INSIDE.replace("{days}", _DAYS["both"])) + PANEL_TEXT + "(SELECT * FROM initial UNION SELECT * FROM hsnap)",
)
BOOK.add(
    "v09",
    lambda s, d: rounded(dated(vintage.truth_series(panel_of(s, d), PROTOCOL.targets))),
    layer("truth") + "SELECT target, truth_mode, CAST(obs AS VARCHAR) AS month, round(value, 6) AS value FROM truth",
)
BOOK.add("v10", lambda s, d: dated(vintage.regime_map(panel_of(s, d), "U")), layer("truth") + "SELECT CAST(obs AS VARCHAR) AS month, regime FROM cycle")


BOOK.add("v11", lambda s, d: dated(vintage.volatility_regime(Run(s, d).latest)), layer("truth") + "SELECT target, CAST(obs AS VARCHAR) AS month, vol_regime FROM vol")
BOOK.add("v12", lambda s, d: vintage.assert_no_leakage(supervised(s, d).origins), layer("supervised") + """
SELECT 'origin after cutoff' AS check, count(*) FILTER (WHERE origin > cutoff) = 0 AS passed, count(*) FILTER (WHERE origin > cutoff) AS n_violations FROM origins
UNION ALL SELECT 'label not after origin', count(*) FILTER (WHERE target_date <= origin) = 0, count(*) FILTER (WHERE target_date <= origin) FROM origins
UNION ALL SELECT 'origin moves back', count(*) FILTER (WHERE origin < p) = 0, count(*) FILTER (WHERE origin < p) FROM (
  SELECT origin, max(origin) OVER (PARTITION BY target, horizon ORDER BY cutoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM origins)""")
BOOK.add(
    "v13",
    lambda s, d: dated(supervised(s, d).origins),
    layer("supervised") + "SELECT target, CAST(cutoff AS VARCHAR) AS vintage_date, CAST(origin AS VARCHAR) AS origin_date, horizon, CAST(target_date AS VARCHAR) AS target_date, n_train FROM origins",
)
BOOK.add(
    "d07",
    lambda s, d: dated(supervised(s, d).first_vintages.select("target", "cutoff_idx", "origin_idx")),
    layer("supervised") + "SELECT target, CAST(cutoff AS VARCHAR) AS vintage_date, CAST(origin AS VARCHAR) AS origin_date FROM first_v",
)
BOOK.add("a12", lambda s, d: vintage.data_audit(panel_of(s, d)), VP + """
SELECT series_id, count(*) AS rows, count(DISTINCT observation_date) AS observations, count(DISTINCT vintage_date) AS vintages,
       CAST(min(observation_date) AS VARCHAR) AS first_observation, CAST(max(observation_date) AS VARCHAR) AS last_observation,
       CAST(min(vintage_date) AS VARCHAR) AS first_vintage, CAST(max(vintage_date) AS VARCHAR) AS last_vintage,
       count(*) - count(DISTINCT (observation_date, vintage_date)) AS duplicate_series_obs_vintage FROM vp GROUP BY 1""")

# -- series operators ---------------------------------------------------------------------------------


def _latest_spine(spark, folder) -> DataFrame:
    latest = vintage.truth(vintage_source(Tables(spark, folder)), "latest")
    return calendar.month_spine(latest, ["series_id"], "observation_date")


SPINE = """
latest AS (SELECT series_id, observation_date AS month, max_by(value, vintage_date) AS value FROM vintage_panel GROUP BY 1, 2),
months AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM latest GROUP BY 1),
s AS (SELECT series_id, month, value FROM months LEFT JOIN latest USING (series_id, month))"""


def monthly():
    return Window.partitionBy("series_id").orderBy("month_idx")


def w11(spark, folder):
    spine = _latest_spine(spark, folder)
    return rounded(dated(spine.select("series_id", "month_idx", *[series.transformed("value", monthly(), k).alias(k) for k in series.TRANSFORMS])))


BOOK.add("w11", w11, with_(VINTAGES, SPINE) + """
SELECT series_id, CAST(month AS VARCHAR) AS month, round(value, 6) AS level, round(value - lag(value) OVER w, 6) AS diff,
       round((value / nullif(lag(value) OVER w, 0) - 1.0::DOUBLE) * 100.0::DOUBLE, 6) AS pct,
       round((value / nullif(lag(value, 12) OVER w, 0) - 1.0::DOUBLE) * 100.0::DOUBLE, 6) AS yoy_pct,
       round((ln(value) - ln(lag(value) OVER w)) * 1200.0::DOUBLE, 6) AS logdiff_ann
FROM s WINDOW w AS (PARTITION BY series_id ORDER BY month)""")


def _select_on_spine(build, sql):
    return (
        lambda s, d: rounded(dated(_latest_spine(s, d).select("series_id", "month_idx", *build()))),
        with_(VINTAGES, SPINE) + sql,
    )


BOOK.add("w12", *_select_on_spine(
    lambda: [series.ffill_limit("value", monthly(), 1).alias("filled")],
    """SELECT series_id, CAST(month AS VARCHAR) AS month, round(last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month
       ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS filled FROM s""",
))
BOOK.add("w13", *_select_on_spine(
    lambda: [series.rolling_sd("value", monthly(), 24, 12).alias("sd")],
    """SELECT series_id, CAST(month AS VARCHAR) AS month, round(CASE WHEN count(value) OVER w >= 12 THEN stddev_samp(value) OVER w END, 6) AS sd
       FROM s WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
))
BOOK.add("w14", *_select_on_spine(
    lambda: [c.alias(f"lag{k}") for k, c in enumerate(series.lags("value", monthly(), 0, 3))],
    "SELECT series_id, CAST(month AS VARCHAR) AS month, " + ", ".join(f"round(lag(value, {k}) OVER w, 6) AS lag{k}" for k in range(4))
    + " FROM s WINDOW w AS (PARTITION BY series_id ORDER BY month)",
))
BOOK.add("w15", *_select_on_spine(
    lambda: [series.label("value", monthly(), h).alias(f"label_{h}") for h in (1, 3)],
    "SELECT series_id, CAST(month AS VARCHAR) AS month, round(lead(value, 1) OVER w, 6) AS label_1, round(lead(value, 3) OVER w, 6) AS label_3 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY month)",
))

# -- forecasts --------------------------------------------------------------------------------------------

FORECAST_TEXT = "target, CAST(cutoff AS VARCHAR) AS vintage_date, CAST(origin AS VARCHAR) AS origin_date, CAST(target_date AS VARCHAR) AS target_date, horizon, model"
for _name, _model in zip(("m01", "m02", "m03", "m04"), models.BASELINES):
    BOOK.add(
        _name,
        lambda s, d, m=_model: rounded(dated(models.baseline_forecasts(supervised(s, d), (m,)).drop("runtime_s"))),
        layer("forecasts") + f"SELECT {FORECAST_TEXT}, round(forecast, 6) AS forecast, round(sigma, 6) AS sigma, 'ok' AS status FROM fc WHERE model = '{_model}'",
    )


def m13(spark, folder):
    out = f"{stage_root(spark)}/external-{uuid.uuid4().hex}"
    made = rounded(Run(spark, folder).forecasts.withColumn("runtime_s", F.lit(0.0)))
    made.withColumn("shard", F.col("model")).write.partitionBy("shard").option("header", True).csv(out)
    return dated(models.read_external_forecasts(spark, out))


BOOK.add("m13", m13, layer("forecasts") + f"SELECT {FORECAST_TEXT}, round(forecast, 6) AS forecast, round(sigma, 6) AS sigma, 0.0::DOUBLE AS runtime_s, 'ok' AS status FROM fc")

# -- evaluation ----------------------------------------------------------------------------------------------

KEYS = "truth_mode, target, horizon, model, CAST(origin AS VARCHAR) AS origin_date"


def scored_base(spark, folder) -> DataFrame:
    run = Run(spark, folder)
    made = E.attach_truth(run.forecasts, run.truth)
    return E.scored_density(E.intervals(E.prequential_sigma(made, PROTOCOL.horizons)))


def _base_query(*columns: str):
    return (
        lambda s, d: rounded(dated(scored_base(s, d).select("truth_mode", "target", "horizon", "model", "origin_idx", *columns))),
        layer("ledger") + f"SELECT {KEYS}, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + " FROM base_ledger",
    )


BOOK.add("e01", *_base_query("error", "sigma"))
BOOK.add("e02", *_base_query("covered80", "covered90", "width80", "width90"))
BOOK.add("e03", *_base_query("crps"))
BOOK.add("e04", *_base_query("pit"))
BOOK.add(
    "e05",
    lambda s, d: rounded(dated(scored_base(s, d).select(
        "truth_mode", "target", "horizon", "model", "origin_idx",
        E.pinball(F.col("actual"), F.col("forecast") - E.Z90 * F.col("sigma"), 0.1).alias("pinball10"),
        E.pinball(F.col("actual"), F.col("forecast") + E.Z90 * F.col("sigma"), 0.9).alias("pinball90"),
    ))),
    layer("ledger") + f"""SELECT {KEYS},
      round(greatest(0.1::DOUBLE * (actual - (forecast - 1.2815515655446004 * sigma)), (0.1::DOUBLE - 1) * (actual - (forecast - 1.2815515655446004 * sigma))), 6) AS pinball10,
      round(greatest(0.9::DOUBLE * (actual - (forecast + 1.2815515655446004 * sigma)), (0.9::DOUBLE - 1) * (actual - (forecast + 1.2815515655446004 * sigma))), 6) AS pinball90
      FROM base_ledger""",
)
LEDGER_NUMBERS = ("forecast", "sigma", "actual", "error", "crps", "pit", "covered80", "covered90", "width80", "width90")
BOOK.add(
    "e06",
    lambda s, d: rounded(dated(Run(s, d).ledger.drop("runtime_s"))),
    layer("ledger") + f"SELECT truth_mode, {FORECAST_TEXT}, regime, 'ok' AS status, " + ", ".join(f"round({c}, 6) AS {c}" for c in LEDGER_NUMBERS) + " FROM ledger",
)


def j15(spark, folder):
    run = Run(spark, folder)
    made = run.forecasts.select("target", "target_idx", "horizon", "model")
    return dated(E.attach_regime(made, vintage.regime_map(run.panel, "U"), vintage.volatility_regime(run.latest)))


BOOK.add(
    "j15",
    j15,
    with_(VINTAGES, SUPERVISED, FORECASTS, TRUTH) + """
SELECT f.target, CAST(f.target_date AS VARCHAR) AS target_date, horizon, model, coalesce(c.regime, 'unknown') AS cycle, coalesce(v.vol_regime, 'unknown') AS vol_regime
FROM fc f LEFT JOIN cycle c ON c.obs = f.target_date LEFT JOIN vol v ON v.target = f.target AND v.obs = f.target_date""",
)
CELL = "truth_mode, target, horizon, regime, model"
BOOK.add(
    "e07",
    lambda s, d: rounded(E.aggregate_metrics(Run(s, d).ledger).drop("runtime_s", "pit_ks_p", "pit_ks_d")),
    layer("ledger") + f"""SELECT {CELL}, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, round(avg(crps), 6) AS crps,
      round(avg(covered80), 6) AS coverage80, round(avg(covered90), 6) AS coverage90, round(avg(width80), 6) AS width80, round(avg(width90), 6) AS width90,
      round(avg(pit), 6) AS pit_mean, round(var_samp(pit), 6) AS pit_var FROM ledger GROUP BY ALL""",
)
BOOK.add(
    "e08",
    lambda s, d: rounded(E.pit_ks(Run(s, d).ledger, [*E.CELL, "model"]).drop("pit_ks_p")),
    layer("ks") + f"SELECT {CELL}, round(pit_ks_d, 6) AS pit_ks_d FROM ks",
)
BOOK.add(
    "e08_pvalue",
    lambda s, d: rounded(E.pit_ks(Run(s, d).ledger, [*E.CELL, "model"])),
    layer("ks") + f""", law AS (SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * pit_ks_d AS x FROM ks)
SELECT {CELL}, round(pit_ks_d, 6) AS pit_ks_d, round(CASE WHEN x IS NULL THEN NULL WHEN x < 0.2 THEN 1.0::DOUBLE ELSE greatest(least((
  SELECT sum((CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0 END) * exp(-2.0::DOUBLE * j * j * x * x)) FROM range(1, 31) t(j)), 1.0::DOUBLE), 0.0::DOUBLE) END, 6) AS pit_ks_p FROM law""",
)
PAIRED_NUMBERS = ("rmse", "baseline_rmse", "rmse_rel", "crps", "baseline_crps", "crps_rel", "combined_rel", "coverage80", "coverage90", "width80", "width90", "pit_mean", "pit_var")
BOOK.add(
    "e09",
    lambda s, d: rounded(Run(s, d).paired.drop("runtime_s", "pit_ks_p", "pit_ks_d")),
    layer("paired") + f"""SELECT {CELL}, 'naive_last' AS baseline, n_common, baseline_n, baseline_n - n_common AS failure_count,
      round(CAST(n_common AS DOUBLE) / baseline_n, 6) AS success_share_vs_baseline, """ + ", ".join(f"round({c}, 6) AS {c}" for c in PAIRED_NUMBERS) + " FROM paired",
)
BOARD_NUMBERS = ("score", "rmse_rel", "crps_rel", "coverage80", "coverage90")
BOARD_TEXT = "model, " + ", ".join(f"round({c}, 6) AS {c}" for c in BOARD_NUMBERS) + """, cells, expected_cells, common_origins, baseline_origins, failure_count,
      round(CAST(common_origins AS DOUBLE) / baseline_origins, 6) AS success_share_vs_baseline, score < 1 AS beats_naive_last, cells = expected_cells AS complete_cell_coverage"""
BOOK.add("e10", lambda s, d: rounded(Run(s, d).board.drop("runtime_s")), layer("board") + f"SELECT CAST(rank AS INT) AS rank, {BOARD_TEXT} FROM board")


def e11(spark, folder):
    run = Run(spark, folder)
    return rounded(E.complexity_report(run.paired, run.dm, "first_release").drop("runtime_s"))


BOOK.add("e11", e11, layer("dm") + """
SELECT p.*, coalesce(dm_cells, 0) AS dm_cells, coalesce(w, 0) AS significant_wins, coalesce(l, 0) AS significant_losses, coalesce(w, 0) - coalesce(l, 0) AS net_significant_wins
FROM (SELECT model, count(combined_rel) AS cells, round(avg(combined_rel), 6) AS mean_score, round(median(combined_rel), 6) AS median_score,
        round(avg(rmse_rel), 6) AS mean_rmse_rel, round(avg(crps_rel), 6) AS mean_crps_rel,
        round(avg(CASE WHEN combined_rel < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_cells_beating_naive,
        round(avg(CASE WHEN rmse_rel < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_rmse_beating_naive,
        round(min(combined_rel), 6) AS best_cell_score, round(max(combined_rel), 6) AS worst_cell_score,
        round(avg(abs(coverage90 - 0.9::DOUBLE)), 6) AS mean_abs_90pct_coverage_error, CAST(sum(n_common) AS BIGINT) AS common_origins,
        CAST(sum(baseline_n) AS BIGINT) AS baseline_origins, CAST(sum(baseline_n - n_common) AS BIGINT) AS failure_count,
        round(sum(n_common) / CAST(sum(baseline_n) AS DOUBLE), 6) AS success_share_vs_baseline, avg(combined_rel) < 1 AS beats_naive_on_average
      FROM paired WHERE truth_mode = 'first_release' AND regime = 'all' GROUP BY 1) p
LEFT JOIN (SELECT model, count(*) AS dm_cells, count(*) FILTER (WHERE p_holm < 0.05 AND mean_loss_diff < 0) AS w,
                  count(*) FILTER (WHERE p_holm < 0.05 AND mean_loss_diff > 0) AS l FROM dm WHERE truth_mode = 'first_release' GROUP BY 1) d ON d.model = p.model""")
PARETO_SQL = """SELECT model, round(score, 6) AS score, true AS measured, CASE WHEN score = (SELECT min(score) FROM board) THEN true END AS best_is_efficient,
       round(1 - score, 6) AS skill_gain_vs_naive, sign(1 - score) AS gain_sign FROM board"""


def e12(spark, folder):
    """The frontier over measured runtimes; what depends on the seconds of a run is told by facts that do not."""
    board = E.pareto_frontier(Run(spark, folder, timed=True).board)
    best = F.col("score") == F.min("score").over(Window.partitionBy())  # one row per model
    return rounded(
        board.select(
            "model", "score", (F.col("runtime_s") > 0).alias("measured"), F.when(best, F.col("pareto_efficient")).alias("best_is_efficient"),
            "skill_gain_vs_naive", F.signum("skill_gain_per_runtime_s").cast("tinyint").alias("gain_sign"),
        )
    )


def j14(spark, folder):
    """The same dominance on a large table: orders nobody beats on both value and date."""
    t = Tables(spark, folder)
    daily = t.orders.groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("runtime_s")).agg(
        F.min("o_totalprice").alias("score")
    )
    board = daily.withColumn("model", F.col("runtime_s").cast("bigint"))
    return E.pareto_frontier(board).where("pareto_efficient").select("model", "score")


BOOK.add("e12", e12, layer("board") + PARETO_SQL)
BOOK.add("j14", j14, """
WITH b AS (SELECT CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS BIGINT) AS model, min(o_totalprice) AS score FROM orders GROUP BY 1)
SELECT model, score FROM b x WHERE NOT EXISTS (
  SELECT 1 FROM b o WHERE o.score <= x.score AND o.model <= x.model AND (o.score < x.score OR o.model < x.model))""")
REVISIONS = layer("paired") + """,
sided AS (SELECT *, CAST(rank() OVER (PARTITION BY truth_mode, target, horizon ORDER BY combined_rel) AS DOUBLE) AS rk,
                 first_value(model) OVER (PARTITION BY truth_mode, target, horizon ORDER BY combined_rel, model) AS win
          FROM paired WHERE regime = 'all')
SELECT f.target, f.horizon, f.model, round(f.combined_rel, 6) AS score_first, round(f.rmse_rel, 6) AS rmse_rel_first, round(f.crps_rel, 6) AS crps_rel_first,
       f.rk AS rank_first, f.baseline_n - f.n_common AS failure_count_first, round(CAST(f.n_common AS DOUBLE) / f.baseline_n, 6) AS success_share_first,
       round(r.combined_rel, 6) AS score_revised, round(r.rmse_rel, 6) AS rmse_rel_revised, round(r.crps_rel, 6) AS crps_rel_revised,
       r.rk AS rank_revised, r.baseline_n - r.n_common AS failure_count_revised, round(CAST(r.n_common AS DOUBLE) / r.baseline_n, 6) AS success_share_revised,
       f.win AS first_winner, r.win AS revised_winner, round(r.combined_rel - f.combined_rel, 6) AS score_revision_shift,
       r.rk - f.rk AS rank_shift, f.win <> r.win AS winner_flipped
FROM sided f JOIN sided r ON f.truth_mode = 'first_release' AND r.truth_mode = 'latest' AND f.target = r.target AND f.horizon = r.horizon AND f.model = r.model"""
BOOK.add("e13", lambda s, d: rounded(E.revision_instability(Run(s, d).paired)), REVISIONS)
BOOK.add(
    "w03",
    lambda s, d: E.revision_instability(Run(s, d).paired).select("target", "horizon", "model", "rank_first", "rank_revised", "rank_shift"),
    REVISIONS.replace("SELECT f.target, f.horizon, f.model, round", "SELECT target, horizon, model, rank_first, rank_revised, rank_shift FROM (SELECT f.target, f.horizon, f.model, round") + ")",
)
REGIME_SQL = layer("paired") + """
SELECT model, round(er, 6) AS score_recession, round(ee, 6) AS score_expansion, round(eh, 6) AS score_high_volatility,
       round(en, 6) AS score_normal_volatility, round(er - ee, 6) AS recession_minus_expansion, round(eh - en, 6) AS highvol_minus_normal FROM (
  SELECT model, avg(combined_rel) FILTER (WHERE regime = 'recession') AS er, avg(combined_rel) FILTER (WHERE regime = 'expansion') AS ee,
         avg(combined_rel) FILTER (WHERE regime = 'high_volatility') AS eh, avg(combined_rel) FILTER (WHERE regime = 'normal_volatility') AS en
  FROM paired WHERE truth_mode = 'first_release' GROUP BY 1)"""
for _name in ("e14", "j13"):
    BOOK.add(_name, lambda s, d: rounded(E.regime_comparison(Run(s, d).paired, "first_release")), REGIME_SQL)
BOOK.add(
    "e15",
    lambda s, d: rounded(Run(s, d).dm.drop("p_holm", "significant_5pct_holm")),
    layer("dm") + "SELECT truth_mode, target, horizon, model, 'naive_last' AS baseline, n, round(dm_stat, 6) AS dm_stat, round(mean_loss_diff, 6) AS mean_loss_diff, round(p_value, 6) AS p_value FROM dm",
)
BOOK.add(
    "e16",
    lambda s, d: rounded(Run(s, d).dm.select("truth_mode", "target", "horizon", "model", "p_value", "p_holm", "significant_5pct_holm")),
    layer("dm") + """SELECT truth_mode, target, horizon, model, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm,
      coalesce(p_holm < 0.05, false) AS significant_5pct_holm FROM dm""",
)


def evaluated(spark, folder) -> dict[str, DataFrame]:
    run = Run(spark, folder)
    return E.finalize(run.ledger, run.panel, run.protocol)


BOOK.add("e17", lambda s, d: evaluated(s, d)["summary_facts"], layer("dm") + """,
cx AS (SELECT p.model, avg(CASE WHEN combined_rel < 1 THEN 1.0::DOUBLE ELSE 0 END) AS share, avg(combined_rel) AS score,
              (SELECT count(*) FILTER (WHERE p_holm < 0.05 AND mean_loss_diff < 0) - count(*) FILTER (WHERE p_holm < 0.05 AND mean_loss_diff > 0) FROM dm
               WHERE dm.truth_mode = 'first_release' AND dm.model = p.model) AS net
       FROM paired p WHERE truth_mode = 'first_release' AND regime = 'all' AND p.model <> 'naive_last' GROUP BY 1),
win AS (SELECT target, horizon, min_by(model, combined_rel) FILTER (WHERE truth_mode = 'first_release') AS a,
               min_by(model, combined_rel) FILTER (WHERE truth_mode = 'latest') AS b FROM paired WHERE regime = 'all' GROUP BY 1, 2)
SELECT 'best_model' AS fact, (SELECT model FROM board WHERE rank = 1) AS value
UNION ALL SELECT 'best_score', (SELECT printf('%.6f', score) FROM board WHERE rank = 1)
UNION ALL SELECT 'best_failures', (SELECT CAST(failure_count AS VARCHAR) FROM board WHERE rank = 1)
UNION ALL SELECT 'best_success_share', (SELECT printf('%.6f', CAST(common_origins AS DOUBLE) / baseline_origins) FROM board WHERE rank = 1)
UNION ALL SELECT 'models_beating_baseline', (SELECT CAST(count(*) FILTER (WHERE score < 1) AS VARCHAR) FROM board)
UNION ALL SELECT 'models', (SELECT CAST(count(*) AS VARCHAR) FROM board)
UNION ALL SELECT 'most_consistent_model', (SELECT model FROM cx ORDER BY share DESC, score, model LIMIT 1)
UNION ALL SELECT 'strongest_dm_record', (SELECT model FROM cx ORDER BY net DESC, score, model LIMIT 1)
UNION ALL SELECT 'winner_flips', (SELECT CAST(count(*) FILTER (WHERE a <> b) AS VARCHAR) FROM win)
UNION ALL SELECT 'cells', (SELECT CAST(count(*) AS VARCHAR) FROM win)
UNION ALL SELECT 'efficient_models', '' -- none: the baselines of this run have no measured runtime""")
