"""Two-way fixed-effects regressions of any number of units and periods.

Rows and effects stay in Spark. Units are swept out as group means. What is left of the periods is a system with
one equation per period, solved for all columns at once by conjugate gradients: a step joins the current
direction to the (unit, period) cells, averages by unit and adds up by period. The driver sees a few numbers per
column and step, and matrices of the number of regressors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators.joins import join_one_to_one, merge_covariates, restrict
from panelwright.runtime import stage

TOLERANCE = 1e-11  # of the residual's length, for each column
MAX_STEPS = 1000


def event_time(df: DataFrame) -> DataFrame:
    """Periods since treatment; NULL for units that are never treated."""
    return df.withColumn("event_time", F.col("period") - F.col("treat_period"))


def dummy_name(k: int) -> str:
    return f"event_m{-k}" if k < 0 else f"event_p{k}"


def event_dummies(df: DataFrame, lo: int = -5, hi: int = 6, reference: int = -1) -> tuple[DataFrame, dict[str, int]]:
    """0/1 columns per event time but the reference. Never-treated rows and event times outside
    the window are 0 in all of them."""
    times = {dummy_name(k): k for k in range(lo, hi + 1) if k != reference}
    timed = event_time(df)
    hit = {n: F.when((F.col("event_time") == k) & F.col("treated"), 1.0).otherwise(0.0) for n, k in times.items()}
    return timed.select("*", *[c.alias(n) for n, c in hit.items()]), times


@dataclass(frozen=True)
class Fit:
    """Coefficients, covariance of the chosen clustering and sample sizes."""

    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n_obs: int
    n_units: int
    n_periods: int

    def estimate(self, name: str) -> tuple[float, float]:
        """Coefficient and standard error by name, never by position."""
        i = self.names.index(name)
        return float(self.coef[i]), float(np.sqrt(self.vcov[i, i]))


def _combined(a: str, b: str, factor: np.ndarray) -> Column:
    """``a + factor * b`` of array columns."""
    return F.array(*[F.col(a)[j] + F.lit(float(f)) * F.col(b)[j] for j, f in enumerate(factor)])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


@dataclass(frozen=True)
class Absorbed:
    """Period effects of each column (``period, effect``) and sizes of the panel."""

    effects: DataFrame
    n_obs: int
    n_units: int
    n_periods: int


def absorb(data: DataFrame, columns: list[str], unit: str, period: str) -> Absorbed:
    """An effect per period and column that leaves, together with unit means, each column's residual on unit and
    period effects. Effects are fixed up to a constant per connected part of the panel.

    Conjugate gradients on the period sums of the unit-demeaned columns, scaled by period sizes, with one
    reduction per step. A balanced panel takes one step.
    """
    k = len(columns)
    vector = lambda f: F.array(*[f(j) for j in range(k)])
    units = data.groupBy(unit).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    cells = data.groupBy(unit, period).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    swept = vector(lambda j: F.col(f"_s{j}") - F.col("n") * F.col(f"_m{j}"))
    cells = stage(cells.join(units, unit).select(unit, period, "n", "size", swept.alias("v")))

    def advanced(rows: DataFrame) -> tuple[DataFrame, dict]:
        """``rows`` with ``s``, the system applied to ``z``, landed; sizes and products are taken on the way."""
        mean = vector(lambda j: F.sum(F.col("n") * F.col("z")[j]) / F.first("size"))
        means = cells.join(rows.select(period, "z"), period).groupBy(unit).agg(mean.alias("m"))
        taken = cells.join(means, unit).groupBy(period).agg(vector(lambda j: F.sum(F.col("n") * F.col("m")[j])).alias("t"))
        applied = rows.join(taken, period).withColumn("s", vector(lambda j: F.col("weight") * F.col("z")[j] - F.col("t")[j])).drop("t")
        dots = [F.sum(F.col(a)[j] * F.col(b)[j]).alias(f"{a}{b}{j}") for a, b in ("rr", "rz", "zs") for j in range(k)]
        seen = Observation()
        landed = stage(applied.observe(seen, F.sum("weight").alias("n"), F.sum("share").alias("units"), F.count(F.lit(1)).alias("periods"), *dots))
        return landed, seen.get

    scaled = F.transform("r", lambda x: x / F.col("weight"))
    sums = cells.groupBy(period).agg(F.sum("n").alias("weight"), F.sum(F.col("n") / F.col("size")).alias("share"), vector(lambda j: F.sum(F.col("v")[j])).alias("r"))
    zero = vector(lambda j: F.lit(0.0))
    now, row = advanced(stage(sums.withColumns({"x": zero, "z": scaled, "p": zero, "q": zero})))
    first = alpha = gamma = None
    for _ in range(MAX_STEPS):
        rr, rz, zs = (np.array([row[f"{name}{j}"] or 0.0 for j in range(k)]) for name in ("rr", "rz", "zs"))
        first = rr if first is None else first
        going = rr > TOLERANCE**2 * first
        if not going.any():
            return Absorbed(now.select(period, F.col("x").alias("effect")), int(row["n"] or 0), round(row["units"] or 0), int(row["periods"]))
        rz = np.where(going, rz, 0.0)  # a column that is done takes no more steps
        beta = np.zeros(k) if gamma is None else _ratio(rz, gamma)
        alpha = _ratio(rz, zs if gamma is None else zs - beta * _ratio(rz, alpha))
        gamma = rz
        turned = now.withColumns({"p": _combined("z", "p", beta), "q": _combined("s", "q", beta)}).drop("s")
        moved = turned.withColumns({"x": _combined("x", "p", alpha), "r": _combined("r", "q", -alpha)})
        now, row = advanced(moved.withColumn("z", scaled))
    raise ArithmeticError(f"period effects did not settle in {MAX_STEPS} steps")


def _sandwich(scores: DataFrame, cluster: list[str], k: int) -> tuple[np.ndarray, int]:
    """Outer products of score sums per cluster."""
    sums = scores.groupBy(*cluster).agg(*[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(k)])
    products = [F.sum(F.col(f"_g{i}") * F.col(f"_g{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]
    row = sums.agg(F.count("*").alias("g"), *products).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    return meat, int(row["g"])


def twfe(df: DataFrame, y: str, regressors: list[str], unit: str, period: str, cluster: str = "unit") -> Fit:
    """OLS of ``y`` on ``regressors`` with unit and period effects.

    ``cluster``: ``unit``, or ``two_way`` (unit + period - intersection). Each part carries the
    factor G/(G-1) * (N-1)/(N-K) where K counts all absorbed effects.
    """
    columns = [*regressors, y]
    data = stage(df.select(unit, period, *[F.col(c).cast("double").alias(c) for c in columns]))
    k = len(regressors)
    absorbed = absorb(data, columns, unit, period)
    n_obs, n_units, t = absorbed.n_obs, absorbed.n_units, absorbed.n_periods
    free = data.join(absorbed.effects, period).select(unit, period, *[(F.col(c) - F.col("effect")[i]).alias(f"_v{i}") for i, c in enumerate(columns)])
    means = free.groupBy(F.col(unit).alias("_u")).agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(k + 1)])
    swept = stage(free.join(means, F.col(unit) == F.col("_u")).select(unit, period, *[(F.col(f"_v{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(k + 1)]))

    squares = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"m{i}_{j}") for i in range(k + 1) for j in range(i + 1)]
    row = swept.agg(*squares).first()
    moments = np.array([[row[f"m{max(i, j)}_{min(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    bread = np.linalg.pinv(moments[:k, :k], hermitian=True)
    coef = bread @ moments[:k, k]

    error = F.col(f"_x{k}")
    for i, b in enumerate(coef):
        error = error - F.lit(float(b)) * F.col(f"_x{i}")
    scores = swept.select(unit, period, *[(F.col(f"_x{i}") * error).alias(f"_g{i}") for i in range(k)])

    n_params = k + 1 + (n_units - 1) + (t - 1)

    def part(keys: list[str], rows: DataFrame) -> np.ndarray:
        meat, groups = _sandwich(rows, keys, k)
        factor = groups / (groups - 1) * (n_obs - 1) / (n_obs - n_params)
        return factor * bread @ meat @ bread

    if cluster == "unit":
        vcov = part([unit], scores)
    elif cluster == "two_way":
        scores = stage(scores)
        vcov = part([unit], scores) + part([period], scores) - part([unit, period], scores)
    else:
        raise ValueError("cluster must be 'unit' or 'two_way'")
    return Fit(list(regressors), coef, vcov, n_obs, n_units, t)


# -- event study ------------------------------------------------------------------------------------

EVENT_SCHEMA = "event_time int, estimate double, std_error double, ci_low double, ci_high double"


def event_study(df: DataFrame, lo: int = -5, hi: int = 6, reference: int = -1, cluster: str = "unit") -> DataFrame:
    """Leads and lags around treatment with unit and period effects and 95 % intervals."""
    data, times = event_dummies(df, lo, hi, reference)
    fit = twfe(data, "y", list(times), "unit_id", "period", cluster)
    rows = []
    for name, k in times.items():
        b, se = fit.estimate(name)
        rows.append((k, b, se, b - 1.96 * se, b + 1.96 * se))
    return df.sparkSession.createDataFrame(rows, EVENT_SCHEMA)  # one row per event time


def event_study_robust(df: DataFrame) -> DataFrame:
    """The narrower window, and two-way clustering of the main one."""
    narrow = event_study(df, -4, 5).withColumn("variant", F.lit("window -4..+5"))
    two_way = event_study(df, cluster="two_way").withColumn("variant", F.lit("two-way clusters"))
    return narrow.unionByName(two_way)


def demeaned_moments(df: DataFrame, y: str, regressors: list[str], unit: str, period: str) -> DataFrame:
    """Two-way demeaned cross products of a balanced panel as ``a, b, moment`` rows."""
    columns = [*regressors, y]
    data = df.select(unit, period, *[F.col(c).cast("double").alias(c) for c in columns])
    by_unit = data.groupBy(F.col(unit).alias("_u")).agg(*[F.avg(c).alias(f"{c}_u") for c in columns])
    by_period = data.groupBy(F.col(period).alias("_t")).agg(*[F.avg(c).alias(f"{c}_t") for c in columns])
    overall = {c: data.agg(F.avg(c)).scalar() for c in columns}
    joined = data.join(by_unit, F.col(unit) == F.col("_u")).join(by_period, F.col(period) == F.col("_t"))
    clean = joined.select(*[(F.col(c) - F.col(f"{c}_u") - F.col(f"{c}_t") + overall[c]).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = clean.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m{i}").alias("moment")) for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(listed).alias("r")).select("r.a", "r.b", "r.moment")


# -- firm-year effect -----------------------------------------------------------------------------------

KEYS = ["firm_id", "year"]
RESULT_SCHEMA = "variant string, estimate double, std_error double, n_obs bigint"


def firm_year_sample(outcomes: DataFrame, covariates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adults only, one covariate row per key, log sales, flagged missing covariates; and the ledger."""
    keep = [F.abs("baseline_score"), F.col("baseline_score")]
    merged, repeated = join_one_to_one(outcomes, covariates, KEYS, on_dup="report", keep=keep)
    flagged = merged.withColumns(
        {"missing_covariate": F.when(F.col("baseline_score").isNull(), 1).otherwise(0), "log_sales": F.log1p("sales")}
    )
    adults, dropped = restrict(flagged, F.col("age") >= 18, "age below 18")
    ledger = dropped.unionByName(
        repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")).select(
            F.lit("repeated covariate key").alias("reason"), "rows"
        )
    ).unionByName(
        adults.agg(F.sum("missing_covariate").alias("rows")).select(F.lit("missing covariates, kept").alias("reason"), "rows")
    )
    return adults, ledger


def treatment_effect(outcomes: DataFrame, covariates: DataFrame) -> Fit:
    """Effect of ``treated_post`` with log sales, firm and year effects, clustered by firm.

    No post-treatment mediator and no lagged outcome; outcomes without covariates stay in.
    """
    sample, _ = firm_year_sample(outcomes, covariates)
    return twfe(sample, "outcome", ["treated_post", "log_sales"], "firm_id", "year")


def defect_sensitivity(outcomes: DataFrame, covariates: DataFrame) -> DataFrame:
    """The treatment coefficient of the corrected design and under single defects."""
    spark = outcomes.sparkSession
    sample, _ = firm_year_sample(outcomes, covariates)
    sample = stage(sample)
    base = ["treated_post", "log_sales"]
    # (firm, year) is unique, so a firm's window is its calendar years.
    lagged = sample.withColumn(
        "lag_outcome", F.lag("outcome").over(Window.partitionBy("firm_id").orderBy("year"))
    ).where(F.col("lag_outcome").isNotNull())
    fanned = merge_covariates(outcomes, covariates, KEYS, "baseline_score").where(F.col("age") >= 18)
    variants = {
        "corrected": (sample, base),
        "age above 18": (sample.where(F.col("age") > 18), base),
        "log without zero sales": (sample.where(F.col("sales") > 0).withColumn("log_sales", F.ln("sales")), base),
        "complete cases only": (sample.where(F.col("missing_covariate") == 0), base),
        "mediator controlled": (sample, [*base, "mediator"]),
        "lagged outcome controlled": (lagged, [*base, "lag_outcome"]),
        "repeated covariate rows": (fanned.withColumn("log_sales", F.log1p("sales")), base),
    }
    rows = []
    for name, (data, regressors) in variants.items():
        fit = twfe(data, "outcome", regressors, "firm_id", "year")
        rows.append((name, *fit.estimate("treated_post"), fit.n_obs))
    return spark.createDataFrame(rows, RESULT_SCHEMA)  # one row per variant

