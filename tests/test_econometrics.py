"""Distributed moments against the dense dummy regression."""

import numpy as np
import pandas as pd
import pytest
from helpers import rows

from panelwright.plans import econometrics as R


def dense(frame, y, regressors, unit, period, clusters):
    dummies = [pd.get_dummies(frame[unit], drop_first=True, dtype=float), pd.get_dummies(frame[period], drop_first=True, dtype=float)]
    x = np.hstack([frame[regressors].to_numpy(float), np.ones((len(frame), 1)), *[d.to_numpy() for d in dummies]])
    bread = np.linalg.pinv(x.T @ x)
    coef = bread @ x.T @ frame[y].to_numpy(float)
    scores = x * (frame[y].to_numpy(float) - x @ coef)[:, None]
    total = np.zeros_like(bread)
    for sign, keys in clusters:
        sums = pd.DataFrame(scores).groupby([frame[k].to_numpy() for k in keys]).sum().to_numpy()
        g, (n, k) = len(sums), x.shape
        total += sign * g / (g - 1) * (n - 1) / (n - k) * bread @ sums.T @ sums @ bread
    m = len(regressors)
    return coef[:m], total[:m, :m]


def panel(keep=1.0, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for u in range(40):
        treated, start = u % 4 != 0, 5 + u % 6
        alpha = rng.normal()
        for t in range(1, 16):
            if rng.random() > keep:
                continue
            effect = 0.3 * max(t - start + 1, 0) if treated else 0
            data.append((u, t, float(start) if treated else None, alpha + 0.1 * t + effect + rng.normal(0, 0.3), treated, float(rng.normal())))
    return pd.DataFrame(data, columns=["unit_id", "period", "treat_period", "y", "treated", "x"])


def to_spark(spark, frame):
    records = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(records, "unit_id long, period int, treat_period double, y double, treated boolean, x double")


@pytest.mark.parametrize("keep, cluster", [(1.0, "unit"), (0.7, "two_way")], ids=["balanced", "unbalanced, two-way"])
def test_twfe_is_the_dense_regression(spark, keep, cluster):
    frame = panel(keep)
    df, times = R.event_dummies(to_spark(spark, frame))
    names = [*times, "x"]
    wide = frame.assign(**{n: ((frame.period - frame.treat_period == k) & frame.treated).astype(float) for n, k in times.items()})
    units, both = [(1, ["unit_id"])], [(1, ["unit_id"]), (1, ["period"]), (-1, ["unit_id", "period"])]
    coef, vcov = dense(wide, "y", names, "unit_id", "period", units if cluster == "unit" else both)
    fit = R.twfe(df, "y", names, "unit_id", "period", cluster)
    assert (fit.n_obs, fit.n_units, fit.n_periods) == (len(frame), 40, 15)
    assert np.allclose(fit.coef, coef, atol=1e-9)
    assert np.allclose(fit.vcov, vcov, atol=1e-9)


def test_more_periods_than_a_driver_would_solve(spark):
    rng = np.random.default_rng(9)
    data = []
    for u in range(60):
        begin = int(rng.integers(0, 4000))
        for t in sorted(set(rng.integers(begin, begin + 1000, 120).tolist())):
            data += [(u, t, None, 0.0, True, float(rng.normal() + 0.01 * u))] * (1 + (t % 97 == 0))
    frame = pd.DataFrame(data, columns=["unit_id", "period", "treat_period", "y", "treated", "x"])
    extra = pd.DataFrame([(70 + k % 3, k, None, 0.0, True, float(rng.normal())) for k in range(5000)], columns=frame.columns)
    frame = pd.concat([frame, extra], ignore_index=True)
    frame["y"] = frame.x * 0.7 + rng.normal(size=len(frame)) + np.sin(frame.period) + frame.unit_id / 9
    assert frame.period.nunique() == 5000
    fit = R.twfe(to_spark(spark, frame), "y", ["x"], "unit_id", "period", "unit")

    u, t = frame.unit_id.astype("category").cat.codes.to_numpy(), frame.period.to_numpy()
    units, v = int(u.max()) + 1, frame[["x", "y"]].to_numpy()
    counts, sums = np.zeros((units, 5000)), np.zeros((units, 2))
    np.add.at(counts, (u, t), 1)
    np.add.at(sums, u, v)
    size = counts.sum(axis=1)
    right = np.zeros((5000, 2))
    np.add.at(right, t, v - (sums / size[:, None])[u])
    normal = np.diag(counts.sum(axis=0)) - counts.T @ (counts / size[:, None])
    effect = np.vstack([np.zeros(2), np.linalg.solve(normal[1:, 1:], right[1:])])
    free = v - effect[t]
    mean = np.zeros((units, 2))
    np.add.at(mean, u, free)
    free -= (mean / size[:, None])[u]
    coef = free[:, 0] @ free[:, 1] / (free[:, 0] @ free[:, 0])
    score = np.zeros(units)
    np.add.at(score, u, free[:, 0] * (free[:, 1] - coef * free[:, 0]))
    n, params = len(frame), 1 + 1 + units - 1 + 4999
    error = np.sqrt(units / (units - 1) * (n - 1) / (n - params) * (score**2).sum()) / (free[:, 0] @ free[:, 0])
    assert (fit.n_obs, fit.n_units, fit.n_periods) == (n, units, 5000)
    assert fit.estimate("x") == pytest.approx((coef, error), rel=1e-8)


def test_event_study_shape(spark):
    got = R.event_study(to_spark(spark, panel())).orderBy("event_time").collect()
    assert [r.event_time for r in got] == [-5, -4, -3, -2, 0, 1, 2, 3, 4, 5, 6]
    assert all(r.ci_low == pytest.approx(r.estimate - 1.96 * r.std_error) for r in got)


def test_never_treated_and_outside_the_window_are_zero(spark):
    df, times = R.event_dummies(to_spark(spark, panel()))
    sums = df.selectExpr("treated", "event_time", "+".join(times) + " as s")
    assert sums.where("not treated and s > 0").count() == 0
    assert sums.where("event_time is null and treated").count() == 0
    assert sums.where("(event_time < -5 or event_time > 6 or event_time = -1) and s > 0").count() == 0
    assert sums.where("event_time between 0 and 6 and s != 1").count() == 0


def firm_data(spark):
    rng = np.random.default_rng(4)
    outcomes, covariates = [], []
    for firm in range(1, 61):
        alpha = rng.normal()
        for year in range(2018, 2026):
            post = int(firm <= 30 and year >= 2022)
            sales = max(0.0, float(rng.lognormal(7, 0.6)) - 500)
            mediator = 0.6 * post + float(rng.normal(0, 0.5))
            outcomes.append((firm, year, 17 + firm % 40, sales, post, mediator, alpha + 0.2 * (year - 2018) + 1.2 * post + 0.15 * np.log1p(sales) + float(rng.normal(0, 0.3))))
            if firm != 7:
                covariates.append((firm, year, firm % 5, 0.1 * (firm % 7)))
    covariates.append((10, 2020, 0, 99.0))
    o = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in outcomes], "firm_id long, year int, age int, sales double, treated_post int, mediator double, outcome double")
    return o, spark.createDataFrame(covariates, "firm_id long, year int, industry int, baseline_score double")


def test_corrected_firm_year_effect(spark):
    outcomes, covariates = firm_data(spark)
    sample, ledger = R.firm_year_sample(outcomes, covariates)
    assert dict(rows(ledger)) == {"age below 18": 8, "repeated covariate key": 1, "missing covariates, kept": 8}
    assert sample.where("firm_id = 10 and year = 2020").first().baseline_score == pytest.approx(0.3)
    fit = R.treatment_effect(outcomes, covariates)
    frame = sample.toPandas()
    coef, vcov = dense(frame, "outcome", ["treated_post", "log_sales"], "firm_id", "year", [(1, ["firm_id"])])
    assert fit.estimate("treated_post") == pytest.approx((coef[0], np.sqrt(vcov[0, 0])))
    assert fit.n_obs == 59 * 8
    assert fit.estimate("treated_post")[0] == pytest.approx(1.2, abs=0.3)


def test_defects_change_the_answer(spark):
    got = {r.variant: r for r in R.defect_sensitivity(*firm_data(spark)).collect()}
    assert got["age above 18"].n_obs < got["corrected"].n_obs < got["repeated covariate rows"].n_obs
    assert got["complete cases only"].n_obs == got["corrected"].n_obs - 8
    assert len({round(r.estimate, 6) for r in got.values()}) == len(got)
