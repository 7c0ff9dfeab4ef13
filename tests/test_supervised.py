"""Supervised origins against a plain pandas rebuild of one snapshot at a time."""

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelwright.functions.cleaning import month_index
from panelwright.plans import models, vintage
from panelwright.plans.supervised import US_MONTHLY, Protocol, Supervised

PROTOCOL = Protocol(
    targets={"Y": "diff", "Z": "level"}, predictors=("X", "LATE"), vintage_start="2001-01-31", vintage_end="2003-08-31",
    recession_indicator="REC", horizons=(1, 3), lags=2, max_staleness=2, min_train=20,
)


def wave(i, k):
    return float(np.sin(i * 0.7 + k) * 3 + 0.1 * i * k + ((i * 7919 + k * 104729) % 13) / 7)


@pytest.fixture(scope="module")
def source():
    data = []
    for i, month in enumerate(pd.date_range("1999-01-01", periods=56, freq="MS")):
        release = month + pd.offsets.MonthEnd(0)
        for k, series in enumerate(("Y", "Z", "X", "LATE", "REC")):
            if series == "LATE" and (i < 30 or i in (40, 41, 44)):
                continue
            if series == "X" and i % 9 == 4:
                continue
            value = float(i % 17 < 5) if series == "REC" else wave(i, k)
            data.append((series, month, release, value))
            if series != "REC":
                data.append((series, month, month + pd.offsets.MonthEnd(4), value + 0.05 * (k + 1)))
    return pd.DataFrame(data, columns=["series_id", "observation_date", "vintage_date", "value"])


@pytest.fixture(scope="module")
def data(spark, source):
    text = source.astype({"observation_date": str, "vintage_date": str})
    return Supervised(vintage.vintage_panel(spark.createDataFrame(text)), PROTOCOL)


def expected(source):
    """One snapshot at a time, the long way."""
    seen, out = set(), []
    for cutoff in pd.date_range(PROTOCOL.vintage_start, PROTOCOL.vintage_end, freq="ME"):
        known = source[source.vintage_date <= cutoff].sort_values("vintage_date")
        wide = known.groupby(["observation_date", "series_id"]).value.last().unstack().asfreq("MS")
        for target, kind in PROTOCOL.targets.items():
            y = wide[target].diff() if kind == "diff" else wide[target]
            origin = y.last_valid_index()
            x = pd.DataFrame({f"y{k}": y.shift(k) for k in range(1, PROTOCOL.lags + 1)})
            block = pd.DataFrame({"y": y})
            for p in PROTOCOL.predictors:
                if p in wide:
                    filled = wide[p].ffill(limit=PROTOCOL.max_staleness)
                    block[p] = filled
                    for k in range(PROTOCOL.lags):
                        x[f"{p}{k}"] = filled.shift(k)
            block = block.loc[:origin].dropna()
            ready = {}
            for h in {1, *PROTOCOL.horizons}:
                train = x.assign(label=y.shift(-h)).loc[:origin].dropna()
                ready[h] = (len(train) >= 20 and len(block) >= 20 and not x.loc[origin].isna().any(), train)
            if not ready[1][0] or (target, origin) in seen:
                continue
            seen.add((target, origin))
            for h in PROTOCOL.horizons:
                if ready[h][0]:
                    out.append((target, cutoff, origin, h, y.loc[:origin].dropna(), ready[h][1], x.loc[origin], block))
    return out


def index(day):
    return day.year * 12 + day.month - 1


def test_origins_match_the_plain_loop(data, source):
    want = sorted((t, index(c), index(o), h, index(o) + h, len(train)) for t, c, o, h, _, train, _, _ in expected(source))
    assert rows(data.origins) == want
    assert len(want) > 20


def test_feature_rows_match(data, source):
    built = data.selected_rows.toPandas()
    for t, c, o, h, y, train, x_new, block in expected(source)[::7]:
        group = built[(built.target == t) & (built.cutoff_idx == index(c))].sort_values("month_idx")
        used = group[group.x_complete & group[f"label_{h}"].notna()]
        assert np.allclose(np.array(used.x.tolist(), float), train.drop(columns="label").to_numpy())
        assert np.allclose(used[f"label_{h}"], train.label)
        assert np.allclose(np.array(group.iloc[-1].x, float), x_new.to_numpy())
        assert np.allclose(np.array(group[group.mv_complete].mv.tolist(), float), block.to_numpy())
        assert np.allclose(group.y.dropna(), y)


def test_baselines_match_the_plain_loop(data, source):
    got = {(r.target, r.origin_idx, r.horizon, r.model): (r.forecast, r.sigma) for r in models.baseline_forecasts(data).collect()}

    def sd(v):
        return 1.0 if len(v) < 3 else max(v.std(ddof=1), 1e-8)

    for t, _, o, h, y, *_ in expected(source):
        v = y.to_numpy()
        season = y.diff(12).dropna()
        step = sd(y.diff().dropna()) * np.sqrt(h)
        want = {
            "mean": (v.mean(), sd(y - y.mean())),
            "naive_last": (v[-1], step),
            "naive_drift": (v[-1] + h * (v[-1] - v[0]) / (len(v) - 1), step),
            "seasonal_naive": (v[max(len(v) - 12 + (h - 1) % 12, 0)], sd(season if len(season) else y.diff().dropna())),
        }
        for model, pair in want.items():
            assert np.allclose(got[t, index(o), h, model], pair)
    assert len(got) == 4 * len(expected(source))


def test_forecasts_do_not_depend_on_the_cells_run_together(spark, data):
    from dataclasses import replace

    whole = models.baseline_forecasts(data)
    parts = None
    for target, kind in PROTOCOL.targets.items():
        for h in PROTOCOL.horizons:
            cell = Supervised(data.panel, replace(PROTOCOL, targets={target: kind}, horizons=(h,)))
            made = models.baseline_forecasts(cell)
            parts = made if parts is None else parts.unionByName(made)
    assert rows(parts) == rows(whole)


def test_published_protocol_is_frozen():
    assert US_MONTHLY.horizons == (1, 3, 6, 12)
    assert (US_MONTHLY.lags, US_MONTHLY.max_staleness, US_MONTHLY.min_train, US_MONTHLY.seed) == (12, 3, 72, 1729)
    assert US_MONTHLY.leaderboard_truth == "first_release"


def test_month_index_of_first_origin(spark):
    assert rows(spark.sql("select date'2001-01-31' as d").select(month_index(F.col("d")))) == [(2001 * 12,)]
