"""Vintage tables against brute force over random revision histories."""

import json
import random
from datetime import date, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelwright.catalog.forecast import dated
from panelwright.plans import vintage as V
from panelwright.sources import tables as S

SERIES = ("barley", "cement", "freight")


def month_ends(first, last):
    day = first
    while day <= last:
        following = (day.replace(day=28) + timedelta(days=4)).replace(day=1)
        yield following - timedelta(days=1)
        day = following


def releases(seed):
    """(series, month, release day, value): one to five revisions on any days, some in one month."""
    rng = random.Random(seed)
    out = []
    for series in SERIES:
        for m in range(14):
            month = date(2011 + m // 12, m % 12 + 1, 1)
            days = sorted(rng.sample(range(20, 260), rng.randint(1, 5)))
            out += [(series, month, month + timedelta(days=d), round(rng.uniform(50, 90), 2)) for d in days]
    return out


def as_panel(spark, data):
    return V.vintage_panel(
        spark.createDataFrame([(s, str(m), str(v), str(x)) for s, m, v, x in data], "series_id string, observation_date string, vintage_date string, value string")
    )


def known(data, day):
    last = {}
    for s, m, v, x in sorted(data, key=lambda r: r[2]):
        if v <= day:
            last[s, m] = x
    return sorted((s, str(m), x) for (s, m), x in last.items())


def test_month_end_snapshots(spark):
    data = releases(1)
    low, high = date(2011, 3, 9), date(2012, 5, 31)
    shown = dated(V.snapshots(as_panel(spark, data), str(low), str(high))).collect()
    for day in month_ends(low, high):
        got = sorted((r.series_id, str(r.observation_date), r.value) for r in shown if str(r.vintage_date) == str(day))
        assert got == known(data, day)


def test_snapshots_at_any_days(spark):
    data = releases(2)
    days = [date(2011, 8, 17), date(2010, 12, 1), date(2011, 8, 18), date(2012, 11, 5), date(2030, 1, 1)]
    shown = V.snapshots_at(as_panel(spark, data), V.days_of(spark, [str(d) for d in days])).collect()
    for day in days:
        got = sorted((r.series_id, str(r.observation_date), r.value) for r in shown if r.cutoff == day)
        assert got == known(data, day)
    assert V.snapshots_at(as_panel(spark, data), V.days_of(spark, [])).count() == 0


def test_truth_modes(spark):
    data = releases(3)
    panel = as_panel(spark, data)
    for mode, pick in (("first_release", min), ("latest", max)):
        want = {}
        for s, m, v, x in data:
            want.setdefault((s, str(m)), []).append((v, x))
        got = {(r.series_id, str(r.observation_date)): r.value for r in V.truth(panel, mode).collect()}
        assert got == {k: pick(r)[1] for k, r in want.items()}
    with pytest.raises(ValueError):
        V.truth(panel, "average")


def test_rows_without_numbers_are_no_releases(spark):
    raw = [("barley", "2011-01-01", "2011-02-11", text) for text in (".", "NaN", "", "n/a")]
    assert as_panel(spark, raw).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        V.vintage_panel(spark.range(1))


def payload(entries):
    names = ("date", "realtime_start", "realtime_end", "value")
    return {"series_id": "cement", "count": len(entries), "observations": [{n: v for n, v in zip(names, e, strict=True) if v is not None} for e in entries]}


ENTRIES = [
    ("2011-06-01", "2011-07-14", "2011-08-13", "61.5"),
    ("2011-06-01", "2011-08-14", None, "63"),
    ("2011-07-01", "2011-08-14", "2011-09-11", "."),
    ("2011-07-01", "2011-09-12", "", "58.25"),
    ("2011-08-01", None, None, "70"),
]


def test_revision_payload(spark, tmp_path):
    (tmp_path / "cement.json").write_text(json.dumps(payload(ENTRIES)))
    history = S.read_revision_json(spark, str(tmp_path / "cement.json"))
    got = sorted((str(r.observation_date), str(r.realtime_start), str(r.realtime_end), r.value) for r in history.collect())
    assert got == [
        ("2011-06-01", "2011-07-14", "2011-08-13", 61.5),
        ("2011-06-01", "2011-08-14", "9999-12-31", 63.0),
        ("2011-07-01", "2011-08-14", "2011-09-11", None),
        ("2011-07-01", "2011-09-12", "9999-12-31", 58.25),
    ]
    assert sorted((str(r.vintage_date), r.value) for r in V.initial_release(history).collect()) == [("2011-07-14", 61.5), ("2011-09-12", 58.25)]
    (tmp_path / "cut.json").write_text(json.dumps(payload(ENTRIES) | {"count": 6}))
    with pytest.raises(Exception, match="truncated revision history for cement"):
        S.read_revision_json(spark, str(tmp_path / "cut.json")).collect()


def intervals(spark, *parts):
    text = spark.createDataFrame([("freight", "2011-04-01", *p) for p in parts], "series_id string, o string, a string, b string, value double")
    return text.select(
        "series_id", F.to_date("o").alias("observation_date"), F.to_date("a").alias("realtime_start"), F.to_date("b").alias("realtime_end"), "value"
    )


def shown(history, first, last):
    return sorted((str(r.vintage_date), r.value) for r in V.snapshot_from_history(history, V.month_ends(history.sparkSession, first, last)).collect())


def test_withdrawn_value_stays_withdrawn(spark):
    history = intervals(spark, ("2011-05-19", "2011-06-20", 7.5), ("2011-06-21", "9999-12-31", None))
    assert shown(history, "2011-05-01", "2011-07-31") == [("2011-05-31", 7.5)]


def test_of_overlapping_intervals_the_later_start_counts(spark):
    history = intervals(spark, ("2011-05-02", "9999-12-31", 3.25), ("2011-05-23", "2011-06-11", 4.75))
    assert shown(history, "2011-05-01", "2011-06-30") == [("2011-05-31", 4.75), ("2011-06-30", 3.25)]


def test_history_at_any_days_is_brute_force(spark):
    rng = random.Random(11)
    base = date(2012, 1, 1)
    history = []
    for s in ("barley", "cement"):
        for k in range(60):
            start = base + timedelta(days=rng.randrange(90))
            end = rng.choice([None, date(9999, 12, 31), start + timedelta(days=rng.randrange(30))])
            history.append((s, date(2011, 1 + k % 4, 1), start, end, rng.choice([None, float(k)])))
    history = list({(h[0], h[1], h[2]): h for h in history}.values())  # a start is unique per observation
    days = [base + timedelta(days=d) for d in (0, 3, 17, 44, 45, 46, 200)] + [base - timedelta(days=9), base + timedelta(days=3)]
    df = spark.createDataFrame(history, "series_id string, observation_date date, realtime_start date, realtime_end date, value double")
    got = sorted((r.series_id, r.observation_date, r.vintage_date, r.value) for r in V.snapshot_from_history(df, V.days_of(spark, [str(d) for d in days])).collect())
    want = []
    for key in {h[:2] for h in history}:
        for day in set(days):
            active = [h for h in history if h[:2] == key and h[2] <= day and (h[3] is None or day <= h[3])]
            if active and (value := max(active, key=lambda h: h[2])[4]) is not None:
                want.append((*key, day, value))
    assert got == sorted(want) and len(got) > 8


def test_short_series_has_no_volatility_regime(spark):
    short = spark.createDataFrame([("freight", 30 + i, 1.5 * i) for i in range(6)], "target string, month_idx int, value double")
    assert {r.vol_regime for r in V.volatility_regime(short).collect()} == {"unknown"}


def test_leakage_check_counts_each_kind(spark):
    schema = "target string, cutoff_idx int, origin_idx int, horizon int, target_idx int"
    moves = [("barley", 40, 38, 2, 40), ("barley", 41, 44, 2, 46), ("barley", 42, 37, 2, 37), ("cement", 40, 39, 2, 41)]
    got = V.assert_no_leakage(spark.createDataFrame(moves, schema))
    assert rows(got, "check", "n_violations") == [("label not after origin", 1), ("origin after cutoff", 1), ("origin moves back", 1)]
