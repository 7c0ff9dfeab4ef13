"""Event study and firm-year regressions."""

from __future__ import annotations


from panelwright.catalog.basics import FIRM_YEAR, PANEL_ES
from panelwright.catalog.book import BOOK
from panelwright.catalog.ctes import with_
from panelwright.catalog.forecast import rounded
from panelwright.plans import econometrics as R
from panelwright.sources.derived import event_study_panel, firm_year
from panelwright.sources.tables import Tables

WINDOW = [k for k in range(-5, 7) if k != -1]
DUMMIES = ", ".join(
    f"CASE WHEN treated AND period - treat_period = {k} THEN 1.0::DOUBLE ELSE 0 END AS {R.dummy_name(k)}" for k in WINDOW
)


def es(spark, folder):
    return event_study_panel(Tables(spark, folder))


def r01(spark, folder):
    data, times = R.event_dummies(es(spark, folder))
    return data.select("unit_id", "period", *times)


BOOK.add("r01", r01, with_(PANEL_ES) + f"SELECT unit_id, period, {DUMMIES} FROM es_panel")


def r02(spark, folder):
    data, times = R.event_dummies(es(spark, folder))
    return rounded(R.demeaned_moments(data, "y", list(times), "unit_id", "period"), 4)


_NAMES = [*map(R.dummy_name, WINDOW), "y"]
_CLEAN = ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY unit_id) - avg({c}) OVER (PARTITION BY period) + avg({c}) OVER () AS {c}" for c in _NAMES
)
_MOMENTS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 4) AS moment FROM clean" for i, a in enumerate(_NAMES) for b in _NAMES[i:]
)
BOOK.add("r02", r02, with_(PANEL_ES, f"d AS (SELECT unit_id, period, y, {DUMMIES} FROM es_panel)", f"clean AS (SELECT {_CLEAN} FROM d)") + _MOMENTS)


def regression(name: str, rows: str, regressors: list[str], unit: str, period: str, y: str = "y", clusters: str = "unit") -> str:
    """CTEs ``{name}_coef (i, b)``, ``{name}_vcov (i, j, v)`` and ``{name}_size (n, units, periods)``: dense normal equations.

    Periods are explicit regressors, units are demeaned, and the equations are solved by elimination in a recursion.
    """
    meats = {"unit": [("unit", 1)], "two_way": [("unit", 1), ("period", 1), ("unit, period", -1)]}[clusters]
    k = len(regressors)
    parts = " UNION ALL ".join(
        f"""SELECT x.j AS i, z.j AS j, {sign} * sum(x.g * z.g) * any_value(c.groups / (c.groups - 1) * (n - 1) / (n - {k} - units - periods + 1)) AS v
        FROM (SELECT {key}, j, sum(g) AS g FROM {name}_score GROUP BY {key}, j) x JOIN (SELECT {key}, j, sum(g) AS g FROM {name}_score GROUP BY {key}, j) z USING ({key}),
             (SELECT count(DISTINCT ({key})) AS groups FROM {name}_d) c, {name}_size GROUP BY ALL"""
        for key, sign in meats
    )
    return f"""
{name}_d AS (SELECT row_number() OVER () AS rid, {unit} AS unit, {period} AS period, [{", ".join(f"CAST({c} AS DOUBLE)" for c in regressors)}] AS x, CAST({y} AS DOUBLE) AS y FROM ({rows})),
{name}_size AS (SELECT count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT period) AS periods FROM {name}_d),
{name}_p AS (SELECT list(DISTINCT period ORDER BY period) AS ps FROM {name}_d),
{name}_w AS (SELECT rid, unit, period, x || list_transform(ps[2:], lambda p: CASE WHEN period = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) || [y] AS v FROM {name}_d, {name}_p),
{name}_l AS (SELECT rid, unit, period, unnest(v) AS v, generate_subscripts(v, 1) AS j, len(v) - 1 AS k FROM {name}_w),
{name}_c AS (SELECT rid, unit, period, j, k, v - avg(v) OVER (PARTITION BY unit, j) AS v FROM {name}_l),
{name}_m AS (SELECT a.j AS i, b.j AS j, a.k AS k, sum(a.v * b.v) AS m FROM {name}_c a JOIN {name}_c b USING (rid) GROUP BY ALL),
{name}_a AS (SELECT i, k, list(m ORDER BY j) || list_transform(range(1, k + 1), lambda q: CASE WHEN q = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM {name}_m WHERE i <= k GROUP BY i, k),
{name}_e(s, k, m) AS (SELECT 1, k, list(r ORDER BY i) FROM {name}_a GROUP BY k UNION ALL
  SELECT s + 1, k, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda x: x / top[s]) ELSE list_transform(r, lambda x, j: x - r[s] * top[j] / top[s]) END)
  FROM (SELECT s, k, m, m[s] AS top FROM {name}_e WHERE s <= k)),
{name}_r AS (SELECT unnest(m) AS r, generate_subscripts(m, 1) AS i, k FROM {name}_e WHERE s = k + 1),
{name}_coef AS (SELECT i, r[k + 1] AS b FROM {name}_r),
{name}_bread AS (SELECT i, unnest(r[k + 2:]) AS v, generate_subscripts(r[k + 2:], 1) AS j FROM {name}_r),
{name}_u AS (SELECT rid, sum(CASE WHEN j > k THEN v ELSE -v * b END) AS e FROM {name}_c LEFT JOIN {name}_coef ON i = j GROUP BY rid),
{name}_score AS (SELECT unit, period, j, sum(v * e) AS g FROM {name}_c JOIN {name}_u USING (rid) WHERE j <= k GROUP BY ALL),
{name}_meat AS (SELECT i, j, sum(v) AS v FROM ({parts}) GROUP BY i, j),
{name}_vcov AS (SELECT a.i AS i, c.j AS j, sum(a.v * m.v * c.v) AS v FROM {name}_bread a JOIN {name}_meat m ON a.j = m.i JOIN {name}_bread c ON c.i = m.j
  WHERE a.i <= {k} AND c.j <= {k} GROUP BY ALL)"""


_ES = f"SELECT unit_id, period, y, {DUMMIES} FROM es_panel"
_TIMES = [*map(R.dummy_name, WINDOW)]


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + with_(*ctes).removeprefix("WITH ")


def study(name: str, window: list[int]) -> str:
    """Rows of an event study from the CTEs of ``name``."""
    times = ", ".join(f"({n}, {k})" for n, k in enumerate(window, 1))
    return f"""SELECT CAST(t.k AS INT) AS event_time, round(b, 6) AS estimate, round(sqrt(v), 6) AS std_error, round(b - 1.96::DOUBLE * sqrt(v), 6) AS ci_low,
  round(b + 1.96::DOUBLE * sqrt(v), 6) AS ci_high FROM {name}_coef c JOIN {name}_vcov q ON q.i = c.i AND q.j = c.i JOIN (VALUES {times}) t(i, k) ON t.i = c.i"""


def r03(spark, folder):
    """Covariance matrix of the event-time coefficients, clustered by unit."""
    data, times = R.event_dummies(es(spark, folder))
    fit = R.twfe(data, "y", list(times), "unit_id", "period")
    rows = [(a, b, float(fit.vcov[i, j])) for i, a in enumerate(fit.names) for j, b in enumerate(fit.names)]
    return rounded(spark.createDataFrame(rows, "a string, b string, covariance double"), 6)  # one row per pair of regressors


_NAMED = f"(SELECT unnest({_TIMES}) AS a, generate_subscripts({_TIMES}, 1) AS i)"
BOOK.add("r03", r03, recursive(PANEL_ES, regression("f", _ES, _TIMES, "unit_id", "period")) + f"""
SELECT x.a AS a, z.a AS b, round(v, 6) AS covariance FROM f_vcov JOIN {_NAMED} x USING (i) JOIN {_NAMED} z ON z.i = f_vcov.j""")
BOOK.add("r04", lambda s, d: rounded(R.event_study(es(s, d)), 6), recursive(PANEL_ES, regression("f", _ES, _TIMES, "unit_id", "period")) + study("f", WINDOW))
_NARROW = [k for k in range(-4, 6) if k != -1]
BOOK.add(
    "r05",
    lambda s, d: rounded(R.event_study_robust(es(s, d)), 6),
    recursive(PANEL_ES, regression("f", _ES, [R.dummy_name(k) for k in _NARROW], "unit_id", "period"), regression("g", _ES, _TIMES, "unit_id", "period", clusters="two_way"))
    + f"SELECT *, 'window -4..+5' AS variant FROM ({study('f', _NARROW)}) UNION ALL SELECT *, 'two-way clusters' FROM ({study('g', WINDOW)})",
)

_SAMPLE = "SELECT f.*, ln(1 + sales) AS log_sales, baseline_score FROM firm_year f LEFT JOIN covariate c ON c.firm_id = f.firm_id AND c.year = f.year WHERE age >= 18"
_BASE = ["treated_post", "log_sales"]


def r06(spark, folder):
    fit = R.treatment_effect(*firm_year(Tables(spark, folder)))
    return rounded(spark.createDataFrame([(*fit.estimate("treated_post"), fit.n_obs)], "estimate double, std_error double, n_obs bigint"), 6)


def effect(name: str, label: str | None = None) -> str:
    said = f"'{label}' AS variant, " if label else ""
    return f"SELECT {said}round(b, 6) AS estimate, round(sqrt(v), 6) AS std_error, n AS n_obs FROM {name}_coef c JOIN {name}_vcov q ON q.i = c.i AND q.j = c.i, {name}_size WHERE c.i = 1"


BOOK.add("r06", r06, recursive(FIRM_YEAR, regression("f", _SAMPLE, _BASE, "firm_id", "year", "outcome")) + effect("f"))
BOOK.add("r06_sample", lambda s, d: R.firm_year_sample(*firm_year(Tables(s, d)))[1], with_(FIRM_YEAR) + """
SELECT 'age below 18' AS reason, count(*) FILTER (WHERE age < 18) AS rows FROM firm_year
UNION ALL SELECT 'repeated covariate key', count(*) - count(DISTINCT (firm_id, year)) FROM covariate_file
UNION ALL SELECT 'missing covariates, kept', count(*) FROM firm_year f WHERE age >= 18 AND NOT EXISTS (
  SELECT 1 FROM covariate c WHERE c.firm_id = f.firm_id AND c.year = f.year)""")
_VARIANTS = {
    "corrected": (_SAMPLE, _BASE),
    "age above 18": (f"SELECT * FROM ({_SAMPLE}) WHERE age > 18", _BASE),
    "log without zero sales": (f"SELECT * REPLACE (ln(sales) AS log_sales) FROM ({_SAMPLE}) WHERE sales > 0", _BASE),
    "complete cases only": (f"SELECT * FROM ({_SAMPLE}) WHERE baseline_score IS NOT NULL", _BASE),
    "mediator controlled": (_SAMPLE, [*_BASE, "mediator"]),
    "lagged outcome controlled": (
        f"SELECT * FROM (SELECT *, lag(outcome) OVER (PARTITION BY firm_id ORDER BY year) AS lag_outcome FROM ({_SAMPLE})) WHERE lag_outcome IS NOT NULL", [*_BASE, "lag_outcome"]),
    "repeated covariate rows": (_SAMPLE, _BASE),
}
BOOK.add(
    "r07",
    lambda s, d: rounded(R.defect_sensitivity(*firm_year(Tables(s, d))), 6),
    recursive(FIRM_YEAR, *[regression(f"v{n}", rows, xs, "firm_id", "year", "outcome") for n, (rows, xs) in enumerate(_VARIANTS.values())])
    + " UNION ALL ".join(effect(f"v{n}", label) for n, label in enumerate(_VARIANTS)),
)
