"""The forecast evaluation once more in plain SQL, layer by layer."""

from __future__ import annotations

from panelwright.catalog.ctes import VINTAGES

SUPERVISED = """
cutoffs AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(vintage_date)), date_trunc('month', max(vintage_date)), INTERVAL 1 MONTH)) AS DATE)) AS cutoff FROM vp),
snap AS (
  SELECT cutoff, series_id, observation_date AS obs, max_by(value, vintage_date) AS value
  FROM vp JOIN cutoffs ON vintage_date <= cutoff GROUP BY ALL),
spine AS (
  SELECT cutoff, CAST(unnest(generate_series(CAST(min(obs) AS TIMESTAMP), CAST(max(obs) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS obs
  FROM snap GROUP BY 1),
wide AS (
  SELECT cutoff, obs, max(value) FILTER (WHERE series_id = 'R') AS r, max(value) FILTER (WHERE series_id = 'A') AS a,
         max(value) FILTER (WHERE series_id = 'N') AS n
  FROM spine LEFT JOIN snap USING (cutoff, obs) GROUP BY ALL),
filled AS (
  SELECT cutoff, obs, r, a, last_value(n IGNORE NULLS) OVER (PARTITION BY cutoff ORDER BY obs ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n
  FROM wide),
ys AS (
  SELECT 'R' AS target, cutoff, obs, (r / nullif(lag(r, 12) OVER w, 0) - 1.0::DOUBLE) * 100.0::DOUBLE AS y, n
  FROM filled WINDOW w AS (PARTITION BY cutoff ORDER BY obs)
  UNION ALL SELECT 'A', cutoff, obs, a, n FROM filled),
feat AS (
  SELECT *, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3, lag(n, 1) OVER w AS n1, lag(n, 2) OVER w AS n2,
         lead(y, 1) OVER w AS l1, lead(y, 3) OVER w AS l3,
         max(CASE WHEN y IS NOT NULL THEN obs END) OVER (PARTITION BY target, cutoff) AS origin
  FROM ys WINDOW w AS (PARTITION BY target, cutoff ORDER BY obs)),
known AS (
  SELECT *, (y1 + y2 + y3 + n + n1 + n2) IS NOT NULL AS full_x, (y + n) IS NOT NULL AS full_mv FROM feat WHERE obs <= origin),
cand AS (
  SELECT target, cutoff, origin, bool_or(obs = origin AND full_x) AS ready_x, count(*) FILTER (WHERE full_mv) AS n_mv,
         count(*) FILTER (WHERE full_x AND l1 IS NOT NULL) AS t1, count(*) FILTER (WHERE full_x AND l3 IS NOT NULL) AS t3
  FROM known GROUP BY ALL),
first_v AS (
  SELECT target, origin, min(cutoff) AS cutoff FROM cand WHERE ready_x AND n_mv >= 24 AND t1 >= 24 GROUP BY 1, 2),
origins AS (
  SELECT * FROM (
    SELECT target, cutoff, origin, CAST(h AS INT) AS horizon, CAST(origin + to_months(CAST(h AS INT)) AS DATE) AS target_date,
           CASE h WHEN 1 THEN t1 ELSE t3 END AS n_train
    FROM first_v JOIN cand USING (target, origin, cutoff) CROSS JOIN (SELECT unnest([1, 3]) AS h)) WHERE n_train >= 24)
"""

FORECASTS = """
hist AS (
  SELECT k.target, k.cutoff, k.obs, k.y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k.target, k.cutoff) AS n,
         y - lag(y, 1) OVER w AS d1, y - lag(y, 12) OVER w AS d12
  FROM known k JOIN first_v f ON f.target = k.target AND f.cutoff = k.cutoff WHERE y IS NOT NULL
  WINDOW w AS (PARTITION BY k.target, k.cutoff ORDER BY k.obs)),
hstat AS (
  SELECT target, cutoff, max(n) AS n, avg(y) AS m, stddev_samp(y) AS sd, min_by(y, obs) AS f, max_by(y, obs) AS l,
         count(d1) AS c1, stddev_samp(d1) AS s1, count(d12) AS c12, stddev_samp(d12) AS s12,
         max(y) FILTER (WHERE i = n - 12) AS sea1, max(y) FILTER (WHERE i = n - 10) AS sea3 FROM hist GROUP BY ALL),
hsig AS (
  SELECT *, CASE WHEN n < 3 THEN 1 ELSE greatest(sd, 1e-8) END AS g, CASE WHEN c1 < 3 THEN 1 ELSE greatest(s1, 1e-8) END AS g1,
         CASE WHEN c12 < 3 THEN 1 ELSE greatest(s12, 1e-8) END AS g12 FROM hstat),
fc AS (
  SELECT o.target, o.cutoff, o.origin, o.target_date, o.horizon, model,
         CASE model WHEN 'mean' THEN m WHEN 'naive_last' THEN l WHEN 'naive_drift' THEN l + o.horizon * (l - f) / greatest(n - 1, 1)
              ELSE CASE WHEN n >= 12 THEN CASE o.horizon WHEN 1 THEN sea1 ELSE sea3 END ELSE l END END AS forecast,
         CASE model WHEN 'mean' THEN g WHEN 'seasonal_naive' THEN CASE WHEN c12 > 0 THEN g12 ELSE g1 END
              ELSE g1 * sqrt(o.horizon) END AS sigma
  FROM origins o JOIN hsig USING (target, cutoff)
  CROSS JOIN (SELECT unnest(['mean', 'naive_last', 'naive_drift', 'seasonal_naive']) AS model))
"""

TRUTH = """
truth_raw AS (
  SELECT series_id, observation_date, unnest(['first_release', 'latest']) AS truth_mode,
         unnest([min_by(value, vintage_date), max_by(value, vintage_date)]) AS value
  FROM vp GROUP BY 1, 2),
truth_spine AS (
  SELECT series_id AS target, truth_mode,
         CAST(unnest(generate_series(CAST(min(observation_date) AS TIMESTAMP), CAST(max(observation_date) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS obs
  FROM truth_raw WHERE series_id IN ('R', 'A') GROUP BY 1, 2),
truth AS (
  SELECT target, truth_mode, obs,
         CASE target WHEN 'R' THEN (value / nullif(lag(value, 12) OVER w, 0) - 1.0::DOUBLE) * 100.0::DOUBLE ELSE value END AS value
  FROM (SELECT s.*, r.value FROM truth_spine s LEFT JOIN truth_raw r
        ON r.series_id = s.target AND r.truth_mode = s.truth_mode AND r.observation_date = s.obs)
  WINDOW w AS (PARTITION BY target, truth_mode ORDER BY obs)),
cycle AS (
  SELECT observation_date AS obs, CASE WHEN value >= 0.5 THEN 'recession' ELSE 'expansion' END AS regime
  FROM truth_raw WHERE series_id = 'U' AND truth_mode = 'latest'),
vol_sd AS (
  SELECT target, obs, CASE WHEN count(d) OVER w >= 12 THEN stddev_samp(d) OVER w END AS sd FROM (
    SELECT target, obs, value - lag(value) OVER (PARTITION BY target ORDER BY obs) AS d FROM truth WHERE truth_mode = 'latest')
  WINDOW w AS (PARTITION BY target ORDER BY obs ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
vol AS (
  SELECT target, obs, CASE WHEN lim IS NULL THEN 'unknown' WHEN sd >= lim THEN 'high_volatility' ELSE 'normal_volatility' END AS vol_regime
  FROM vol_sd JOIN (SELECT target, percentile_cont(0.75) WITHIN GROUP (ORDER BY sd) AS lim FROM vol_sd GROUP BY 1) USING (target))
"""

LEDGER = """
matched AS (
  SELECT f.*, t.truth_mode, t.value AS actual, t.value - f.forecast AS error,
         year(origin) * 12 + month(origin) AS oi
  FROM fc f JOIN truth t ON t.target = f.target AND t.obs = f.target_date WHERE t.value IS NOT NULL),
past AS (
  SELECT *, CASE horizon WHEN 1 THEN count(error) OVER p1 ELSE count(error) OVER p3 END AS matured,
         CASE horizon WHEN 1 THEN avg(error * error) OVER p1 ELSE avg(error * error) OVER p3 END AS mse
  FROM matched
  WINDOW p1 AS (PARTITION BY truth_mode, target, horizon, model ORDER BY oi RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         p3 AS (PARTITION BY truth_mode, target, horizon, model ORDER BY oi RANGE BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)),
widened AS (
  SELECT * EXCLUDE (sigma), CASE WHEN matured >= 8 THEN greatest(0.35::DOUBLE * sigma + 0.65::DOUBLE * sqrt(mse), 1e-8) ELSE sigma END AS sigma FROM past),
zs AS (SELECT *, (actual - forecast) / sigma AS z, abs((actual - forecast) / sigma) / sqrt(2.0::DOUBLE) AS u FROM widened),
cdf AS (
  SELECT *, CASE WHEN z = 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * (1 + sign(z) * CASE WHEN u > 6 THEN 1.0::DOUBLE ELSE
            exp(-u * u) * list_sum(list_transform(range(0, 250), lambda k: exp((2 * k + 1) * ln(u) - lgamma(k + 1.5)))) END) END AS pit
  FROM zs),
base_ledger AS (
  SELECT *, sigma * (z * (2 * pit - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS crps,
         CASE WHEN actual BETWEEN forecast - 1.2815515655446004 * sigma AND forecast + 1.2815515655446004 * sigma THEN 1.0::DOUBLE ELSE 0 END AS covered80,
         CASE WHEN actual BETWEEN forecast - 1.6448536269514722 * sigma AND forecast + 1.6448536269514722 * sigma THEN 1.0::DOUBLE ELSE 0 END AS covered90,
         2 * 1.2815515655446004 * sigma AS width80, 2 * 1.6448536269514722 * sigma AS width90 FROM cdf),
labelled AS (
  SELECT b.*, coalesce(c.regime, 'unknown') AS cyc, coalesce(v.vol_regime, 'unknown') AS vr
  FROM base_ledger b LEFT JOIN cycle c ON c.obs = b.target_date LEFT JOIN vol v ON v.target = b.target AND v.obs = b.target_date),
ledger AS (SELECT * EXCLUDE (cyc, vr), unnest(list_distinct([cyc, 'all', vr])) AS regime FROM labelled)
"""

KS = """
ks AS (
  SELECT truth_mode, target, horizon, regime, model, CASE WHEN max(n) >= 8 THEN max(greatest(i / n - pit, pit - (i - 1) / n)) END AS pit_ks_d, max(n) AS n
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY truth_mode, target, horizon, regime, model ORDER BY pit) AS DOUBLE) AS i,
               CAST(count(*) OVER (PARTITION BY truth_mode, target, horizon, regime, model) AS DOUBLE) AS n FROM ledger) GROUP BY ALL)
"""

PAIRED = """
paired AS (
  SELECT truth_mode, target, horizon, regime, model, n AS n_common, rmse, baseline_rmse, rmse / baseline_rmse AS rmse_rel, crps, baseline_crps,
         crps / baseline_crps AS crps_rel, 0.6::DOUBLE * (rmse / baseline_rmse) + 0.4::DOUBLE * (crps / baseline_crps) AS combined_rel,
         coverage80, coverage90, width80, width90, pit_mean, pit_var, baseline_n
  FROM (SELECT m.truth_mode, m.target, m.horizon, m.regime, m.model, count(*) AS n, sqrt(avg(m.error * m.error)) AS rmse,
               sqrt(avg(b.error * b.error)) AS baseline_rmse, avg(m.crps) AS crps, avg(b.crps) AS baseline_crps,
               avg(m.covered80) AS coverage80, avg(m.covered90) AS coverage90, avg(m.width80) AS width80, avg(m.width90) AS width90,
               avg(m.pit) AS pit_mean, var_samp(m.pit) AS pit_var
        FROM ledger m JOIN ledger b ON b.model = 'naive_last' AND b.truth_mode = m.truth_mode AND b.target = m.target AND b.horizon = m.horizon
             AND b.regime = m.regime AND b.origin = m.origin AND b.target_date = m.target_date GROUP BY ALL)
  JOIN (SELECT truth_mode, target, horizon, regime, count(DISTINCT origin) AS baseline_n FROM ledger WHERE model = 'naive_last' GROUP BY ALL)
  USING (truth_mode, target, horizon, regime))
"""

DM = """
dm_d AS (
  SELECT m.truth_mode, m.target, m.horizon, m.model, m.origin, m.error * m.error - b.error * b.error AS d
  FROM ledger m JOIN ledger b ON b.model = 'naive_last' AND b.regime = 'all' AND b.truth_mode = m.truth_mode AND b.target = m.target
       AND b.horizon = m.horizon AND b.origin = m.origin
  WHERE m.regime = 'all' AND m.model <> 'naive_last'),
dm_c AS (SELECT *, d - avg(d) OVER (PARTITION BY truth_mode, target, horizon, model) AS c FROM dm_d),
dm_g AS (
  SELECT *, c * lag(c, 1) OVER w AS g1, c * lag(c, 2) OVER w AS g2 FROM dm_c
  WINDOW w AS (PARTITION BY truth_mode, target, horizon, model ORDER BY origin)),
dm_s AS (
  SELECT truth_mode, target, horizon, model, count(*) AS n, avg(d) AS dbar,
         sum(c * c) / count(*) + CASE WHEN horizon = 3 THEN 2 * (2.0::DOUBLE / 3) * sum(g1) / count(*) + 2 * (1.0::DOUBLE / 3) * sum(g2) / count(*) ELSE 0 END AS v
  FROM dm_g GROUP BY truth_mode, target, horizon, model),
dm_t AS (
  SELECT truth_mode, target, horizon, model, n, CASE WHEN n >= 8 THEN dbar END AS mean_loss_diff,
         CASE WHEN n >= 8 AND v > 0 THEN dbar / sqrt(v / n) * sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / CAST(n AS DOUBLE)) / n) END AS dm_stat
  FROM dm_s),
dm_p AS (
  SELECT *, CASE WHEN dm_stat IS NOT NULL THEN 1 - 2 * exp(lgamma(n / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE)) / sqrt(pi()) * (th / 4000 / 3) *
         list_sum(list_transform(range(0, 4001), lambda k: pow(cos(th * k / 4000), n - 2) *
                  CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)) END AS p_value
  FROM (SELECT *, atan(abs(dm_stat) / sqrt(n - 1)) AS th FROM dm_t)),
dm AS (
  SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0::DOUBLE, max((m - rn + 1) * p_value) OVER (
            PARTITION BY truth_mode, target, horizon ORDER BY p_value, model ROWS UNBOUNDED PRECEDING)) END AS p_holm
  FROM (SELECT *, row_number() OVER (PARTITION BY truth_mode, target, horizon ORDER BY p_value NULLS LAST, model) AS rn,
               count(p_value) OVER (PARTITION BY truth_mode, target, horizon) AS m FROM dm_p))
"""

BOARD = """
board AS (
  SELECT row_number() OVER (ORDER BY score NULLS LAST, model) AS rank, * FROM (
    SELECT model, avg(combined_rel) AS score, avg(rmse_rel) AS rmse_rel, avg(crps_rel) AS crps_rel, avg(coverage80) AS coverage80,
           avg(coverage90) AS coverage90, count(combined_rel) AS cells, CAST(sum(n_common) AS BIGINT) AS common_origins,
           CAST(sum(baseline_n) AS BIGINT) AS baseline_origins, CAST(sum(baseline_n - n_common) AS BIGINT) AS failure_count,
           (SELECT count(DISTINCT (target, horizon)) FROM paired WHERE truth_mode = 'first_release' AND regime = 'all') AS expected_cells
    FROM paired WHERE truth_mode = 'first_release' AND regime = 'all' GROUP BY 1))
"""

LAYERS = {
    "supervised": [VINTAGES, SUPERVISED],
    "forecasts": [VINTAGES, SUPERVISED, FORECASTS],
    "truth": [VINTAGES, TRUTH],
    "ledger": [VINTAGES, SUPERVISED, FORECASTS, TRUTH, LEDGER],
    "paired": [VINTAGES, SUPERVISED, FORECASTS, TRUTH, LEDGER, PAIRED],
    "board": [VINTAGES, SUPERVISED, FORECASTS, TRUTH, LEDGER, PAIRED, BOARD],
    "dm": [VINTAGES, SUPERVISED, FORECASTS, TRUTH, LEDGER, PAIRED, BOARD, DM],
    "ks": [VINTAGES, SUPERVISED, FORECASTS, TRUTH, LEDGER, KS],
}


def layer(name: str) -> str:
    text = ",".join(c.strip() for c in LAYERS[name])
    return "WITH " + text + "\n"
