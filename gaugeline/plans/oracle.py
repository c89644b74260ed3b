"""Reference SQL for the named queries, in plain station-wide windows and joins.

Written for a single-node engine over the same tables; it is a check of results,
not a model for the plans.
"""

from __future__ import annotations

from gaugeline.plans.shapes import shaped_sql

RAW = """
raw AS (
  SELECT event_id, user_id // 10 AS station_id, date_trunc('hour', ts) AS ts, value,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_type = 'error' AS is_error
  FROM events)"""

OBS = RAW + """,
kept AS (
  SELECT station_id, ts, min(event_id) AS event_id, min_by(value, event_id) AS value,
         min_by(k, event_id) AS k, min_by(is_error, event_id) AS is_error
  FROM raw GROUP BY station_id, ts),
obs AS (
  SELECT station_id, ts, 'ST' || station_id AS station_name,
         28e0 + (station_id % 5) * 0.35e0 AS latitude, 76e0 + (station_id // 5) * 0.4e0 AS longitude,
         CASE WHEN is_error AND k % 10 = 0 THEN NULL ELSE value / 5e0 - 10e0 END AS temperature,
         k * 1.05e0 AS humidity, 940e0 + (event_id * 37) % 160 AS pressure,
         (event_id % 30) / 2e0 AS wind_speed
  FROM kept)"""

SPEC = OBS + """,
spec AS (
  SELECT s.station_id * 10 + i.i AS seq, s.station_id,
         CASE WHEN i.i = 5 THEN 'temperature' WHEN (s.station_id + i.i) % 4 = 0 THEN 'humidity'
              WHEN (s.station_id + i.i) % 4 = 1 THEN 'pressure' ELSE 'temperature' END AS variable,
         (['spike','drop','frozen','drift','missing','multivariate'])[i.i + 1] AS fault,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(i.i * 100 + 10 + (s.station_id * 37) % 80 AS BIGINT)) AS start_ts,
         CAST(([1,2,3,4,6])[(s.station_id * 3 + i.i) % 5 + 1] AS BIGINT) AS duration,
         (['mild','moderate','severe'])[(s.station_id + i.i) % 3 + 1] AS severity
  FROM (SELECT DISTINCT station_id FROM obs) s, (SELECT unnest(range(6)) AS i) i)"""


def faulty(condition: str = "TRUE") -> str:
    """obs -> faulty, with the spec rows meeting the condition."""
    return SPEC + f""",
hit0 AS (
  SELECT o.*, s.seq, s.variable, s.fault, s.severity,
         CASE s.variable WHEN 'temperature' THEN o.temperature WHEN 'humidity' THEN o.humidity ELSE o.pressure END AS v,
         CASE s.severity WHEN 'mild' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS sev
  FROM obs o JOIN spec s ON s.station_id = o.station_id AND o.ts >= s.start_ts
       AND o.ts < s.start_ts + to_hours(s.duration)
  WHERE {condition}),
hit1 AS (
  SELECT *, row_number() OVER w AS i, first_value(v) OVER w AS v0,
         CASE WHEN variable = 'humidity' THEN ([10e0, 25e0, 40e0])[sev + 1] ELSE ([5e0, 10e0, 20e0])[sev + 1] END AS magnitude
  FROM hit0 WINDOW w AS (PARTITION BY seq ORDER BY ts)),
hit2 AS (
  SELECT *, CASE fault WHEN 'spike' THEN v + magnitude WHEN 'drop' THEN v - magnitude WHEN 'frozen' THEN v0
                       WHEN 'drift' THEN v + i * ([0.2e0, 0.5e0, 1e0])[sev + 1]
                       WHEN 'multivariate' THEN v + ([5e0, 10e0, 15e0])[sev + 1] END AS nv,
         CASE WHEN fault = 'multivariate' THEN 'multivariate_inconsistency' ELSE variable || '_' || fault END AS ft
  FROM hit1),
faulty AS (
  SELECT o.station_id, o.ts, o.station_name, o.latitude, o.longitude, o.wind_speed,
         CASE WHEN h.variable = 'temperature' THEN h.nv ELSE o.temperature END AS temperature,
         CASE WHEN h.variable = 'humidity' THEN h.nv ELSE o.humidity END AS humidity,
         CASE WHEN h.variable = 'pressure' THEN h.nv ELSE o.pressure END AS pressure,
         o.temperature AS original_temperature, o.humidity AS original_humidity, o.pressure AS original_pressure,
         CASE WHEN h.seq IS NULL THEN 0 ELSE 1 END AS is_anomaly,
         coalesce(h.ft, 'normal') AS fault_type, coalesce(h.severity, 'none') AS fault_severity
  FROM obs o LEFT JOIN hit2 h ON h.station_id = o.station_id AND h.ts = o.ts)"""


def row_faulty(change: str, fault: str, duration: int) -> str:
    return OBS + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) - 1 AS rn FROM obs),
marked AS (
  SELECT *, rn - (5 + station_id % 7) AS step,
         rn >= 5 + station_id % 7 AND rn < 5 + station_id % 7 + {duration} AS hit FROM numbered),
faulty AS (
  SELECT station_id, ts, CASE WHEN hit THEN {change} ELSE temperature END AS temperature, humidity, pressure,
         temperature AS original_temperature, humidity AS original_humidity, pressure AS original_pressure,
         CASE WHEN hit THEN 1 ELSE 0 END AS is_anomaly,
         CASE WHEN hit THEN 'temperature_{fault}' ELSE 'normal' END AS fault_type,
         CASE WHEN hit THEN 'severe' ELSE 'none' END AS fault_severity FROM marked)"""


def feat(src: str) -> str:
    """CTEs that end in `feat`: every feature over table `src`."""
    base = []
    for v, p in (("temperature", "pt"), ("pressure", "pp"), ("humidity", "ph")):
        base.append(f"CASE WHEN count({p}) OVER d >= 3 THEN avg({p}) OVER d END AS {v}_rolling_mean_24h")
        base.append(f"CASE WHEN count({p}) OVER d >= 3 THEN stddev_samp({p}) OVER d END AS {v}_rolling_std_24h")
    dev = []
    for v in ("temperature", "pressure", "humidity"):
        dev.append(f"{v} - {v}_rolling_mean_24h AS {v}_deviation_24h")
        dev.append(f"({v} - {v}_rolling_mean_24h) / nullif({v}_rolling_std_24h, 0) AS {v}_zscore_24h")
    return f""",
f0 AS (
  SELECT *, lag(temperature) OVER w AS pt, lag(pressure) OVER w AS pp, lag(humidity) OVER w AS ph,
         temperature - lag(temperature) OVER w AS temperature_change,
         temperature - lag(temperature, 6) OVER w AS temperature_change_6h,
         row_number() OVER w AS rn,
         CASE WHEN temperature = lag(temperature) OVER w THEN 0 ELSE 1 END AS run_start,
         abs((temperature - lag(temperature, 2) OVER w) / 2e0
             - (lag(temperature, 3) OVER w - lag(temperature, 5) OVER w) / 2e0) AS trajectory_change
  FROM {src} WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
f1 AS (
  SELECT *, abs(temperature_change) AS absolute_temperature_change, coalesce(temperature_change, 0e0) AS step0,
         sign(coalesce(temperature_change, 0e0)) AS sgn,
         sum(run_start) OVER (PARTITION BY station_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run_id FROM f0),
f2 AS (
  SELECT *, CASE WHEN lag(sgn) OVER (PARTITION BY station_id ORDER BY ts) <> sgn THEN 1 ELSE 0 END AS flip,
         count(*) OVER (PARTITION BY station_id, run_id) AS repeat_length,
         row_number() OVER (PARTITION BY station_id, run_id ORDER BY ts) AS running_length FROM f1),
f3 AS (
  SELECT *, {", ".join(base)},
         CASE WHEN count(pt) OVER r24 >= 3 THEN avg(pt) OVER r24 END AS row_mean,
         CASE WHEN count(pt) OVER r24 >= 3 THEN stddev_samp(pt) OVER r24 END AS row_std,
         CASE WHEN count(temperature) OVER r6 >= 6 THEN stddev_samp(temperature) OVER r6 END AS temperature_std_6h,
         CASE WHEN count(temperature) OVER r6 >= 2 THEN stddev_samp(temperature) OVER r6 END AS temperature_std_6h_live,
         CASE WHEN count(temperature) OVER r6 = 6 THEN regr_slope(temperature, CAST(rn AS DOUBLE)) OVER r6 END AS temperature_trend_6h,
         CASE WHEN count(pt) OVER r6 >= 3 THEN quantile_cont(pt, 0.5) OVER r6 END AS previous_6h_median,
         CASE WHEN count(pt) OVER r12 >= 6 THEN quantile_cont(pt, 0.5) OVER r12 END AS previous_12h_median,
         CASE WHEN count(temperature_change) OVER r6 >= 3 THEN count(CASE WHEN temperature_change > 0 THEN 1 END) OVER r6 END AS rises_6h,
         CASE WHEN count(temperature_change) OVER r6 >= 3 THEN count(CASE WHEN temperature_change < 0 THEN 1 END) OVER r6 END AS falls_6h,
         CAST(sum(flip) OVER r6 AS BIGINT) AS sign_flips, sum(step0) OVER r6 AS cum_change_6h
  FROM f2 WINDOW d AS (PARTITION BY station_id ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW),
                 r6 AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
                 r12 AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
                 r24 AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
feat AS (
  SELECT *, {", ".join(dev)}, abs(temperature - previous_6h_median) AS local_temperature_residual,
         abs(temperature - previous_12h_median) AS local_residual_12h FROM f3)"""


VOTES = """,
votes0 AS (
  SELECT *,
    CASE WHEN temperature IS NULL OR temperature < -50 OR temperature > 60 OR humidity IS NULL OR humidity < 0
           OR humidity > 100 OR pressure IS NULL OR pressure < 870 OR pressure > 1085 THEN 1 ELSE 0 END AS rule_score,
    CASE WHEN abs(temperature_zscore_24h) > 3 OR abs(temperature_deviation_24h) > 10 THEN 1 ELSE 0 END AS statistical_score,
    CASE WHEN abs(temperature_zscore_24h) > 2.5 THEN 1 ELSE 0 END AS isolation_score,
    CASE WHEN absolute_temperature_change > 6 THEN 1 ELSE 0 END AS sudden_change,
    CASE WHEN repeat_length >= 6 AND temperature_std_6h <= 1.0 THEN 1 ELSE 0 END AS frozen_pattern,
    CASE WHEN abs(temperature_trend_6h) > 3 THEN 1 ELSE 0 END AS extreme_trend
  FROM feat),
votes1 AS (SELECT *, greatest(sudden_change, frozen_pattern, extreme_trend) AS temporal_score FROM votes0),
votes2 AS (SELECT *, rule_score + statistical_score + isolation_score + temporal_score AS anomaly_score FROM votes1),
votes AS (SELECT *, CASE WHEN anomaly_score >= 1 THEN 1 ELSE 0 END AS predicted FROM votes2)"""

THRESHOLDS = """,
med AS (
  SELECT station_id, quantile_cont(absolute_temperature_change, 0.5) AS m1, quantile_cont(local_temperature_residual, 0.5) AS m2,
         quantile_cont(temperature_std_6h, 0.5) AS m3, quantile_cont(abs(cum_change_6h), 0.5) AS m4,
         stddev_samp(absolute_temperature_change) AS s1, stddev_samp(local_temperature_residual) AS s2,
         stddev_samp(temperature_std_6h) AS s3, stddev_samp(abs(cum_change_6h)) AS s4,
         quantile_cont(temperature_std_6h, 0.1) AS low_spread
  FROM votes GROUP BY station_id),
mad AS (
  SELECT v.station_id, quantile_cont(abs(absolute_temperature_change - m1), 0.5) AS d1,
         quantile_cont(abs(local_temperature_residual - m2), 0.5) AS d2,
         quantile_cont(abs(temperature_std_6h - m3), 0.5) AS d3, quantile_cont(abs(abs(cum_change_6h) - m4), 0.5) AS d4
  FROM votes v JOIN med USING (station_id) GROUP BY v.station_id),
thr AS (
  SELECT station_id, m1 + 5 * CASE WHEN d1 > 0 THEN d1 ELSE s1 END AS thr_change,
         m2 + 5 * CASE WHEN d2 > 0 THEN d2 ELSE s2 END AS thr_residual,
         m3 + 1 * CASE WHEN d3 > 0 THEN d3 ELSE s3 END AS thr_spread,
         m4 + 3 * CASE WHEN d4 > 0 THEN d4 ELSE s4 END AS thr_cumulative, low_spread
  FROM med JOIN mad USING (station_id))"""

DIAG = THRESHOLDS + """,
g0 AS (
  SELECT v.*, t.* EXCLUDE (station_id), temperature IS NULL AS c_missing,
         temperature IS NOT NULL AND coalesce(absolute_temperature_change > thr_change OR local_temperature_residual > thr_residual,
           coalesce(absolute_temperature_change > thr_change, false) OR coalesce(local_temperature_residual > thr_residual, false)) AS c_spike
  FROM votes v LEFT JOIN thr t USING (station_id)),
g1 AS (SELECT *, NOT c_missing AND NOT c_spike AND coalesce(repeat_length >= 4 AND temperature_std_6h <= low_spread, false) AS c_frozen FROM g0),
g2 AS (SELECT *, NOT c_missing AND NOT c_spike AND NOT c_frozen AND coalesce(sign_flips >= 2 AND temperature_std_6h > thr_spread, false) AS c_noise FROM g1),
g3 AS (SELECT *, NOT c_missing AND NOT c_spike AND NOT c_frozen AND NOT c_noise
              AND coalesce(abs(cum_change_6h) > thr_cumulative AND sign_flips <= 2, false) AS c_drift, anomaly_score > 0 AS fired FROM g2),
g4 AS (
  SELECT *, CASE WHEN c_missing THEN 'MISSING' WHEN c_spike AND fired THEN 'SPIKE' WHEN c_frozen AND fired THEN 'FROZEN'
                 WHEN c_noise THEN 'NOISE' WHEN c_drift AND fired THEN 'DRIFT' WHEN fired THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS diagnosed_fault
  FROM g3),
diag AS (
  SELECT *, round_even(CASE diagnosed_fault
      WHEN 'MISSING' THEN 1e0
      WHEN 'SPIKE' THEN CASE WHEN NOT coalesce(thr_change > 0, false) THEN 0e0 WHEN absolute_temperature_change IS NULL THEN NULL
                             ELSE least(absolute_temperature_change / thr_change, 2e0) / 2 END
      WHEN 'FROZEN' THEN CASE WHEN NOT coalesce(low_spread > 0, false) THEN 0e0 ELSE 1 - least(temperature_std_6h / low_spread, 1e0) END
      WHEN 'NOISE' THEN CASE WHEN NOT coalesce(thr_spread > 0, false) THEN 0e0 ELSE least(temperature_std_6h / thr_spread, 2e0) / 2 END
      WHEN 'DRIFT' THEN CASE WHEN NOT coalesce(thr_cumulative > 0, false) THEN 0e0 ELSE least(abs(cum_change_6h) / thr_cumulative, 2e0) / 2 END
      WHEN 'SUSPICIOUS' THEN 0.4e0 ELSE 0e0 END, 2) AS diagnosis_confidence
  FROM g4)"""


def interpolated(src: str, value: str, out: str, tag: str) -> str:
    """CTEs from `src` to `<tag>`, adding `out`: positional interpolation of `value`."""
    return f""",
{tag}0 AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS {tag}n, {value} AS {tag}v FROM {src}),
{tag}1 AS (
  SELECT *, last_value({tag}v IGNORE NULLS) OVER b AS {tag}lv, last_value(CASE WHEN {tag}v IS NOT NULL THEN {tag}n END IGNORE NULLS) OVER b AS {tag}ln,
         first_value({tag}v IGNORE NULLS) OVER a AS {tag}rv, first_value(CASE WHEN {tag}v IS NOT NULL THEN {tag}n END IGNORE NULLS) OVER a AS {tag}rn
  FROM {tag}0 WINDOW b AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     a AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{tag} AS (
  SELECT *, CASE WHEN {tag}v IS NOT NULL THEN {tag}v WHEN {tag}lv IS NULL THEN {tag}rv WHEN {tag}rv IS NULL THEN {tag}lv
                 ELSE {tag}lv + ({tag}rv - {tag}lv) * (CAST({tag}n - {tag}ln AS DOUBLE) / ({tag}rn - {tag}ln)) END AS {out}
  FROM {tag}1)"""


CORR = (
    DIAG
    + interpolated("diag", "temperature", "filled", "ia")
    + """,
rep AS (SELECT *, CASE diagnosed_fault WHEN 'MISSING' THEN filled WHEN 'SPIKE' THEN coalesce(previous_6h_median, previous_12h_median)
                       ELSE temperature END AS repaired FROM ia)"""
    + interpolated("rep", "CASE WHEN diagnosed_fault <> 'FROZEN' THEN repaired END", "bridged", "ib")
    + """,
c0 AS (
  SELECT *, diagnosed_fault NOT IN ('NORMAL', 'SUSPICIOUS')
            AND (coalesce(diagnosis_confidence >= 0.3, false) OR diagnosed_fault = 'MISSING') AS app,
         CASE diagnosed_fault WHEN 'FROZEN' THEN bridged WHEN 'NOISE' THEN previous_6h_median
              WHEN 'DRIFT' THEN previous_12h_median ELSE repaired END AS fix FROM ib),
corr AS (
  SELECT *, temperature AS temperature_original, CASE WHEN app THEN fix ELSE temperature END AS temperature_corrected,
         CASE WHEN app THEN 1 ELSE 0 END AS correction_applied FROM c0),
mart AS (SELECT * REPLACE (CASE WHEN diagnosed_fault <> 'NORMAL' THEN 1 ELSE 0 END AS is_anomaly) FROM corr)"""
)

FAULTY = faulty()
# overlapping faults, one CTE for each in its order: drift, humidity spike, freeze, drop
OVERLAPPED = OBS + """,
p0 AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(10 + (station_id * 37) % 80 AS BIGINT)) AS h, temperature AS t0, humidity AS u0 FROM obs),
p1 AS (SELECT *, ts >= h AND ts < h + INTERVAL 6 HOUR AS a, ts >= h + INTERVAL 1 HOUR AND ts < h + INTERVAL 4 HOUR AS b,
              ts >= h + INTERVAL 2 HOUR AND ts < h + INTERVAL 6 HOUR AS c, ts >= h + INTERVAL 3 HOUR AND ts < h + INTERVAL 5 HOUR AS d FROM p0),
p2 AS (SELECT *, CASE WHEN a THEN t0 + 0.5e0 * row_number() OVER (PARTITION BY station_id, a ORDER BY ts) ELSE t0 END AS t1 FROM p1),
p3 AS (SELECT *, CASE WHEN c THEN first_value(t1) OVER (PARTITION BY station_id, c ORDER BY ts) ELSE t1 END AS t2 FROM p2),
faulty AS (
  SELECT * EXCLUDE (temperature, humidity), CASE WHEN d THEN t2 - 10e0 ELSE t2 END AS temperature, CASE WHEN b THEN u0 + 25e0 ELSE u0 END AS humidity,
         t0 AS original_temperature, u0 AS original_humidity, pressure AS original_pressure,
         CASE WHEN a OR b OR c OR d THEN 1 ELSE 0 END AS is_anomaly,
         CASE WHEN d THEN 'temperature_drop' WHEN c THEN 'temperature_frozen' WHEN b THEN 'humidity_spike' WHEN a THEN 'temperature_drift' ELSE 'normal' END AS fault_type,
         CASE WHEN a OR b OR c OR d THEN 'moderate' ELSE 'none' END AS fault_severity
  FROM p3)"""
FEAT_OBS = OBS + feat("obs")
FEAT = FAULTY + feat("faulty")
VOTED = FEAT + VOTES
DIAGNOSED = VOTED + DIAG
CORRECTED = VOTED + CORR
ENSEMBLE = FEAT + """,
e0 AS (
  SELECT *, greatest(abs(temperature_zscore_24h), abs(pressure_zscore_24h), abs(humidity_zscore_24h)) AS mz,
         coalesce(least(abs(temperature_zscore_24h) / 5e0, 1e0), 0e0) AS ml_anomaly_score,
         CASE WHEN temperature < -20 OR temperature > 50 OR pressure < 950 OR pressure > 1050 OR humidity < 0 OR humidity > 100
              THEN 1 ELSE 0 END AS statistical_anomaly FROM feat),
e1 AS (SELECT *, CASE WHEN mz > 3 THEN 1 ELSE 0 END AS temporal_anomaly, coalesce(least(mz, 6e0) / 6e0, 0e0) AS temporal_z_score FROM e0),
e2 AS (SELECT *, 0.4e0 * temporal_z_score + 0.6e0 * ml_anomaly_score AS ensemble_score FROM e1),
ens AS (
  SELECT *, CASE WHEN ensemble_score >= 0.5 THEN 1 ELSE 0 END AS ensemble_prediction,
         CASE WHEN ensemble_score < 0.3 THEN 'Normal' WHEN ensemble_score < 0.6 THEN 'Low' WHEN ensemble_score < 0.8 THEN 'Medium' ELSE 'High' END AS severity,
         coalesce(nullif(concat_ws('; ',
           CASE WHEN abs(temperature_zscore_24h) > 3 THEN 'Temperature deviates strongly from recent baseline' END,
           CASE WHEN abs(pressure_zscore_24h) > 3 THEN 'Pressure deviates strongly from recent baseline' END,
           CASE WHEN abs(humidity_zscore_24h) > 3 THEN 'Humidity deviates strongly from recent baseline' END,
           CASE WHEN ml_anomaly_score > 0.7 THEN 'ML model identifies unusual multivariate pattern' END), ''),
           'No significant anomaly detected') AS reason FROM e2)"""

STATIONS = OBS + """,
st AS (SELECT station_id, min_by(station_name, ts) AS station_name, min_by(latitude, ts) AS latitude, min_by(longitude, ts) AS longitude
       FROM obs GROUP BY station_id)"""
DIST = """,
dist0 AS (
  SELECT x.station_id AS a, y.station_id AS b,
         pow(sin(radians(y.latitude - x.latitude) / 2), 2)
         + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2) AS h
  FROM st x, st y WHERE x.station_id <> y.station_id),
dist AS (SELECT a, b, 6371e0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM dist0),
near AS (SELECT * FROM dist WHERE km > 0 AND km <= 100)"""


def consensus(src: str, flag: str) -> str:
    """CTE `cons`: neighbour counts and average for every row of `src`."""
    return f""",
cons AS (
  SELECT o.station_id, o.ts, o.temperature AS station_value, count(n.temperature) AS neighbor_count,
         count(CASE WHEN n.temperature IS NOT NULL AND n.{flag} = 0 THEN 1 END) AS normal_neighbors,
         count(CASE WHEN n.temperature IS NOT NULL AND n.{flag} = 1 THEN 1 END) AS anomalous_neighbors,
         avg(n.temperature) AS neighbor_average,
         coalesce(array_to_string(list_sort(list(round(n.temperature, 3)) FILTER (WHERE n.temperature IS NOT NULL)), ','), '') AS neighbor_values_text
  FROM {src} o LEFT JOIN near ON near.a = o.station_id LEFT JOIN {src} n ON n.station_id = near.b AND n.ts = o.ts
  GROUP BY o.station_id, o.ts, o.temperature)"""


EVID = """,
ev0 AS (
  SELECT c.*, v.isolation_score, v.statistical_score, abs(c.station_value - c.neighbor_average) AS spatial_difference
  FROM cons c JOIN votes v USING (station_id, ts)),
ev1 AS (
  SELECT *, isolation_score + statistical_score + CASE WHEN spatial_difference > 5 THEN 1 ELSE 0 END AS evidence_score,
         concat_ws('|', CASE WHEN isolation_score = 1 THEN 'ML anomaly detected' END,
           CASE WHEN statistical_score = 1 THEN 'Temporal deviation detected' END,
           CASE WHEN spatial_difference > 5 THEN 'Value differs significantly from nearby stations' END) AS reasons_text FROM ev0),
ev AS (SELECT *, CASE WHEN evidence_score >= 3 THEN 'Sensor Fault' WHEN evidence_score = 2 THEN 'Suspicious' ELSE 'Likely Weather Event' END AS classification FROM ev1)"""

LOO = """,
cells AS (SELECT ts, station_id, avg(temperature) AS cell FROM obs GROUP BY ts, station_id),
loo0 AS (
  SELECT d.station_id, d.ts, d.temperature, d.diagnosed_fault, d.diagnosis_confidence, count(c.cell) AS neighbor_count, avg(c.cell) AS neighbor_avg_temperature
  FROM diag d LEFT JOIN cells c ON c.ts = d.ts AND c.station_id <> d.station_id
  WHERE d.diagnosed_fault <> 'NORMAL' GROUP BY ALL),
loo AS (
  SELECT *, abs(temperature - neighbor_avg_temperature) AS spatial_deviation,
         CASE WHEN neighbor_count < 2 OR temperature IS NULL THEN 'INSUFFICIENT_DATA'
              WHEN abs(temperature - neighbor_avg_temperature) <= 5 THEN 'WEATHER_EVENT' ELSE 'SENSOR_FAULT' END AS spatial_classification FROM loo0)"""


def prf(tp: str, fp: str, fn: str) -> str:
    def safe(num: str, den: str) -> str:
        return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0e0 END"

    return (
        f"{safe(tp, f'{tp} + {fp}')} AS precision, {safe(tp, f'{tp} + {fn}')} AS recall, "
        f"{safe(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1"
    )


def describe_sql(src: str, columns: dict[str, str], quantiles: dict[str, float]) -> str:
    q = ", ".join(f"quantile_cont({{e}}, {p}) AS {n}" for n, p in quantiles.items())
    parts = [
        f"SELECT '{c}' AS column_name, count({e}) AS n, avg({e}) AS mean, stddev_samp({e}) AS std, "
        f"CAST(min({e}) AS DOUBLE) AS min, {q.format(e=e)}, CAST(max({e}) AS DOUBLE) AS max FROM {src}"
        for c, e in columns.items()
    ]
    return " UNION ALL ".join(parts)


SWEEPS = {
    "deviation": ("abs(temperature_deviation_24h)", (5, 6, 7, 8, 9, 10), ">"),
    "zscore": ("abs(temperature_zscore_24h)", (1.5, 2, 2.5, 3), ">"),
    "change": ("absolute_temperature_change", (3, 4, 5, 6, 8, 10), ">"),
    "run_length": ("repeat_length", (4, 5, 6, 7, 8, 10), ">="),
    "change_6h": ("abs(temperature_change_6h)", (3, 4, 5, 6, 7, 8, 10), ">"),
    "trend": ("abs(temperature_trend_6h)", (1, 1.5, 2, 2.5, 3), ">"),
}
COMBOS = {
    "std > 2": ("temperature_drift", "temperature_std_6h > 2"),
    "std > 2 AND change > 4": ("temperature_drift", "temperature_std_6h > 2 AND absolute_temperature_change > 4"),
    "std > 2 AND residual > 4": ("temperature_drift", "temperature_std_6h > 2 AND local_temperature_residual > 4"),
    "change > 4 AND residual > 4": (
        "temperature_spike",
        "absolute_temperature_change > 4 AND local_temperature_residual > 4",
    ),
    "repeat >= 6 AND std <= 1.0": ("temperature_frozen", "repeat_length >= 6 AND temperature_std_6h <= 1.0"),
    "repeat >= 6 AND std <= 0.25": ("temperature_frozen", "repeat_length >= 6 AND temperature_std_6h <= 0.25"),
}


def _penalty(col: str) -> str:
    return f"CASE {col} WHEN 'temperature_spike' THEN 15 WHEN 'temperature_drift' THEN 10 WHEN 'temperature_frozen' THEN 12 WHEN 'temperature_drop' THEN 10 WHEN 'humidity_spike' THEN 8 WHEN 'humidity_drift' THEN 8 WHEN 'humidity_frozen' THEN 10 WHEN 'humidity_drop' THEN 8 WHEN 'pressure_spike' THEN 8 WHEN 'pressure_drift' THEN 8 WHEN 'pressure_frozen' THEN 10 WHEN 'pressure_drop' THEN 8 WHEN 'multivariate_inconsistency' THEN 10 WHEN 'normal' THEN 0 ELSE 5 END"


def _ledger(src: str, lost: str) -> str:
    return f""",
led0 AS (SELECT *, greatest(0, 100 - sum({lost}) OVER (PARTITION BY station_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS hs FROM {src}),
led AS (SELECT *, CAST(hs AS BIGINT) AS health_score, CASE WHEN hs >= 80 THEN 'GREEN' WHEN hs >= 50 THEN 'YELLOW' ELSE 'RED' END AS health_status FROM led0)"""


def _detectors_union(select: str) -> str:
    names = ("rule_score", "statistical_score", "isolation_score", "temporal_score")
    return " UNION ALL ".join(f"SELECT '{d}' AS detector, " + select.format(d=d) + " FROM votes" for d in names)


def _unit(key: str, seed: int = 42) -> str:
    """A number in (0, 1) from the MD5 of the key."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', {key}, {seed})), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


def _greedy(one_per_turn: bool) -> str:
    """open -> chosen, going through the candidates one by one."""
    placed = "k.turn = c.turn OR " if one_per_turn else ""
    return f""",
cand AS (SELECT station_id, variable, fault, turn, draw, ts AS start_ts, CAST(([1,2,3,4,6])[CAST(floor(u3 * 5) AS INT) + 1] AS BIGINT) AS duration,
                (['mild','moderate','severe'])[CAST(floor(u4 * 3) AS INT) + 1] AS severity,
                row_number() OVER (ORDER BY turn, draw, station_id, ts) AS i FROM open),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, turn BIGINT, station_id BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP)[]) AS kept
  UNION ALL
  SELECT c.i, CASE WHEN len(list_filter(w.kept, lambda k: {placed}(k.station_id = c.station_id AND c.start_ts < k.end_ts AND c.start_ts + to_hours(c.duration) > k.start_ts))) > 0
                   THEN w.kept
                   ELSE list_append(w.kept, CAST(struct_pack(i := c.i, turn := c.turn, station_id := c.station_id, start_ts := c.start_ts, end_ts := c.start_ts + to_hours(c.duration))
                                                 AS STRUCT(i BIGINT, turn BIGINT, station_id BIGINT, start_ts TIMESTAMP, end_ts TIMESTAMP))) END
  FROM walk w JOIN cand c ON c.i = w.i + 1),
chosen AS (SELECT cand.*, row_number() OVER (ORDER BY i) AS seq FROM cand
           WHERE i IN (SELECT unnest(list_transform(kept, lambda k: k.i)) FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)))"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, ctes: str, source: str, tail: str = "") -> None:
        out[name] = f"WITH {ctes.strip()}\nSELECT {shaped_sql(name)} FROM {source} {tail}"

    # sources and sinks
    add("src_csv_clean", OBS, "obs")
    add("obs_normalize", OBS, "obs")
    add("obs_union", OBS, "(SELECT station_id, ts, temperature, CASE WHEN station_id % 2 = 0 THEN humidity END AS humidity, "
        "CASE WHEN station_id % 2 = 1 THEN wind_speed END AS wind_speed FROM obs)")
    qc = ("(SELECT *, CASE WHEN temperature IS NULL OR temperature < -50 OR temperature > 60 THEN 1 ELSE 0 END AS temperature_rule_flag, "
          "CASE WHEN humidity IS NULL OR humidity < 0 OR humidity > 100 THEN 1 ELSE 0 END AS humidity_rule_flag, "
          "CASE WHEN pressure IS NULL OR pressure < 870 OR pressure > 1085 THEN 1 ELSE 0 END AS pressure_rule_flag, "
          "greatest(temperature_rule_flag, humidity_rule_flag, pressure_rule_flag) AS qc_flag FROM obs)")
    add("stage_handoff", OBS, qc)
    meta = OBS + """,
meta AS (SELECT ts, station_id, station_name, latitude, longitude FROM obs WHERE station_id % 3 <> 0),
enr AS (SELECT o.station_id, o.ts, o.temperature, coalesce(m.station_name, 'Station ' || o.station_id) AS station_name, m.latitude, m.longitude
        FROM obs o LEFT JOIN meta m USING (ts, station_id))"""
    add("enrich_metadata", meta, "enr")
    add("enrich_match_report", meta, "(SELECT count(*) AS n_rows, count(latitude) AS n_matched FROM enr)")
    add("handoff_mismatch", FAULTY, "(SELECT count(*) AS n_rows, count(CASE WHEN a.fault_severity <> CASE WHEN a.station_id % 4 = 0 THEN 'mild' "
        "ELSE a.fault_severity END THEN 1 END) AS n_mismatch FROM faulty a)")
    # profiling
    cols = ("station_id", "ts", "station_name", "latitude", "longitude", "temperature", "humidity", "pressure", "wind_speed")
    add("null_profile", OBS, "(" + " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, '{c}' AS column_name, count(*) - count({c}) AS n_null FROM obs" for c in cols) + ")")
    readings = {c: c for c in ("temperature", "humidity", "pressure", "wind_speed")}
    add("describe_readings", OBS, f"({describe_sql('obs', readings, {'p25': 0.25, 'p50': 0.5, 'p75': 0.75})})")
    tails = {"p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}
    add("describe_abs_z", FEAT, "(" + describe_sql("feat", {
        "abs_zscore": "abs(temperature_zscore_24h)", "abs_change": "absolute_temperature_change",
        "abs_deviation": "abs(temperature_deviation_24h)", "abs_trend": "abs(temperature_trend_6h)",
        "std_6h": "temperature_std_6h"}, tails) + ")")
    add("dup_keys", RAW, "(SELECT station_id, ts, count(*) AS n_rows FROM raw GROUP BY station_id, ts HAVING count(*) > 1)")
    gaps = OBS + ", gap AS (SELECT station_id, epoch(ts - lag(ts) OVER (PARTITION BY station_id ORDER BY ts)) / 3600e0 AS gap_hours FROM obs)"
    add("cadence_hist", gaps, "(SELECT station_id, gap_hours, count(*) AS n_rows FROM gap WHERE gap_hours IS NOT NULL GROUP BY 1, 2)")
    add("gap_count", gaps, "(SELECT station_id, count(CASE WHEN gap_hours > 1 THEN 1 END) AS n_gaps FROM gap GROUP BY 1)")
    add("station_catalog", OBS, "(SELECT station_id, min_by(station_name, ts) AS station_name, max(ts) AS last_ts, count(*) AS n_rows FROM obs GROUP BY 1)")
    add("station_dim", STATIONS, "st")
    period = "CASE WHEN h >= 5 AND h < 12 THEN 'Morning' WHEN h >= 12 AND h < 17 THEN 'Afternoon' WHEN h >= 17 AND h < 21 THEN 'Evening' ELSE 'Night' END"
    cal = OBS + f""",
cal AS (SELECT station_id, ts, hour(ts) AS h, hour(ts) AS hour, day(ts) AS day, month(ts) AS month, isodow(ts) - 1 AS day_of_week,
               dayofyear(ts) AS day_of_year, {period} AS time_period FROM obs)"""
    add("calendar_features", cal, "cal")
    add("time_period_counts", cal, "(SELECT time_period, count(*) AS n_rows FROM cal GROUP BY 1)")
    add("week_slice", OBS, "obs", "WHERE station_id = 1 AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
    add("latest_per_station", OBS, "obs", "QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) = 1")
    add("top_hot", OBS, "obs", "ORDER BY temperature DESC NULLS LAST, ts, station_id LIMIT 20")
    add("recent_readings", OBS, "obs", "ORDER BY ts DESC, station_id LIMIT 10")
    add("anomaly_context", FAULTY, "(SELECT r.station_id, r.ts, e.ts AS event_ts, r.temperature, r.is_anomaly, r.fault_type FROM faulty r JOIN faulty e "
        "ON e.station_id = r.station_id AND e.is_anomaly = 1 AND r.ts BETWEEN e.ts - INTERVAL 3 HOUR AND e.ts + INTERVAL 3 HOUR)")
    three = ("temperature", "humidity", "pressure")
    add("impute_median", OBS, "(SELECT station_id, ts, " + ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM obs)) AS {c}" for c in three) + " FROM obs)")
    add("standardize", OBS, "(SELECT station_id, ts, " + ", ".join(
        f"({c} - (SELECT avg({c}) FROM obs)) / (SELECT stddev_pop({c}) FROM obs) AS {c}_scaled" for c in three) + " FROM obs)")
    # features
    add("baseline_24h", FEAT_OBS, "feat")
    add("zscore_24h", FEAT_OBS, "feat")
    add("baseline_24rows", FEAT_OBS, "(SELECT station_id, ts, row_mean AS temperature_rolling_mean_24h, row_std AS temperature_rolling_std_24h, "
        "temperature - row_mean AS temperature_deviation_24h, (temperature - row_mean) / nullif(row_std, 0) AS temperature_zscore_24h FROM feat)")
    for name in ("step_change", "rolling_std_6", "trend_6", "residual_6_12", "direction_counts", "trajectory_change", "sign_flips", "cum_change_6"):
        add(name, FEAT_OBS, "feat")
    add("repeat_length", FEAT, "feat")
    add("max_run", FEAT, "(SELECT station_id, max(repeat_length) AS max_run FROM feat GROUP BY 1)")
    add("run_hist", FEAT, "(SELECT repeat_length, count(*) // repeat_length AS n_runs, count(*) AS n_rows FROM feat GROUP BY 1)")
    add("run_entry_jump", FEAT, "(" + describe_sql("(SELECT * FROM feat WHERE repeat_length >= 3)", {"jump": "absolute_temperature_change"},
        {"p50": 0.5, "p90": 0.9}) + ")")
    add("same_as_prev", FEAT, "(SELECT station_id, count(*) AS n_rows, CAST(sum(1 - run_start) AS BIGINT) AS n_same, avg(1 - run_start) AS same_share FROM feat GROUP BY 1)")
    # detectors
    add("qc_flags", OBS, qc)
    add("qc_totals", OBS, "(SELECT count(*) AS n_rows, " + ", ".join(
        f"CAST(sum({f}) AS BIGINT) AS {f}" for f in ("temperature_rule_flag", "humidity_rule_flag", "pressure_rule_flag", "qc_flag")) + f" FROM {qc})")
    add("stat_range_flag", ENSEMBLE, "ens")
    add("temporal_z", ENSEMBLE, "ens")
    add("statistical_vote", VOTED, "votes")
    add("temporal_vote", VOTED, "(SELECT *, greatest(sudden_change, extreme_trend, CASE WHEN repeat_length >= 6 THEN 1 ELSE 0 END) AS temporal_score_no_std, "
        "greatest(sudden_change, extreme_trend, CASE WHEN repeat_length >= 6 AND temperature_std_6h <= 0.1 THEN 1 ELSE 0 END) AS temporal_score_tight_std FROM votes)")
    add("ensemble_score", ENSEMBLE, "ens")
    add("severity_bands", ENSEMBLE, "(SELECT severity, count(*) AS n_rows FROM ens GROUP BY 1)")
    add("reasons", ENSEMBLE, "ens")
    add("vote_score", VOTED, "votes")
    add("rule_combos", VOTED, "(SELECT sudden_change, frozen_pattern, extreme_trend, count(*) AS n_rows FROM votes WHERE is_anomaly = 0 GROUP BY 1, 2, 3)")
    add("combo_hits", VOTED, "(" + " UNION ALL ".join(
        f"SELECT '{n}' AS combo, count(CASE WHEN fault_type = '{f}' AND {c} THEN 1 END) AS fault_hits, count(CASE WHEN fault_type = '{f}' THEN 1 END) AS fault_rows, "
        f"count(CASE WHEN is_anomaly = 0 AND {c} THEN 1 END) AS normal_hits FROM votes" for n, (f, c) in COMBOS.items()) + ")")
    add("threshold_sweep", VOTED, "(SELECT *, n_hits * 100e0 / n_rows AS percent FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS measure, CAST({t} AS DOUBLE) AS threshold, count(CASE WHEN {e} {op} {t} THEN 1 END) AS n_hits, count(*) AS n_rows FROM votes WHERE is_anomaly = 0"
        for n, (e, ts, op) in SWEEPS.items() for t in ts) + "))")
    parts = ("concat_ws('; ', CASE WHEN rule_score = 1 THEN 'Physical-range quality check flagged the reading' END, "
             "CASE WHEN statistical_score = 1 THEN 'Statistical deviation from the 24h station baseline' END, "
             "CASE WHEN isolation_score = 1 THEN 'Saved Isolation Forest flagged a multivariate anomaly' END, "
             "CASE WHEN temporal_score = 1 THEN 'Temporal pattern (sudden change / freeze / extreme trend)' END)")
    add("explanations", DIAGNOSED, f"""(SELECT station_id, ts, diagnosed_fault, CASE
        WHEN diagnosed_fault = 'NORMAL' AND p = '' THEN 'No detector evidence of anomaly; reading consistent with recent station history'
        WHEN diagnosed_fault = 'NORMAL' THEN 'Detectors raised weak/mixed signals but primary diagnosis remains NORMAL; ' || p
        WHEN diagnosed_fault = 'SUSPICIOUS' THEN 'Detector evidence without a confident specific fault type' || CASE WHEN p = '' THEN '' ELSE ': ' || p END
        ELSE 'Primary diagnosis: ' || diagnosed_fault || CASE WHEN p = '' THEN '' ELSE '. ' || p END END AS explanation
        FROM (SELECT *, {parts} AS p FROM diag))""")
    # spatial
    near = STATIONS + DIST
    add("station_pairs_500km", near, "dist", "WHERE km <= 500")
    add("neighbors_100km", near, "near")
    add("knn_neighbors", near, "(SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) AS rank FROM dist) q", "WHERE rank <= 3")
    add("latest_spatial_check", OBS, """(SELECT a AS station_id, ts, temperature, count(*) AS n_neighbors, avg(t) AS neighbor_average, temperature - avg(t) AS spatial_difference
      FROM (SELECT l.station_id AS a, l.ts, l.temperature, o.temperature AS t,
              row_number() OVER (PARTITION BY l.station_id ORDER BY sqrt(pow(o.latitude - l.latitude, 2) + pow(o.longitude - l.longitude, 2)), o.station_id) AS r
            FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC) = 1) l
            JOIN obs o ON o.ts = l.ts AND o.station_id <> l.station_id AND o.temperature IS NOT NULL WHERE l.temperature IS NOT NULL)
      WHERE r <= 3 GROUP BY a, ts, temperature)""")
    cons = near + consensus("(SELECT *, 0 AS flag0 FROM obs)", "flag0")
    add("neighbor_avg", cons, "(SELECT *, abs(station_value - neighbor_average) AS spatial_difference FROM cons)")
    voted_near = VOTED + STATIONS[len(OBS):] + DIST
    add("neighbor_consensus", voted_near + consensus("votes", "predicted"), "cons")
    evid = voted_near + consensus("votes", "predicted") + EVID
    add("evidence_class", evid, "ev")
    corrected = """(SELECT *, CASE WHEN classification = 'Sensor Fault' THEN coalesce(neighbor_average, lv, station_value) ELSE station_value END AS corrected_value
      FROM (SELECT e.*, l.lv FROM ev e JOIN (SELECT station_id, ts, last_value(temperature IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lv FROM votes) l USING (station_id, ts)))"""
    add("spatial_correct", evid, corrected)
    add("loo_consistency", DIAGNOSED + LOO, "loo")
    cells = ", ".join(f"avg(CASE WHEN station_id % 100 = {k} THEN temperature END) AS c{k}" for k in range(100))
    add("unknown_keys", OBS, "(SELECT station_id, ts + INTERVAL 30 MINUTE AS ts FROM obs WHERE temperature > 5 AND (station_id + hour(ts)) % 3 = 0)")
    add("station_pivot", OBS, f"(SELECT station_id // 100 AS block, ts, {cells} FROM obs GROUP BY 1, 2)")
    boosted = """(SELECT l.station_id, l.ts, l.diagnosed_fault, l.spatial_classification,
        CASE WHEN l.spatial_classification = 'SENSOR_FAULT' AND l.diagnosis_confidence IS NOT NULL THEN least(l.diagnosis_confidence + 0.2e0, 1e0) ELSE l.diagnosis_confidence END AS diagnosis_confidence FROM loo l)"""
    add("spatial_boost", DIAGNOSED + LOO, boosted)
    add("spatial_merge", DIAGNOSED + LOO, "(SELECT d.station_id, d.ts, l.neighbor_avg_temperature, l.neighbor_count, l.spatial_classification FROM diag d LEFT JOIN loo l USING (station_id, ts))")
    pert = "SELECT ts, count(DISTINCT station_id) AS station_count, avg(temperature) AS average_temperature, max(temperature) AS max_temperature, min(temperature) AS min_temperature FROM obs"
    add("regional_heat", OBS, f"({pert} WHERE temperature >= 40 GROUP BY ts HAVING count(DISTINCT station_id) >= 2)")
    add("candidate_times", OBS, f"({pert} GROUP BY ts HAVING count(DISTINCT station_id) >= 2 AND avg(temperature) BETWEEN 10 AND 20)")
    batch = evid + """,
evf AS (
  SELECT *, CASE WHEN classification = 'Sensor Fault' THEN coalesce(neighbor_average, station_value) ELSE station_value END AS corrected_value,
         CASE WHEN classification <> 'Sensor Fault' THEN NULL WHEN station_value < -20 THEN 'temperature_drop' ELSE 'temperature_spike' END AS fault_type
  FROM ev WHERE isolation_score = 1 OR statistical_score = 1)""" + _ledger("evf", "CASE WHEN fault_type IS NULL THEN 0 WHEN fault_type = 'temperature_drop' THEN 10 ELSE 15 END")
    add("spatial_batch", batch, "led")
    # diagnosis and correction
    add("robust_threshold", VOTED + THRESHOLDS, "thr")
    add("diagnose_faults", DIAGNOSED, "diag")
    add("interpolate_gaps", OBS + interpolated("obs", "temperature", "temperature_filled", "ia"), "ia")
    add("correct_rule", CORRECTED, "corr")
    add("health_ledger", FAULTY + _ledger("faulty", _penalty("fault_type")), "led")
    rate = "anomalies * 100e0 / records"
    add("station_health", CORRECTED, f"""(SELECT *, round_even({rate}, 2) AS anomaly_rate, CASE WHEN {rate} < 2 THEN 'Healthy' WHEN {rate} < 5 THEN 'Watch' ELSE 'At Risk' END AS health_status
      FROM (SELECT station_name, count(*) AS records, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, CAST(sum(correction_applied) AS BIGINT) AS corrections FROM mart GROUP BY 1))""")
    # injection
    add("inject_spike_abs", row_faulty("55e0", "spike", 1), "faulty")
    add("inject_drift_rows", row_faulty("temperature + 1e0 * step", "drift", 6), "faulty")
    timed = faulty("s.fault = 'drift'").replace("v + i * ([0.2e0, 0.5e0, 1e0])[sev + 1]", f"v + ([1, -1, 1, 1, -1, 1])[(i - 1) % 6 + 1] * magnitude * (0.4e0 + 0.6e0 * {_unit('station_id, seq, i')})").replace("variable || '_' || fault", "variable || '_noise'")
    normal = f"sqrt(-2e0 * ln({_unit('station_id, station_id, step')})) * cos(2e0 * pi() * {_unit('station_id, station_id, step', 43)})"
    noisy = ",\n".join(f"{form} AS (WITH {ctes.strip()} SELECT station_id, ts, temperature, original_temperature, is_anomaly, fault_type, '{form}' AS form FROM faulty)" for form, ctes in (("timed", timed), ("rows", row_faulty(f"temperature + 2e0 * {normal}", "noise", 6))))
    add("inject_noise", noisy.replace("rows AS (WITH", '"rows" AS (WITH'), '(FROM timed UNION ALL FROM "rows")')
    add("inject_frozen_rows", row_faulty("first_value(temperature) OVER (PARTITION BY station_id, hit ORDER BY rn)", "frozen", 6), "faulty")
    add("inject_missing_rows", row_faulty("CAST(NULL AS DOUBLE)", "missing", 4), "faulty")
    for f in ("spike", "drop", "frozen", "drift", "missing", "multivariate"):
        add(f"inject_{f}", faulty(f"s.fault = '{f}'"), "faulty")
    bad = SPEC + """,
rspec AS (SELECT station_id + CASE WHEN station_id % 5 = 4 THEN 1000000 ELSE 0 END AS station_id, station_id AS seq,
            CASE WHEN station_id % 5 = 0 THEN -1 WHEN station_id % 5 = 1 THEN 100000000 ELSE 3 END AS start_row,
            CASE WHEN station_id % 5 = 2 THEN 0 ELSE 6 END AS duration FROM (SELECT DISTINCT station_id FROM obs)),
n AS (SELECT station_id, count(*) AS n FROM obs GROUP BY 1),
prob AS (SELECT r.*, CASE WHEN n.n IS NULL THEN 'unknown station' WHEN start_row < 0 THEN 'start before first row'
           WHEN duration <= 0 THEN 'duration not positive' WHEN start_row + duration > n.n THEN 'span exceeds rows' END AS problem
         FROM rspec r LEFT JOIN n USING (station_id))"""
    add("invalid_specs", bad, "prob", "WHERE problem IS NOT NULL")
    add("inject_overlap", OVERLAPPED, "faulty")
    shifted = SPEC + """,
sp AS (SELECT seq, station_id, start_ts, start_ts + to_hours(duration) AS end_ts FROM spec
       UNION ALL SELECT seq + 1000000, station_id, start_ts + INTERVAL 1 HOUR, start_ts + INTERVAL 3 HOUR FROM spec WHERE seq % 3 = 0)"""
    add("schedule_overlaps", shifted, "sp x", "WHERE EXISTS (SELECT 1 FROM sp y WHERE y.station_id = x.station_id AND (y.start_ts < x.start_ts OR (y.start_ts = x.start_ts AND y.seq < x.seq)) AND y.end_ts > x.start_ts)")
    isl = FAULTY + """,
b0 AS (SELECT station_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM faulty WHERE is_anomaly = 1 WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
b1 AS (SELECT *, sum(fresh) OVER (PARTITION BY station_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM b0),
b AS (SELECT station_id, min(ts) - INTERVAL 1 HOUR AS region_start, max(ts) + INTERVAL 1 HOUR AS region_end, count(*) AS n_rows FROM b1 GROUP BY station_id, island)"""
    add("fault_islands", isl, "b")
    draws = OBS + f""",
h AS (SELECT station_id, ts, {_unit("station_id, ts")} AS draw FROM obs),
d AS (SELECT station_id, ts, draw, 0 AS turn, {_unit("station_id, ts", 43)} AS u1, {_unit("station_id, ts", 44)} AS u2,
             {_unit("station_id, ts", 45)} AS u3, {_unit("station_id, ts", 46)} AS u4
      FROM (SELECT * FROM h ORDER BY draw, station_id, ts LIMIT 1000)),
open AS (SELECT *, (['spike','drop','frozen','drift','missing','multivariate'])[CAST(floor(u2 * 6) AS INT) + 1] AS fault,
             CASE WHEN fault = 'multivariate' THEN 'temperature' ELSE (['temperature','humidity','pressure'])[CAST(floor(u1 * 3) AS INT) + 1] END AS variable FROM d)"""
    add("fault_schedule", "RECURSIVE " + draws.strip() + _greedy(False), "chosen", "WHERE seq <= 100")
    each = isl + f""",
ranked AS (SELECT station_id, ts, row_number() OVER w AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM faulty WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
combo AS (SELECT unnest(range(10)) AS turn),
h AS (SELECT station_id, ts, turn, (['humidity','pressure'])[turn // 5 + 1] AS variable, (['spike','frozen','drift','noise','missing'])[turn % 5 + 1] AS fault,
             {_unit("station_id, ts, turn")} AS draw FROM ranked, combo WHERE rn > 200 AND rn <= n - 200),
d AS (SELECT *, {_unit("station_id, ts, turn", 45)} AS u3, {_unit("station_id, ts, turn", 46)} AS u4
      FROM h QUALIFY row_number() OVER (PARTITION BY turn ORDER BY draw, station_id, ts) <= 200),
open AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.station_id = d.station_id AND d.ts < b.region_end
           AND d.ts + to_hours(CAST(([1,2,3,4,6])[CAST(floor(u3 * 5) AS INT) + 1] AS BIGINT)) > b.region_start))"""
    add("fault_schedule_each", "RECURSIVE " + each.strip() + _greedy(True), "chosen")
    add("fault_summary", FAULTY, "(SELECT fault_type, fault_severity, count(*) AS n_rows FROM faulty GROUP BY 1, 2)")
    types = ("normal", "temperature_spike", "temperature_drop", "temperature_frozen", "temperature_drift", "temperature_missing", "multivariate_inconsistency")
    add("fault_crosstab", FAULTY, "(SELECT station_id, " + ", ".join(f"count(CASE WHEN fault_type = '{t}' THEN 1 END) AS {t}" for t in types) + " FROM faulty GROUP BY 1)")
    add("injection_diff", FAULTY, "(SELECT station_id, ts, fault_type, fault_severity, " + ", ".join(
        f"original_{v} AS before_{v}, {v} AS after_{v}" for v in three) + " FROM faulty WHERE is_anomaly = 1)")
    # evaluation
    add("confusion", VOTED, "(SELECT is_anomaly AS truth, predicted AS prediction, count(*) AS n_rows FROM votes GROUP BY 1, 2)")
    cells = VOTED + """,
cm AS (SELECT count(CASE WHEN is_anomaly = 0 AND predicted = 0 THEN 1 END) AS tn, count(CASE WHEN is_anomaly = 0 AND predicted = 1 THEN 1 END) AS fp,
              count(CASE WHEN is_anomaly = 1 AND predicted = 0 THEN 1 END) AS fn, count(CASE WHEN is_anomaly = 1 AND predicted = 1 THEN 1 END) AS tp FROM votes)""" + f""",
pc AS (SELECT '0' AS label, {prf('tn', 'fn', 'fp')}, tn + fp AS support FROM cm UNION ALL SELECT '1', {prf('tp', 'fp', 'fn')}, tp + fn FROM cm),
rep AS (SELECT * FROM pc UNION ALL
        SELECT 'accuracy', (tp + tn) * 1e0 / (tp + tn + fp + fn), (tp + tn) * 1e0 / (tp + tn + fp + fn), (tp + tn) * 1e0 / (tp + tn + fp + fn), tp + tn + fp + fn FROM cm UNION ALL
        SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pc UNION ALL
        SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pc)"""
    add("class_report", cells, "rep")
    auc = """(SELECT (sum(CASE WHEN {t} = 1 THEN rk END) - count(CASE WHEN {t} = 1 THEN 1 END) * (count(CASE WHEN {t} = 1 THEN 1 END) + 1) / 2e0)
        / (count(CASE WHEN {t} = 1 THEN 1 END) * 1e0 * count(CASE WHEN {t} = 0 THEN 1 END)) AS auc, count(CASE WHEN {t} = 1 THEN 1 END) AS n_pos, count(CASE WHEN {t} = 0 THEN 1 END) AS n_neg
      FROM (SELECT {t}, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2e0 AS rk FROM {src}))"""
    add("roc_auc", ENSEMBLE, auc.format(t="is_anomaly", s="ensemble_score", src="ens"))
    add("roc_auc_by_detector", VOTED, "(" + _detectors_union(
        "(1 + avg(CASE WHEN is_anomaly = 1 THEN {d} END) - avg(CASE WHEN is_anomaly = 0 THEN {d} END)) / 2 AS auc") + ")")
    for name, by in (("prf_by_fault", "fault_type"), ("prf_by_severity", "fault_severity")):
        add(name, VOTED, f"""(SELECT *, {prf('tp', 'fp', 'fn')} FROM (SELECT {by}, count(*) AS n_rows, count(CASE WHEN predicted = 1 THEN 1 END) AS tp,
            count(CASE WHEN predicted = 0 THEN 1 END) AS fn, (SELECT count(*) FROM votes WHERE is_anomaly = 0 AND predicted = 1) AS fp FROM votes WHERE is_anomaly = 1 GROUP BY 1))""")
    add("prf_by_station", VOTED, f"""(SELECT *, {prf('tp', 'fp', 'fn')} FROM (SELECT station_name, count(CASE WHEN is_anomaly = 1 AND predicted = 1 THEN 1 END) AS tp,
        count(CASE WHEN is_anomaly = 0 AND predicted = 1 THEN 1 END) AS fp, count(CASE WHEN is_anomaly = 1 AND predicted = 0 THEN 1 END) AS fn FROM votes GROUP BY 1) WHERE tp + fn > 0)""")
    add("detector_metrics", VOTED, f"(SELECT *, {prf('hits', '(predicted - hits)', 'fn')} FROM (" + _detectors_union(
        "CAST(sum({d}) AS BIGINT) AS predicted, count(CASE WHEN is_anomaly = 1 AND {d} = 1 THEN 1 END) AS hits, count(CASE WHEN is_anomaly = 1 AND {d} = 0 THEN 1 END) AS fn") + "))")
    add("vote_sweep", VOTED, f"(SELECT *, {prf('hits', '(predicted - hits)', 'fn')} FROM (" + " UNION ALL ".join(
        f"SELECT {t} AS threshold, count(CASE WHEN anomaly_score >= {t} THEN 1 END) AS predicted, count(CASE WHEN is_anomaly = 1 AND anomaly_score >= {t} THEN 1 END) AS hits, "
        f"count(CASE WHEN is_anomaly = 1 AND anomaly_score < {t} THEN 1 END) AS fn FROM votes" for t in (1, 2, 3)) + "))")
    add("detection_rate", VOTED, "(SELECT fault_type, count(*) AS n_rows, CAST(sum(predicted) AS BIGINT) AS n_detected, avg(predicted) AS rate FROM votes GROUP BY 1)")
    add("feature_by_fault", VOTED, "(SELECT fault_type, count(absolute_temperature_change) AS n, min(absolute_temperature_change) AS min, avg(absolute_temperature_change) AS mean, "
        "quantile_cont(absolute_temperature_change, 0.5) AS median, max(absolute_temperature_change) AS max FROM votes GROUP BY 1)")
    add("detector_count", VOTED, "(SELECT fault_type, count(*) AS n_rows, avg(anomaly_score) AS mean_votes, min(anomaly_score) AS min_votes, max(anomaly_score) AS max_votes, "
        + ", ".join(f"count(CASE WHEN anomaly_score = {k} THEN 1 END) AS votes_{k}" for k in range(5)) + " FROM votes WHERE is_anomaly = 1 GROUP BY 1)")
    err = "count(*) AS n, CAST(sum(correction_applied) AS BIGINT) AS n_corrected, avg(abs(temperature_corrected - original_temperature)) AS mae, sqrt(avg(pow(temperature_corrected - original_temperature, 2))) AS rmse FROM corr WHERE is_anomaly = 1"
    add("correction_error", CORRECTED, f"(SELECT fault_type, {err} GROUP BY 1 UNION ALL SELECT 'OVERALL', {err})")
    add("match_rate", DIAGNOSED, """(SELECT fault_type, count(*) AS n, avg(CASE WHEN diagnosed_fault = CASE WHEN fault_type LIKE '%missing%' THEN 'MISSING'
        WHEN fault_type LIKE '%spike%' THEN 'SPIKE' WHEN fault_type LIKE '%frozen%' THEN 'FROZEN' WHEN fault_type LIKE '%drift%' THEN 'DRIFT'
        WHEN fault_type LIKE '%noise%' THEN 'NOISE' END THEN 1 ELSE 0 END) AS match_rate FROM diag WHERE is_anomaly = 1 GROUP BY 1)""")
    add("model_agreement", VOTED, """(SELECT count(*) AS n_rows, avg(CASE WHEN isolation_score = statistical_score THEN 1 ELSE 0 END) AS accuracy,
        sum(isolation_score * statistical_score) * 1e0 / sum(statistical_score) AS precision, sum(isolation_score * statistical_score) * 1e0 / sum(isolation_score) AS recall,
        sum(is_anomaly * isolation_score) * 1e0 / sum(is_anomaly) AS old_truth_recall, sum(is_anomaly * statistical_score) * 1e0 / sum(is_anomaly) AS new_truth_recall FROM votes)""")
    add("diag_distribution", CORRECTED, "(SELECT diagnosed_fault, count(*) AS n_rows, CAST(sum(correction_applied) AS BIGINT) AS n_corrected FROM corr GROUP BY 1)")
    labels = ("NORMAL", "SUSPICIOUS", "MISSING", "SPIKE", "FROZEN", "DRIFT", "NOISE")
    add("diag_crosstab", DIAGNOSED, "(SELECT fault_type, " + ", ".join(f"count(CASE WHEN diagnosed_fault = '{x}' THEN 1 END) AS {x.lower()}" for x in labels) + " FROM diag GROUP BY 1)")
    # monitoring marts
    kpi = "count(*) AS records, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, CAST(sum(correction_applied) AS BIGINT) AS corrections FROM mart"
    add("kpi", CORRECTED, f"""(SELECT *, records - anomalies AS normal, {rate} AS anomaly_rate, CASE WHEN anomalies = 0 THEN 'Normal' WHEN {rate} < 5 THEN 'Monitoring' ELSE 'Elevated' END AS status
        FROM (SELECT station_name, {kpi} GROUP BY 1 UNION ALL SELECT 'All Stations', {kpi}))""")
    add("latest_alert", CORRECTED, "mart", "WHERE is_anomaly = 1 ORDER BY ts DESC, station_id DESC LIMIT 1")
    add("fault_counts", CORRECTED, "(SELECT upper(diagnosed_fault) AS diagnosed_fault, count(*) AS n_rows, max(is_anomaly) AS is_fault FROM mart GROUP BY 1)")
    add("method_counts", CORRECTED, "(SELECT 'rule_based' AS correction_method, count(*) AS n_rows FROM mart WHERE correction_applied = 1)")
    add("confidence_hist", CORRECTED, """(SELECT CAST(least(floor((c - lo) / CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1 END), 19) AS INTEGER) AS bin, count(*) AS n_rows
        FROM (SELECT diagnosis_confidence AS c, min(diagnosis_confidence) OVER () AS lo, max(diagnosis_confidence) OVER () AS hi FROM mart WHERE is_anomaly = 1 AND diagnosis_confidence IS NOT NULL) GROUP BY 1)""")
    add("signal_means", VOTED, "(" + _detectors_union("round_even(avg({d}), 4) AS mean_vote") + ")")
    add("station_compare", CORRECTED, "(SELECT station_name, count(*) AS total_records, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, round_even(sum(is_anomaly) * 100e0 / count(*), 2) AS anomaly_rate FROM mart GROUP BY 1)")
    add("series_overlay", CORRECTED, "mart")
    # streams, read to the end
    add("stream_qc", OBS, qc.replace(" FROM obs)", ", CASE WHEN temperature < -20 OR temperature > 50 OR pressure < 950 OR pressure > 1050 OR humidity < 0 OR humidity > 100 THEN 1 ELSE 0 END AS statistical_anomaly FROM "
        "(SELECT *, CASE WHEN is_error AND k % 10 = 0 THEN NULL ELSE value / 5e0 - 10e0 END AS temperature, k * 1.05e0 AS humidity, 940e0 + (event_id * 37) % 160 AS pressure FROM raw))"))
    add("stream_dedup", RAW, "(SELECT DISTINCT station_id, ts FROM raw)")
    add("stream_kpis", OBS, f"""(SELECT station_id, date_trunc('day', ts) AS window_start, count(*) AS n_rows, CAST(sum(qc_flag) AS BIGINT) AS n_flagged, avg(temperature) AS mean_temperature
        FROM {qc} GROUP BY 1, 2)""")
    add("stream_sliding", OBS, f"""(SELECT station_id, window_start, count(*) AS n_rows, CAST(sum(qc_flag) AS BIGINT) AS n_flagged, avg(temperature) AS mean_temperature
        FROM (SELECT *, unnest([date_trunc('day', ts) + to_hours(CAST(hour(ts) // 12 * 12 AS INTEGER)), date_trunc('day', ts) + to_hours(CAST(hour(ts) // 12 * 12 - 12 AS INTEGER))]) AS window_start FROM {qc}) GROUP BY 1, 2)""")
    live = FEAT_OBS + """,
live0 AS (
  SELECT *, temperature - row_mean AS dev, (temperature - row_mean) / nullif(row_std, 0) AS z FROM feat),
live AS (
  SELECT station_id, ts, z AS temperature_zscore_24h, running_length,
    CASE WHEN temperature IS NULL OR temperature < -50 OR temperature > 60 OR humidity IS NULL OR humidity < 0
           OR humidity > 100 OR pressure IS NULL OR pressure < 870 OR pressure > 1085 THEN 1 ELSE 0 END AS rule_score,
    CASE WHEN abs(z) > 3 OR abs(dev) > 10 THEN 1 ELSE 0 END AS statistical_score,
    CASE WHEN absolute_temperature_change > 6 OR (running_length >= 6 AND temperature_std_6h_live <= 1.0) OR abs(temperature_trend_6h) > 3 THEN 1 ELSE 0 END AS temporal_score
  FROM live0)"""
    add("stream_causal_votes", live, "live")
    add("stream_late_votes", live, "live")
    add("stream_health", FAULTY + _ledger("faulty", _penalty("fault_type")), "led")
    return out
