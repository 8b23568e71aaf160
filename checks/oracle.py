"""SQL (DuckDB dialect) that gives the result of each query on the same tables.

Written on its own terms: plain window frames, range joins and counts, no shared code
with the engine.
"""

from __future__ import annotations

SENSORS = ("s1", "s2", "s3", "s4")
LABELS = ("t1", "t2", "t3", "t4")

HOLED = "CASE WHEN (l_orderkey*7 + l_linenumber*3 + l_partkey) % 5 = 0 THEN NULL ELSE l_quantity END"


def _raw(name: str, s1: str) -> str:
    return f"""{name} AS (
  SELECT l_suppkey AS entity, l_shipdate AS ts, {s1} AS s1, l_extendedprice AS s2,
         l_discount AS s3, l_tax AS s4,
         CAST(l_returnflag = 'R' AS TINYINT) AS t1, CAST(l_linestatus = 'F' AS TINYINT) AS t2,
         CAST(l_quantity >= 49 AS TINYINT) AS t3, CAST(l_discount >= 0.1 AS TINYINT) AS t4,
         l_orderkey AS a1, l_linenumber AS a2, l_partkey AS a3
  FROM lineitem)"""


def _last(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn, a1, a2, a3) FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, ts ORDER BY a1 DESC, a2 DESC, a3 DESC) AS rn
    FROM {source}) WHERE rn = 1)"""


RAW = _raw("panel_raw", "l_quantity")
RAW_HOLES = _raw("panel_raw", HOLED)
PANEL = RAW + ",\n" + _last("panel", "panel_raw")
HOLES = RAW_HOLES + ",\n" + _last("panel", "panel_raw")
LIVE = """live AS (
  SELECT user_id AS entity, ts, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
         CAST(event_type = 'error' AS TINYINT) AS error, CAST(event_type = 'purchase' AS TINYINT) AS purchase,
         CAST(event_type = 'signup' AS TINYINT) AS signup, CAST(event_type = 'click' AS TINYINT) AS click
  FROM events)"""


def iso(column: str) -> str:
    return (
        f"CASE WHEN epoch_us({column}) % 1000000 = 0 THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def tidy(value: str, digits: int) -> str:
    """Rounded from nine decimals: the last bit of a mean depends on the order of its rows."""
    return f"CAST(round(CAST({value} AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


QUERIES: dict[str, str] = {}
Q = QUERIES

# --- sources -------------------------------------------------------------------------
Q["csv_scan"] = f"""WITH {RAW}
SELECT CAST(entity AS VARCHAR) AS entity, ts, {", ".join(f"CAST({s} AS FLOAT) AS {s}" for s in SENSORS)},
       t1, t2, t3, t4 FROM panel_raw"""
Q["csv_quoted_scan"] = """
SELECT doc_id, md5('He said "' || text || '", a line' || chr(10) || 'and more') AS quoted_md5, md5(text) AS text_md5, source FROM documents"""
Q["parquet_scan"] = f"WITH {RAW} SELECT entity, ts, s1 FROM panel_raw"
Q["file_order_keep_last"] = f"WITH {PANEL} SELECT entity, ts, s1, s2 FROM panel"

# --- validation ----------------------------------------------------------------------
Q["validation_counts"] = f"""WITH {RAW_HOLES}
SELECT count(*) AS rows, count(DISTINCT entity) AS entities,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT entity, ts FROM panel_raw)) AS duplicate_keys,
       {", ".join(f"count(*) - count({c}) AS missing_{c}" for c in ("ts", "entity", *SENSORS, "t1", "a2"))},
       count(*) FILTER (s1 < 5 OR s1 > 45) AS outside_s1,
       count(*) FILTER (s2 < 2000 OR s2 > 90000) AS outside_s2,
       count(*) FILTER (s3 < CAST(0.01 AS DOUBLE) OR s3 > CAST(0.09 AS DOUBLE)) AS outside_s3,
       count(*) FILTER (s4 < 0 OR s4 > CAST(0.07 AS DOUBLE)) AS outside_s4,
       1 AS invalid_labels,
       count(DISTINCT a2) FILTER (a2 NOT IN (0, 1)) AS invalid_a2_values, count(*) FILTER (a2 NOT IN (0, 1)) AS invalid_a2_rows,
       strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp_start,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp_end
FROM panel_raw"""
Q["bounds_check"] = f"""WITH {RAW}
SELECT 's1' AS sensor, count(*) AS out_of_bounds FROM panel_raw WHERE s1 NOT BETWEEN 5 AND 45
UNION ALL SELECT 's2', count(*) FROM panel_raw WHERE s2 NOT BETWEEN 2000 AND 90000
UNION ALL SELECT 's3', count(*) FROM panel_raw WHERE s3 NOT BETWEEN CAST(0.01 AS DOUBLE) AND CAST(0.09 AS DOUBLE)
UNION ALL SELECT 's4', count(*) FROM panel_raw WHERE s4 NOT BETWEEN 0 AND CAST(0.07 AS DOUBLE)"""
Q["validation_report_many_invalid"] = f"WITH {RAW}\n" + union(
    [f"SELECT '{c}' AS label, count(DISTINCT {c}) AS distinct_values, count(*) AS rows FROM panel_raw WHERE {c} NOT IN (0, 1)" for c in ("a2", "a3")]
)
Q["binary_domain_check"] = f"""WITH {RAW}
SELECT 'a2' AS label, CAST(a2 AS DOUBLE) AS value, count(*) AS rows FROM panel_raw WHERE a2 NOT IN (0, 1) GROUP BY a2"""
Q["missing_required"] = "WITH " + RAW_HOLES + "\n" + union(
    [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM panel_raw" for c in ("ts", "entity", *SENSORS, *LABELS)]
)
Q["duplicate_surplus"] = f"""WITH {RAW}
SELECT CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM panel_raw GROUP BY entity, ts)"""
Q["duplicate_members"] = f"""WITH {RAW}
SELECT CAST(sum(n) AS BIGINT) AS members FROM (SELECT count(*) AS n FROM panel_raw GROUP BY entity, ts) WHERE n > 1"""

# --- cleaning ------------------------------------------------------------------------
Q["clean_keep_last"] = f"WITH {PANEL} SELECT * FROM panel"
Q["clean_table"] = f"""WITH {HOLES}
SELECT CAST(entity AS VARCHAR) AS entity, ts,
       {", ".join(f"CAST(CAST({s} AS FLOAT) AS DOUBLE) AS {s}" for s in SENSORS)},
       t1, t2, t3, t4, s1 IS NULL AS row_has_missing_sensor FROM panel"""
_INTERPOLATE = f"""WITH {HOLES},
numbered AS (SELECT entity, ts, s1, s2, row_number() OVER (PARTITION BY entity ORDER BY ts) AS rn FROM panel),
known AS (SELECT entity, ts, s1, rn FROM numbered WHERE s1 IS NOT NULL),
framed AS (
  SELECT n.*, p.ts AS pt, p.s1 AS pv, p.rn AS pr FROM numbered n
  ASOF LEFT JOIN known p ON n.entity = p.entity AND n.ts >= p.ts),
closed AS (
  SELECT f.*, x.ts AS nt, x.s1 AS nv FROM framed f
  ASOF LEFT JOIN known x ON f.entity = x.entity AND f.ts <= x.ts)
SELECT entity, ts, s2, round(CASE
    WHEN s1 IS NOT NULL THEN s1
    WHEN rn - pr <= 2 AND nv IS NOT NULL
      THEN pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)) END, 6) AS s1
FROM closed"""
Q["interpolate_gaps"] = Q["interpolate_gaps_long_entities"] = _INTERPOLATE


# --- splits --------------------------------------------------------------------------
def _split(columns: str, train: str, both: str, gap: int) -> str:
    return f"""WITH {PANEL},
numbered AS (
  SELECT entity, ts, s1, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS i,
         count(*) OVER (PARTITION BY entity) AS n FROM panel),
cut AS (SELECT *, floor(n * CAST({train} AS DOUBLE)) AS a, floor(n * ({both})) AS b FROM numbered),
manifest AS (
  SELECT {columns}, CASE WHEN i < a THEN 'train' WHEN i < b THEN 'validation' ELSE 'test' END AS split,
       (i >= a - {gap} AND i < a + {gap}) OR (i >= b - {gap} AND i < b + {gap}) AS is_boundary_gap
  FROM cut)"""


_BOTH = "CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE)"
Q["split_manifest"] = Q["split_manifest_long_entities"] = _split("entity, ts", "0.7", _BOTH, 24) + "\nSELECT * FROM manifest"
Q["split_joined"] = _split("entity, ts", "0.7", _BOTH, 24) + """
SELECT panel.entity, panel.ts, s1, split, is_boundary_gap FROM panel LEFT JOIN manifest USING (entity, ts)"""
Q["split_by_window"] = _split("entity, ts, s1", "0.6", "CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE)", 10) + "\nSELECT * FROM manifest"
Q["leakage_free"] = _split("entity, ts, s1", "0.7", _BOTH, 24) + "\nSELECT * FROM manifest WHERE NOT is_boundary_gap"
Q["pipeline_manifest"] = _split("CAST(entity AS VARCHAR) AS entity, ts, CAST(CAST(s1 AS FLOAT) AS DOUBLE) AS s1", "0.7", _BOTH, 24) + "\nSELECT * FROM manifest"

# --- targets -------------------------------------------------------------------------
Q["future_value"] = f"""WITH {PANEL}
SELECT entity, ts, s1, lead(s1, 6) OVER (PARTITION BY entity ORDER BY ts) AS s1_in_6 FROM panel"""


def _event(source: str, column: str, horizon: int, output: str) -> str:
    return f"""WITH {source}
SELECT entity, ts, {column}, CAST(CASE WHEN count({column}) OVER f = {horizon} THEN max({column}) OVER f END AS FLOAT) AS {output}
FROM panel WINDOW f AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)"""


Q["future_label"] = Q["future_label_long_entities"] = _event(PANEL, "t3", 24, "t3_within_24")
Q["future_label_missing_values"] = _event(HOLES, "s1", 3, "s1_peak")

# --- features ------------------------------------------------------------------------
_CALENDAR = """CAST(hour(ts) AS TINYINT) AS hour, CAST(isodow(ts) - 1 AS TINYINT) AS day_of_week, CAST(month(ts) AS TINYINT) AS month,
       CAST(dayofyear(ts) AS SMALLINT) AS day_of_year, CAST(isodow(ts) >= 6 AS TINYINT) AS is_weekend"""
Q["calendar_features"] = f"WITH {LIVE} SELECT entity, ts, {_CALENDAR} FROM live"
Q["cyclic_features"] = f"""WITH {LIVE}
SELECT entity, ts,
       round(CAST(CAST(sin(2 * pi() * hour(ts) / 24) AS FLOAT) AS DOUBLE), 5) AS hour_sin,
       round(CAST(CAST(cos(2 * pi() * hour(ts) / 24) AS FLOAT) AS DOUBLE), 5) AS hour_cos,
       round(CAST(CAST(sin(2 * pi() * dayofyear(ts) / 365.25) AS FLOAT) AS DOUBLE), 5) AS day_of_year_sin,
       round(CAST(CAST(cos(2 * pi() * dayofyear(ts) / 365.25) AS FLOAT) AS DOUBLE), 5) AS day_of_year_cos
FROM live"""


def _shifts(sensor: str, steps: tuple[int, ...]) -> list[str]:
    lags = [f"lag({sensor}, {k}) OVER w AS {sensor}_lag_{k}h" for k in steps]
    return lags + [f"round({sensor} - lag({sensor}, {k}) OVER w, 6) AS {sensor}_change_{k}h" for k in steps]


def _rolls(sensor: str, windows: tuple[int, ...], statistics: tuple[str, ...]) -> list[str]:
    calls = {"mean": "round(avg({0}) OVER f{1}, 5)", "std": "round(stddev_samp({0}) OVER f{1}, 3)", "min": "min({0}) OVER f{1}", "max": "max({0}) OVER f{1}"}
    return [
        f"CASE WHEN count({sensor}) OVER f{w} = {w} THEN {calls[name].format(sensor, w)} END AS {sensor}_roll_{name}_{w}h"
        for w in windows
        for name in statistics
    ]


def _frames(windows: tuple[int, ...]) -> str:
    order = "PARTITION BY entity ORDER BY ts"
    frames = [f"f{w} AS ({order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in windows]
    return "WINDOW " + ", ".join([f"w AS ({order})", *frames])


Q["lag_change"] = f"""WITH {PANEL}
SELECT entity, ts, s1, s2, {", ".join(_shifts("s1", (1, 6, 24)) + _shifts("s2", (1, 6, 24)))}
FROM panel {_frames(())}"""
_ALL = ("mean", "std", "min", "max")
Q["rolling_statistics"] = f"""WITH {HOLES}
SELECT entity, ts, s1, s2, {", ".join(_rolls("s1", (6, 24), _ALL) + _rolls("s2", (6, 24), _ALL))}
FROM panel {_frames((6, 24))}"""
_SET = [part for s in SENSORS for part in _shifts(s, (1, 6, 24, 72)) + _rolls(s, (6, 24, 72), ("mean", "std"))]
Q["feature_set"] = Q["feature_set_long_entities"] = f"""WITH {PANEL}
SELECT entity, ts, s1, s2, s3, s4, {_CALENDAR},
       {", ".join(_SET)}
FROM panel {_frames((6, 24, 72))}"""


# --- exploratory statistics ----------------------------------------------------------
def _sampling(source: str) -> str:
    return f"""sampling AS (
  SELECT CASE WHEN median(step) > 0 THEN median(step) / 1000000 END AS seconds FROM (
    SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY ts) AS step FROM {source}))"""


Q["dataset_summary"] = f"""WITH {PANEL}, {_sampling("panel")}
SELECT count(*) AS total_records, count(DISTINCT entity) AS total_entities,
       {iso("min(ts)")} AS analysis_start, {iso("max(ts)")} AS analysis_end,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 86400, 2) AS duration_days,
       (SELECT CASE WHEN seconds IS NULL THEN 'unknown'
                    WHEN seconds % 3600 = 0 THEN printf('%g', seconds / 3600) || CASE WHEN seconds = 3600 THEN ' hour' ELSE ' hours' END
                    WHEN seconds % 60 = 0 THEN printf('%g', seconds / 60) || ' minutes'
                    ELSE printf('%g', seconds) || ' seconds' END FROM sampling) AS sampling_frequency
FROM panel"""
Q["sampling_interval"] = f"WITH {PANEL}, {_sampling('panel')} SELECT seconds FROM sampling"
Q["sampling_interval_long_entities"] = f"WITH {LIVE}, {_sampling('live')} SELECT seconds FROM sampling"


def _statistics(source: str, digits: int, names: dict[str, str]) -> str:
    parts = []
    for s in SENSORS:
        values = {
            "mean": f"avg({s})", "std": f"stddev_samp({s})", "min": f"min({s})", "q1": f"quantile_cont({s}, 0.25)",
            "median": f"quantile_cont({s}, 0.5)", "q3": f"quantile_cont({s}, 0.75)", "max": f"max({s})",
        }
        cells = ", ".join(f"{tidy(v, digits)} AS {names.get(n, n)}" for n, v in values.items())
        parts.append(f"SELECT '{s}' AS sensor, count({s}) AS count, {cells} FROM panel")
    return f"WITH {source}\n" + union(parts)


Q["sensor_statistics"] = Q["sensor_statistics_many_values"] = _statistics(HOLES, 3, {})
Q["sensor_summary_report"] = _statistics(PANEL, 4, {"q1": "q25", "median": "q50", "q3": "q75"})
Q["outlier_analysis"] = f"WITH {PANEL}\n" + union(
    [
        f"""SELECT '{s}' AS sensor, count(*) FILTER ({s} < lo OR {s} > hi) AS count,
       {tidy(f"(count(*) FILTER ({s} < lo OR {s} > hi) * 100.0 / count({s}))", 4)} AS percentage,
       {tidy("any_value(lo)", 3)} AS lower_bound, {tidy("any_value(hi)", 3)} AS upper_bound
FROM panel, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(CAST({s} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({s} AS DOUBLE), 0.75) AS q3 FROM panel))"""
        for s in (*SENSORS, "t3")
    ]
)


def _histogram(source: str, name: str, sensors: tuple[str, ...], bins: int) -> str:
    parts = [
        f"""SELECT '{s}' AS sensor, CAST(b.bin AS INTEGER) AS bin, {tidy("b.lo", 3)} AS bin_start, {tidy("b.hi", 3)} AS bin_end,
       {tidy("((b.lo + b.hi) / 2)", 3)} AS bin_center, count(p.{s}) AS count
FROM (SELECT bin, mn + bin * ((mx - mn) / {bins}) AS lo,
             CASE WHEN bin = {bins - 1} THEN mx ELSE mn + (bin + 1) * ((mx - mn) / {bins}) END AS hi
      FROM range(0, {bins}) r(bin), (SELECT min({s}) AS mn, max({s}) AS mx FROM {name})) b
LEFT JOIN {name} p ON p.{s} >= b.lo AND (p.{s} < b.hi OR (b.bin = {bins - 1} AND p.{s} <= b.hi))
GROUP BY b.bin, b.lo, b.hi"""
        for s in sensors
    ]
    return f"WITH {source}\n" + union(parts)


Q["sensor_histogram"] = _histogram(PANEL, "panel", SENSORS, 36)
Q["sensor_histogram_report"] = _histogram(LIVE, "live", ("value", "k"), 50)


def _corr(a: str, b: str) -> str:
    return tidy(f"(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END)", 4)


Q["sensor_correlation"] = f"WITH {HOLES}\n" + union(
    [f"SELECT '{a}' AS row, '{b}' AS \"column\", {_corr(a, b)} AS correlation FROM panel" for a in SENSORS for b in SENSORS]
)
Q["sensor_correlation_matrix"] = f"WITH {PANEL}\n" + union(
    [f"SELECT '{a}' AS sensor, " + ", ".join(f"{_corr(a, b)} AS {b}" for b in SENSORS) + " FROM panel" for a in SENSORS]
)
_COVERAGE = f"""WITH {PANEL}, {_sampling("panel")},
spans AS (
  SELECT entity, count(*) AS records, min(ts) AS first, max(ts) AS last,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds FROM panel GROUP BY entity),
coverage AS (
  SELECT entity, records, {iso("first")} AS start, {iso("last")} AS "end",
         round(spans.seconds / 86400, 2) AS duration_days,
         CAST(round_even(spans.seconds / sampling.seconds, 0) + 1 AS BIGINT) AS expected_records
  FROM spans, sampling)"""
Q["entity_coverage"] = _COVERAGE + """
SELECT *, round(least(100.0, CAST(records AS DOUBLE) / expected_records * 100), 3) AS coverage_percentage FROM coverage"""
Q["coverage_duration"] = _COVERAGE + "\nSELECT entity, duration_days AS value FROM coverage"
Q["entity_rows"] = f"WITH {PANEL} SELECT entity, count(*) AS rows, min(ts) AS start, max(ts) AS \"end\" FROM panel GROUP BY entity"


def _means(sensors: tuple[str, ...]) -> str:
    return ", ".join(f"{tidy(f'avg({s})', 3)} AS {s}" for s in sensors)


Q["hourly_pattern"] = f"WITH {LIVE} SELECT CAST(hour(ts) AS INTEGER) AS hour, {_means(('value', 'k'))} FROM live GROUP BY 1"
Q["weekday_pattern"] = f"WITH {PANEL} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_index, dayname(ts) AS day, {_means(SENSORS)} FROM panel GROUP BY 1, 2"
Q["monthly_pattern"] = f"WITH {PANEL} SELECT strftime(ts, '%Y-%m') AS month, {_means(SENSORS)} FROM panel GROUP BY 1"


def _balance(labels: tuple[str, ...]) -> str:
    return "balance AS (" + union(
        [
            f"""SELECT '{c}' AS target, '{c}' AS display_name, count(*) FILTER ({c} = 1) AS positive, count(*) FILTER ({c} = 0) AS negative,
  round(count(*) FILTER ({c} = 1) / count(*) * 100, 8) AS positive_percentage,
  round(count(*) FILTER ({c} = 1) / count(*) * 10000, 4) AS positive_per_10000 FROM panel"""
            for c in labels
        ]
    ) + ")"


Q["label_balance"] = f"WITH {PANEL}, {_balance(LABELS)} SELECT * FROM balance"
Q["label_balance_map"] = f"WITH {PANEL}, {_balance(LABELS)} SELECT * EXCLUDE (positive_per_10000) FROM balance"
Q["positive_rate_floor"] = f"""WITH {PANEL}, {_balance((*LABELS, "s2"))}
SELECT target, greatest(positive_percentage, CAST(0.00000001 AS DOUBLE)) AS rate FROM balance"""
Q["label_value_counts"] = f"WITH {HOLES}\n" + union(
    [f"SELECT '{c}' AS target, CAST({c} AS DOUBLE) AS value, count(*) AS count FROM panel GROUP BY {c}" for c in ("t1", "t2", "s1")]
)
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in LABELS)
Q["label_by_entity"] = f"WITH {PANEL} SELECT entity, {_SUMS} FROM panel GROUP BY entity"
_MONTHLY = f"""WITH {PANEL},
monthly AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS records, {_SUMS} FROM panel GROUP BY 1)"""
Q["monthly_labels"] = _MONTHLY + "\nSELECT *, " + ", ".join(f"round({c} / records * 10000, 5) AS {c}_per_10000" for c in LABELS) + " FROM monthly"
Q["label_timeline_rate"] = _MONTHLY + "\nSELECT month, round(t3 / records * 10000, 5) AS value FROM monthly"
_PAIRS = f"WITH {PANEL}, pairs AS (" + union(
    [f"SELECT '{a}' AS row, '{b}' AS \"column\", count(*) FILTER ({a} = 1 AND {b} = 1) AS count FROM panel" for a in LABELS for b in LABELS]
) + ")"
Q["label_cooccurrence"] = _PAIRS + "\nSELECT * FROM pairs"
Q["cooccurrence_matrix"] = _PAIRS + "\nSELECT row, " + ", ".join(f"max(count) FILTER (\"column\" = '{c}') AS {c}" for c in LABELS) + " FROM pairs GROUP BY row"
Q["cooccurrence_strength"] = _PAIRS + "\nSELECT *, round(count / (SELECT max(count) FROM pairs), 6) AS strength FROM pairs"
Q["label_effects"] = f"WITH {PANEL}\n" + union(
    [
        f"""SELECT '{c}' AS target, '{c}' AS display_name, count(*) FILTER ({c} = 1) AS positive_count, count(*) FILTER ({c} = 0) AS negative_count,
  '{s}' AS sensor, {tidy(f"avg({s}) FILTER ({c} = 1)", 3)} AS positive_mean, {tidy(f"avg({s}) FILTER ({c} = 0)", 3)} AS negative_mean,
  {tidy(f"((avg({s}) FILTER ({c} = 1) - avg({s}) FILTER ({c} = 0)) / stddev_samp({s}))", 4)} AS standardized_difference FROM panel"""
        for c in LABELS
        for s in SENSORS
    ]
)
Q["evidence_flag"] = f"WITH {PANEL}\n" + union(
    [
        f"SELECT '{c}' AS target, '{s}' AS sensor, count(*) FILTER ({c} = 1) AS positive_count, count(*) FILTER ({c} = 1) < 1000 AS thin_evidence FROM panel"
        for c in LABELS
        for s in SENSORS
    ]
)
Q["relationship_sample"] = f"""WITH {HOLES}
SELECT {iso("ts")} AS timestamp, CAST(entity AS VARCHAR) AS entity, {", ".join(f"{tidy(s, 3)} AS {s}" for s in SENSORS)}
FROM (SELECT * FROM panel WHERE s1 IS NOT NULL
      ORDER BY md5(concat_ws('|', '42', CAST(entity AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR))) LIMIT 2500)"""
Q["missing_by_column"] = f"WITH {HOLES}\n" + union(
    [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM panel" for c in (*SENSORS, *LABELS)]
)
Q["data_quality"] = f"""WITH {RAW_HOLES}
SELECT {" + ".join(f"(count(*) - count({c}))" for c in (*SENSORS, *LABELS))} AS missing_values,
       {", ".join(f"count(*) - count({c}) AS missing_{c}" for c in (*SENSORS, *LABELS))},
       (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM panel_raw GROUP BY entity, ts) WHERE n > 1) AS duplicate_timestamps,
       count(*) - count(ts) AS invalid_timestamps
FROM panel_raw"""

# --- live readings -------------------------------------------------------------------
Q["live_mapping"] = f"""WITH {LIVE}
SELECT CAST(user_id AS VARCHAR) AS entity, ts, value,
       CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, event_type FROM events"""


def _resample(start: str) -> str:
    return f"""SELECT entity, {start} AS ts, round(median(value), 4) AS value, median(k) AS k FROM live
GROUP BY 1, 2 HAVING median(value) IS NOT NULL OR median(k) IS NOT NULL"""


_HOURLY = _resample("date_trunc('hour', ts)")
_DAILY = _resample("CAST(date_trunc('day', ts) AS TIMESTAMP)")
Q["resample_hourly"] = f"WITH {LIVE} {_HOURLY}"
Q["resample_daily"] = Q["resample_daily_crowded_windows"] = f"WITH {LIVE} {_DAILY}"
Q["resample_seven_hours"] = f"""WITH {LIVE.replace("live AS", "readings AS")},
live AS (SELECT r.*, CAST(date_trunc('day', min(ts) OVER (PARTITION BY entity)) AS TIMESTAMP) AS origin FROM readings r)
{_resample("time_bucket(INTERVAL 7 HOUR, ts, origin)")}"""
Q["resample_stream"] = f"""WITH {LIVE}, hourly AS ({_HOURLY})
SELECT * FROM hourly WHERE ts + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR"""
Q["live_feature_set"] = f"""WITH {LIVE}, daily AS (
SELECT entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, median(value) AS value, median(k) AS k FROM live GROUP BY 1, 2)
SELECT CAST(entity AS VARCHAR) AS entity, ts, round(value, 3) AS value, k,
       round(CAST(CAST(lag(value) OVER w AS FLOAT) AS DOUBLE), 3) AS value_lag_1h, round(k - lag(k) OVER w, 3) AS k_change_1h,
       CASE WHEN count(k) OVER r = 3 THEN round(CAST(CAST(avg(k) OVER r AS FLOAT) AS DOUBLE), 3) END AS k_roll_mean_3h
FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts), r AS (PARTITION BY entity ORDER BY ts ROWS 2 PRECEDING)"""

# --- views and contracts -------------------------------------------------------------
Q["ranked_entities"] = f"WITH {PANEL} SELECT entity, CAST(sum(t3) AS BIGINT) AS count FROM panel GROUP BY entity ORDER BY 2 DESC, CAST(entity AS VARCHAR)"
Q["sensor_pairs"] = f"WITH {HOLES} SELECT s1 AS x, s3 AS y, entity, ts AS timestamp FROM panel WHERE s1 IS NOT NULL AND s1 NOT IN (7, 8)"
Q["alias_resolution"] = f"""WITH {LIVE}
SELECT entity, ts, CASE WHEN error = 0 THEN value END AS temp, k AS temperature_c,
       CASE WHEN error = 0 AND value IS NOT NULL THEN value ELSE k END AS temperature, CAST(-1 AS DOUBLE) AS co2 FROM live"""

Q["normalised_sections"] = f"""WITH {LIVE}
SELECT 'temperature' AS sensor, count(value) AS count, {tidy("avg(value)", 3)} AS mean FROM live
UNION ALL SELECT 'co2', count(k), {tidy("avg(k)", 3)} FROM live
UNION ALL SELECT s, NULL, NULL FROM (VALUES ('humidity'), ('weight')) AS t(s)"""

# --- whole flows ---------------------------------------------------------------------
Q["training_rows"] = _split("entity, ts", "0.7", _BOTH, 24) + f""",
featured AS (
  SELECT entity, ts, round(CAST(CAST(lag(s1, 1) OVER w AS FLOAT) AS DOUBLE), 3) AS s1_lag_1h,
         round(CAST(CAST(s1 - lag(s1, 6) OVER w AS FLOAT) AS DOUBLE), 3) AS s1_change_6h,
         CASE WHEN count(s1) OVER r = 6 THEN round(CAST(CAST(avg(s1) OVER r AS FLOAT) AS DOUBLE), 3) END AS s1_roll_mean_6h,
         CAST(CASE WHEN count(t3) OVER f = 24 THEN max(t3) OVER f END AS FLOAT) AS event
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts), r AS (PARTITION BY entity ORDER BY ts ROWS 5 PRECEDING),
       f AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING))
SELECT entity, ts, split, s1_lag_1h, s1_change_6h, s1_roll_mean_6h, event FROM featured JOIN manifest USING (entity, ts) WHERE NOT is_boundary_gap"""

# --- joins in time, scores and forecasts ---------------------------------------------------
_STATIONS = f"""WITH {RAW},
rows AS (SELECT entity, ts, s1, a1, a2, a3, CAST(CASE WHEN entity % 11 = 0 THEN NULL WHEN entity % 3 = 0 THEN 0 ELSE entity % 40 END AS INT) AS station FROM panel_raw),
readings AS (
  SELECT CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END AS INT) AS station, o_orderdate AS read_at, arg_max(o_totalprice, o_orderkey) AS pressure
  FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1, 2)"""


def _as_of(comparison: str, near: str) -> str:
    return f"""{_STATIONS}
SELECT rows.*, CASE WHEN {near} THEN r.read_at END AS read_at, CASE WHEN {near} THEN r.pressure END AS pressure
FROM rows ASOF LEFT JOIN readings r ON rows.station = r.station AND rows.ts {comparison} r.read_at"""


Q["weather_as_of"] = Q["weather_as_of_long_entities"] = _as_of(">=", "rows.ts - r.read_at <= INTERVAL 3 DAY")
Q["weather_ahead"] = _as_of("<=", "r.read_at - rows.ts <= INTERVAL 3 DAY")

_SCORED = f"""WITH {RAW_HOLES},
scored AS (SELECT entity, ts, floor(s1 + 100 * s3) / 64 AS score, CASE WHEN a3 % 17 <> 0 THEN t1 END AS t1 FROM panel_raw),
counts AS (SELECT score, count(*) AS n, CAST(sum(t1) AS BIGINT) AS p FROM scored WHERE score IS NOT NULL AND t1 IS NOT NULL GROUP BY 1),
curve AS (SELECT score, n, p, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n - p) OVER w AS BIGINT) AS fp, sum(p) OVER () AS ps, sum(n - p) OVER () AS qs
          FROM counts WINDOW w AS (ORDER BY score DESC))"""


def _at(i: int, limit: float) -> str:
    alarms = f"sum(n) FILTER (score >= {limit})"
    caught = f"coalesce(sum(p) FILTER (score >= {limit}), 0)"
    return f"""round({caught} / sum(p), 9) AS recall_{i}, round({caught} / {alarms}, 9) AS precision_{i},
  round((coalesce({alarms}, 0) - {caught}) / sum(n - p), 9) AS false_positive_rate_{i}"""


Q["ranking_metrics"] = f"""{_SCORED}
SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(p) AS BIGINT) AS positives, round(sum(p * (tp / (tp + fp))) / sum(p), 9) AS average_precision,
  round((SELECT sum(x.n_pos * y.n_neg * CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END)
         FROM (SELECT score, p AS n_pos FROM counts) x, (SELECT score, n - p AS n_neg FROM counts) y) / (sum(p) * sum(n - p)), 9) AS roc_area,
  {_at(0, 0.3)}, {_at(1, 0.5)}, {_at(2, 2.0)} FROM curve"""
Q["ranking_curve"] = f"""{_SCORED}
SELECT score AS threshold, tp AS true_positives, fp AS false_positives, tp / ps AS recall, tp / (tp + fp) AS precision, fp / qs AS false_positive_rate FROM curve"""


def _isotonic(source: str) -> str:
    """By the definition: the fit at a score is the highest, over first scores up to it, of the lowest mean over last scores from it on."""
    return f"""sums AS (SELECT score, n, p, row_number() OVER (ORDER BY score) AS i, sum(n) OVER (ORDER BY score) AS ns, sum(p) OVER (ORDER BY score) AS ps FROM {source}),
spans AS (SELECT a.i AS a, b.i AS b, (b.ps - a.ps + a.p) / (b.ns - a.ns + a.n) AS mean FROM sums a JOIN sums b ON a.i <= b.i),
lowest AS (SELECT s.i, spans.a, min(mean) AS mean FROM sums s JOIN spans ON spans.a <= s.i AND s.i <= spans.b GROUP BY 1, 2),
fit AS (SELECT i, max(mean) AS fit FROM lowest GROUP BY 1),
blocks AS (SELECT min(score) AS low, max(score) AS high, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, sum(score * n) / sum(n) AS mean_score, sum(p) / sum(n) AS rate
           FROM sums JOIN fit USING (i) GROUP BY round(fit, 12))"""


Q["calibration_curve"] = Q["calibration_curve_many_groups"] = f"""{_SCORED}, {_isotonic("counts")}
SELECT low, high, n, positives, round(mean_score, 9) AS mean_score, rate FROM blocks"""
Q["calibrated_scores"] = f"""{_SCORED}, upper_counts AS (SELECT * FROM counts WHERE score >= 0.2), {_isotonic("upper_counts")},
frame AS (SELECT entity, ts, max(score) AS score FROM scored GROUP BY 1, 2)
SELECT entity, ts, score, CASE WHEN score < (SELECT min(low) FROM blocks) THEN (SELECT arg_min(rate, low) FROM blocks) ELSE rate END AS probability
FROM frame ASOF LEFT JOIN blocks ON frame.score >= blocks.low"""

_LEAD = f"""WITH {PANEL},
alarms AS (SELECT entity, ts, lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS before FROM panel WHERE s1 >= 44),
episodes AS (SELECT entity, ts AS alarm_at FROM alarms WHERE before IS NULL OR ts - before > INTERVAL 5 DAY),
events AS (SELECT entity, ts AS event_at FROM panel WHERE s2 > 75000),
announced AS (SELECT e.entity, e.alarm_at, (SELECT min(v.event_at) FROM events v WHERE v.entity = e.entity AND v.event_at >= e.alarm_at AND v.event_at <= e.alarm_at + INTERVAL 20 DAY) AS event_at
              FROM episodes e),
matched AS (SELECT entity, event_at, min(alarm_at) AS alarm_at, count(*) AS n FROM announced WHERE event_at IS NOT NULL GROUP BY 1, 2)"""
Q["event_lead_time"] = Q["event_lead_time_long_entities"] = f"""{_LEAD}
SELECT v.entity, v.event_at, m.alarm_at, CAST(date_diff('day', m.alarm_at, v.event_at) AS INT) AS lead_days, coalesce(m.n, 0) AS episodes
FROM events v LEFT JOIN matched m USING (entity, event_at)
UNION ALL SELECT entity, NULL, alarm_at, NULL, NULL FROM announced WHERE event_at IS NULL"""

# --- preparing features ----------------------------------------------------------------------
_PARTS = _split("entity, ts", "0.7", _BOTH, 24).replace(PANEL, HOLES)
Q["train_only_scaling"] = f"""{_PARTS}, parts AS (SELECT * FROM panel JOIN manifest USING (entity, ts)),
stats AS (SELECT {", ".join(f"avg({s}) AS m_{s}, stddev_samp({s}) AS d_{s}" for s in SENSORS)} FROM parts WHERE split = 'train' AND NOT is_boundary_gap)
SELECT entity, ts, split, {", ".join(f"round(({s} - m_{s}) / d_{s}, 6) AS {s}_scaled" for s in SENSORS)} FROM parts, stats"""


def _share(feature: str, value: str) -> str:
    """Shares of training and served rows per bin between inner deciles, and their stability index."""
    return f"""SELECT '{feature}' AS feature, sum((q - p) * ln(q / p)) AS shift FROM (
  SELECT greatest(count(*) FILTER (NOT later) / (SELECT count(*) FROM panel WHERE year(ts) < 1999), 1e-4) AS p,
         greatest(count(*) FILTER (later) / (SELECT count(*) FROM panel WHERE year(ts) >= 1999), 1e-4) AS q
  FROM (SELECT year(ts) >= 1999 AS later, CASE WHEN year(ts) >= 1999 THEN {value} ELSE {feature} END AS x FROM panel)
  GROUP BY CASE WHEN x IS NULL THEN -1 ELSE (SELECT count(*) FROM
    (SELECT DISTINCT unnest(quantile_cont({feature}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM panel WHERE year(ts) < 1999) c WHERE c.e <= x) END)"""


Q["feature_parity"] = f"""WITH {HOLES}, shifts AS ({union([_share("s1", "s1"), _share("s2", "s2 * 1.3"), _share("s4", "s4")])})
SELECT feature, CASE WHEN shift > 0.2 THEN 'shifted' ELSE 'ok' END AS status, round(shift, 6) AS shift FROM shifts
UNION ALL VALUES ('s3', 'type', NULL), ('t1', 'missing', NULL), ('t9', 'extra', NULL)"""
Q["oversampled_train"] = f"""{_PARTS}, parts AS (SELECT entity, ts, t3, split, is_boundary_gap FROM panel JOIN manifest USING (entity, ts)),
own AS (SELECT *, split = 'train' AND NOT is_boundary_gap AND t3 = 1 AS rare FROM parts),
sizes AS (SELECT count(*) FILTER (rare) AS p, count(*) FILTER (split = 'train' AND NOT is_boundary_gap AND NOT rare) AS q FROM own),
wanted AS (SELECT p, greatest(p, CAST(round_even(q * CAST(0.3 AS DOUBLE) / (1 - CAST(0.3 AS DOUBLE)), 0) AS BIGINT)) AS w FROM sizes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY md5(concat_ws('|', CAST(entity AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR))), entity, ts) AS k FROM own)
SELECT entity, ts, t3, split, is_boundary_gap, unnest(range(CASE WHEN rare THEN w // p + CASE WHEN k <= w % p THEN 1 ELSE 0 END ELSE 1 END)) AS copy FROM ranked, wanted"""

# --- streams that keep tables per batch --------------------------------------------------------
Q["stream_keep_last"] = f"WITH {PANEL} SELECT * FROM panel"
Q["stream_live_features"] = f"""SELECT * FROM ({Q["live_feature_set"]})
WHERE ts + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR"""
Q["resample_stream_seven_hours"] = f"""SELECT * FROM ({Q["resample_seven_hours"]})
WHERE ts + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

# --- written reports and the other modes -----------------------------------------------------------
Q["label_timeline_count"] = _MONTHLY + "\nSELECT month, CAST(t3 AS DOUBLE) AS value FROM monthly"
Q["coverage_records"] = _COVERAGE + "\nSELECT entity, CAST(records AS DOUBLE) AS value FROM coverage"
Q["coverage_percentage"] = _COVERAGE + "\nSELECT entity, round(least(100.0, CAST(records AS DOUBLE) / expected_records * 100), 3) AS value FROM coverage"
Q["sorted_output"] = f"WITH {PANEL} SELECT entity, ts, s1, row_number() OVER (ORDER BY entity, ts) AS place FROM panel"
Q["report_missing_values"] = f"WITH {PANEL}\n" + union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM panel" for c in (*SENSORS, *LABELS)])
Q["report_entity_coverage"] = f"WITH {PANEL} SELECT entity, count(*) AS rows, CAST(min(ts) AS DATE) AS start, CAST(max(ts) AS DATE) AS \"end\" FROM panel GROUP BY entity"
_MEANS_4 = ", ".join(f"round(avg({s}), 4) AS {s}" for s in SENSORS)
Q["report_hourly_patterns"] = f"WITH {PANEL} SELECT hour(ts) AS hour, {_MEANS_4} FROM panel GROUP BY 1"
Q["report_weekday_patterns"] = f"WITH {PANEL} SELECT dayname(ts) AS weekday, {_MEANS_4} FROM panel GROUP BY 1"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in LABELS)
Q["report_monthly_target_counts"] = f"WITH {PANEL} SELECT strftime(ts, '%Y-%m') AS month, {_SUMS} FROM panel GROUP BY 1"
Q["report_target_by_entity"] = f"WITH {PANEL} SELECT entity, {_SUMS} FROM panel GROUP BY entity"
