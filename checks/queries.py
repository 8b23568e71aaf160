"""One query per operator, over whole test tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import contracts, preparation, profile, scores
from sensorloom.operators.asof import as_of_join
from sensorloom.operators.clean import canonical_types, clean, interpolate_time, keep_last
from sensorloom.operators.features import common_features, series_features, time_features
from sensorloom.operators.ordered import Skew, measure
from sensorloom.operators.ranking import with_positions
from sensorloom.operators.split import chronological_split, drop_boundary_gap, join_manifest, with_splits
from sensorloom.operators.targets import future_event, future_point
from sensorloom.operators.validate import (
    binary_domain,
    bounds_counts,
    duplicate_keys,
    missing_counts,
    validation_report,
)
from sensorloom.plans.pipeline import PipelineConfig, live_features, run_pipeline, training_table
from sensorloom.plans.report import report_tables
from sensorloom.settings import MAX_DISTINCT, MAX_GROUP_ROWS, shared_folder
from sensorloom.sources.files import read_panel, write_csv_report, write_panel
from sensorloom.sources.tables import LIVE, PANEL, live_raw, panel, panel_raw, table
from sensorloom.streaming import batches
from sensorloom.streaming.live import await_resampled, map_live, resample_median, stream_resampled

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Labels with values outside {0, 1}, for the domain check.
CHECKED = replace(PANEL, labels=("t1", "a2"))
LAGS = (1, 6, 24)
WINDOWS = (6, 24)


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, folder)

    REGISTRY[function.__name__] = run
    return function


def scratch(spark: SparkSession, folder: str, name: str) -> str:
    """A folder for what a query writes; the next run over the same tables writes there again."""
    return f"{shared_folder(spark)}/{name}-{zlib.crc32(str(folder).encode()):08x}"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_groups(spark: SparkSession, rows: int = 200, distinct: int = 40) -> Iterator[None]:
    """Lower the group bounds, so that the plan for over-long entities is used on them all."""
    old = {key: spark.conf.get(key, None) for key in (MAX_GROUP_ROWS, MAX_DISTINCT)}
    spark.conf.set(MAX_GROUP_ROWS, str(rows))
    spark.conf.set(MAX_DISTINCT, str(distinct))
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the columns whose name contains a key, so that engines agree to the last digit."""
    columns = []
    for name in df.columns:
        places = next((d for part, d in digits.items() if part in name), None)
        columns.append(F.col(name) if places is None else F.round(F.col(name).cast("double"), places).alias(name))
    return df.select(*columns)


def sizes(spark: SparkSession, folder: str) -> Skew:
    """Entity sizes of the panel, bounded by those of its raw rows (cheaper to count)."""
    return measure(panel_raw(spark, folder).select("entity", "ts"), PANEL)


def measured(spark: SparkSession, folder: str, holes: bool = False) -> tuple[DataFrame, Skew]:
    """The panel and its entity sizes; where these are plain, its exchange serves the windows per entity too."""
    skew = sizes(spark, folder)
    return panel(spark, folder, holes, skew), skew


FEATURE_DIGITS = {"_change_": 6, "_roll_mean_": 5, "_roll_std_": 3}


# --- sources -------------------------------------------------------------------------


@query
def csv_scan(spark, folder):
    path = f"{scratch(spark, folder, 'csv_scan')}.csv"
    write_csv_report(panel_raw(spark, folder), path, one_file=False)
    read = read_panel(spark, path)
    return canonical_types(read, PANEL).select("entity", "ts", *PANEL.sensors, *PANEL.labels)


@query
def csv_quoted_scan(spark, folder):
    """Texts with quotes, commas and line breaks, written as CSV and read back."""
    path = f"{scratch(spark, folder, 'csv_quoted')}.csv"
    quoted = F.concat(F.lit('He said "'), F.col("text"), F.lit('", a line\nand more'))
    write_csv_report(table(spark, folder, "documents").select("doc_id", quoted.alias("quoted"), "text", "source"), path, one_file=False)
    read = read_panel(spark, path, arrival=False, multiline=True)
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("quoted").alias("quoted_md5"), F.md5("text").alias("text_md5"), "source")


@query
def parquet_scan(spark, folder):
    path = f"{scratch(spark, folder, 'parquet_scan')}.parquet"
    write_panel(panel_raw(spark, folder), path)
    return read_panel(spark, path, arrival=False).select("entity", "ts", "s1")


@query
def file_order_keep_last(spark, folder):
    """Keep-last by place in the file: the written rows are in arrival order."""
    path = f"{scratch(spark, folder, 'file_order')}.parquet"
    write_panel(panel_raw(spark, folder).orderBy(*PANEL.arrival, "entity", "ts"), path)
    kept = keep_last(read_panel(spark, path), PANEL.with_arrival("_arrival"))
    return kept.select("entity", "ts", "s1", "s2")


# --- validation ----------------------------------------------------------------------


@query
def validation_counts(spark, folder):
    report = validation_report(panel_raw(spark, folder, holes=True), CHECKED)
    return report.select(
        "rows",
        "entities",
        "duplicate_keys",
        *[F.col("missing_by_column")[c].alias(f"missing_{c}") for c in CHECKED.required],
        *[F.col("out_of_sanity_bounds")[s].alias(f"outside_{s}") for s in CHECKED.sensors],
        F.size("invalid_binary_values").alias("invalid_labels"),
        F.col("invalid_binary_values")["a2"]["distinct_values"].alias("invalid_a2_values"),
        F.col("invalid_binary_values")["a2"]["rows"].alias("invalid_a2_rows"),
        "timestamp_start",
        "timestamp_end",
    )


@query
def validation_report_many_invalid(spark, folder):
    """A label with more invalid values than any bound for groups (here lowered as well)."""
    spec = replace(PANEL, labels=("t1", "a2", "a3"))
    with small_groups(spark, distinct=3):
        report = validation_report(panel_raw(spark, folder), spec)
    return report.select(F.explode("invalid_binary_values").alias("label", "found")).select("label", "found.distinct_values", "found.rows")


@query
def bounds_check(spark, folder):
    return bounds_counts(panel_raw(spark, folder), PANEL)


@query
def binary_domain_check(spark, folder):
    return binary_domain(panel_raw(spark, folder), CHECKED)


@query
def missing_required(spark, folder):
    return missing_counts(panel_raw(spark, folder, holes=True), PANEL)


@query
def duplicate_surplus(spark, folder):
    return duplicate_keys(panel_raw(spark, folder), PANEL).select("surplus")


@query
def duplicate_members(spark, folder):
    return duplicate_keys(panel_raw(spark, folder), PANEL).select("members")


# --- cleaning ------------------------------------------------------------------------


@query
def clean_keep_last(spark, folder):
    return panel(spark, folder)


@query
def clean_table(spark, folder):
    """All cleaning steps, from text columns with stray blanks and odd headers."""
    raw = panel_raw(spark, folder, holes=True)
    text = raw.select(
        F.concat(F.lit(" \t"), F.col("entity").cast("string"), F.lit("\n")).alias(" Entity "),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TS"),
        F.coalesce(F.col("s1").cast("string"), F.lit("broken")).alias("S1"),
        *[F.col(s).cast("string").alias(s) for s in ("s2", "s3", "s4")],
        *[F.col(c).cast("string").alias(c) for c in PANEL.labels],
        *PANEL.arrival,
    )
    cleaned = clean(text, PANEL).drop(*PANEL.arrival)
    return cleaned.withColumns({s: F.col(s).cast("double") for s in PANEL.sensors})


def _interpolated(spark, folder):
    frame, skew = measured(spark, folder, holes=True)
    filled = interpolate_time(frame, PANEL, limit=2, skew=skew)
    return rounded(filled.select("entity", "ts", "s1", "s2"), {"s1": 6})


@query
def interpolate_gaps(spark, folder):
    return _interpolated(spark, folder)


@query
def interpolate_gaps_long_entities(spark, folder):
    with small_groups(spark):
        return _interpolated(spark, folder)


# --- splits --------------------------------------------------------------------------


@query
def split_manifest(spark, folder):
    frame, skew = measured(spark, folder)
    return chronological_split(frame, PANEL, gap_rows=24, skew=skew)


@query
def split_manifest_long_entities(spark, folder):
    with small_groups(spark):
        return chronological_split(panel(spark, folder), PANEL, gap_rows=24, skew=sizes(spark, folder))


@query
def split_joined(spark, folder):
    frame = panel(spark, folder).select("entity", "ts", "s1")
    return join_manifest(frame, chronological_split(frame, PANEL, gap_rows=24, skew=sizes(spark, folder)), PANEL)


@query
def split_by_window(spark, folder):
    frame, skew = measured(spark, folder)
    return with_splits(frame.select("entity", "ts", "s1"), PANEL, 0.6, 0.2, 10, skew)


@query
def leakage_free(spark, folder):
    frame, skew = measured(spark, folder)
    return drop_boundary_gap(with_splits(frame.select("entity", "ts", "s1"), PANEL, gap_rows=24, skew=skew))


# --- targets -------------------------------------------------------------------------


@query
def future_value(spark, folder):
    frame, skew = measured(spark, folder)
    return future_point(frame.select("entity", "ts", "s1"), PANEL, "s1", 6, "s1_in_6", skew)


@query
def future_label(spark, folder):
    frame, skew = measured(spark, folder)
    return future_event(frame.select("entity", "ts", "t3"), PANEL, "t3", 24, "t3_within_24", skew)


@query
def future_label_missing_values(spark, folder):
    frame, skew = measured(spark, folder, holes=True)
    return future_event(frame.select("entity", "ts", "s1"), PANEL, "s1", 3, "s1_peak", skew)


@query
def future_label_long_entities(spark, folder):
    with small_groups(spark):
        frame = panel(spark, folder).select("entity", "ts", "t3")
        return future_event(frame, PANEL, "t3", 24, "t3_within_24", sizes(spark, folder))


# --- features ------------------------------------------------------------------------


@query
def calendar_features(spark, folder):
    frame = live_raw(spark, folder).select("entity", "ts")
    return time_features(frame, LIVE).select("entity", "ts", "hour", "day_of_week", "month", "day_of_year", "is_weekend")


@query
def cyclic_features(spark, folder):
    frame = time_features(live_raw(spark, folder).select("entity", "ts"), LIVE)
    return rounded(frame.select("entity", "ts", "hour_sin", "hour_cos", "day_of_year_sin", "day_of_year_cos"), {"_sin": 5, "_cos": 5})


@query
def lag_change(spark, folder):
    frame, skew = measured(spark, folder)
    found = series_features(frame.select("entity", "ts", "s1", "s2"), PANEL, ("s1", "s2"), LAGS, LAGS, (), (), "double", skew)
    return rounded(found, FEATURE_DIGITS)


@query
def rolling_statistics(spark, folder):
    frame, skew = measured(spark, folder, holes=True)
    found = series_features(frame.select("entity", "ts", "s1", "s2"), PANEL, ("s1", "s2"), (), (), WINDOWS, ("mean", "std", "min", "max"), "double", skew)
    return rounded(found, FEATURE_DIGITS)


def _features(spark, folder):
    frame, skew = measured(spark, folder)
    found = common_features(frame, PANEL, output_type="double", skew=skew)
    return rounded(found.drop("hour_sin", "hour_cos", "day_of_year_sin", "day_of_year_cos", *PANEL.labels), FEATURE_DIGITS)


@query
def feature_set(spark, folder):
    return _features(spark, folder)


@query
def feature_set_long_entities(spark, folder):
    with small_groups(spark):
        return _features(spark, folder)


# --- exploratory statistics ----------------------------------------------------------


@query
def dataset_summary(spark, folder):
    return profile.summary(panel(spark, folder), PANEL, skew=sizes(spark, folder))


@query
def sampling_interval(spark, folder):
    frame, skew = measured(spark, folder)
    return profile.sampling_interval(frame, PANEL, skew)


@query
def sampling_interval_long_entities(spark, folder):
    with small_groups(spark, distinct=2):
        return profile.sampling_interval(live_raw(spark, folder), LIVE)


def _statistics(spark, folder):
    frame = panel(spark, folder, holes=True)
    quartiles = profile.sensor_quartiles(frame, PANEL, sizes(spark, folder).rows)
    return profile.sensor_statistics(frame, PANEL, quartiles=quartiles)


@query
def sensor_statistics(spark, folder):
    return _statistics(spark, folder)


@query
def sensor_statistics_many_values(spark, folder):
    with small_groups(spark):
        return _statistics(spark, folder)


@query
def sensor_summary_report(spark, folder):
    found = report_tables(panel(spark, folder), PANEL, sizes(spark, folder).rows)["sensor_summary"]
    return found.select(
        "sensor", "count", *[F.round(f"`{c}`", 4).alias(n) for c, n in
        {"mean": "mean", "std": "std", "min": "min", "25%": "q25", "50%": "q50", "75%": "q75", "max": "max"}.items()],
    )


@query
def outlier_analysis(spark, folder):
    frame, spec = panel(spark, folder), replace(PANEL, sensors=("s1", "s2", "s3", "s4", "t3"))
    quartiles = profile.sensor_quartiles(frame, spec, sizes(spark, folder).rows)
    return profile.outlier_analysis(frame, spec, quartiles=quartiles)


@query
def sensor_histogram(spark, folder):
    return profile.histogram(panel(spark, folder), PANEL)


@query
def sensor_histogram_report(spark, folder):
    return profile.histogram(live_raw(spark, folder), LIVE, bins=50)


@query
def sensor_correlation(spark, folder):
    return profile.correlation(panel(spark, folder, holes=True), PANEL)


@query
def sensor_correlation_matrix(spark, folder):
    return profile.correlation_matrix(panel(spark, folder), PANEL, 4)


@query
def entity_coverage(spark, folder):
    return profile.entity_coverage(panel(spark, folder), PANEL, skew=sizes(spark, folder))


@query
def entity_rows(spark, folder):
    return profile.entity_rows(panel(spark, folder), PANEL)


@query
def hourly_pattern(spark, folder):
    return profile.hourly_pattern(live_raw(spark, folder), LIVE)


@query
def weekday_pattern(spark, folder):
    return profile.weekday_pattern(panel(spark, folder), PANEL)


@query
def monthly_pattern(spark, folder):
    return profile.monthly_pattern(panel(spark, folder), PANEL)


@query
def label_balance(spark, folder):
    return profile.label_balance(panel(spark, folder), PANEL)


@query
def label_value_counts(spark, folder):
    frame = panel(spark, folder, holes=True)
    return profile.label_value_counts(frame, replace(PANEL, labels=("t1", "t2", "s1")))


@query
def label_by_entity(spark, folder):
    return profile.label_by_entity(panel(spark, folder), PANEL)


@query
def monthly_labels(spark, folder):
    return profile.monthly_labels(panel(spark, folder), PANEL)


@query
def label_cooccurrence(spark, folder):
    return profile.cooccurrence(panel(spark, folder), PANEL)


@query
def label_effects(spark, folder):
    return profile.label_effects(panel(spark, folder), PANEL)


@query
def positive_rate_floor(spark, folder):
    balance = profile.label_balance(panel(spark, folder), replace(PANEL, labels=(*PANEL.labels, "s2")))
    return profile.positive_rate_floor(balance)


@query
def relationship_sample(spark, folder):
    return profile.relationship_sample(panel(spark, folder, holes=True), PANEL)


@query
def missing_by_column(spark, folder):
    return profile.missing_by_column(panel(spark, folder, holes=True), PANEL)


@query
def data_quality(spark, folder):
    found = profile.data_quality(panel_raw(spark, folder, holes=True), PANEL)
    return found.select(
        "missing_values",
        *[F.col("missing_by_column")[c].alias(f"missing_{c}") for c in (*PANEL.sensors, *PANEL.labels)],
        "duplicate_timestamps",
        "invalid_timestamps",
    )


# --- live readings -------------------------------------------------------------------

DEVICE_COLUMNS = {"user_id": "entity", "recorded_at": "ts", "reading": "value", "count_text": "k"}


def _device_rows(spark, folder):
    """Events in the shape of a device table: text times and numbers, padded keys."""
    events = table(spark, folder, "events")
    return events.select(
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("user_id"),
        F.col("ts").cast("string").alias("recorded_at"),
        F.col("value").cast("string").alias("reading"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k")).alias("count_text"),
        "event_type",
    )


@query
def live_mapping(spark, folder):
    mapped = map_live(_device_rows(spark, folder), DEVICE_COLUMNS, LIVE)
    return mapped.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _resampled(spark, folder, frequency):
    found = resample_median(live_raw(spark, folder), LIVE, frequency)
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), {"value": 4})


@query
def resample_hourly(spark, folder):
    return _resampled(spark, folder, "1h")


@query
def resample_daily(spark, folder):
    return _resampled(spark, folder, "1 day")


@query
def resample_seven_hours(spark, folder):
    return _resampled(spark, folder, "7h")


@query
def resample_daily_crowded_windows(spark, folder):
    with small_groups(spark, rows=2):
        return _resampled(spark, folder, "1 day")


@query
def resample_stream(spark, folder):
    """The same resampling as a stream over the events file; open windows are not emitted."""
    base = scratch(spark, folder, "resample_stream")
    remove(spark, base)  # a stream goes on from the state it finds
    schema = table(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        .select(F.col("user_id").alias("entity"), "ts", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    )
    await_resampled(stream_resampled(stream, LIVE, f"{base}/out", f"{base}/state", watermark="1 hour"))
    found = spark.read.parquet(f"{base}/out")
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), {"value": 4})


@query
def live_feature_set(spark, folder):
    raw = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    config = PipelineConfig(spec=LIVE, frequency="1d", lags=(1,), changes=(1,), windows=(3,), statistics=("mean",))
    found = live_features(raw.select("user_id", "ts", "value", "k"), {"user_id": "entity"}, config)
    names = ["entity", "ts", "value", "k", "value_lag_1h", "k_change_1h", "k_roll_mean_3h"]
    return rounded(found.select(*names).withColumn("ts", F.col("ts").cast("timestamp_ntz")), {"value": 3, "k_": 3})


# --- views and contracts -------------------------------------------------------------


@query
def ranked_entities(spark, folder):
    return profile.ranked_entities(profile.label_by_entity(panel(spark, folder), PANEL), "t3", "entity")


@query
def sensor_pairs(spark, folder):
    """All complete rows as x and y; the third sensor is made infinite or NaN at times."""
    odd = F.when(F.col("s1") == 7, float("nan")).when(F.col("s1") == 8, float("inf")).otherwise(F.col("s3"))
    frame = panel(spark, folder, holes=True).withColumn("s3", odd).withColumnRenamed("ts", "timestamp")
    return profile.sensor_pairs(frame, "s1", "s3", "entity")


@query
def cooccurrence_matrix(spark, folder):
    return profile.cooccurrence_matrix(profile.cooccurrence(panel(spark, folder), PANEL), PANEL.labels)


@query
def cooccurrence_strength(spark, folder):
    found = profile.cooccurrence_strength(profile.cooccurrence(panel(spark, folder), PANEL))
    return rounded(found, {"strength": 6})


@query
def evidence_flag(spark, folder):
    found = profile.evidence_flag(profile.label_effects(panel(spark, folder), PANEL), enough=1_000)
    return found.select("target", "sensor", "positive_count", "thin_evidence")


@query
def label_timeline_rate(spark, folder):
    return profile.label_timeline(profile.monthly_labels(panel(spark, folder), PANEL), "t3", "rate")


@query
def coverage_duration(spark, folder):
    return profile.coverage_metric(profile.entity_coverage(panel(spark, folder), PANEL, skew=sizes(spark, folder)), "duration", "entity")


@query
def alias_resolution(spark, folder):
    events = live_raw(spark, folder).select("entity", F.col("ts"), F.when(F.col("error") == 0, F.col("value")).alias("temp"), F.col("k").alias("temperature_c"))
    return contracts.resolve_aliases(events, {"temperature": ("temperature", "temp", "temperature_c"), "co2": ("co2", "co2_ppm")}, {"co2": -1.0})


@query
def label_balance_map(spark, folder):
    counts = profile.label_balance(panel(spark, folder), PANEL)
    entry = F.struct(F.col("positive").alias("ones"), F.col("negative").alias("zeros"), F.col("positive_percentage").alias("rate"))
    packed = counts.agg(F.map_from_entries(F.collect_list(F.struct("target", entry))).alias("target_balance"))
    return contracts.label_balance_rows(packed, "target_balance").drop("positive_per_10000")


@query
def normalised_sections(spark, folder):
    """Statistics under other sensor names, through the section contract; two sensors are absent."""
    live = live_raw(spark, folder)
    statistics = profile.sensor_statistics(live, LIVE).withColumn("sensor", F.when(F.col("sensor") == "value", "temp").otherwise("co2_ppm"))
    sections = contracts.normalise_sections({"sensor_statistics": statistics})
    return sections["sensor_statistics"].select("sensor", "count", "mean").unionByName(sections["hive_stats"].select(F.col("hive").alias("sensor"), F.col("records").alias("count"), F.lit(0.0).alias("mean")))


# --- whole flows ---------------------------------------------------------------------


@query
def training_rows(spark, folder):
    """Features, target, manifest join and leakage removal in one flow."""
    frame = panel(spark, folder).select("entity", "ts", *PANEL.sensors, "t3")
    config = PipelineConfig(spec=PANEL, lags=(1,), changes=(6,), windows=(6,), statistics=("mean",))
    manifest = chronological_split(frame, PANEL, gap_rows=24, skew=sizes(spark, folder))
    found = training_table(frame, manifest, config, target="t3", horizon=24, output="event", skew=sizes(spark, folder))
    return rounded(found.select("entity", "ts", "split", "s1_lag_1h", "s1_change_6h", "s1_roll_mean_6h", "event"), {"s1_": 3})


@query
def pipeline_manifest(spark, folder):
    """The whole pipeline from a Parquet source; its manifest joined with its clean table."""
    base = scratch(spark, folder, "pipeline")
    write_panel(panel_raw(spark, folder).orderBy(*PANEL.arrival, "entity", "ts"), f"{base}/raw.parquet")
    config = PipelineConfig(spec=PANEL.with_arrival("_arrival"), gap_rows=24)
    paths = run_pipeline(spark, f"{base}/raw.parquet", base, config)
    cleaned, manifest = spark.read.parquet(paths["clean"]), spark.read.parquet(paths["manifest"])
    return join_manifest(cleaned.select("entity", "ts", F.col("s1").cast("double").alias("s1")), manifest, PANEL)


# --- joins in time, scores and forecasts ---------------------------------------------------


def _stations(spark, folder):
    """Panel rows with the weather station that serves their entity (some have none), and its readings."""
    frame = panel_raw(spark, folder).select("entity", "ts", "s1", "a1", "a2", "a3")
    station = F.when(F.col("entity") % 11 != 0, F.when(F.col("entity") % 3 == 0, 0).otherwise(F.col("entity") % 40)).cast("int")
    orders = table(spark, folder, "orders")
    readings = orders.select(
        F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 40).cast("int").alias("station"), F.col("o_orderdate").alias("read_at"),
        F.col("o_totalprice").alias("pressure"), "o_orderkey",
    )
    return frame.withColumn("station", station), readings.filter(F.col("o_orderkey") % 4 == 0)


def _weather(spark, folder, direction="backward"):
    frame, readings = _stations(spark, folder)
    return as_of_join(
        frame, readings, on=["station"], left_time="ts", right_time="read_at", columns=["read_at", "pressure"],
        tolerance=F.expr("INTERVAL 3 DAYS"), tie=["o_orderkey"], direction=direction,
    )


@query
def weather_as_of(spark, folder):
    return _weather(spark, folder)


@query
def weather_as_of_long_entities(spark, folder):
    with small_groups(spark):
        return _weather(spark, folder)


@query
def weather_ahead(spark, folder):
    return _weather(spark, folder, "forward")


def _scored(spark, folder):
    """A score with ties and nulls beside a label with nulls."""
    frame = panel_raw(spark, folder, holes=True)
    return frame.select(*PANEL.keys, (F.floor(F.col("s1") + 100 * F.col("s3")) / 64).alias("score"), F.when(F.col("a3") % 17 != 0, F.col("t1")).alias("t1"))


@query
def ranking_metrics(spark, folder):
    found = scores.ranking_metrics(_scored(spark, folder), "score", "t1", (0.3, 0.5, 2.0))
    return rounded(found, {"average": 9, "area": 9, "recall": 9, "precision": 9, "false": 9})


@query
def ranking_curve(spark, folder):
    return scores.ranking_curve(_scored(spark, folder), "score", "t1").drop("n", "positives")


@query
def calibration_curve(spark, folder):
    return rounded(scores.calibration_curve(_scored(spark, folder), "score", "t1"), {"mean_score": 9})


@query
def calibration_curve_many_groups(spark, folder):
    return rounded(scores.calibration_curve(_scored(spark, folder), "score", "t1", block=5), {"mean_score": 9})


@query
def calibrated_scores(spark, folder):
    frame = _scored(spark, folder).groupBy("entity", "ts").agg(F.max("score").alias("score"))
    curve = scores.calibration_curve(_scored(spark, folder).filter("score >= 0.2"), "score", "t1")
    return scores.calibrated(frame, curve, "score", "probability")


def _lead(spark, folder):
    frame = panel(spark, folder).select("entity", "ts", "s1", "s2")
    return scores.event_lead_time(frame, PANEL, F.col("s2") > 75_000, F.col("s1") >= 44, F.expr("INTERVAL 20 DAYS"), F.expr("INTERVAL 5 DAYS"))


def _lead_rows(spark, folder):
    events, false = _lead(spark, folder)
    both = events.withColumn("lead_days", F.expr("extract(DAY FROM lead)").cast("int")).drop("lead").unionByName(false, allowMissingColumns=True)
    return both.select("entity", "event_at", "alarm_at", "lead_days", "episodes")


@query
def event_lead_time(spark, folder):
    return _lead_rows(spark, folder)


@query
def event_lead_time_long_entities(spark, folder):
    with small_groups(spark, rows=30):
        return _lead_rows(spark, folder)


# --- preparing features ----------------------------------------------------------------------


def _split_panel(spark, folder):
    frame, skew = measured(spark, folder, holes=True)
    return with_splits(frame, PANEL, gap_rows=24, skew=skew)


@query
def train_only_scaling(spark, folder):
    frame = _split_panel(spark, folder)
    found = preparation.apply_scaling(frame, preparation.fit_scaling(frame, PANEL), PANEL)
    return rounded(found.select("entity", "ts", "split", *[f"{s}_scaled" for s in PANEL.sensors]), {"_scaled": 6})


@query
def feature_parity(spark, folder):
    """Served rows are those of later days, with one feature moved, one of another type, one gone and one too many."""
    frame = panel(spark, folder, holes=True).select("ts", "s1", "s2", "s3", "s4", "t1")
    contract = preparation.feature_contract(frame.filter(F.year("ts") < 1999), ["s1", "s2", "s3", "s4", "t1"])
    served = frame.filter(F.year("ts") >= 1999).select("s1", (F.col("s2") * 1.3).alias("s2"), F.col("s3").cast("float").alias("s3"), "s4", F.lit(1).alias("t9"))
    return rounded(preparation.feature_parity(served, contract), {"shift": 6})


@query
def oversampled_train(spark, folder):
    frame = _split_panel(spark, folder).select("entity", "ts", "t3", "split", "is_boundary_gap")
    return preparation.oversample(frame, PANEL, "t3", 0.3)


# --- streams that keep tables per batch --------------------------------------------------------


def _in_turn(spark, df, path, time, bounds, start):
    """The whole table as files between time bounds; each part arrives when the one before it is done, and is one batch.

    ``start`` starts the stream it is given, which goes on from its checkpoint. A part has as many files as tasks that wrote it.
    """
    remove(spark, path)
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.filter(F.col(time) >= F.lit(low).cast(df.schema[time].dataType))
        part = part if high is None else part.filter(F.col(time) < F.lit(high).cast(df.schema[time].dataType))
        part.write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(df.schema).parquet(f"{path}/in")).awaitTermination()


@query
def stream_keep_last(spark, folder):
    base = scratch(spark, folder, "stream_keep_last")
    start = lambda stream: batches.stream_keep_last(stream, PANEL, f"{base}/out", f"{base}/state", delay="60 days")
    _in_turn(spark, panel_raw(spark, folder), base, "ts", ["1997-01-01", "1998-06-01", "2000-01-01"], start)
    return batches.kept(spark, f"{base}/out").drop(*PANEL.arrival)


EVENT_CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]


@query
def stream_live_features(spark, folder):
    base = scratch(spark, folder, "stream_live_features")
    raw = live_raw(spark, folder).select("entity", F.col("ts").cast("timestamp").alias("ts"), "value", "k")
    options = {"watermark": "1 hour", "frequency": "1d", "lags": (1,), "changes": (1,), "windows": (3,), "statistics": ("mean",)}
    _in_turn(spark, raw, base, "ts", EVENT_CUTS, lambda stream: batches.stream_features(stream, LIVE, f"{base}/out", f"{base}/state", **options))
    found = spark.read.parquet(f"{base}/out/features").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "entity": F.col("entity").cast("string")})
    return rounded(found.select("entity", "ts", "value", "k", "value_lag_1h", "k_change_1h", "k_roll_mean_3h"), {"value": 3, "k_": 3})


@query
def resample_stream_seven_hours(spark, folder):
    base = scratch(spark, folder, "resample_stream_seven_hours")
    raw = live_raw(spark, folder).select("entity", F.col("ts").cast("timestamp").alias("ts"), "value", "k")
    start = lambda stream: batches.stream_anchored(stream, LIVE, f"{base}/out", f"{base}/state", frequency="7h", delay="1 hour")
    _in_turn(spark, raw, base, "ts", EVENT_CUTS, start)
    found = spark.read.parquet(f"{base}/out/windows").drop("batch")
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), {"value": 4})


# --- written reports and the other modes -----------------------------------------------------------


@query
def label_timeline_count(spark, folder):
    return profile.label_timeline(profile.monthly_labels(panel(spark, folder), PANEL), "t3", "count")


def _coverage_mode(spark, folder, mode):
    frame, skew = measured(spark, folder)
    return profile.coverage_metric(profile.entity_coverage(frame, PANEL, skew=skew), mode, "entity")


@query
def coverage_records(spark, folder):
    return _coverage_mode(spark, folder, "records")


@query
def coverage_percentage(spark, folder):
    return _coverage_mode(spark, folder, "coverage")


@query
def sorted_output(spark, folder):
    """Rows of the sorted table with their place in the order in which it is written."""
    base = scratch(spark, folder, "sorted_output")
    write_panel(panel(spark, folder).select("entity", "ts", "s1"), f"{base}.parquet", PANEL)
    stored = read_panel(spark, f"{base}.parquet").withColumnRenamed("_arrival", "read_as")
    return with_positions(stored, [F.col("read_as")], "place").drop("read_as")


def _report(spark, folder, name):
    """One of the report tables, as the files hold it."""
    path = f"{scratch(spark, folder, 'report')}/{name}"
    write_csv_report(report_tables(panel(spark, folder), PANEL, sizes(spark, folder).rows)[name], path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _rounded_report(spark, folder, name, digits=4):
    found = _report(spark, folder, name)
    return rounded(found, {c: digits for c, kind in found.dtypes if kind == "double"})


@query
def report_missing_values(spark, folder):
    return _report(spark, folder, "missing_values")


@query
def report_entity_coverage(spark, folder):
    return _report(spark, folder, "hive_coverage").select("entity", F.col("rows").cast("long").alias("rows"), F.to_date("start").alias("start"), F.to_date("end").alias("end"))


@query
def report_hourly_patterns(spark, folder):
    return _rounded_report(spark, folder, "hourly_patterns")


@query
def report_weekday_patterns(spark, folder):
    return _rounded_report(spark, folder, "weekday_patterns")


@query
def report_monthly_target_counts(spark, folder):
    return _report(spark, folder, "monthly_target_counts").withColumn("month", F.date_format("month", "yyyy-MM"))


@query
def report_target_by_entity(spark, folder):
    return _report(spark, folder, "target_by_hive")
