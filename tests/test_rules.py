"""Refusals, contracts, sources and plan shapes."""

import datetime
import os
import re
from collections import Counter

import pandas as pd
import pytest
from conftest import SPEC, bounds, random_panel, to_spark
from pyspark.sql import functions as F

from sensorloom.functions.scalar import short_number, strip
from sensorloom.operators import contracts, profile
from sensorloom.operators.clean import clean, keep_last
from sensorloom.operators.features import common_features
from sensorloom.operators.ordered import Skew, measure
from sensorloom.operators.rolling import block_sizes
from sensorloom.operators.split import check_fractions, chronological_split, drop_boundary_gap, join_manifest
from sensorloom.operators.targets import future_event, future_point
from sensorloom.operators.validate import validation_report
from sensorloom.plans.pipeline import PipelineConfig, load_config, run_pipeline
from sensorloom.plans.report import eda, write_sections
from sensorloom.sources.files import read_panel, table_format, with_arrival, write_csv_report
from sensorloom.sources.live import read_live
from sensorloom.sources.tables import PANEL, panel
from sensorloom.spec import HOURLY_PANEL, LIVE_COLUMNS, PanelSpec
from sensorloom.streaming.live import await_resampled, frequency_seconds, map_live, resample_median, stream_resampled


@pytest.fixture(scope="module")
def df(spark):
    return to_spark(spark, random_panel()).cache()


def hourly_rows(n=3, **changes):
    row = {"timestamp": "2024-01-01 00:00", "hive_id": "h", "temperature_c": "1", "co2_ppm": "2", "humidity_pct": "3", "weight_kg": "4"}
    row |= dict.fromkeys(HOURLY_PANEL.labels, "0")
    start = datetime.datetime(2024, 1, 1)
    rows = [row | {"timestamp": str(start + datetime.timedelta(hours=i))} for i in range(n)]
    rows[0] |= changes
    return rows


def hourly(spark, **changes):
    return with_arrival(spark.createDataFrame(pd.DataFrame(hourly_rows(**changes))))


# --- refusals ------------------------------------------------------------------------


@pytest.mark.parametrize("fractions", [(0, 0.5), (0.5, 1.0), (0.7, 0.3)])
def test_fractions(fractions):
    with pytest.raises(ValueError):
        check_fractions(*fractions)


def test_unknown_format_and_missing_columns(spark, df):
    with pytest.raises(ValueError, match="No reader"):
        table_format("data.xlsx.txt")
    with pytest.raises(ValueError, match="weight_kg"):
        clean(hourly(spark).drop("weight_kg"), HOURLY_PANEL)
    with pytest.raises(ValueError, match="arrival"):
        keep_last(df, SPEC)
    with pytest.raises(ValueError, match="horizon"):
        future_event(df, SPEC, "e", 0, "x")
    with pytest.raises(ValueError, match="live table lacks"):
        map_live(df, LIVE_COLUMNS, HOURLY_PANEL)
    with pytest.raises(ValueError):
        frequency_seconds("1 fortnight")


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("change", [{"timestamp": "soon"}, {"swarming_happened_1": "yes"}, {"swarming_happened_1": None}, {"swarming_happened_1": "300"}])
def test_strict_columns_fail_the_job(spark, ansi, change):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="invalid timestamp|not a small integer"):
            clean(hourly(spark, **change), HOURLY_PANEL).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_lenient_sensors_and_fractions(spark):
    row = clean(hourly(spark, temperature_c="12f", co2_ppm=" 7 ", humidity_pct="NaN", swarming_happened_1="1.5"), HOURLY_PANEL).orderBy("timestamp").first()
    assert (row.temperature_c, row.co2_ppm, row.humidity_pct, row.swarming_happened_1) == (None, 7.0, None, 1)
    assert row.row_has_missing_sensor


def test_validation_raises(spark):
    with pytest.raises(ValueError, match="timestamp"):
        validation_report(hourly(spark, timestamp="soon"), HOURLY_PANEL)
    with pytest.raises(ValueError, match="hive_id"):
        validation_report(hourly(spark, hive_id=None), HOURLY_PANEL)
    report = validation_report(hourly(spark, weight_kg="900", swarming_happened_1="3"), HOURLY_PANEL).first()
    assert {k: tuple(v) for k, v in report.invalid_binary_values.items()} == {"swarming_happened_1": (1, 1)}
    assert report.out_of_sanity_bounds["weight_kg"] == 1
    assert (report.rows, report.duplicate_keys, report.timestamp_end) == (3, 0, "2024-01-01T02:00:00")


def test_manifest_join_is_one_to_one(spark, df):
    manifest = chronological_split(df, SPEC, gap_rows=3)
    joined = join_manifest(df, manifest, SPEC)
    assert joined.count() == df.count()
    with pytest.raises(Exception, match="The manifest holds a key more than once"):
        join_manifest(df, manifest.union(manifest), SPEC).collect()
    with pytest.raises(Exception, match="The manifest holds a key more than once"):
        join_manifest(df.limit(0), manifest.union(manifest), SPEC).collect()
    with pytest.raises(Exception, match="The table holds a key more than once"):
        join_manifest(df.union(df), manifest, SPEC).collect()
    with pytest.raises(ValueError):
        drop_boundary_gap(df)
    with pytest.raises(Exception, match="rows without a split"):
        drop_boundary_gap(join_manifest(df, manifest.filter("hive <> 'm1'"), SPEC)).collect()


# --- small helpers -------------------------------------------------------------------


def test_strip_and_number_text(spark):
    odd = "　\x1c\xa0 x y\t\n\x85"
    assert spark.createDataFrame([(odd,)], "s string").select(strip(F.col("s"))).first()[0] == odd.strip() == "x y"
    values = [0.5, 90.25, 1e-5, 123456.0, 1234567.0, 999999.5, 100.0]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", short_number(F.col("v")).alias("t")).collect()
    assert all(r.t == f"{r.v:g}" for r in found)


def test_sampling_labels(spark):
    for seconds, label in ((None, "unknown"), (3600.0, "1 hour"), (7200.0, "2 hours"), (600.0, "10 minutes"), (0.5, "0.5 seconds")):
        frame = spark.createDataFrame([(seconds,)], "s double")
        assert frame.select(profile.sampling_label(F.col("s"))).first()[0] == label


def test_block_sizes():
    assert block_sizes((6, 24, 72)) == {6: 6, 24: 6, 72: 24}
    for windows in ((72,), (7, 13), (1, 2, 3), (97,), (144, 168)):
        plan = block_sizes(windows)
        assert set(windows) <= set(plan)
        assert all(w % b == 0 and b in plan for w, b in plan.items())


def test_contracts(spark):
    frame = spark.createDataFrame([(1, None, 5.0), (2, 3.0, 6.0)], "row_count int, temp double, temperature_c double")
    found = contracts.normalise_sections({"hive_coverage": frame, "hourly_patterns": frame})
    assert found["hive_stats"].select("records", "coverage_percentage").collect()[0] == (1, None)
    assert [r.temperature for r in found["hourly_patterns"].orderBy("row_count").collect()] == [5.0, 3.0]
    counts = spark.sql("SELECT map('x', 3, 'y', 0) AS m")
    assert {tuple(r) for r in contracts.label_balance_rows(counts, "m").collect()} == {("x", 3, 0), ("y", 0, 0)}


# --- sources and flows ---------------------------------------------------------------


def test_csv_missing_texts_and_file_order(spark, tmp_path):
    path = tmp_path / "raw.csv"
    rows = hourly_rows(200, temperature_c="NA")
    rows += [rows[5] | {"temperature_c": "99"}]
    pd.DataFrame(rows).to_csv(path, index=False)
    raw = read_panel(spark, str(path))
    assert validation_report(raw, HOURLY_PANEL).first().missing_by_column["temperature_c"] == 1
    found = clean(raw, HOURLY_PANEL).filter(F.col("timestamp") == datetime.datetime(2024, 1, 1, 5)).collect()
    assert [r.temperature_c for r in found] == [99.0]


def test_pipeline_and_report(spark, tmp_path):
    source = tmp_path / "raw.csv"
    frame = random_panel()[["hive", "ts", "a", "b"]]
    table = pd.DataFrame({"timestamp": frame["ts"], "hive_id": " " + frame["hive"], "temperature_c": frame["a"], "co2_ppm": 400.0, "humidity_pct": 50.0, "weight_kg": 30.0})
    for i, label in enumerate(HOURLY_PANEL.labels):
        table[label] = (frame.index % (i + 3) == 0).astype(int)
    pd.concat([table, table.head(10)]).to_csv(source, index=False)
    config = PipelineConfig.from_mapping({"cleaning": {"interpolate_missing_sensors": True}, "split": {"boundary_gap_hours": 5, "test_fraction": 0.15}})
    paths = run_pipeline(spark, str(source), str(tmp_path / "out"), config)
    assert spark.read.parquet(paths["clean"]).count() == len(table)
    assert spark.read.parquet(paths["manifest"]).filter("is_boundary_gap").count() > 0
    raw, cleaned = (spark.read.json(paths[k]).first() for k in ("raw_report", "clean_report"))
    assert (raw.duplicate_keys, cleaned.duplicate_keys, cleaned.entities) == (10, 0, 5)
    reports = {p.name for p in (tmp_path / "out/reports/common_eda").iterdir()}
    assert len(reports) == 11
    summary = pd.concat(pd.read_csv(p) for p in (tmp_path / "out/reports/common_eda/sensor_summary").glob("*.csv"))
    assert list(summary.columns) == ["sensor", "count", "mean", "std", "min", "25%", "50%", "75%", "max"]

    sections = eda(spark.read.parquet(paths["clean"]), HOURLY_PANEL)
    assert len(sections) == 16
    assert {"total_hives", "total_records"} <= set(sections["summary"].columns)
    write_sections({k: sections[k] for k in ("summary", "hive_stats", "data_quality")}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/hive_stats")).count() == 5


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"split": {"train_fraction": 0.6, "validation_fraction": 0.2}, "common_features": {"lags_hours": [2]}, "dataset": {"hive_column": "box"}}')
    config = load_config(str(tmp_path / "c.json"))
    assert (config.train, config.lags, config.spec.entity, config.gap_rows) == (0.6, (2,), "box", 72)
    with pytest.raises(ValueError):
        PipelineConfig.from_mapping({"split": {"test_fraction": 0.5}})


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    times = pd.date_range("2024-01-01", periods=600, freq="10min")
    rows = pd.DataFrame({"device_id": [f" d{i % 3} " for i in range(600)], "recorded_at": times.astype(str)})
    for i, name in enumerate(["internal_temp", "internal_humidity", "internal_co2", "total_weight", "external_temp", "external_humidity"]):
        rows[name] = [(j * (i + 3)) % 17 + 0.5 for j in range(600)]
    for part in range(3):
        spark.createDataFrame(rows.iloc[part * 200 : part * 200 + 200]).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    batch = resample_median(map_live(read_live(spark, str(tmp_path / "in")), LIVE_COLUMNS, HOURLY_PANEL), HOURLY_PANEL)
    live = map_live(read_live(spark, str(tmp_path / "in"), stream=True, maxFilesPerTrigger="1"), LIVE_COLUMNS, HOURLY_PANEL)
    with pytest.raises(ValueError, match="watermark"):
        resample_median(live, HOURLY_PANEL)
    with pytest.raises(ValueError, match="divides"):
        resample_median(live, HOURLY_PANEL, "7h", "1 hour")
    stream_resampled(live, HOURLY_PANEL, str(tmp_path / "out"), str(tmp_path / "state"), watermark="1 hour").awaitTermination()
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = batch.filter(F.col("timestamp") + F.expr("interval 1 hour") <= F.lit(str(times[-1] - pd.Timedelta("1h"))).cast("timestamp"))
    assert found == {tuple(r) for r in closed.collect()}
    assert len(found) > 250


def test_late_rows_of_a_stream_are_counted(spark, tmp_path):
    sensors = HOURLY_PANEL.sensors
    for day in (2, 3, 1):  # files out of time order
        rows = [("h", pd.Timestamp(f"2024-01-0{day} {hour:02}:15").to_pydatetime(), *[1.0] * len(sensors)) for hour in range(0, 20, 2)]
        frame = spark.createDataFrame(rows, f"{HOURLY_PANEL.entity} string, {HOURLY_PANEL.timestamp} timestamp, " + ", ".join(f"{s} double" for s in sensors))
        frame.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    live = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    with pytest.raises(TypeError, match="watermark"):
        stream_resampled(live, HOURLY_PANEL, str(tmp_path / "a"), str(tmp_path / "b"))
    for watermark, late in (("1 hour", 10), ("3 days", 0)):
        name = watermark.replace(" ", "")
        started = stream_resampled(live, HOURLY_PANEL, str(tmp_path / f"out{name}"), str(tmp_path / f"state{name}"), watermark=watermark)
        if late:
            with pytest.warns(UserWarning, match="late"):
                assert await_resampled(started) == late
        else:
            assert await_resampled(started) == 0


def test_sections_from_one_scan_equal_the_single_functions(spark, df):
    sections = eda(df, SPEC, bins=12, sample=40)
    single = {
        "summary": profile.summary(df, SPEC),
        "sensor_statistics": profile.sensor_statistics(df, SPEC),
        "outlier_analysis": profile.outlier_analysis(df, SPEC),
        "hive_stats": profile.entity_coverage(df, SPEC),
        "sensor_histograms": profile.histogram(df, SPEC, 12),
        "target_balance": profile.label_balance(df, SPEC),
        "target_cooccurrence": profile.cooccurrence(df, SPEC),
        "target_sensor_effects": profile.label_effects(df, SPEC),
        "relationship_sample": profile.relationship_sample(df, SPEC, 40),
        "correlation": profile.correlation(df, SPEC),
        "data_quality": profile.data_quality(df, SPEC),
    }
    for name, frame in single.items():
        assert sorted(map(str, sections[name].collect())) == sorted(map(str, frame.collect())), name
    for name in set(sections) - set(single):
        assert sections[name].count() > 0


# --- plans ---------------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_shares_one_exchange_and_sort(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    to_spark(spark, random_panel()).write.parquet(path)
    table = spark.read.parquet(path)
    skew = measure(table, SPEC)
    plan = plan_of(future_event(common_features(table, SPEC, ("a", "b"), skew=skew), SPEC, "e", 24, "soon", skew))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1
    assert "Python" not in plan
    narrow = plan_of(profile.hourly_pattern(table, SPEC))
    assert "ReadSchema: struct<ts:timestamp_ntz,a:double,b:double,flat:double>" in narrow


def test_keep_last_drops_copies_before_the_exchange(spark, df):
    plan = plan_of(keep_last(with_arrival(df), SPEC))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_place_of_parquet_rows_is_narrow_and_follows_paths(spark, tmp_path):
    path = str(tmp_path / "in order %é.parquet")
    for day, values in (("b", [3.0, 4.0]), ("a c", [1.0, 2.0]), ("é", [5.0, 6.0])):
        rows = [("x", 1, v) for v in values] + [("only " + day, 1, 0.0), (None, None, values[0])]
        spark.createDataFrame(rows, "hive string, ts int, a double").coalesce(1).write.parquet(f"{path}/day={day}")
    found = read_panel(spark, path)
    assert found.columns == ["hive", "ts", "a", "day", "_arrival"] and found.schema["_arrival"].dataType.simpleString() == "struct<file:bigint,row:bigint>"
    paths = spark.read.parquet(path).select("hive", "a", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    assert [r.a for r in found.orderBy("_arrival").collect()] == [r.a for r in paths.orderBy("at").collect()]
    kept = keep_last(found, SPEC.with_arrival("_arrival")).select("hive", "a")
    assert Counter(map(tuple, kept.collect())) == Counter([("x", 6.0), ("only b", 0.0), ("only a c", 0.0), ("only é", 0.0), (None, 5.0)])
    assert read_panel(spark, path, arrival=False).count() == 12


def test_sample_is_a_bounded_top_k(spark, df):
    sample = profile.relationship_sample(df, SPEC, limit=50)
    assert sample.count() == 50
    assert "TakeOrderedAndProject" in plan_of(sample)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, profile.relationship_sample(df.repartition(3), SPEC, limit=50).collect()))


# --- results that must not depend on sizes or layout ---------------------------------


def test_report_is_the_same_under_any_bound(spark):
    raw = hourly(spark, swarming_happened_1="3")
    with bounds(spark, 1, distinct=1):
        low = validation_report(raw, HOURLY_PANEL).first()
    assert low == validation_report(raw, HOURLY_PANEL).first()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_means_do_not_depend_on_partitions(spark, folder):
    path = f"/root/testdata/{folder}"
    if not os.path.isdir(path):
        pytest.skip("test tables are not there")
    table = panel(spark, path)
    found = [sorted(map(tuple, profile.monthly_pattern(table.repartition(n), PANEL).collect())) for n in (1, 2, 3, 5, 8)]
    assert all(rows == found[0] for rows in found)


def test_windows_guard_rows_without_entity(spark, df):
    loose = df.withColumn("hive", F.lit(None).cast("string"))
    assert future_point(loose, SPEC, "a", 1, "next", Skew(4, 0)).filter("next is not null").isEmpty()


def test_quoted_csv_cells(spark, tmp_path):
    cells = [('a "b" c', "x"), ("two\nlines, one comma", " padded "), ('"', "'")]
    path = write_csv_report(spark.createDataFrame(cells, "text string, other string"), str(tmp_path / "quoted.csv"))
    assert sorted(map(tuple, read_panel(spark, path, arrival=False, multiline=True).collect())) == sorted(cells)
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_panel(spark, str(tmp_path / "short.csv"), arrival=False).collect()


def test_absent_columns_have_types(spark):
    found = contracts.resolve_aliases(spark.range(1), contracts.COVERAGE_ALIASES, contracts.COVERAGE_DEFAULTS)
    assert dict(found.dtypes) == {"id": "bigint", "hive": "string", "records": "bigint", "coverage_percentage": "double"}


def test_late_and_unordered_live_windows(spark, tmp_path):
    """A hot entity whose windows do not divide a day, in salted joins, against plain medians."""
    hours = pd.date_range("2024-01-01", periods=500, freq="37min")
    frame = pd.DataFrame({"hive": ["hot"] * 480 + ["b"] * 20, "ts": hours, "a": range(500), "b": 1.0})
    spec = PanelSpec("hive", "ts", ("a", "b"), ())
    found = resample_median(spark.createDataFrame(frame).repartition(6), spec, "7h").toPandas()
    origin = frame.groupby("hive")["ts"].transform("min").dt.floor("D")
    start = origin + ((frame["ts"] - origin) // pd.Timedelta("7h")) * pd.Timedelta("7h")
    wanted = frame.groupby(["hive", start])["a"].median()
    assert sorted(found["a"]) == sorted(wanted)


def test_sections_are_complete_and_live_columns_configured(spark):
    found = contracts.normalise_sections({"sensor_statistics": spark.createDataFrame([("temp", 2), ("co2", 3), ("co2_ppm", 4)], "sensor string, count long")})
    assert sorted(map(tuple, found["sensor_statistics"].collect()), key=str) == [("co2", 3), ("humidity", None), ("temperature", 2), ("weight", None)]
    assert all(found[name].isEmpty() for name in contracts.ABSENT_SECTIONS if name != "sensor_statistics")
    config = PipelineConfig.from_mapping({"columns": {"dev": "hive_id"}, "optional_metadata": {"seen": "ingested"}})
    assert (config.live_columns, config.live_optional) == ({"dev": "hive_id"}, {"seen": "ingested"})
    live = spark.createDataFrame([("h ", "2024-01-01 00:00", 1.0)], "dev string, timestamp string, seen double")
    mapped = map_live(live, {"dev": "hive_id"}, PanelSpec("hive_id", "timestamp", (), ()), config.live_optional)
    assert mapped.columns == ["hive_id", "timestamp", "ingested"]
