"""Streams that keep tables per batch equal the batch result, also when a batch is run again."""

import pandas as pd
import pytest
from conftest import SPEC
from pyspark.sql import functions as F

from checks.queries import _in_turn
from sensorloom.operators.clean import keep_last
from sensorloom.operators.features import common_features
from sensorloom.streaming import batches
from sensorloom.streaming.live import resample_median

START = pd.Timestamp("2024-01-01")
SCHEMA = "hive string, ts timestamp, a double, b double, flat double, _arrival long"


def rows_of(*parts):
    """Files of (hive, hour, value) rows; the arrival order is that of the list."""
    n, files = 0, []
    for part in parts:
        files.append([])
        for hive, hour, value in part:
            n += 1
            files[-1].append((hive, None if hour is None else (START + pd.Timedelta(hours=hour)).to_pydatetime(), value, None if n % 7 == 0 else value * 2, 1.0, n))
    return files


@pytest.fixture
def live(spark, tmp_path):
    def make(files):
        for rows in files:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        frame = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
        return frame, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))

    return make


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def run_again(path, tmp_path):
    """As after a failure between the last batch's work and its commit: the batch is run once more."""
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].rename(tmp_path / "gone")
    (commits[-1].parent / f".{commits[-1].name}.crc").rename(tmp_path / "gone.crc")


def test_keep_last_equals_batch_with_files_out_of_order(spark, live, tmp_path):
    files = rows_of(
        [("x", 10, 1.0), ("x", 10, 2.0), ("y", 12, 3.0), (None, 11, 1.0)],
        [("x", 10, 4.0), ("y", 2, 9.0), ("z", None, 1.0)],  # earlier than what came before, in time
        [("x", 40, 5.0), ("y", 12, 6.0), (None, 11, 7.0)],
        [("x", 3, 8.0), ("x", 41, 8.5), ("y", 12, 9.5)],  # 3 and 12 are late by now
    )
    batch, stream = live(files)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    start = lambda: batches.stream_keep_last(stream, SPEC, path, state, delay="24 h").awaitTermination()
    start()
    late = spark.read.parquet(f"{path}/late")
    hours = lambda *hs: [(START + pd.Timedelta(hours=h)).to_pydatetime() for h in hs]
    assert {(r.hive, r.ts) for r in late.collect()} == {("x", hours(3)[0]), ("y", hours(12)[0])}
    wanted = keep_last(batch.filter("ts is not null").join(late.select("_arrival"), "_arrival", "left_anti"), SPEC)
    assert bag(batches.kept(spark, path)) == bag(wanted.select(*batch.columns))
    closed = spark.read.parquet(f"{path}/closed")
    assert closed.count() == 4 and closed.filter("hive = 'x'").first().a == 4.0
    before = (bag(batches.kept(spark, path)), bag(late))
    run_again(path, tmp_path)
    start()
    assert (bag(batches.kept(spark, path)), bag(spark.read.parquet(f"{path}/late"))) == before


def test_features_of_a_stream_equal_those_of_a_batch(spark, live, tmp_path):
    files = rows_of(*[[(hive, hour + k * 30 + 0.25 * (i % 3), float((hour * 7 + i) % 11)) for hour in range(30) for i, hive in enumerate(("hot", "hot", "hot", "b"))] for k in range(4)])
    batch, stream = live(files)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    options = {"lags": (1, 3), "changes": (2,), "windows": (4,), "statistics": ("mean", "std", "max")}
    start = lambda: batches.stream_features(stream, SPEC, path, state, watermark="1 hour", **options).awaitTermination()
    start()
    found = spark.read.parquet(f"{path}/features").drop("batch")
    last = START + pd.Timedelta(hours=118)
    wanted = common_features(resample_median(batch, SPEC), SPEC, **options).filter(F.col("ts") + F.expr("interval 1 hour") <= F.lit(str(last)).cast("timestamp"))
    rounded = lambda df: bag(df.select(*[F.round(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]))
    assert rounded(found) == rounded(wanted) and found.count() > 200
    tails = list((tmp_path / "out" / "tail").glob("batch=*"))
    assert len(tails) <= 2 and spark.read.parquet(str(sorted(tails)[-1])).groupBy("hive").count().agg(F.max("count")).first()[0] == 3
    run_again(path, tmp_path)
    start()
    assert rounded(spark.read.parquet(f"{path}/features").drop("batch")) == rounded(wanted)


@pytest.mark.parametrize("frequency, hours", [("7h", 7), ("2d", 48)])
def test_anchored_windows_of_a_stream_equal_those_of_a_batch(spark, live, tmp_path, frequency, hours):
    files = rows_of(*[[(hive, 5 + k * 50 + step * 0.5 + 30 * (hive == "b"), float((step * 3) % 13)) for step in range(100) for hive in ("a", "b")] for k in (0, 1, 2, 3)])
    files[1][:20], files[0][:20] = files[0][:20], files[1][:20]  # in time, but not in order
    batch, stream = live(files)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    start = lambda: batches.stream_anchored(stream, SPEC, path, state, frequency=frequency, delay="90 h").awaitTermination()
    start()
    found = spark.read.parquet(f"{path}/windows").drop("batch")
    mark = (START + pd.Timedelta(hours=5 + 150 + 49.5 + 30 - 90)).to_pydatetime()
    wanted = resample_median(batch, SPEC, frequency).filter(F.col("ts") + F.expr(f"interval {hours} hours") <= F.lit(str(mark)).cast("timestamp"))
    assert bag(found) == bag(wanted) and found.count() > 3 and spark.read.parquet(f"{path}/late").count() == 0
    run_again(path, tmp_path)
    start()
    assert bag(spark.read.parquet(f"{path}/windows").drop("batch")) == bag(wanted)


def test_parts_of_a_table_in_turn_are_many_files_and_one_batch_each(spark, tmp_path):
    table = spark.range(0, 400, 1, 4).select(F.col("id").alias("n"), F.timestamp_seconds(F.col("id") % 100).alias("ts"))
    seen = []

    def each(rows, batch):
        found = rows.agg(F.count("n"), F.min("ts"), F.max("ts")).first()
        seen.append((found[0], found[1].second, found[2].second, len(list((tmp_path / "parts" / "in").glob("part-*.parquet")))))

    def start(stream):
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    _in_turn(spark, table.filter("ts < timestamp_seconds(60)"), str(tmp_path / "parts"), "ts", ["1970-01-01 00:00:20", "1970-01-01 00:00:50"], start)
    # One file would be one task that reads the whole table and, in its batch, all of a part.
    assert seen == [(80, 0, 19, 4), (120, 20, 49, 8), (40, 50, 59, 12)]
