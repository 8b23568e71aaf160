"""Streams whose batches keep their own tables: keep-last, features and windows of any length.

Spark offers no row windows, no keep-last by arrival and no windows anchored per entity on a stream. Here
each micro-batch is an ordinary DataFrame that meets what the one before it left open. A batch writes
parts of its own, named by its number, and the mark of its time last; a batch that is run again after a
failure reads the same predecessor and overwrites the same parts, so that it changes nothing.

Time moves as with a watermark: ``mark`` is the latest time seen minus a delay. What is not later than the
mark is closed; rows that arrive after that are late and go to a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.scalar import epoch_micros, known
from ..operators.clean import keep_last
from ..operators.features import common_features
from ..spec import PanelSpec
from .live import frequency_seconds, median_per_window, resample_median

_MARK = T.StructType([T.StructField("latest", T.LongType())])


class Parts:
    """Tables below one folder, one part per batch."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def read(self, spark: SparkSession, name: str, batch: int, schema: T.StructType) -> DataFrame:
        """The part of a batch; before the first batch there is nothing."""
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={batch}")

    def all(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}").drop("batch")

    def latest(self, spark: SparkSession, batch: int) -> int | None:
        """The latest time (microseconds) seen up to a batch."""
        row = self.read(spark, "marks", batch, _MARK).first()
        return row["latest"] if row else None

    def close(self, spark: SparkSession, batch: int, latest: int | None, passing: tuple[str, ...]) -> None:
        """Write the mark of a batch; parts of ``passing`` tables from before its predecessor are no longer needed."""
        self.write(spark.createDataFrame([(latest,)], _MARK).coalesce(1), "marks", batch)
        for name in (*passing, "marks"):
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint_path: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _micros(delay: str) -> int:
    return frequency_seconds(delay) * 1_000_000


def _divided(rows: DataFrame, at: Column, parts: Parts, batch: int, delay: int) -> tuple[DataFrame, int | None, int | None]:
    """The rows that are in time, the latest time seen with this batch and the mark it moves to. Late rows are written."""
    spark = rows.sparkSession
    before = parts.latest(spark, batch - 1)
    here = rows.agg(F.max(at)).first()[0]
    latest = max((t for t in (before, here) if t is not None), default=None)
    late = F.lit(False) if before is None else at <= F.lit(before - delay)
    parts.write(rows.filter(late), "late", batch)
    return rows.filter(~late), latest, None if latest is None else latest - delay


def stream_keep_last(live: DataFrame, spec: PanelSpec, path: str, checkpoint_path: str, *, delay: str, available_now: bool = True) -> StreamingQuery:
    """Keep the last arrival of every (entity, timestamp) of a stream.

    Keys wait in ``open`` until they are older than the latest time seen by ``delay``; then their last row, by
    ``spec.arrival``, goes to ``closed`` for good. Rows of closed keys, and others as old, go to ``late``. Rows without
    a timestamp cannot wait for one and are left out. ``kept`` reads closed and open keys as one table.
    """
    parts, wait, schema = Parts(path), _micros(delay), live.schema

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = epoch_micros(F.col(spec.timestamp))
        rows = rows.filter(F.col(spec.timestamp).isNotNull()).persist()  # read several times below
        fresh, latest, mark = _divided(rows, at, parts, batch, wait)
        newest = keep_last(fresh.unionByName(parts.read(spark, "open", batch - 1, schema)), spec)
        over = F.lit(False) if mark is None else at <= F.lit(mark)
        parts.write(newest.filter(over), "closed", batch)
        parts.write(newest.filter(~over), "open", batch)
        parts.close(spark, batch, latest, ("open",))
        rows.unpersist()

    return _started(live, each, checkpoint_path, available_now)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """Closed keys and those that still wait, as of the last batch."""
    parts = Parts(path)
    last = spark.read.parquet(f"{path}/marks").agg(F.max("batch")).first()[0]
    closed = parts.all(spark, "closed")
    return closed.unionByName(parts.read(spark, "open", last, closed.schema))


def stream_features(
    live: DataFrame,
    spec: PanelSpec,
    path: str,
    checkpoint_path: str,
    *,
    watermark: str,
    frequency: str = "1 hour",
    lags: tuple[int, ...] = (1, 6, 24, 72),
    changes: tuple[int, ...] = (1, 6, 24, 72),
    windows: tuple[int, ...] = (6, 24, 72),
    statistics: tuple[str, ...] = ("mean", "std"),
    available_now: bool = True,
) -> StreamingQuery:
    """Features of a stream of mapped readings, in ``features``: windows are closed by Spark's watermark, and
    each batch of closed windows is put behind the last rows of its entities.

    Those rows, as many per entity as lags and windows reach back, are all of the past that is read; they are kept in ``tail``. Windows close
    in the order of time, so what is emitted later never lies before them.
    """
    parts = Parts(path)
    reach = max(*lags, *changes, *[w - 1 for w in windows], 1)
    closed = resample_median(live, spec, frequency, watermark)
    schema = closed.schema

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.select(*schema.names).persist()
        tail = parts.read(spark, "tail", batch - 1, schema)
        both = rows.withColumn("_new", F.lit(True)).unionByName(tail.withColumn("_new", F.lit(False)))
        made = common_features(both, spec, lags=lags, changes=changes, windows=windows, statistics=statistics)
        parts.write(made.filter("_new").drop("_new"), "features", batch)
        newest = F.row_number().over(Window.partitionBy(spec.entity).orderBy(F.col(spec.timestamp).desc()))
        parts.write(both.withColumn("_age", newest).filter(F.col("_age") <= reach).select(*schema.names), "tail", batch)
        parts.close(spark, batch, None, ("tail",))
        rows.unpersist()

    return _started(closed, each, checkpoint_path, available_now)


def stream_anchored(
    live: DataFrame, spec: PanelSpec, path: str, checkpoint_path: str, *, frequency: str, delay: str, available_now: bool = True
) -> StreamingQuery:
    """Medians of windows of any length, in ``windows``: they start at midnight of the entity's first day, as in a batch.

    Rows wait in ``open`` until their window is over and older than ``delay``. The first day of an entity is kept in ``days``
    once its first window closes; no earlier row can come in time after that. Late rows go to ``late``.
    """
    parts, wait, length = Parts(path), _micros(delay), frequency_seconds(frequency) * 1_000_000
    rows_of = live.select(*spec.keys, *spec.sensors).withColumn(spec.timestamp, F.col(spec.timestamp).cast("timestamp"))
    rows_of = rows_of.select(*spec.keys, *[known(rows_of, s).cast("double").alias(s) for s in spec.sensors])
    schema = rows_of.schema
    days = T.StructType([schema[spec.entity], T.StructField("_origin", T.LongType())])

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = epoch_micros(F.col(spec.timestamp))
        rows = rows.filter(F.col(spec.entity).isNotNull() & F.col(spec.timestamp).isNotNull()).persist()
        fresh, latest, mark = _divided(rows, at, parts, batch, wait)
        waiting = fresh.unionByName(parts.read(spark, "open", batch - 1, schema))
        first = waiting.groupBy(spec.entity).agg(epoch_micros(F.date_trunc("day", F.min(spec.timestamp))).alias("_first"))
        old = parts.read(spark, "days", batch - 1, days)
        origins = old.join(first, spec.entity, "full").select(spec.entity, F.coalesce("_origin", "_first").alias("_origin"))
        start = at - F.pmod(at - F.col("_origin"), F.lit(length))
        placed = waiting.join(origins, spec.entity).withColumn("_from", start).persist()
        over = F.lit(False) if mark is None else F.col("_from") + length <= F.lit(mark)
        done = placed.filter(over).withColumn("_start", F.timestamp_micros("_from"))
        parts.write(median_per_window(done.select(spec.entity, "_start", *spec.sensors), spec), "windows", batch)
        parts.write(placed.filter(~over).select(*schema.names), "open", batch)
        ended = placed.filter(over).select(spec.entity, "_origin").distinct()
        parts.write(old.unionByName(ended.join(old, spec.entity, "left_anti")), "days", batch)
        parts.close(spark, batch, latest, ("open", "days"))
        placed.unpersist()
        rows.unpersist()

    return _started(rows_of, each, checkpoint_path, available_now)
