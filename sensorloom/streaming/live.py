"""Live readings: mapping to panel columns and resampling, as a batch or as a stream."""

from __future__ import annotations

import re
import time
import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import epoch_micros, known, lenient_number, strict_timestamp, strip
from ..operators.quantiles import quantiles_of_ranges, ranged
from ..settings import checkpoint, max_group_rows
from ..spec import PanelSpec

_UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "minute": 60, "t": 60, "h": 3600, "hour": 3600, "d": 86_400, "day": 86_400}
DAY = 86_400
SALTS = 32


def frequency_seconds(frequency: str) -> int:
    """Length of a frequency such as ``1h``, ``10min`` or ``1 hour``."""
    match = re.fullmatch(r"\s*(\d*)\s*([a-z]+?)s?\s*", frequency.lower())
    seconds = int(match.group(1) or 1) * _UNITS.get(match.group(2), 0) if match else 0
    if seconds <= 0:
        raise ValueError(f"Unknown frequency: {frequency}")
    return seconds


def map_live(df: DataFrame, mapping: Mapping[str, str], spec: PanelSpec, optional: Mapping[str, str] | None = None) -> DataFrame:
    """Rename live columns to panel columns; UTC timestamps, trimmed entity, lenient numbers.

    Columns of ``optional`` are renamed where they are; others pass through. Works on batches and streams; order a batch with
    ``sort_panel`` when it is written.
    """
    absent = [name for name in mapping if name not in df.columns]
    if absent:
        raise ValueError(f"The live table lacks {absent}.")
    renamed = df.withColumnsRenamed({**(optional or {}), **mapping})
    return renamed.withColumns(
        {
            spec.timestamp: strict_timestamp(renamed, spec.timestamp, "timestamp"),
            spec.entity: strip(F.col(spec.entity)),
            **{sensor: lenient_number(renamed, sensor) for sensor in spec.sensors},
        }
    )


def resample_median(
    df: DataFrame, spec: PanelSpec, frequency: str = "1 hour", watermark: str | None = None
) -> DataFrame:
    """Median of every sensor per entity and time window, labelled by the window start.

    Windows start at midnight of the entity's first day. Windows in which every sensor
    is missing are left out. Streams need ``watermark`` and a frequency that divides a
    day, for which the first day does not matter.
    """
    seconds = frequency_seconds(frequency)
    rows = df.filter(F.col(spec.entity).isNotNull() & F.col(spec.timestamp).isNotNull())
    rows = rows.withColumn(spec.timestamp, F.col(spec.timestamp).cast("timestamp"))
    rows = rows.select(*spec.keys, *[known(rows, s).cast("double").alias(s) for s in spec.sensors])

    if df.isStreaming:
        if DAY % seconds:
            raise ValueError("A stream can only be resampled to a frequency that divides a day.")
        if watermark is None:
            raise ValueError("A stream needs a watermark, or no window would ever be closed.")
        window = F.window(spec.timestamp, f"{seconds} seconds")
        medians = rows.withWatermark(spec.timestamp, watermark).groupBy(F.col(spec.entity), window).agg(
            *_medians(spec)
        )
        return _some_value(medians.select(spec.entity, F.col("window.start").alias(spec.timestamp), *spec.sensors), spec)

    if DAY % seconds:
        rows = _anchored(rows, spec, seconds)
    else:
        rows = rows.withColumn("_start", F.window(spec.timestamp, f"{seconds} seconds").start)
    return median_per_window(rows, spec)


def median_per_window(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Medians per entity and ``_start``, which becomes the time; crowded windows are counted by value ranges."""
    keys = [spec.entity, "_start"]

    bound = max_group_rows(rows.sparkSession)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    if total["largest"] <= bound:
        medians = rows.groupBy(*keys).agg(*_medians(spec))
    else:
        # However many windows are crowded, they stay a table; a join can split those it finds long.
        crowded = checkpoint(sizes.filter(F.col("n") > bound).select(*keys))
        few = rows.join(crowded, keys, "left_anti").groupBy(*keys).agg(*_medians(spec))
        many = _crowded_medians(rows.join(crowded, keys, "left_semi"), keys, spec)
        medians = few.unionByName(many)
    return _some_value(medians.select(spec.entity, F.col("_start").alias(spec.timestamp), *spec.sensors), spec)


def _medians(spec: PanelSpec) -> list:
    return [F.median(s).alias(s) for s in spec.sensors]


def _some_value(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.filter(F.coalesce(*[F.col(s) for s in spec.sensors]).isNotNull())


def _anchored(rows: DataFrame, spec: PanelSpec, seconds: int) -> DataFrame:
    """Window starts counted from midnight of each entity's first day."""
    first = rows.groupBy(spec.entity).agg(
        epoch_micros(F.date_trunc("day", F.min(spec.timestamp))).alias("_origin")
    )
    # The few values per entity are repeated, so that no task gets all rows of a long one.
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spec.timestamp), F.lit(SALTS)).cast("int"))
    length = seconds * 1_000_000
    offset = epoch_micros(F.col(spec.timestamp)) - F.col("_origin")
    start = F.timestamp_micros(F.col("_origin") + offset - F.pmod(offset, F.lit(length)))
    return rows.join(first, [spec.entity, "_salt"]).withColumn("_start", start).drop("_origin", "_salt")


def _crowded_medians(rows: DataFrame, keys: list[str], spec: PanelSpec) -> DataFrame:
    """Medians of groups too large for one task, by counting ranks over value ranges."""
    cells = F.array(*[F.struct(F.lit(s).alias("column"), F.col(s).alias("value")) for s in spec.sensors])
    long = rows.select(*keys, F.explode(cells).alias("t")).select(*keys, "t.*", F.lit(1).alias("_weight")).filter(F.col("value").isNotNull())
    found = quantiles_of_ranges(ranged(long, [*keys, "column"]), [*keys, "column"], [0.5])
    middle = F.element_at("quantiles", 1)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == s, middle)).alias(s) for s in spec.sensors])


def stream_resampled(
    live: DataFrame,
    spec: PanelSpec,
    path: str,
    checkpoint_path: str,
    frequency: str = "1 hour",
    *,
    watermark: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append closed windows of a stream to a Parquet folder.

    Rows later than ``watermark`` are dropped; ``await_resampled`` counts what they would have changed.
    ``checkpoint_path`` must be storage that every executor can reach.
    """
    writer = (
        resample_median(live, spec, frequency, watermark)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint_path)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def await_resampled(query: StreamingQuery, seconds: float | None = None) -> int:
    """Waits until ``query`` ends (or ``seconds`` are over) and returns how many late groups the watermark
    dropped since the call, with a warning if there are any; rows of one entity, window and batch are one
    group.

    Progress is read every half second, as Spark keeps that of a hundred batches only.
    """
    dropped, seen, until = 0, "", None if seconds is None else time.monotonic() + seconds
    while True:
        over = query.awaitTermination(0.5) or (until is not None and time.monotonic() >= until)
        for progress in query.recentProgress:
            if progress["timestamp"] > seen:
                seen = progress["timestamp"]
                dropped += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
        if over:
            break
    if dropped:
        warnings.warn(f"The watermark dropped {dropped} late groups.", stacklevel=2)
    return dropped
