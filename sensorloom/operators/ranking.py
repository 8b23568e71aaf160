"""Exact positions and running totals over one global order of all rows.

A window without partitions would bring the whole table into one task. Here rows are dealt out by
value ranges and sorted inside them; every range is counted and summed, one small row a range, and
the totals of the ranges before it complete what a row knows from its own range. Rows that tie in
the whole order are told apart by their place in the input, so that a third of all rows may tie.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..settings import checkpoint

_BITS = 33  # of an id of monotonically_increasing_id() that count rows inside a partition


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def laid_out(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, str]:
    """The rows in range partitions, kept in a checkpoint, with the name of a column whose values grow along the order."""
    tie, place = unused(df, "_tie"), unused(df, "_place")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(ranges, *order, F.col(tie)).sortWithinPartitions(*order, tie)
    return checkpoint(sorted_.drop(tie).withColumn(place, F.monotonically_increasing_id())), place


def range_of(place: str) -> Column:
    """The number of the range a row was dealt to."""
    return F.shiftright(place, _BITS)


def _offsets(laid: DataFrame, place: str, sums: Sequence[str]) -> DataFrame:
    """What lies before each range, one row a range: ``_range``, ``_before`` and a total per column."""
    totals = [F.sum(name).alias(f"s{i}") for i, name in enumerate(sums)]
    found = laid.groupBy(range_of(place).alias("r")).agg(F.count(F.lit(1)).alias("n"), *totals).orderBy("r").collect()
    types = [T.LongType(), *[laid.schema[name].dataType for name in sums]]
    before = [list(accumulate((row[i + 1] or 0 for row in found), initial=0)) for i in range(len(types))]
    names = ["_before", *[f"_before_{name}" for name in sums]]
    fields = [T.StructField("_range", T.LongType()), *[T.StructField(n, _wide(t)) for n, t in zip(names, types, strict=True)]]
    rows = [(row["r"], *[b[i] for b in before]) for i, row in enumerate(found)]
    return F.broadcast(laid.sparkSession.createDataFrame(rows, T.StructType(fields)))  # one row a partition


def _wide(kind: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else T.LongType()


def with_positions(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """Add ``output``, the position (from 1) of each row in ``order`` over the whole table."""
    laid, place = laid_out(df, order)
    offsets = _offsets(laid, place, [])
    inside = F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))
    found = laid.withColumn("_range", range_of(place)).join(offsets, "_range")
    return found.select(*df.columns, (F.col("_before") + inside + 1).alias(output))


def with_running_totals(df: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Add ``{name}_so_far`` for each column of ``sums``: its total over all rows up to this one,
    itself included. ``order`` should tell rows apart; nulls count as nothing."""
    laid, place = laid_out(df, order)
    offsets = _offsets(laid, place, sums)
    ranged = laid.withColumn("_range", range_of(place))
    running = Window.partitionBy("_range").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.coalesce(F.sum(name).over(running), F.lit(0)).alias(f"_run_{name}") for name in sums])
    total = [(F.col(f"_before_{name}") + F.col(f"_run_{name}")).alias(f"{name}_so_far") for name in sums]
    return local.join(offsets, "_range").select(*df.columns, *total)
