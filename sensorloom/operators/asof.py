"""As-of join of two time-ordered tables: each row of one meets the latest earlier row of the other.

Both tables are laid into one order by (key, time) and the values of the second are carried
forward. If a count says that every key fits one task, that is one exchange, one sort and one window.
Otherwise the order is cut into ranges of about equal size, wherever a key may end: values are
carried inside a range, and across its edge a small table gives what its first key brings along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import max_group_rows
from .ranking import laid_out, range_of, unused

BACKWARD, FORWARD = "backward", "forward"


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    *,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    tolerance: Column | None = None,
    tie: Sequence[str] = (),
    direction: str = BACKWARD,
) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` at or before its time, under the same key.

    ``direction="forward"`` takes the earliest row at or after it. Of several rows of ``right`` at one
    time the last in the order of ``tie`` (then of all its columns) counts. ``tolerance``, in the unit in which
    the two times are subtracted, bounds how far away the row may be. Rows without a match, key or time keep
    nulls; rows of ``right`` without key or time are never met. ``on`` may be empty.
    """
    if direction not in (BACKWARD, FORWARD):
        raise ValueError(f"unknown direction {direction}")
    clash = [c for c in columns if c.lower() in {name.lower() for name in left.columns}]
    if clash:
        raise ValueError(f"The table already has {', '.join(clash)}.")
    own, at, side, ties = (unused(left, n) for n in ("_own", "_at", "_side", "_ties"))
    payload = F.struct(F.col(right_time).alias("at"), *[F.col(f"`{c}`") for c in columns])
    met = right.filter(F.col(right_time).isNotNull())
    for key in on:
        met = met.filter(F.col(key).isNotNull())
    order_of_ties = F.struct(*[F.col(c) for c in (*tie, *sorted({*columns} - {*tie}))])
    offered = met.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(on)], F.col(right_time).alias(at), F.lit(0).alias(side), order_of_ties.alias(ties), payload.alias("_offer"))
    able = F.col(left_time).isNotNull()
    for key in on:
        able = able & F.col(key).isNotNull()
    asked = left.filter(able).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(on)], F.col(left_time).alias(at), F.lit(1).alias(side), F.struct(*[f"`{c}`" for c in left.columns]).alias(own))
    both = offered.unionByName(asked, allowMissingColumns=True)
    keys = [f"_key{i}" for i in range(len(on))]
    carried = _carried(both, keys, at, side, ties, direction)

    away = F.col(at) - F.col("_found.at") if direction == BACKWARD else F.col("_found.at") - F.col(at)
    near = F.lit(True) if tolerance is None else away <= tolerance
    joined = carried.filter(F.col(side) == 1).select(f"{own}.*", *[F.when(near, F.col(f"_found.`{c}`")).alias(c) for c in columns])
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    return joined.unionByName(left.filter(~able).select(*[f"`{c}`" for c in left.columns], *empty))


def _carried(both: DataFrame, keys: list[str], at: str, side: str, ties: str, direction: str) -> DataFrame:
    """Add ``_found``: the latest offer so far, in the order of the direction."""
    # An offer comes before the rows of its own time, the one that counts last.
    order = [F.col(at).asc() if direction == BACKWARD else F.col(at).desc(), F.col(side), F.col(ties).asc_nulls_first()]
    offer = F.when(F.col(side) == 0, F.col("_offer"))
    largest = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if keys and largest <= max_group_rows(both.sparkSession):
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("_found", F.last(offer, ignorenulls=True).over(so_far))

    laid, place = laid_out(both, [*[F.col(k) for k in keys], *order])
    ranged = laid.withColumn("_range", range_of(place))
    inside = Window.partitionBy(*keys, "_range").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.last(offer, ignorenulls=True).over(inside))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.groupBy(*keys, "_range").agg(F.max_by("_offer", F.when(F.col(side) == 0, F.col(place))).alias("_last"))
    # A range begins inside one key at most, so this table has no more rows than there are ranges.
    edges = last.withColumn("_edge", F.last("_last", ignorenulls=True).over(before)).filter(F.col("_edge").isNotNull()).select(*keys, "_range", "_edge")
    met = local.join(F.broadcast(edges), [*keys, "_range"], "left")
    return met.withColumn("_found", F.coalesce("_local", "_edge"))
