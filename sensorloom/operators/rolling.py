"""Rolling statistics over the last ``w`` rows, with long windows built from short ones.

A Spark row frame visits all ``w`` rows for every row. A window of 72 rows is also
three windows of 24 side by side, and each of those four windows of 6. So only short
windows use a frame; longer ones combine shifted results of a window that divides them.
All steps share one partitioning and one order, so this adds no exchange and no sort.

Means and squared deviations of equal-sized blocks combine without cancellation, so the
result is as exact as the direct one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.scalar import known

STATISTICS = ("mean", "std", "min", "max")
_DIRECT = 12  # longest window that is cheap as a frame, and most blocks per combination


def block_sizes(windows: Sequence[int]) -> dict[int, int]:
    """For every window the size of the blocks it is built from (itself: a row frame).

    Adds helper sizes where a long window is not a multiple of a wanted one. A length
    without a suitable divisor stays a row frame.
    """
    plan: dict[int, int] = {}

    def add(window: int) -> None:
        if window in plan:
            return
        built = [size for size in plan if size < window and window % size == 0 and window // size <= _DIRECT]
        if window > _DIRECT and not built:
            helpers = [size for size in range(2, window) if window % size == 0 and window // size <= _DIRECT]
            if helpers:
                add(helpers[0])
                built = [helpers[0]]
        plan[window] = max(built) if built and window > 2 else window

    for window in sorted(set(windows)):
        add(window)
    return plan


def rolling(
    df: DataFrame, sensors: Sequence[str], windows: Sequence[int], statistics: Sequence[str], order: WindowSpec
) -> DataFrame:
    """Add ``_{statistic}_{sensor}_{window}``; NULL unless the whole window holds values."""
    wanted = set(statistics)
    moments = bool(wanted & {"mean", "std"})
    plan = block_sizes(windows)
    frame = df

    direct, gated = {}, {}
    for sensor in sensors:
        value = known(df, sensor).cast("double")
        for window in (w for w, block in plan.items() if block == w):
            rows = order.rowsBetween(1 - window, 0)
            measures = {}
            if moments:
                measures["mean"] = F.avg(value).over(rows)
            if "std" in wanted:
                measures["m2"] = F.var_pop(value).over(rows) * window
            if "min" in wanted:
                measures["min"] = F.min(value).over(rows)
            if "max" in wanted:
                measures["max"] = F.max(value).over(rows)
            direct[f"_n_{sensor}_{window}"] = F.count(value).over(rows)
            for name, measure in measures.items():
                column = f"_{name}_{sensor}_{window}"
                direct[column] = measure
                gated[column] = F.when(F.col(f"_n_{sensor}_{window}") == window, F.col(column))
    frame = frame.withColumns(direct).withColumns(gated)

    # A window only waits for the blocks it is built from, so one step can hold several.
    done = {w for w, block in plan.items() if block == w}
    while len(done) < len(plan):
        ready = [w for w, block in plan.items() if w not in done and block in done]
        kinds = [kind for kind in ("mean", "m2", "min", "max") if f"_{kind}_{sensors[0]}_{plan[ready[0]]}" in frame.columns]
        shifted = {}
        for sensor in sensors:
            for window in ready:
                for kind in kinds:
                    source = f"_{kind}_{sensor}_{plan[window]}"
                    for step in range(plan[window], window, plan[window]):
                        shifted[f"{source}@{step}"] = F.lag(source, step).over(order)
        frame = frame.withColumns(shifted)
        # Means first, on their own: the deviations below use each of them many times.
        for group in (("mean",), ("m2", "min", "max")):
            combined = {
                f"_{kind}_{sensor}_{window}": _combine(kind, sensor, window, plan[window])
                for sensor in sensors
                for window in ready
                for kind in kinds
                if kind in group
            }
            frame = frame.withColumns(combined) if combined else frame
        frame = frame.drop(*shifted)
        done.update(ready)

    if "std" in wanted:
        frame = frame.withColumns(
            {
                f"_std_{s}_{w}": F.sqrt(F.try_divide(F.col(f"_m2_{s}_{w}"), F.lit(float(w - 1))))
                for s in sensors
                for w in windows
            }
        )
    return frame


def _combine(kind: str, sensor: str, window: int, block: int) -> Column:
    """A statistic of the window from its equal-sized blocks; NULL if a block has none."""

    def blocks(name: str) -> list[Column]:
        source = f"_{name}_{sensor}_{block}"
        return [F.col(source), *[F.col(f"{source}@{step}") for step in range(block, window, block)]]

    def total(columns: list[Column]) -> Column:
        return reduce(Column.__add__, columns)

    parts = blocks(kind)
    if kind == "mean":
        return parts[0] + total([part - parts[0] for part in parts[1:]]) / len(parts)
    if kind == "m2":
        gaps = [part - F.col(f"_mean_{sensor}_{window}") for part in blocks("mean")]
        return total(parts) + F.lit(float(block)) * total([gap * gap for gap in gaps])
    complete = reduce(Column.__and__, [part.isNotNull() for part in parts])
    return F.when(complete, F.least(*parts) if kind == "min" else F.greatest(*parts))
