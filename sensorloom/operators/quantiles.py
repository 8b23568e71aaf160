"""Exact linear-interpolated quantiles that never gather a column in one task.

Equal values are counted first (combined before the exchange), then ranks are counted
over the distinct values. A measured distinct count decides how: few distinct values
are ordered in one window per column; many are dealt to ranges of about equal size (see
``ranking``) and counted there, and only the one or two ranges that hold the wanted ranks are
ordered. Ranges steer balance alone; the results are exact either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import known
from ..settings import max_distinct
from .ranking import laid_out, range_of


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    weight: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Rows (column, count, quantiles): the known values and their exact quantiles.

    ``weight`` names a column that says how many times a row counts. ``rows``, if known,
    bounds the rows of the table; a small one saves the job that counts distinct values.
    A column without any known value has count 0 and NULL quantiles.
    """
    names = [f"v{i}" for i in range(len(columns))]
    values = df.select(
        *[known(df, column).cast("double").alias(name) for name, column in zip(names, columns, strict=True)],
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_weight"),
    )
    bound = max_distinct(df.sparkSession)
    if rows is not None and rows <= bound:
        sizes = dict.fromkeys(names, rows)
    else:
        sizes = values.agg(
            F.count("*").alias("rows"), *[F.approx_count_distinct(name).alias(name) for name in names]
        ).first().asDict()
    few = [name for name in names if sizes[name] <= bound]
    many = [name for name in names if sizes[name] > bound]

    parts = []
    if few:
        parts.append(quantiles_of_counts(_long(values, few), ["column"], fractions))
    if many:
        parts.append(quantiles_of_ranges(ranged(_long(values, many), ["column"]), ["column"], fractions))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    listed = df.sparkSession.createDataFrame(
        list(zip(names, columns, strict=True)), "column string, name string"
    )
    # One row per column on both sides.
    return listed.join(F.broadcast(found), "column", "left").select(
        F.col("name").alias("column"), F.coalesce("count", F.lit(0)).alias("count"), "quantiles"
    )


def _long(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row (column, value, _weight) per known value."""
    cells = [F.struct(F.lit(name).alias("column"), F.col(name).alias("value")) for name in names]
    return (
        values.select(F.explode(F.array(*cells)).alias("cell"), "_weight")
        .select("cell.*", "_weight")
        .filter(F.col("value").isNotNull())
    )


def ranged(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, value, _weight), equal ones added up, with ``piece``: ranges of about equal size over all groups,
    however large one of them is or however close its values lie together."""
    counted = long.groupBy(*keys, "value").agg(F.sum("_weight").alias("_weight"))
    laid, place = laid_out(counted, [*[F.col(key) for key in keys], F.col("value")])
    return laid.withColumn("piece", range_of(place)).drop(place)


def _rank(fraction: float) -> Column:
    return F.lit(float(fraction)) * (F.col("total") - 1)


def _holds(rank: Column) -> Column:
    return (F.col("start") <= rank) & (rank < F.col("stop"))


def _pick(ranked: DataFrame, keys: list[str], fractions: Sequence[float]) -> DataFrame:
    """Interpolate from rows (keys, total, value, start, stop) that cover the wanted ranks."""
    found = ranked.groupBy(*keys, "total").agg(
        *[F.max(F.when(_holds(F.floor(_rank(f))), F.col("value"))).alias(f"low{i}") for i, f in enumerate(fractions)],
        *[F.max(F.when(_holds(F.ceil(_rank(f))), F.col("value"))).alias(f"high{i}") for i, f in enumerate(fractions)],
    )
    quantiles = [
        F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (_rank(f) - F.floor(_rank(f)))
        for i, f in enumerate(fractions)
    ]
    return found.select(*keys, F.col("total").alias("count"), F.array(*quantiles).alias("quantiles"))


def quantiles_of_counts(long: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Quantiles per group of (keys, value, _weight) rows with few distinct values."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("value")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    counts = long.groupBy(*keys, "value").agg(F.sum("_weight").alias("n"))
    ranked = counts.select(
        *keys,
        "value",
        F.sum("n").over(whole).alias("total"),
        (F.sum("n").over(running) - F.col("n")).alias("start"),
        F.sum("n").over(running).alias("stop"),
    )
    return _pick(ranked, keys, fractions)


def quantiles_of_ranges(long: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Quantiles per group of (keys, value, piece, _weight) rows with many distinct values.

    ``piece`` must not decrease as ``value`` grows.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("piece")
    totals = (
        long.groupBy(*keys, "piece")
        .agg(F.sum("_weight").alias("n"))
        .select(
            *keys,
            "piece",
            (F.sum("n").over(order) - F.col("n")).alias("start"),
            F.sum("n").over(order).alias("stop"),
            F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
        )
    )
    wanted = F.lit(False)
    for fraction in fractions:
        wanted = wanted | _holds(F.floor(_rank(fraction))) | _holds(F.ceil(_rank(fraction)))
    # At most two pieces per group and fraction, whatever the size of the data.
    needed = totals.filter(wanted).select(*keys, "piece", F.col("start").alias("base"), "total")

    inside = Window.partitionBy(*keys, "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        long.join(needed, [*keys, "piece"])
        .groupBy(*keys, "piece", "base", "total", "value")
        .agg(F.sum("_weight").alias("n"))
        .withColumn("stop", F.col("base") + F.sum("n").over(inside))
        .withColumn("start", F.col("stop") - F.col("n"))
    )
    return _pick(ranked, keys, fractions)
