"""Per-entity ordered work that survives one entity holding a large share of all rows.

The usual plan is one hash exchange on the entity, one sort by time and one window
pass. It is used whenever a measured bound says every entity fits one task. Entities
above the bound are cut along time:

* ``Skew`` lists them (at most ``MAX_LISTED_GROUPS``, so the list may be broadcast)
  and holds time cut points, plain numbers that make every slice of an entity small.
* ``with_position`` numbers rows exactly: local number in the slice plus the row
  counts of the slices before it.
* ``windowed`` runs any row-frame expression over runs of consecutive positions; each
  run also receives copies of the few rows next to it that its frames reach into.

Cut points only steer balance. Whatever they are, the results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import epoch_micros
from ..settings import MAX_LISTED_GROUPS, max_group_rows
from ..spec import PanelSpec

MAX_PIECES = 16_384
_ROWS_PER_CUT = 200


@dataclass(frozen=True)
class Skew:
    """What one counting job found out about the entities of a panel."""

    rows: int
    null_rows: int
    long_entities: tuple = ()
    cuts: tuple[float, ...] = ()

    @property
    def plain(self) -> bool:
        """True if every entity fits one task and no row lacks its entity."""
        return not self.long_entities and not self.null_rows


def group_limit(rows: int, bound: int) -> int:
    """Rows a group may have before it is cut up; at most ``MAX_LISTED_GROUPS`` exceed it."""
    return max(bound, rows // MAX_LISTED_GROUPS)


def pieces_for(rows: int, bound: int) -> int:
    """Into how many pieces ``rows`` are cut so that each stays well below ``bound``."""
    return max(2, min(MAX_PIECES, -(-4 * rows // max(1, bound))))


def cut_points(df: DataFrame, columns: Sequence[str], rows: int, pieces: int) -> dict[str, list[float]]:
    """For each numeric column, values that cut it into pieces of about equal row count.

    Estimated on one sample for all columns, the way Spark picks the bounds of a range exchange.
    """
    fraction = min(1.0, _ROWS_PER_CUT * pieces / max(1, rows))
    sampled = df if fraction == 1.0 else df.sample(fraction, seed=17)
    steps = [step / pieces for step in range(1, pieces)]
    found = sampled.approxQuantile(list(columns), steps, 1 / (4 * pieces))
    return {column: sorted(set(cuts)) for column, cuts in zip(columns, found, strict=True)}


def piece_number(df: DataFrame, column: str, cuts: Sequence[float], output: str) -> DataFrame:
    """Add the number of the piece a value falls in (NULL for a NULL value)."""
    if not cuts:
        return df.withColumn(output, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(
        splits=splits, inputCol=column, outputCol=output, handleInvalid="keep"
    ).transform(df)


def measure(df: DataFrame, spec: PanelSpec) -> Skew:
    """Count rows per entity (one narrow, pre-aggregated job) and find the long ones."""
    bound = max_group_rows(df.sparkSession)
    counts = df.groupBy(spec.entity).agg(F.count("*").alias("_n"))
    total = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col(spec.entity).isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.max(F.when(F.col(spec.entity).isNotNull(), F.col("_n"))), F.lit(0)).alias("largest"),
    ).first()
    limit = group_limit(total["rows"], bound)
    if total["largest"] <= limit:
        return Skew(total["rows"], total["nulls"])
    listed = counts.filter((F.col("_n") > limit) & F.col(spec.entity).isNotNull()).collect()
    entities = tuple(sorted(row[spec.entity] for row in listed))
    long_rows = sum(row["_n"] for row in listed)
    moments = (
        df.join(_listed(df, spec, entities), spec.entity, "left_semi")
        .select(epoch_micros(F.col(spec.timestamp)).cast("double").alias("_at"))
    )
    cuts = cut_points(moments, ["_at"], long_rows, pieces_for(long_rows, bound))["_at"]
    return Skew(total["rows"], total["nulls"], entities, tuple(cuts))


def _listed(df: DataFrame, spec: PanelSpec, entities: tuple) -> DataFrame:
    schema = T.StructType([T.StructField(spec.entity, df.schema[spec.entity].dataType)])
    frame = df.sparkSession.createDataFrame([(entity,) for entity in entities], schema)
    return F.broadcast(frame)  # at most MAX_LISTED_GROUPS keys, see group_limit


def short_part(df: DataFrame, spec: PanelSpec, skew: Skew) -> DataFrame:
    part = df.filter(F.col(spec.entity).isNotNull())
    if not skew.long_entities:
        return part
    return part.join(_listed(df, spec, skew.long_entities), spec.entity, "left_anti").select(*df.columns)


def long_part(df: DataFrame, spec: PanelSpec, skew: Skew) -> DataFrame:
    """Rows of the long entities with ``_slice``, the number of their time slice."""
    part = df.join(_listed(df, spec, skew.long_entities), spec.entity, "left_semi").select(*df.columns)
    stamped = part.withColumn("_at", epoch_micros(F.col(spec.timestamp)).cast("double"))
    sliced = piece_number(stamped, "_at", skew.cuts, "_slice").drop("_at")
    # Rows without a time come last in any order, so they are spread over slices beyond all others.
    beyond = F.lit(1e9) + F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(len(skew.cuts) + 1))
    return sliced.withColumn("_slice", F.coalesce(F.nanvl(F.col("_slice"), F.lit(None)), beyond))


def by_time(keys: Sequence[str], spec: PanelSpec) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(spec.timestamp).asc_nulls_last())


def by_time_reversed(keys: Sequence[str], spec: PanelSpec) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(spec.timestamp).desc_nulls_first())


def positions_of_long(sliced: DataFrame, spec: PanelSpec) -> DataFrame:
    """``_row`` (0-based) and ``_rows`` for sliced rows; ``_slice`` is kept."""
    keys = [spec.entity, "_slice"]
    before = Window.partitionBy(spec.entity).orderBy("_slice")
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(spec.entity)).alias("_rows"),
        )
    )
    return (
        sliced.withColumn("_local", F.row_number().over(by_time(keys, spec)))
        .join(offsets, keys)
        .withColumn("_row", F.col("_before") + F.col("_local") - 1)
        .select(*sliced.columns, "_row", "_rows")
    )


def with_position(df: DataFrame, spec: PanelSpec, skew: Skew | None = None) -> DataFrame:
    """Add ``_row`` (0-based position in the entity by time) and ``_rows`` (entity size).

    Rows without an entity belong to no series and are left out.
    """
    skew = skew or measure(df, spec)
    window = by_time([spec.entity], spec)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = short_part(df, spec, skew).select(
        *df.columns,
        (F.row_number().over(window) - 1).cast("long").alias("_row"),
        F.count(F.lit(1)).over(whole).alias("_rows"),
    )
    if not skew.long_entities:
        return numbered
    positions = positions_of_long(long_part(df, spec, skew), spec).drop("_slice")
    return numbered.unionByName(positions)


def windowed(
    df: DataFrame,
    spec: PanelSpec,
    build: Callable[[DataFrame, list[str]], DataFrame],
    *,
    before: int = 0,
    after: int = 0,
    skew: Skew | None = None,
) -> DataFrame:
    """Apply ``build(frame, keys)``, which adds columns over ``by_time(keys, spec)``.

    ``before`` and ``after`` say how many rows its frames reach back and ahead.
    Rows without an entity belong to no series: the added columns are NULL there.
    """
    skew = skew or measure(df, spec)
    if skew.plain:
        # ``skew`` may come from another table, so rows without an entity are looked after here too.
        built = build(df, [spec.entity])
        return built.select(*[F.when(F.col(spec.entity).isNotNull(), F.col(f"`{c}`")).alias(c) if c not in df.columns else F.col(f"`{c}`") for c in built.columns])

    result = build(short_part(df, spec, skew), [spec.entity])
    added = [field for field in result.schema if field.name not in df.columns]
    if skew.long_entities:
        run_rows = max(max_group_rows(df.sparkSession), before, after, 1)
        runs = _runs(positions_of_long(long_part(df, spec, skew), spec), run_rows, before, after)
        pieces = build(runs, [spec.entity, "_run"])
        result = result.unionByName(pieces.filter(~F.col("_copy")).select(*result.columns))
    if skew.null_rows:
        loose = df.filter(F.col(spec.entity).isNull())
        empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in added]
        result = result.unionByName(loose.select(*df.columns, *empty))
    return result


def _runs(positioned: DataFrame, run_rows: int, before: int, after: int) -> DataFrame:
    """Give every row its run of ``run_rows`` positions, plus copies for the runs beside it."""
    run = F.floor(F.col("_row") / F.lit(run_rows)).cast("long")
    offset = F.col("_row") % run_rows

    def place(number: Column, copy: bool) -> Column:
        return F.struct(number.alias("_run"), F.lit(copy).alias("_copy"))

    places = [place(run, False)]
    if before:
        reaches_next = (offset >= run_rows - before) & (F.col("_row") - offset + run_rows < F.col("_rows"))
        places.append(F.when(reaches_next, place(run + 1, True)))
    if after:
        places.append(F.when((offset < after) & (run > 0), place(run - 1, True)))
    kept = [name for name in positioned.columns if name not in ("_row", "_rows", "_slice")]
    return positioned.select(*kept, F.explode(F.array_compact(F.array(*places))).alias("_place")).select(
        *kept, "_place.*"
    )
