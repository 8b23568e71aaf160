"""Cleaning: header, types, keep-last, order, time-weighted interpolation, missing flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import (
    epoch_micros,
    known,
    lenient_number,
    missing,
    strict_flag,
    strict_timestamp,
    strip,
)
from ..spec import PanelSpec
from .ordered import (
    Skew,
    by_time,
    by_time_reversed,
    long_part,
    measure,
    positions_of_long,
    short_part,
)
from .validate import require_columns

MISSING_FLAG = "row_has_missing_sensor"


def normalise_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def canonical_types(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Strict timestamps and labels, trimmed entity, lenient float sensors."""
    typed = {
        spec.timestamp: strict_timestamp(df, spec.timestamp),
        spec.entity: strip(F.col(spec.entity)),
        **{sensor: lenient_number(df, sensor, "float") for sensor in spec.sensors},
        **{label: strict_flag(df, label) for label in spec.labels},
    }
    return df.withColumns(typed)


def keep_last(df: DataFrame, spec: PanelSpec, skew: Skew | None = None) -> DataFrame:
    """Keep the last arrival of every (entity, timestamp).

    ``row_number() = 1`` lets Spark drop all but one row per key before the exchange,
    so a key with very many copies costs one row per map task. Where ``skew`` says that every
    entity fits one task, rows are exchanged by entity instead, and the windows per entity that follow need
    no exchange of their own.
    """
    absent = [name for name in spec.arrival if name not in df.columns]
    if absent:
        raise ValueError(f"Keep-last needs the arrival order; missing columns: {absent}")
    newest = Window.partitionBy(*spec.keys).orderBy(*[F.col(name).desc() for name in spec.arrival])
    rows = df.repartition(spec.entity) if skew is not None and skew.plain else df
    return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def sort_panel(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Global order by (entity, timestamp); a range exchange splits long entities by time."""
    return df.orderBy(*spec.keys)


def missing_flag(df: DataFrame, spec: PanelSpec) -> DataFrame:
    flag = F.lit(False)
    for sensor in spec.sensors:
        flag = flag | missing(df, sensor)
    return df.withColumn(MISSING_FLAG, flag)


def interpolate_time(
    df: DataFrame, spec: PanelSpec, limit: int = 3, skew: Skew | None = None
) -> DataFrame:
    """Linear in elapsed time, between two known values only, per entity.

    Fills the first ``limit`` missing values of each run. Rows without an entity
    belong to no series and are left out. The table must have unique keys.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    skew = skew or measure(df, spec)
    at = epoch_micros(F.col(spec.timestamp))

    def reading(sensor: str, row: Column) -> Column:
        value = known(df, sensor)
        return F.when(value.isNotNull(), F.struct(value.alias("x"), at.alias("t"), row.alias("r")))

    def neighbours(frame: DataFrame, keys: list[str]) -> DataFrame:
        """Nearest known reading at or before, and at or after, each row of its group."""
        readings = {f"_read_{s}": reading(s, F.col("_row")) for s in spec.sensors}
        ahead = by_time_reversed(keys, spec).rowsBetween(Window.unboundedPreceding, 0)
        behind = by_time(keys, spec).rowsBetween(Window.unboundedPreceding, 0)
        return frame.withColumns(readings).withColumns(
            {
                **{f"_prev_{s}": F.last(f"_read_{s}", True).over(behind) for s in spec.sensors},
                **{f"_next_{s}": F.last(f"_read_{s}", True).over(ahead) for s in spec.sensors},
            }
        )

    def fill(frame: DataFrame) -> DataFrame:
        filled = {}
        for sensor in spec.sensors:
            prev, following = F.col(f"_prev_{sensor}"), F.col(f"_next_{sensor}")
            slope = (following["x"].cast("double") - prev["x"]) / (following["t"] - prev["t"])
            estimate = prev["x"] + slope * (at - prev["t"])
            near = F.col("_row") - prev["r"] <= limit
            filled[sensor] = (
                F.when(known(df, sensor).isNotNull(), F.col(sensor))
                .when(near & following.isNotNull(), estimate.cast(df.schema[sensor].dataType))
            )
        return frame.withColumns(filled).select(*df.columns)

    numbered = short_part(df, spec, skew).withColumn(
        "_row", F.row_number().over(by_time([spec.entity], spec)).cast("long")
    )
    result = fill(neighbours(numbered, [spec.entity]))
    if not skew.long_entities:
        return result

    # Long entities: look inside each time slice, then take what the slice lacks from
    # the nearest slice that has a reading (one row per slice, not per reading).
    keys = [spec.entity, "_slice"]
    placed = positions_of_long(long_part(df, spec, skew), spec)
    edges = placed.groupBy(*keys).agg(
        *[F.max_by(reading(s, F.col("_row")), F.when(known(df, s).isNotNull(), F.col("_row"))).alias(f"_last_{s}") for s in spec.sensors],
        *[F.min_by(reading(s, F.col("_row")), F.when(known(df, s).isNotNull(), F.col("_row"))).alias(f"_first_{s}") for s in spec.sensors],
    )
    earlier = Window.partitionBy(spec.entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(spec.entity).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        *[F.last(f"_last_{s}", True).over(earlier).alias(f"_in_{s}") for s in spec.sensors],
        *[F.last(f"_first_{s}", True).over(later).alias(f"_out_{s}") for s in spec.sensors],
    )
    joined = neighbours(placed, keys).join(carried, keys).withColumns(
        {
            **{f"_prev_{s}": F.coalesce(f"_prev_{s}", f"_in_{s}") for s in spec.sensors},
            **{f"_next_{s}": F.coalesce(f"_next_{s}", f"_out_{s}") for s in spec.sensors},
        }
    )
    return result.unionByName(fill(joined))


def clean(
    df: DataFrame,
    spec: PanelSpec,
    interpolate: bool = False,
    limit: int = 3,
    deduplicate: bool = True,
    skew: Skew | None = None,
) -> DataFrame:
    """The shared cleaning steps. Order the output with ``sort_panel`` when writing it."""
    frame = normalise_header(df)
    require_columns(frame, spec)
    frame = canonical_types(frame, spec)
    if deduplicate:
        frame = keep_last(frame, spec)
    frame = frame.drop("_arrival")
    if interpolate:
        frame = interpolate_time(frame, spec, limit, skew)
    return missing_flag(frame, spec)
