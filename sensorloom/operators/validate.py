"""Validation of a raw or cleaned panel: one counting pass and one key group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_text, lenient_number, lenient_timestamp, missing
from ..spec import PanelSpec


def require_columns(df: DataFrame, spec: PanelSpec) -> None:
    absent = [name for name in spec.required if name not in df.columns]
    if absent:
        raise ValueError(f"The panel lacks {absent}.")


def validation_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row: everything that a single pass over the table can count."""
    require_columns(df, spec)
    moment = lenient_timestamp(df, spec.timestamp)
    outside = {}
    for sensor in spec.sensors:
        if sensor in spec.bounds:
            low, high = spec.bounds[sensor]
            value = lenient_number(df, sensor)
            outside[sensor] = F.count_if((value < low) | (value > high))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.col(spec.entity)).alias("entities"),
        F.count_if(moment.isNull()).alias("invalid_timestamps"),
        F.count_if(missing(df, spec.entity)).alias("null_entities"),
        *[F.count_if(missing(df, name)).alias(f"missing_{name}") for name in spec.required],
        *[count.alias(f"outside_{sensor}") for sensor, count in outside.items()],
        F.count_if(_any_invalid_label(df, spec)).alias("invalid_label_rows"),
        iso_text(F.min(moment)).alias("start"),
        iso_text(F.max(moment)).alias("end"),
    )


def _any_invalid_label(df: DataFrame, spec: PanelSpec) -> Column:
    invalid = F.lit(False)
    for label in spec.labels:
        invalid = invalid | F.coalesce(~lenient_number(df, label).isin(0.0, 1.0), F.lit(False))
    return invalid


def missing_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows (column, missing) for every required column."""
    require_columns(df, spec)
    counts = df.agg(*[F.count_if(missing(df, name)).alias(name) for name in spec.required])
    return counts.unpivot([], list(spec.required), "column", "missing")


def bounds_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows (sensor, out_of_bounds); missing values are not counted."""
    bounded = [sensor for sensor in spec.sensors if sensor in spec.bounds]
    counts = []
    for sensor in bounded:
        low, high = spec.bounds[sensor]
        value = lenient_number(df, sensor)
        counts.append(F.count_if((value < low) | (value > high)).alias(sensor))
    return df.agg(*counts).unpivot([], bounded, "sensor", "out_of_bounds")


def binary_domain(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows (label, value, rows): every value of a label other than 0 and 1."""
    pairs = F.array(
        *[F.struct(F.lit(label).alias("label"), lenient_number(df, label).alias("value")) for label in spec.labels]
    )
    return (
        df.select(F.explode(pairs).alias("pair"))
        .select("pair.*")
        .filter(~F.col("value").isin(0.0, 1.0))
        .groupBy("label", "value")
        .agg(F.count("*").alias("rows"))
    )


def duplicate_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row: ``surplus`` (all copies but one per key) and ``members`` (every copy)."""
    copies = df.groupBy(*spec.keys).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"),
    )


def validation_report(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One-row report. Raises ValueError for bad timestamps or rows without an entity.

    Each label with values other than 0 and 1 is listed with the number of those values and of
    the rows that hold them; ``binary_domain`` gives the values themselves as a table.
    """
    counts = validation_counts(df, spec).first()
    if counts["invalid_timestamps"]:
        raise ValueError(f"Some values of {spec.timestamp} are no timestamps.")
    if counts["null_entities"]:
        raise ValueError(f"Some rows have no {spec.entity}.")

    # At most one row per label.
    offending = []
    if counts["invalid_label_rows"]:
        domain = binary_domain(df, spec).groupBy("label")
        offending = domain.agg(F.count("*").alias("distinct_values"), F.sum("rows").alias("rows")).orderBy("label").collect()
    listed = [part for row in offending for part in (F.lit(row["label"]), F.struct(F.lit(row["distinct_values"]).alias("distinct_values"), F.lit(row["rows"]).alias("rows")))]
    invalid = F.create_map(*listed).cast("map<string,struct<distinct_values:bigint,rows:bigint>>")

    def as_map(entries: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(part) for entry in entries.items() for part in entry]).cast("map<string,bigint>")

    return duplicate_keys(df, spec).select(
        F.lit(counts["rows"]).cast("long").alias("rows"),
        F.lit(counts["entities"]).cast("long").alias("entities"),
        F.col("surplus").alias("duplicate_keys"),
        as_map({name: counts[f"missing_{name}"] for name in spec.required}).alias("missing_by_column"),
        invalid.alias("invalid_binary_values"),
        as_map({s: counts[f"outside_{s}"] for s in spec.sensors if s in spec.bounds}).alias("out_of_sanity_bounds"),
        F.lit(counts["start"]).alias("timestamp_start"),
        F.lit(counts["end"]).alias("timestamp_end"),
    )
