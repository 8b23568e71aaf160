"""Column contracts between result tables and their readers: aliases, defaults, label maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which a reader may find each result column.
SENSOR_ALIASES = {
    "temperature": ("temperature", "temp", "temperature_c"),
    "humidity": ("humidity", "humidity_pct"),
    "co2": ("co2", "co2_ppm"),
    "weight": ("weight", "weight_kg"),
}
SUMMARY_ALIASES = {
    "total_records": ("total_records", "rows"),
    "total_hives": ("total_hives", "hives"),
    "analysis_start": ("analysis_start", "start"),
    "analysis_end": ("analysis_end", "end"),
    "duration_days": ("duration_days",),
    "sampling_frequency": ("sampling_frequency", "frequency"),
}
SUMMARY_DEFAULTS = {"total_records": 0, "total_hives": 0, "sampling_frequency": "1 hour"}
COVERAGE_ALIASES = {
    "hive": ("hive", "hive_id"),
    "records": ("records", "row_count", "count"),
    "coverage_percentage": ("coverage_percentage", "coverage"),
}
COVERAGE_DEFAULTS = {"records": 0}
BALANCE_ALIASES = {
    "display_name": ("display_name", "name"),
    "positive": ("positive", "ones", "count_1"),
    "negative": ("negative", "zeros", "count_0"),
    "positive_percentage": ("positive_percentage", "percentage", "rate"),
    "positive_per_10000": ("positive_per_10000",),
}
SECTION_ALIASES = {"hive_stats": ("hive_stats", "hive_coverage"), "correlation": ("correlation", "sensor_correlation")}


# Types of contract columns, for those that a table has under no alias.
COLUMN_TYPES = {
    "total_records": "bigint", "total_hives": "bigint", "analysis_start": "string", "analysis_end": "string",
    "duration_days": "double", "sampling_frequency": "string", "hive": "string", "records": "bigint",
    "coverage_percentage": "double", "display_name": "string", "positive": "bigint", "negative": "bigint",
    "positive_percentage": "double", "positive_per_10000": "double", "sensor": "string", "count": "bigint",
}


def _first_known(present: Mapping[str, Column], names: Sequence[str], default: object = None, kind: str = "double") -> Column:
    found = [present[name] for name in names if name in present]
    if found:
        return F.coalesce(*found, *([] if default is None else [F.lit(default)]))
    return F.lit(default).cast(kind) if default is None or kind != "double" else F.lit(default)


def resolve_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Add each canonical column as the first known value among its aliases.

    All other columns stay. A column found under no alias gets its default, or NULL.
    """
    present = {name: F.col(f"`{name}`") for name in df.columns}
    values = dict(defaults or {})
    return df.withColumns(
        {name: _first_known(present, names, values.get(name), COLUMN_TYPES.get(name, "double")) for name, names in aliases.items()}
    )


def label_balance_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows from a map of label to count, or of label to a struct of counts."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.MapType):
        raise TypeError(f"Column {column} is not a map.")
    entries = df.select(F.explode(column).alias("target", "value"))
    if not isinstance(kind.valueType, T.StructType):
        return entries.select("target", F.col("value").alias("positive"), F.lit(0).alias("negative"))
    present = {name: F.col(f"value.`{name}`") for name in kind.valueType.names}
    defaults = {"positive": 0, "negative": 0}
    resolved = {name: _first_known(present, names, defaults.get(name), COLUMN_TYPES[name]) for name, names in BALANCE_ALIASES.items()}
    resolved["display_name"] = F.coalesce(resolved["display_name"], F.col("target"))
    return entries.select("target", *[value.alias(name) for name, value in resolved.items()])


# What a reader finds where a result has no such section: no rows, but the columns it asks for.
_PATTERN = ", ".join(f"{name} double" for name in SENSOR_ALIASES)
ABSENT_SECTIONS = {
    "sensor_statistics": "sensor string, count bigint",
    "outlier_analysis": "sensor string, count bigint, percentage double",
    "hive_stats": "hive string, records bigint, coverage_percentage double",
    "hourly_patterns": f"hour int, {_PATTERN}",
    "weekday_patterns": f"day string, {_PATTERN}",
    "monthly_patterns": f"month string, {_PATTERN}",
    "sensor_histograms": "sensor string, bin int, count bigint",
    "target_balance": "target string, display_name string, positive bigint, negative bigint, positive_percentage double, positive_per_10000 double",
    "target_by_hive": "hive string",
    "monthly_target_counts": "month string, records bigint",
    "target_cooccurrence": "row string, column string, count bigint",
    "target_sensor_effects": "target string, sensor string",
    "relationship_sample": f"hive string, timestamp string, {_PATTERN}",
    "correlation": "row string, column string, correlation double",
    "data_quality": "name string, missing bigint",
}


def canonical_sensors(statistics: DataFrame) -> DataFrame:
    """Statistics with one row per canonical sensor, from the first of its aliases that has one.

    A sensor found under no alias has a row without values. The alias table is fixed and small.
    """
    known = [(name, alias, place) for name, aliases in SENSOR_ALIASES.items() for place, alias in enumerate(aliases)]
    aliases = statistics.sparkSession.createDataFrame(known, "_canonical string, _alias string, _place int")
    values = [c for c in statistics.columns if c != "sensor"]
    found = aliases.join(statistics, F.col("_alias") == F.col("sensor"), "left")
    place = F.when(F.col("sensor").isNotNull(), F.col("_place")).otherwise(len(known))
    first = found.groupBy("_canonical").agg(F.min_by(F.struct(*values), place).alias("_values"))
    return first.select(F.col("_canonical").alias("sensor"), *[F.col(f"_values.`{c}`").alias(c) for c in values])


def normalise_sections(sections: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Give every result table its canonical section name, columns and defaults.

    Sections that are absent become empty tables (if there is any table to go by).
    """
    named = dict(sections)
    spark = next((frame.sparkSession for frame in sections.values()), None)
    for canonical, names in SECTION_ALIASES.items():
        found = next((name for name in names if name in sections), None)
        for name in names:
            named.pop(name, None)
        if found:
            named[canonical] = sections[found]
    if "summary" in named:
        named["summary"] = resolve_aliases(named["summary"], SUMMARY_ALIASES, SUMMARY_DEFAULTS)
    if "hive_stats" in named:
        named["hive_stats"] = resolve_aliases(named["hive_stats"], COVERAGE_ALIASES, COVERAGE_DEFAULTS)
    for section in ("hourly_patterns", "weekday_patterns", "monthly_patterns", "relationship_sample"):
        if section in named:
            named[section] = resolve_aliases(named[section], SENSOR_ALIASES)
    if "sensor_statistics" in named:
        named["sensor_statistics"] = canonical_sensors(named["sensor_statistics"])
    balance = named.get("target_balance")
    if balance is not None and len(balance.columns) == 1 and isinstance(balance.schema[0].dataType, T.MapType):
        named["target_balance"] = label_balance_rows(balance, balance.columns[0])
    if spark:
        for section, columns in ABSENT_SECTIONS.items():
            named.setdefault(section, spark.createDataFrame([], columns))
    return named
