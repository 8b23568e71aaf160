"""Panels derived from the star-schema test tables (lineitem and events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import keep_last
from ..operators.ordered import Skew
from ..spec import PanelSpec

SENSORS = ("s1", "s2", "s3", "s4")
LABELS = ("t1", "t2", "t3", "t4")

PANEL = PanelSpec(
    entity="entity",
    timestamp="ts",
    sensors=SENSORS,
    labels=LABELS,
    bounds={"s1": (5.0, 45.0), "s2": (2_000.0, 90_000.0), "s3": (0.01, 0.09), "s4": (0.0, 0.07)},
    arrival=("a1", "a2", "a3"),
)
LIVE = PanelSpec(
    entity="entity",
    timestamp="ts",
    sensors=("value", "k"),
    labels=("error", "purchase", "signup", "click"),
    bounds={"value": (0.0, 100.0)},
    arrival=("event_id",),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("byte")


def panel_raw(spark: SparkSession, folder: str, holes: bool = False) -> DataFrame:
    """Daily readings per supplier, with repeated keys; ``holes`` blanks one value in five."""
    lines = table(spark, folder, "lineitem")
    quantity = F.col("l_quantity")
    if holes:
        mixed = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")) % 5
        quantity = F.when(mixed != 0, quantity)
    return lines.select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_shipdate").alias("ts"),
        quantity.alias("s1"),
        F.col("l_extendedprice").alias("s2"),
        F.col("l_discount").alias("s3"),
        F.col("l_tax").alias("s4"),
        _flag(F.col("l_returnflag") == "R").alias("t1"),
        _flag(F.col("l_linestatus") == "F").alias("t2"),
        _flag(F.col("l_quantity") >= 49).alias("t3"),
        _flag(F.col("l_discount") >= 0.1).alias("t4"),
        F.col("l_orderkey").alias("a1"),
        F.col("l_linenumber").alias("a2"),
        F.col("l_partkey").alias("a3"),
    )


def panel(spark: SparkSession, folder: str, holes: bool = False, skew: Skew | None = None) -> DataFrame:
    """``panel_raw`` with one row per (entity, timestamp)."""
    return keep_last(panel_raw(spark, folder, holes), PANEL, skew).drop(*PANEL.arrival)


def live_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Irregular readings per user."""
    events = table(spark, folder, "events")
    kinds = [_flag(F.col("event_type") == kind).alias(kind) for kind in LIVE.labels]
    return events.select(
        F.col("user_id").alias("entity"),
        "ts",
        "value",
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        *kinds,
        "event_id",
    )
