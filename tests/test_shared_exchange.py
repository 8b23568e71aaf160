"""Keep-last and the windows per entity share one exchange, and crowded windows are cut however close their values lie."""

import os

import pytest
from conftest import SPEC, bounds
from pyspark.sql import functions as F

from checks.queries import REGISTRY
from sensorloom.operators.quantiles import ranged
from sensorloom.streaming.live import resample_median

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
@pytest.mark.parametrize("name, sorts", [("future_label", 2), ("feature_set", 2), ("lag_change", 2), ("rolling_statistics", 2), ("split_manifest", 2)])
def test_one_exchange_from_the_raw_panel(spark, name, sorts):
    plan = REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") <= sorts, plan


def test_one_hot_window_with_close_values_is_cut(spark):
    rows = spark.range(6001).select(F.lit("hot").alias("hive"), F.lit("2024-01-01 00:10:00").cast("timestamp").alias("ts"), (F.lit(20.0) + F.col("id") * 1e-6).alias("a"), F.col("id").cast("double").alias("b"), F.lit(1.0).alias("flat"))
    far = spark.createDataFrame([("far", i * 1e9) for i in range(50)], "hive string, a double").select("hive", F.lit("2024-01-01 00:10:00").cast("timestamp").alias("ts"), "a", F.col("a").alias("b"), F.lit(1.0).alias("flat"))
    both = rows.unionByName(far)
    with bounds(spark, 40):
        found = {r.hive: (r.a, r.b, r.flat) for r in resample_median(both, SPEC).collect()}
    assert found == {"hot": (20.0 + 3000 * 1e-6, 3000.0, 1.0), "far": (24.5e9, 24.5e9, 1.0)}
    pieces = ranged(rows.select("hive", F.col("a").alias("value"), F.lit(1).alias("_weight")), ["hive"]).groupBy("piece").count().collect()
    assert len(pieces) > 2 and max(r["count"] for r in pieces) < 4000
