"""Source of live device readings. Any frame with the same columns works as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column contract of the live device table.
LIVE_SCHEMA = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("recorded_at", T.StringType()),
        T.StructField("internal_temp", T.DoubleType()),
        T.StructField("internal_humidity", T.DoubleType()),
        T.StructField("internal_co2", T.DoubleType()),
        T.StructField("total_weight", T.DoubleType()),
        T.StructField("external_temp", T.DoubleType()),
        T.StructField("external_humidity", T.DoubleType()),
        T.StructField("reading_at", T.StringType()),
        T.StructField("battery_voltage", T.DoubleType()),
    ]
)


def read_live(
    spark: SparkSession,
    path: str,
    source_format: str = "parquet",
    schema: T.StructType = LIVE_SCHEMA,
    stream: bool = False,
    **options: str,
) -> DataFrame:
    """Readings from a folder of files, as a batch or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.format(source_format).schema(schema).options(**options).load(path)
