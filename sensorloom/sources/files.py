"""File sources and sinks: panel tables and report tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import sort_panel
from ..operators.ranking import unused
from ..spec import PanelSpec

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}

# Cell texts that count as missing in a CSV table.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def table_format(path: str) -> str:
    """Format of a table by its suffix; unknown suffixes are rejected before any read."""
    suffix = PurePosixPath(str(path).rstrip("/")).suffix.lower()
    if suffix not in _FORMATS:
        raise ValueError(f"No reader for tables that end in {suffix!r}.")
    return _FORMATS[suffix]


def read_panel(spark: SparkSession, path: str, arrival: bool = True, multiline: bool = False) -> DataFrame:
    """Read a CSV or Parquet table.

    ``arrival`` adds ``_arrival``, the place of each row in its file, which keep-last
    orders by (Parquet files are numbered in the order of their paths). CSV cells stay text (no inference pass); the operators cast them. Quoted cells
    may hold commas and doubled quotes; with ``multiline`` also line breaks, but then each file
    is one task, so it is off unless asked for. A record with another number of cells than the
    header fails the job.
    """
    kind = table_format(path)
    if kind == "parquet":
        df = spark.read.parquet(str(path))
        return _placed(df) if arrival else df

    df = spark.read.options(header=True, escape='"', multiLine=multiline, mode="FAILFAST").csv(str(path))
    names = df.columns
    cells = [
        F.when(~F.col(f"`{name}`").isin(*MISSING_TEXT), F.col(f"`{name}`")).alias(name) for name in names
    ]
    if not arrival:
        return df.select(*cells)
    # Row ids grow within one file block; blocks are ordered by where they start.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select(*cells, place.alias("_arrival"))


def _placed(df: DataFrame) -> DataFrame:
    """The rows of Parquet files with ``_arrival``: the number of their file and their place inside. A path in
    each row would make most of what keep-last sorts, and a task reads millions of such rows."""
    path, row, number = (unused(df, name) for name in ("_path", "_index", "_file"))
    # Named by a scan, as its rows will name them; that reads no column.
    files = df.select(F.col("_metadata.file_path").alias(path)).distinct().collect()
    names = sorted((found[path] for found in files), key=str.encode)
    numbered = df.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], f"`{path}` string, `{number}` long")
    rows = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    place = F.struct(F.col(number).alias("file"), F.col(row).alias("row"))
    return rows.join(F.broadcast(numbered), path).select(*[f"`{name}`" for name in df.columns], place.alias("_arrival"))  # one row a file


def with_arrival(df: DataFrame) -> DataFrame:
    """Number the rows of a frame that was not read from files in its current order."""
    return df.withColumn("_arrival", F.monotonically_increasing_id())


def write_panel(df: DataFrame, path: str, spec: PanelSpec | None = None, mode: str = "overwrite") -> str:
    """Write Parquet, ordered by (entity, timestamp) if ``spec`` is given."""
    ordered = sort_panel(df, spec) if spec else df
    ordered.write.mode(mode).parquet(str(path))
    return str(path)


def write_csv_report(df: DataFrame, path: str, one_file: bool = True) -> str:
    """Write a report table as CSV; ``one_file`` is for tables of a fixed small size."""
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**plain).csv(str(path))
    return str(path)


def write_json_report(df: DataFrame, path: str, one_file: bool = True) -> str:
    frame = df.coalesce(1) if one_file else df
    frame.write.mode("overwrite").option("ignoreNullFields", False).json(str(path))
    return str(path)
