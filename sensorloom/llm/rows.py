"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the driver's path.

    On a cluster where they do not, install the package or pass it with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{environment.get('PYTHONPATH', '')}".rstrip(":")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_text(spark: SparkSession, function: Callable[[list[str]], Iterable[tuple]], schema: T.StructType) -> Callable[..., Column]:
    """A struct column made from each text; a null text counts as empty.

    Only the text goes to Python, in Arrow batches of at most 64 MB (Spark's default).
    """
    importable(spark)
    names = schema.fieldNames()

    def apply(texts: pd.Series) -> pd.DataFrame:
        rows = list(function([t if t is not None else "" for t in texts]))
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return F.pandas_udf(apply, schema).asNondeterministic()


def fields(df: DataFrame, struct: str) -> list[Column]:
    return [F.col(f"`{struct}`.{name}").alias(name) for name in df.schema[struct].dataType.fieldNames()]
