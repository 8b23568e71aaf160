from __future__ import annotations

import sys
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorloom.settings import MAX_DISTINCT, MAX_GROUP_ROWS, build_session  # noqa: E402
from sensorloom.spec import PanelSpec  # noqa: E402

SPEC = PanelSpec("hive", "ts", ("a", "b", "flat"), ("e", "f"), {"a": (-1.0, 1.0)})


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@contextmanager
def bounds(spark, rows: int, distinct: int = 5):
    """Low group bounds, so that the plans for over-long groups run on small data."""
    spark.conf.set(MAX_GROUP_ROWS, str(rows))
    spark.conf.set(MAX_DISTINCT, str(distinct))
    try:
        yield
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
        spark.conf.unset(MAX_DISTINCT)


def random_panel(seed: int = 3, hot_rows: int = 400) -> pd.DataFrame:
    """One entity with over a third of the rows, several short ones, one of a single row.

    Uneven time steps, 35% missing values in long and short runs, a constant sensor.
    """
    rng = np.random.default_rng(seed)
    parts = []
    for hive, size in (("hot", hot_rows), ("m1", 150), ("m2", 90), ("m3", 40), ("one", 1)):
        steps = rng.choice([1, 1, 1, 2, 7, 40], size=size)
        frame = pd.DataFrame({"hive": hive, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(steps), unit="h")})
        for name in ("a", "b"):
            frame[name] = np.where(rng.random(size) < 0.35, np.nan, rng.normal(size=size).round(3))
        if size > 60:
            frame.loc[20:55, "b"] = np.nan
        frame["flat"] = 2.5
        frame["e"] = (rng.random(size) < 0.05).astype("int8")
        frame["f"] = (rng.random(size) < 0.4).astype("int8")
        parts.append(frame)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame):
    """Spark frame with NULL for NaN, spread over several partitions."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(5)
    floats = [c for c in frame.columns if frame[c].dtype.kind == "f"]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats} | {"ts": F.col("ts").cast("timestamp_ntz")})


def collected(df, keys=("hive", "ts")) -> pd.DataFrame:
    frame = df.toPandas()
    return frame.sort_values(list(keys), na_position="last").reset_index(drop=True)
