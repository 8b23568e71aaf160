"""Targets that look ahead within one entity. Horizons count rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..spec import PanelSpec
from .ordered import Skew, by_time, windowed


def future_point(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    horizon: int,
    output: str,
    skew: Skew | None = None,
) -> DataFrame:
    """Value of ``column`` ``horizon`` rows ahead (behind, if negative)."""

    def build(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.withColumn(output, F.lead(column, horizon).over(by_time(keys, spec)))

    return windowed(
        df, spec, build, before=max(0, -horizon), after=max(0, horizon), skew=skew
    )


def future_event(
    df: DataFrame,
    spec: PanelSpec,
    column: str,
    horizon: int,
    output: str,
    skew: Skew | None = None,
) -> DataFrame:
    """Maximum of ``column`` over the next ``horizon`` rows, as float.

    NULL unless all ``horizon`` rows exist and hold a value.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    value = known(df, column).cast("float")

    def build(frame: DataFrame, keys: list[str]) -> DataFrame:
        ahead = by_time(keys, spec).rowsBetween(1, horizon)
        return frame.withColumn(
            output, F.when(F.count(value).over(ahead) == horizon, F.max(value).over(ahead))
        )

    return windowed(df, spec, build, after=horizon, skew=skew)
