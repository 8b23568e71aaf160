"""Calendar features and past-only time-series features (row offsets within an entity)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import DAYS_PER_YEAR, HOURS_PER_DAY, cycle, day_index, hour_of_day
from ..functions.scalar import known
from ..spec import PanelSpec
from .ordered import Skew, by_time, windowed
from .rolling import STATISTICS, rolling

# The default feature set.
LAGS = (1, 6, 24, 72)
CHANGES = (1, 6, 24, 72)
WINDOWS = (6, 24, 72)
DEFAULT_STATISTICS = ("mean", "std")


def time_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    ts = F.col(spec.timestamp)
    hour, day = hour_of_day(ts), F.dayofyear(ts)
    hour_sin, hour_cos = cycle(hour, HOURS_PER_DAY)
    year_sin, year_cos = cycle(day, DAYS_PER_YEAR)
    return df.withColumns(
        {
            "hour": hour.cast("byte"),
            "day_of_week": day_index(ts).cast("byte"),
            "month": F.month(ts).cast("byte"),
            "day_of_year": day.cast("short"),
            "is_weekend": (day_index(ts) >= 5).cast("byte"),
            "hour_sin": hour_sin.cast("float"),
            "hour_cos": hour_cos.cast("float"),
            "day_of_year_sin": year_sin.cast("float"),
            "day_of_year_cos": year_cos.cast("float"),
        }
    )


def series_features(
    df: DataFrame,
    spec: PanelSpec,
    sensors: Iterable[str] | None = None,
    lags: Iterable[int] = LAGS,
    changes: Iterable[int] = CHANGES,
    windows: Iterable[int] = WINDOWS,
    statistics: Iterable[str] = DEFAULT_STATISTICS,
    output_type: str = "float",
    skew: Skew | None = None,
) -> DataFrame:
    """Lags, changes and rolling statistics of the sensors.

    Rolling windows include the current row and give NULL unless every row of the
    window exists and holds a value. One exchange and one sort serve all of them.
    """
    sensors = list(sensors if sensors is not None else spec.sensors)
    lags, changes, windows = list(lags), list(changes), list(windows)
    chosen = [name for name in STATISTICS if name in set(statistics)]
    reach = max([0, *lags, *changes, *[w - 1 for w in windows]])
    ahead = max([0, *[-k for k in lags], *[-k for k in changes]])

    def build(frame: DataFrame, keys: list[str]) -> DataFrame:
        series = by_time(keys, spec)
        shifts = {
            f"_lag_{s}_{k}": F.lag(known(df, s), k).over(series)
            for s in sensors
            for k in dict.fromkeys([*lags, *changes])
        }
        output = []
        for sensor in sensors:
            output += [
                F.col(f"_lag_{sensor}_{k}").cast(output_type).alias(f"{sensor}_lag_{k}h") for k in lags
            ]
            output += [
                (known(df, sensor) - F.col(f"_lag_{sensor}_{k}")).cast(output_type).alias(f"{sensor}_change_{k}h")
                for k in changes
            ]
            output += [
                F.col(f"_{name}_{sensor}_{w}").cast(output_type).alias(f"{sensor}_roll_{name}_{w}h")
                for w in windows
                for name in chosen
            ]
        rolled = rolling(frame.withColumns(shifts), sensors, windows if chosen else [], chosen, series)
        return rolled.select(*frame.columns, *output)

    return windowed(df, spec, build, before=reach, after=ahead, skew=skew)


def common_features(
    df: DataFrame,
    spec: PanelSpec,
    sensors: Iterable[str] | None = None,
    lags: Iterable[int] = LAGS,
    changes: Iterable[int] = CHANGES,
    windows: Iterable[int] = WINDOWS,
    statistics: Iterable[str] = DEFAULT_STATISTICS,
    output_type: str = "float",
    skew: Skew | None = None,
) -> DataFrame:
    """Calendar features followed by the series features of every sensor."""
    return series_features(
        time_features(df, spec), spec, sensors, lags, changes, windows, statistics, output_type, skew
    )
