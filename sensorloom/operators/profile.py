"""Exploratory statistics of a panel. Every function returns a DataFrame.

``digits=None`` gives unrounded values, as the file reports use them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_index, day_name, hour_of_day, month_key
from ..functions.scalar import (
    epoch_micros,
    finite,
    iso_text,
    known,
    lenient_timestamp,
    missing,
    rounded,
    short_number,
)
from ..settings import checkpoint, max_distinct
from ..spec import PanelSpec
from .ordered import Skew, by_time, measure, windowed
from .quantiles import column_quantiles
from .validate import duplicate_keys

QUARTILES = (0.25, 0.5, 0.75)
SECONDS_PER_DAY = 86_400
MICROS = 1_000_000


def _number(df: DataFrame, name: str) -> Column:
    return known(df, name).cast("double")


def _rows_of(columns: Sequence[str], row: Callable[[str], dict[str, Column]]) -> Column:
    """An array with one struct per name, to turn one wide row into long rows."""
    return F.array(*[F.struct(*[value.alias(key) for key, value in row(name).items()]) for name in columns])


def timed(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with a timestamp that parses; the others take no part in temporal groups."""
    frame = df.withColumn(spec.timestamp, lenient_timestamp(df, spec.timestamp))
    return frame.filter(F.col(spec.timestamp).isNotNull())


# --- summary and sampling ------------------------------------------------------------


def sampling_interval(df: DataFrame, spec: PanelSpec, skew: Skew | None = None) -> DataFrame:
    """One row (seconds): the median step between consecutive rows of an entity.

    NULL if there is no step or the median is not positive.
    """
    keys = timed(df.select(*spec.keys), spec).filter(F.col(spec.entity).isNotNull())
    at = epoch_micros(F.col(spec.timestamp))

    def build(frame: DataFrame, group: list[str]) -> DataFrame:
        return frame.withColumn("step", at - F.lag(at, 1).over(by_time(group, spec)))

    skew = skew or measure(keys, spec)
    steps = windowed(keys, spec, build, before=1, skew=skew).filter(F.col("step").isNotNull())
    counted = steps.groupBy("step").agg(F.count("*").alias("n"))
    if skew.rows > max_distinct(df.sparkSession):
        # Few distinct steps stand for many rows; count them once, read them several times.
        counted = checkpoint(counted)
    median = column_quantiles(counted, ["step"], [0.5], weight="n", rows=skew.rows)
    seconds = F.element_at("quantiles", 1) / MICROS
    return median.select(F.when(seconds > 0, seconds).alias("seconds"))


def sampling_label(seconds: Column) -> Column:
    hours, minutes = seconds / 3600, seconds / 60
    return (
        F.when(seconds.isNull(), F.lit("unknown"))
        .when(seconds % 3600 == 0, F.concat(short_number(hours), F.when(hours == 1, F.lit(" hour")).otherwise(F.lit(" hours"))))
        .when(seconds % 60 == 0, F.concat(short_number(minutes), F.lit(" minutes")))
        .otherwise(F.concat(short_number(seconds), F.lit(" seconds")))
    )


def summary(
    df: DataFrame, spec: PanelSpec, sampling: DataFrame | None = None, skew: Skew | None = None
) -> DataFrame:
    sampling = sampling if sampling is not None else sampling_interval(df, spec, skew)
    ts = lenient_timestamp(df, spec.timestamp)
    totals = df.agg(
        F.count("*").alias("total_records"),
        F.count_distinct(F.col(spec.entity)).alias("_entities"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
    )
    seconds = (epoch_micros(F.col("last")) - epoch_micros(F.col("first"))) / MICROS
    return totals.select(
        "total_records",
        F.col("_entities").alias(f"total_{spec.entities_name}"),
        iso_text(F.col("first")).alias("analysis_start"),
        iso_text(F.col("last")).alias("analysis_end"),
        F.round(seconds / SECONDS_PER_DAY, 2).alias("duration_days"),
        # The label is made from the one sampling row, so its plan appears once.
        sampling.select(sampling_label(F.col("seconds"))).scalar().alias("sampling_frequency"),
    )


# --- sensors -------------------------------------------------------------------------


def sensor_quartiles(df: DataFrame, spec: PanelSpec, rows: int | None = None) -> DataFrame:
    """Rows (column, count, quantiles): the three quartiles of every sensor."""
    return column_quantiles(df, spec.sensors, QUARTILES, rows=rows)


def _sensor_measures(df: DataFrame, spec: PanelSpec) -> list[Column]:
    return [
        F.struct(
            F.count(_number(df, s)).alias("count"),
            F.avg(_number(df, s)).alias("mean"),
            F.stddev_samp(_number(df, s)).alias("std"),
            F.min(_number(df, s)).alias("min"),
            F.max(_number(df, s)).alias("max"),
        ).alias(f"sensor_{s}")
        for s in spec.sensors
    ]


def sensor_statistics(
    df: DataFrame,
    spec: PanelSpec,
    digits: int | None = 3,
    quartiles: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    quartiles = quartiles if quartiles is not None else sensor_quartiles(df, spec)
    moments = totals if totals is not None else df.agg(*_sensor_measures(df, spec))
    rows = _rows_of(
        spec.sensors,
        lambda s: {"column": F.lit(s), "name": F.lit(spec.sensor_name(s)), "m": F.col(f"sensor_{s}")},
    )
    long = moments.select(F.inline(rows)).join(quartiles.select("column", "quantiles"), "column")

    def quantile(position: int) -> Column:
        return rounded(F.element_at("quantiles", position), digits)

    return long.select(
        F.col("name").alias("sensor"),
        F.col("m.count").alias("count"),
        rounded(F.col("m.mean"), digits).alias("mean"),
        rounded(F.col("m.std"), digits).alias("std"),
        rounded(F.col("m.min"), digits).alias("min"),
        quantile(1).alias("q1"),
        quantile(2).alias("median"),
        quantile(3).alias("q3"),
        rounded(F.col("m.max"), digits).alias("max"),
    )


def outlier_analysis(
    df: DataFrame,
    spec: PanelSpec,
    digits: int | None = 3,
    percent_digits: int | None = 4,
    quartiles: DataFrame | None = None,
) -> DataFrame:
    """Values outside 1.5 interquartile ranges; a sensor without values has no bounds."""
    quartiles = quartiles if quartiles is not None else sensor_quartiles(df, spec)
    low, high = F.element_at("quantiles", 1), F.element_at("quantiles", 3)
    fences = (
        quartiles.select("column", (low - 1.5 * (high - low)).alias("low"), (high + 1.5 * (high - low)).alias("high"))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("fences"))
        .scalar()  # one entry per sensor
    )

    def fence(sensor: str, side: str) -> Column:
        return F.element_at(F.col("_fences"), F.lit(sensor))[side]

    counted = df.withColumn("_fences", fences).agg(
        F.first("_fences").alias("_fences"),
        *[
            F.struct(
                F.count(_number(df, s)).alias("n"),
                F.count_if((_number(df, s) < fence(s, "low")) | (_number(df, s) > fence(s, "high"))).alias("outside"),
            ).alias(s)
            for s in spec.sensors
        ],
    )
    rows = _rows_of(
        spec.sensors,
        lambda s: {
            "sensor": F.lit(spec.sensor_name(s)),
            "count": F.col(f"{s}.outside"),
            "percentage": F.coalesce(
                rounded(F.try_divide(F.col(f"{s}.outside"), F.col(f"{s}.n")) * 100, percent_digits), F.lit(0.0)
            ),
            "lower_bound": rounded(fence(s, "low"), digits),
            "upper_bound": rounded(fence(s, "high"), digits),
        },
    )
    return counted.select(F.inline(rows))


def histogram(
    df: DataFrame, spec: PanelSpec, bins: int = 36, digits: int | None = 3, totals: DataFrame | None = None
) -> DataFrame:
    """Equal-width histogram per sensor; empty bins stay, the last bin is closed.

    A value that rounding places beside its bin edge is moved to the bin whose edges
    really enclose it. A constant sensor gets a range of one around its value.
    """
    if totals is None:
        ends_of = [F.struct(F.min(_number(df, s)).alias("min"), F.max(_number(df, s)).alias("max")) for s in spec.sensors]
        totals = df.agg(*[end.alias(f"sensor_{s}") for s, end in zip(spec.sensors, ends_of, strict=True)])
    span = totals.select(F.struct(*[_widened(s) for s in spec.sensors]).alias("spans")).scalar()

    def edge(low: Column, high: Column, number: Column) -> Column:
        return F.when(number == bins, high).otherwise(low + number * ((high - low) / bins))

    def ends(sensor: str) -> tuple[Column, Column]:
        return F.col(f"_spans.{sensor}.low"), F.col(f"_spans.{sensor}.high")

    def guess(sensor: str) -> Column:
        low, high = ends(sensor)
        share = (_number(df, sensor) - low) / (high - low)
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")

    def settled(sensor: str) -> Column:
        (low, high), value, number = ends(sensor), _number(df, sensor), F.col(f"_guess_{sensor}")
        beyond = (value >= edge(low, high, number + 1)) & (number != bins - 1)
        return number - (value < edge(low, high, number)).cast("int") + beyond.cast("int")

    # One integer per value says both sensor and bin: few, small groups before the exchange.
    codes = F.array(*[F.lit(i * bins) + settled(s) for i, s in enumerate(spec.sensors)])
    counts = (
        df.withColumn("_spans", span)
        .withColumns({f"_guess_{s}": guess(s) for s in spec.sensors})
        .select(F.explode(codes).alias("code"))
        .filter(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.count("*").alias("n"))
    )
    # At most one row per sensor and bin is left, so all counts fit one map.
    held = counts.agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("counts")).withColumn("_spans", span)
    names = [F.struct(F.lit(i).alias("i"), F.lit(spec.sensor_name(s)).alias("sensor"), ends(s)[0].alias("low"), ends(s)[1].alias("high")) for i, s in enumerate(spec.sensors)]
    edges = (
        held.select("counts", F.explode(F.array(*names)).alias("s"))
        .select("counts", "s.*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .filter(F.col("low").isNotNull())
    )
    start = edge(F.col("low"), F.col("high"), F.col("bin"))
    stop = edge(F.col("low"), F.col("high"), F.col("bin") + 1)
    return edges.select(
        "sensor",
        "bin",
        rounded(start, digits).alias("bin_start"),
        rounded(stop, digits).alias("bin_end"),
        rounded((start + stop) / 2, digits).alias("bin_center"),
        F.coalesce(F.try_element_at("counts", F.col("i") * bins + F.col("bin")), F.lit(0)).alias("count"),
    )


def _widened(sensor: str) -> Column:
    low, high = F.col(f"sensor_{sensor}.min"), F.col(f"sensor_{sensor}.max")
    same = low == high
    return F.struct(
        F.when(same, low - 0.5).otherwise(low).alias("low"), F.when(same, high + 0.5).otherwise(high).alias("high")
    ).alias(sensor)


def _pairs(names: Sequence[str], prefix: str) -> dict[tuple[str, str], str]:
    """A column name for every unordered pair, found under both of its orders."""
    result = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            result[(a, b)] = f"{prefix}_{min(i, j)}_{max(i, j)}"
    return result


def _correlation_measures(df: DataFrame, spec: PanelSpec) -> list[Column]:
    def pearson(a: str, b: str) -> Column:
        x, y = _number(df, a), _number(df, b)
        both = x.isNotNull() & y.isNotNull()
        scale = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
        value = F.nanvl(F.try_divide(F.covar_samp(x, y), scale), F.lit(None))
        return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))

    once = {name: pair for pair, name in _pairs(spec.sensors, "pearson").items()}
    return [pearson(*pair).alias(name) for name, pair in once.items()]


def correlation(
    df: DataFrame, spec: PanelSpec, digits: int | None = 4, totals: DataFrame | None = None
) -> DataFrame:
    """Rows (row, column, correlation): Pearson over the rows where both are known.

    A constant sensor gives NULL. Symmetric pairs are computed once.
    """
    found = totals if totals is not None else df.agg(*_correlation_measures(df, spec))
    cells = [
        F.struct(
            F.lit(spec.sensor_name(a)).alias("row"),
            F.lit(spec.sensor_name(b)).alias("column"),
            rounded(F.col(name), digits).alias("correlation"),
        )
        for (a, b), name in _pairs(spec.sensors, "pearson").items()
    ]
    return found.select(F.inline(F.array(*cells)))


def correlation_matrix(
    df: DataFrame, spec: PanelSpec, digits: int | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """The correlations as one row per sensor and one column per sensor."""
    names = [spec.sensor_name(s) for s in spec.sensors]
    return correlation(df, spec, digits, totals).groupBy(F.col("row").alias("sensor")).pivot("column", names).agg(F.first("correlation"))


# --- entities ------------------------------------------------------------------------


def entity_coverage(
    df: DataFrame, spec: PanelSpec, sampling: DataFrame | None = None, skew: Skew | None = None
) -> DataFrame:
    """Rows, range and share of expected rows per entity; a missing entity is a group too."""
    sampling = sampling if sampling is not None else sampling_interval(df, spec, skew)
    ts = lenient_timestamp(df, spec.timestamp)
    grouped = df.groupBy(F.col(spec.entity).alias(spec.entity_name)).agg(
        F.count("*").alias("records"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    step = sampling.select("seconds").scalar()
    seconds = (epoch_micros(F.col("last")) - epoch_micros(F.col("first"))) / MICROS
    measured = grouped.withColumn("seconds", seconds).withColumn(
        "expected_records", (F.bround(F.col("seconds") / step, 0) + 1).cast("long")
    )
    share = F.least(F.lit(100.0), F.col("records") / F.col("expected_records") * 100)
    return measured.select(
        spec.entity_name,
        "records",
        iso_text(F.col("first")).alias("start"),
        iso_text(F.col("last")).alias("end"),
        F.round(F.col("seconds") / SECONDS_PER_DAY, 2).alias("duration_days"),
        "expected_records",
        F.round(share, 3).alias("coverage_percentage"),
    )


def entity_rows(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows and time range per entity; rows without an entity are left out."""
    ts = lenient_timestamp(df, spec.timestamp)
    return (
        df.filter(F.col(spec.entity).isNotNull())
        .groupBy(spec.entity)
        .agg(F.count("*").alias("rows"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    )


# --- temporal patterns ---------------------------------------------------------------


def _pattern(df: DataFrame, spec: PanelSpec, keys: dict[str, Column], digits: int | None) -> DataFrame:
    frame = timed(df, spec)
    means = frame.groupBy(*[key.alias(name) for name, key in keys.items()]).agg(
        *[F.avg(_number(df, s)).alias(s) for s in spec.sensors]
    )
    return means.select(*keys, *[rounded(F.col(s), digits).alias(spec.sensor_name(s)) for s in spec.sensors])


def hourly_pattern(df: DataFrame, spec: PanelSpec, digits: int | None = 3) -> DataFrame:
    return _pattern(df, spec, {"hour": hour_of_day(F.col(spec.timestamp))}, digits)


def weekday_pattern(df: DataFrame, spec: PanelSpec, digits: int | None = 3) -> DataFrame:
    """By day index (Monday = 0) with the day name; the file report sorts by name."""
    ts = F.col(spec.timestamp)
    return _pattern(df, spec, {"day_index": day_index(ts), "day": day_name(ts)}, digits)


def monthly_pattern(df: DataFrame, spec: PanelSpec, digits: int | None = 3) -> DataFrame:
    return _pattern(df, spec, {"month": month_key(F.col(spec.timestamp))}, digits)


# --- labels --------------------------------------------------------------------------


def _label_measures(df: DataFrame, spec: PanelSpec) -> list[Column]:
    flags = [
        F.struct(F.count_if(F.col(c) == 1).alias("pos"), F.count_if(F.col(c) == 0).alias("neg")).alias(f"label_{c}")
        for c in spec.labels
    ]
    return [F.count("*").alias("all_rows"), *flags]


def label_balance(df: DataFrame, spec: PanelSpec, totals: DataFrame | None = None) -> DataFrame:
    counted = totals if totals is not None else df.agg(*_label_measures(df, spec))

    def row(label: str) -> dict[str, Column]:
        rate = F.coalesce(F.try_divide(F.col(f"label_{label}.pos"), F.col("all_rows")), F.lit(0.0))
        return {
            "target": F.lit(label),
            "display_name": F.lit(spec.label_name(label)),
            "positive": F.col(f"label_{label}.pos"),
            "negative": F.col(f"label_{label}.neg"),
            "positive_percentage": F.round(rate * 100, 8),
            "positive_per_10000": F.round(rate * 10_000, 4),
        }

    return counted.select(F.inline(_rows_of(spec.labels, row)))


def label_value_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows (target, value, count); a missing value is a value too."""
    pairs = _rows_of(spec.labels, lambda c: {"target": F.lit(c), "value": _number(df, c)})
    return df.select(F.inline(pairs)).groupBy("target", "value").agg(F.count("*").alias("count"))


def label_by_entity(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return (
        df.filter(F.col(spec.entity).isNotNull())
        .groupBy(F.col(spec.entity).alias(spec.entity_name))
        .agg(*[F.coalesce(F.sum(_number(df, c)), F.lit(0)).cast("long").alias(c) for c in spec.labels])
    )


def monthly_labels(df: DataFrame, spec: PanelSpec, rates: bool = True) -> DataFrame:
    grouped = (
        timed(df, spec)
        .groupBy(month_key(F.col(spec.timestamp)).alias("month"))
        .agg(
            F.count("*").alias("records"),
            *[F.coalesce(F.sum(_number(df, c)), F.lit(0)).cast("long").alias(c) for c in spec.labels],
        )
    )
    if not rates:
        return grouped.drop("records")
    return grouped.select(
        "*",
        *[F.round(F.col(c) / F.col("records") * 10_000, 5).alias(f"{c}_per_10000") for c in spec.labels],
    )


def _cooccurrence_measures(df: DataFrame, spec: PanelSpec) -> list[Column]:
    def positive(label: str) -> Column:
        return F.coalesce(_number(df, label).cast("int"), F.lit(0)) == 1

    once = {name: pair for pair, name in _pairs(spec.labels, "together").items()}
    return [F.count_if(positive(a) & positive(b)).alias(name) for name, (a, b) in once.items()]


def cooccurrence(df: DataFrame, spec: PanelSpec, totals: DataFrame | None = None) -> DataFrame:
    """Rows (row, column, count) of rows where both labels are 1; the diagonal is the positives."""
    found = totals if totals is not None else df.agg(*_cooccurrence_measures(df, spec))
    cells = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(name).alias("count"))
        for (a, b), name in _pairs(spec.labels, "together").items()
    ]
    return found.select(F.inline(F.array(*cells)))


def _effect_measures(df: DataFrame, spec: PanelSpec) -> list[Column]:
    return [
        F.struct(
            F.avg(F.when(F.col(label) == 1, _number(df, sensor))).alias("pos"),
            F.avg(F.when(F.col(label) == 0, _number(df, sensor))).alias("neg"),
        ).alias(f"effect_{i}_{j}")
        for i, label in enumerate(spec.labels)
        for j, sensor in enumerate(spec.sensors)
    ]


def label_effects(df: DataFrame, spec: PanelSpec, totals: DataFrame | None = None) -> DataFrame:
    """Per label and sensor: mean of positive and negative rows and their scaled difference."""
    if totals is None:
        totals = df.agg(*_label_measures(df, spec), *_sensor_measures(df, spec), *_effect_measures(df, spec))
    cells = []
    for i, label in enumerate(spec.labels):
        for j, sensor in enumerate(spec.sensors):
            positive, negative = F.col(f"effect_{i}_{j}.pos"), F.col(f"effect_{i}_{j}.neg")
            scaled = F.try_divide(positive - negative, F.col(f"sensor_{sensor}.std"))
            cells.append(
                F.struct(
                    F.lit(label).alias("target"),
                    F.lit(spec.label_name(label)).alias("display_name"),
                    F.col(f"label_{label}.pos").alias("positive_count"),
                    F.col(f"label_{label}.neg").alias("negative_count"),
                    F.lit(spec.sensor_name(sensor)).alias("sensor"),
                    rounded(positive, 3).alias("positive_mean"),
                    rounded(negative, 3).alias("negative_mean"),
                    rounded(scaled, 4).alias("standardized_difference"),
                )
            )
    return totals.select(F.inline(F.array(*cells)))


def positive_rate_floor(balance: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Positive percentage kept above ``floor`` so that it can go on a logarithmic axis."""
    return balance.select(
        "target", F.greatest(F.coalesce("positive_percentage", F.lit(0.0)), F.lit(floor)).alias("rate")
    )


# --- sample and quality --------------------------------------------------------------


def relationship_sample(
    df: DataFrame, spec: PanelSpec, limit: int = 2500, seed: int = 42, digits: int | None = 3
) -> DataFrame:
    """At most ``limit`` complete rows, chosen by a hash of the key, in time order.

    The choice repeats exactly from run to run and needs no full sort (top-k per task).
    """
    frame = timed(df.select(*spec.keys, *spec.sensors), spec)
    for name in [spec.entity, *spec.sensors]:
        frame = frame.filter(~missing(df, name))
    at = epoch_micros(F.col(spec.timestamp))
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(spec.entity).cast("string"), at.cast("string")))
    chosen = frame.orderBy(lot, *[F.col(s) for s in spec.sensors]).limit(limit)
    return chosen.orderBy(spec.timestamp, spec.entity).select(
        iso_text(F.col(spec.timestamp)).alias("timestamp"),
        F.col(spec.entity).cast("string").alias(spec.entity_name),
        *[rounded(F.col(s), digits).alias(spec.sensor_name(s)) for s in spec.sensors],
    )


def _missing_measures(df: DataFrame, spec: PanelSpec) -> list[Column]:
    invalid = F.count_if(lenient_timestamp(df, spec.timestamp).isNull()).alias("invalid_times")
    return [invalid, *[F.count_if(missing(df, c)).alias(f"missing_{c}") for c in (*spec.sensors, *spec.labels)]]


def missing_by_column(df: DataFrame, spec: PanelSpec, totals: DataFrame | None = None) -> DataFrame:
    """Rows (column, missing) for sensors and labels."""
    counts = totals if totals is not None else df.agg(*_missing_measures(df, spec))
    rows = _rows_of([*spec.sensors, *spec.labels], lambda c: {"column": F.lit(c), "missing": F.col(f"missing_{c}")})
    return counts.select(F.inline(rows))


def data_quality(df: DataFrame, spec: PanelSpec, totals: DataFrame | None = None) -> DataFrame:
    """One row: missing values in all and by column, repeated keys (every copy), bad timestamps."""
    counts = totals if totals is not None else df.agg(*_missing_measures(df, spec))
    total = F.lit(0).cast("long")
    entries = []
    for column in (*spec.sensors, *spec.labels):
        total = total + F.col(f"missing_{column}")
        entries += [F.lit(spec.sensor_name(column)), F.col(f"missing_{column}")]
    return counts.select(
        total.alias("missing_values"),
        F.create_map(*entries).alias("missing_by_column"),
        duplicate_keys(df, spec).select("members").scalar().alias("duplicate_timestamps"),
        F.col("invalid_times").alias("invalid_timestamps"),
    )


def table_totals(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row with every measure that the sections of a report need, from a single scan.

    Pass it as ``totals`` to the functions above; it is a written row, not a plan to repeat.
    """
    return checkpoint(
        df.agg(
            *_sensor_measures(df, spec),
            *_correlation_measures(df, spec),
            *_label_measures(df, spec),
            *_cooccurrence_measures(df, spec),
            *_effect_measures(df, spec),
            *_missing_measures(df, spec),
        )
    )


# --- views of the results ------------------------------------------------------------


def ranked_entities(by_entity: DataFrame, label: str, entity: str = "hive") -> DataFrame:
    """Entities by falling count of one label, then by name."""
    count = F.coalesce(F.col(label).cast("long"), F.lit(0))
    return by_entity.select(entity, count.alias("count")).orderBy(F.desc("count"), F.col(entity).cast("string"))


def sensor_pairs(sample: DataFrame, x: str, y: str, entity: str = "hive") -> DataFrame:
    """Two sensors of a sample as x and y, finite values only."""
    return sample.filter(finite(F.col(x)) & finite(F.col(y))).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), entity, "timestamp"
    )


def cooccurrence_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts as one row per label and one column per label; absent pairs are 0."""
    wide = pairs.groupBy("row").pivot("column", list(labels)).agg(F.first("count"))
    return wide.select("row", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in labels])


def cooccurrence_strength(pairs: DataFrame) -> DataFrame:
    """Counts with their share of the largest count (0 if there is none)."""
    largest = pairs.agg(F.max("count").alias("m")).scalar()
    share = F.coalesce(F.least(F.try_divide(F.col("count"), largest), F.lit(1.0)), F.lit(0.0))
    return pairs.select("row", "column", "count", share.alias("strength"))


def evidence_flag(effects: DataFrame, enough: int = 30) -> DataFrame:
    """Effects with a mark on labels that have too few positives to rely on."""
    return effects.withColumn("thin_evidence", F.coalesce("positive_count", F.lit(0)) < enough)


def label_timeline(monthly: DataFrame, label: str, metric: str = "count") -> DataFrame:
    """Monthly count or rate per 10,000 rows of one label."""
    if metric not in ("count", "rate"):
        raise ValueError("metric must be 'count' or 'rate'")
    column = label if metric == "count" else f"{label}_per_10000"
    return monthly.select("month", F.col(column).cast("double").alias("value")).orderBy("month")


def coverage_metric(coverage: DataFrame, metric: str = "records", entity: str = "hive") -> DataFrame:
    """One metric of the entity coverage: records, coverage or duration."""
    columns = {"records": "records", "coverage": "coverage_percentage", "duration": "duration_days"}
    if metric not in columns:
        raise ValueError(f"metric must be one of {sorted(columns)}")
    return coverage.select(entity, F.coalesce(F.col(columns[metric]).cast("double"), F.lit(0.0)).alias("value"))
