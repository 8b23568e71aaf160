"""The exploratory payload (one table per section) and the report written to files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.ordered import Skew, measure
from ..sources.files import write_csv_report, write_json_report
from ..spec import PanelSpec


class Exploration(Mapping[str, DataFrame]):
    """Sections of the exploratory payload, each planned when it is first asked for.

    Sections share the entity sizes, the sampling interval, the quartiles and one scan for
    all whole-table measures. The table
    should be a written or cached one, as every section reads its columns from it.
    """

    def __init__(self, df: DataFrame, spec: PanelSpec, bins: int = 36, sample: int = 2500):
        self._spec = spec
        self._df = df.select(*spec.required)
        self._bins = bins
        self._sample = sample
        self._planned: dict[str, DataFrame] = {}

    @cached_property
    def _skew(self) -> Skew:
        return measure(self._df, self._spec)

    @cached_property
    def _sampling(self) -> DataFrame:
        return P.sampling_interval(self._df, self._spec, self._skew)

    @cached_property
    def _totals(self) -> DataFrame:
        return P.table_totals(self._df, self._spec)

    @cached_property
    def _quartiles(self) -> DataFrame:
        return P.sensor_quartiles(self._df, self._spec, self._skew.rows)

    @cached_property
    def _sections(self) -> dict[str, Callable[[], DataFrame]]:
        df, spec = self._df, self._spec
        return {
            "summary": lambda: P.summary(df, spec, self._sampling),
            "sensor_statistics": lambda: P.sensor_statistics(df, spec, quartiles=self._quartiles, totals=self._totals),
            "outlier_analysis": lambda: P.outlier_analysis(df, spec, quartiles=self._quartiles),
            "hive_stats": lambda: P.entity_coverage(df, spec, self._sampling),
            "hourly_patterns": lambda: P.hourly_pattern(df, spec),
            "weekday_patterns": lambda: P.weekday_pattern(df, spec),
            "monthly_patterns": lambda: P.monthly_pattern(df, spec),
            "sensor_histograms": lambda: P.histogram(df, spec, self._bins, totals=self._totals),
            "target_balance": lambda: P.label_balance(df, spec, totals=self._totals),
            "target_by_hive": lambda: P.label_by_entity(df, spec),
            "monthly_target_counts": lambda: P.monthly_labels(df, spec),
            "target_cooccurrence": lambda: P.cooccurrence(df, spec, totals=self._totals),
            "target_sensor_effects": lambda: P.label_effects(df, spec, totals=self._totals),
            "relationship_sample": lambda: P.relationship_sample(df, spec, self._sample),
            "correlation": lambda: P.correlation(df, spec, totals=self._totals),
            "data_quality": lambda: P.data_quality(df, spec, totals=self._totals),
        }

    def __getitem__(self, section: str) -> DataFrame:
        if section not in self._planned:
            self._planned[section] = self._sections[section]()
        return self._planned[section]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sections)

    def __len__(self) -> int:
        return len(self._sections)


# Sections whose size grows with the number of entities or months.
_GROWING = {"hive_stats", "target_by_hive"}


def eda(df: DataFrame, spec: PanelSpec, bins: int = 36, sample: int = 2500) -> Exploration:
    return Exploration(df, spec, bins, sample)


def write_sections(sections: Mapping[str, DataFrame], path: str) -> None:
    """Write every section as JSON under ``path/<section>``."""
    for name, frame in sections.items():
        write_json_report(frame, f"{path}/{name}", one_file=name not in _GROWING)


def report_tables(df: DataFrame, spec: PanelSpec, rows: int | None = None) -> dict[str, DataFrame]:
    """The unrounded report tables, in the order they are written."""
    quartiles = P.sensor_quartiles(df, spec, rows)
    totals = P.table_totals(df, spec)
    plain = replace(spec, sensor_names={})
    described = P.sensor_statistics(df, plain, digits=None, quartiles=quartiles, totals=totals)
    return {
        "sensor_summary": described.select(
            "sensor",
            "count",
            "mean",
            "std",
            "min",
            F.col("q1").alias("25%"),
            F.col("median").alias("50%"),
            F.col("q3").alias("75%"),
            "max",
        ),
        "missing_values": P.missing_by_column(df, spec, totals),
        "hive_coverage": P.entity_rows(df, spec).orderBy(spec.entity),
        "sensor_correlation": P.correlation_matrix(df, plain, totals=totals),
        "hourly_patterns": P.hourly_pattern(df, plain, None).orderBy("hour"),
        "weekday_patterns": P.weekday_pattern(df, plain, None).drop("day_index").withColumnRenamed("day", "weekday").orderBy("weekday"),
        "monthly_patterns": P.monthly_pattern(df, plain, None).orderBy("month"),
        "monthly_target_counts": P.monthly_labels(df, spec, rates=False).orderBy("month"),
        "target_by_hive": P.label_by_entity(df, spec).withColumnRenamed(spec.entity_name, spec.entity).orderBy(spec.entity),
        "outlier_summary": P.outlier_analysis(df, plain, None, None, quartiles),
    }


def eda_report(df: DataFrame, spec: PanelSpec, path: str, rows: int | None = None) -> None:
    """Write the ten report tables as CSV and the label value counts as JSON."""
    growing = {"hive_coverage", "target_by_hive"}
    for name, frame in report_tables(df, spec, rows).items():
        write_csv_report(frame, f"{path}/{name}", one_file=name not in growing)
    write_json_report(P.label_value_counts(df, spec).orderBy("target", "value"), f"{path}/target_balance")
