"""The common pipeline: validate, clean, write, report, split."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean
from ..operators.features import CHANGES, DEFAULT_STATISTICS, LAGS, WINDOWS, common_features
from ..operators.ordered import Skew, measure
from ..operators.split import chronological_split, drop_boundary_gap, join_manifest
from ..operators.targets import future_event, future_point
from ..operators.validate import binary_domain, validation_report
from ..sources.files import read_panel, write_json_report, write_panel
from ..spec import HOURLY_PANEL, LIVE_COLUMNS, LIVE_OPTIONAL_COLUMNS, PanelSpec, spec_from_config
from ..streaming.live import map_live, resample_median
from .report import eda_report


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of the pipeline; the defaults are the published configuration."""

    spec: PanelSpec = HOURLY_PANEL
    frequency: str = "1h"
    interpolate: bool = False
    interpolation_limit: int = 3
    deduplicate: bool = True
    train: float = 0.70
    validation: float = 0.15
    gap_rows: int = 72
    lags: tuple[int, ...] = LAGS
    changes: tuple[int, ...] = CHANGES
    windows: tuple[int, ...] = WINDOWS
    statistics: tuple[str, ...] = DEFAULT_STATISTICS
    live_columns: Mapping[str, str] = field(default_factory=lambda: dict(LIVE_COLUMNS))
    live_optional: Mapping[str, str] = field(default_factory=lambda: dict(LIVE_OPTIONAL_COLUMNS))

    @classmethod
    def from_mapping(cls, config: Mapping[str, Mapping]) -> PipelineConfig:
        """Read the sections dataset, cleaning, split and common_features."""
        dataset = config.get("dataset", {})
        cleaning = config.get("cleaning", {})
        split = config.get("split", {})
        features = config.get("common_features", {})
        train = float(split.get("train_fraction", 0.70))
        validation = float(split.get("validation_fraction", 0.15))
        test = split.get("test_fraction")
        if test is not None and abs(train + validation + float(test) - 1) > 1e-9:
            raise ValueError("The split fractions must sum to 1.")
        return cls(
            spec=spec_from_config(dataset),
            frequency=str(dataset.get("expected_frequency", "1h")),
            interpolate=bool(cleaning.get("interpolate_missing_sensors", False)),
            interpolation_limit=int(cleaning.get("interpolation_limit_rows", 3)),
            deduplicate=bool(cleaning.get("drop_duplicate_hive_timestamps", True)),
            train=train,
            validation=validation,
            gap_rows=int(split.get("boundary_gap_hours", 72)),
            lags=tuple(features.get("lags_hours", LAGS)),
            changes=tuple(features.get("change_hours", CHANGES)),
            windows=tuple(features.get("rolling_windows_hours", WINDOWS)),
            statistics=tuple(features.get("rolling_statistics", DEFAULT_STATISTICS)),
            live_columns=dict(config.get("columns", LIVE_COLUMNS)),
            live_optional=dict(config.get("optional_metadata", LIVE_OPTIONAL_COLUMNS)),
        )


def load_config(path: str) -> PipelineConfig:
    """Read a JSON or YAML configuration file (YAML needs PyYAML)."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return PipelineConfig.from_mapping(json.loads(text))
    import yaml

    return PipelineConfig.from_mapping(yaml.safe_load(text))


def run_pipeline(spark: SparkSession, source: str, out: str, config: PipelineConfig | None = None) -> dict[str, str]:
    """Run all stages and return the path of every output.

    The cleaned table is written once, in key order, and read back: later stages read
    only the columns they need and do not repeat the cleaning if an executor is lost.
    """
    config = config or PipelineConfig()
    spec = config.spec
    paths = {
        "raw_report": f"{out}/reports/raw_validation_report",
        "clean_report": f"{out}/reports/clean_validation_report",
        "raw_values": f"{out}/reports/raw_invalid_values",
        "clean_values": f"{out}/reports/clean_invalid_values",
        "clean": f"{out}/processed/common_clean.parquet",
        "eda": f"{out}/reports/common_eda",
        "manifest": f"{out}/manifests/common_split_manifest.parquet",
    }
    raw = read_panel(spark, source)
    write_json_report(validation_report(raw, spec), paths["raw_report"])
    write_json_report(binary_domain(raw, spec), paths["raw_values"], one_file=False)
    cleaned = clean(raw, spec, config.interpolate, config.interpolation_limit, config.deduplicate)
    write_panel(cleaned, paths["clean"], spec)

    table = spark.read.parquet(paths["clean"])
    write_json_report(validation_report(table, spec), paths["clean_report"])
    write_json_report(binary_domain(table, spec), paths["clean_values"], one_file=False)
    skew = measure(table, spec)
    eda_report(table, spec, paths["eda"], skew.rows)
    manifest = chronological_split(table, spec, config.train, config.validation, config.gap_rows, skew)
    write_panel(manifest, paths["manifest"], spec)
    return paths


def training_table(
    table: DataFrame,
    manifest: DataFrame,
    config: PipelineConfig,
    *,
    target: str,
    horizon: int,
    output: str,
    event: bool = True,
    skew: Skew | None = None,
) -> DataFrame:
    """Features and one target of a cleaned table, with splits, without boundary rows.

    All windows share one exchange on the entity.
    """
    spec = config.spec
    skew = skew or measure(table, spec)
    make = future_event if event else future_point
    with_features = common_features(
        table, spec, lags=config.lags, changes=config.changes, windows=config.windows,
        statistics=config.statistics, skew=skew,
    )
    with_target = make(with_features, spec, target, horizon, output, skew)
    return drop_boundary_gap(join_manifest(with_target, manifest, spec))


def live_features(raw: DataFrame, mapping: Mapping[str, str] | None, config: PipelineConfig) -> DataFrame:
    """Features of live readings: map, resample to the training frequency, build features.

    Without ``mapping`` the configured ``columns`` section is used.
    """
    spec = config.spec
    mapping = config.live_columns if mapping is None else mapping
    hourly = resample_median(map_live(raw, mapping, spec, config.live_optional), spec, config.frequency)
    return common_features(
        hourly, spec, lags=config.lags, changes=config.changes, windows=config.windows,
        statistics=config.statistics,
    )
