"""Description of a sensor panel: which columns play which role.

Every operator takes a DataFrame and a ``PanelSpec``; none of them hard-codes a
column name, so the same code serves any table keyed by (entity, timestamp).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class PanelSpec:
    """Roles of the columns of a panel table.

    ``arrival`` lists the columns that give the input order of rows sharing one
    (entity, timestamp); keep-last needs them because Spark rows have no order.
    ``entity_name``, ``sensor_names`` and ``label_names`` are the names used in reports.
    """

    entity: str
    timestamp: str
    sensors: tuple[str, ...]
    labels: tuple[str, ...] = ()
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    arrival: tuple[str, ...] = ("_arrival",)
    entity_name: str = "entity"
    sensor_names: Mapping[str, str] = field(default_factory=dict)
    label_names: Mapping[str, str] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.timestamp]

    @property
    def required(self) -> list[str]:
        return [self.timestamp, self.entity, *self.sensors, *self.labels]

    @property
    def entities_name(self) -> str:
        name = self.entity_name
        return f"{name[:-1]}ies" if name.endswith("y") else f"{name}s"

    def sensor_name(self, sensor: str) -> str:
        return self.sensor_names.get(sensor, sensor)

    def label_name(self, label: str) -> str:
        return self.label_names.get(label, label)

    def with_arrival(self, *columns: str) -> PanelSpec:
        return replace(self, arrival=tuple(columns))


# The published column contract of the hourly training table.
HOURLY_PANEL = PanelSpec(
    entity="hive_id",
    timestamp="timestamp",
    sensors=("temperature_c", "co2_ppm", "humidity_pct", "weight_kg"),
    labels=(
        "brood_health_healthy_1",
        "swarming_happened_1",
        "absconding_happened_1",
        "honey_harvested_1",
    ),
    bounds={
        "temperature_c": (-20.0, 60.0),
        "co2_ppm": (0.0, 100_000.0),
        "humidity_pct": (0.0, 100.0),
        "weight_kg": (0.0, 500.0),
    },
    entity_name="hive",
    sensor_names={
        "temperature_c": "temperature",
        "co2_ppm": "co2",
        "humidity_pct": "humidity",
        "weight_kg": "weight",
    },
    label_names={
        "brood_health_healthy_1": "Brood healthy",
        "swarming_happened_1": "Swarming",
        "absconding_happened_1": "Absconding",
        "honey_harvested_1": "Harvesting",
    },
)

# The published mapping from live device columns to panel columns.
LIVE_COLUMNS: dict[str, str] = {
    "device_id": "hive_id",
    "recorded_at": "timestamp",
    "internal_temp": "temperature_c",
    "internal_humidity": "humidity_pct",
    "internal_co2": "co2_ppm",
    "total_weight": "weight_kg",
    "external_temp": "external_temperature_c",
    "external_humidity": "external_humidity_pct",
}
LIVE_OPTIONAL_COLUMNS: dict[str, str] = {
    "reading_at": "ingestion_timestamp",
    "battery_voltage": "battery_voltage",
}


def spec_from_config(dataset: Mapping[str, object], base: PanelSpec = HOURLY_PANEL) -> PanelSpec:
    """Apply the column names of a ``dataset`` configuration section to ``base``.

    Bounds and display names are kept for the columns whose names stay the same.
    """

    def names(key: str, default: Sequence[str]) -> tuple[str, ...]:
        return tuple(str(name) for name in dataset.get(key, default))  # type: ignore[union-attr]

    return replace(
        base,
        entity=str(dataset.get("hive_column", base.entity)),
        timestamp=str(dataset.get("timestamp_column", base.timestamp)),
        sensors=names("sensor_columns", base.sensors),
        labels=names("target_columns", base.labels),
    )
