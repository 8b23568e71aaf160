"""Sensor-panel analytics on Spark."""

from .spec import HOURLY_PANEL, LIVE_COLUMNS, PanelSpec

__all__ = ["HOURLY_PANEL", "LIVE_COLUMNS", "PanelSpec"]
