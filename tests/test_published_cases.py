"""The three small published cases, with their full expected results."""

import datetime

import pandas as pd

from sensorloom.operators.clean import clean, sort_panel
from sensorloom.operators.split import chronological_split
from sensorloom.operators.targets import future_event
from sensorloom.sources.files import with_arrival
from sensorloom.spec import HOURLY_PANEL as SPEC


# The inputs of the published cases.


def test_cleaning_trims_sorts_and_keeps_last(spark):
    rows = [
        ("2024-01-01 01:00", " hive1 ", 35, 800, 60, 40, 1, 0, 0, 0),
        ("2024-01-01 00:00", "hive1", 34, 700, 61, 40, 1, 0, 0, 0),
        ("2024-01-01 00:00", "hive1\t", 33, 700, 61, 40, 1, 0, 0, 0),
    ]
    frame = with_arrival(spark.createDataFrame(rows, SPEC.required).coalesce(1))
    found = sort_panel(clean(frame, SPEC), SPEC).collect()
    assert [(r.hive_id, r.timestamp, r.temperature_c) for r in found] == [
        ("hive1", datetime.datetime(2024, 1, 1, 0), 33.0),
        ("hive1", datetime.datetime(2024, 1, 1, 1), 35.0),
    ]
    assert not any(r.row_has_missing_sensor for r in found)


def test_split_is_chronological(spark):
    times = pd.date_range("2024-01-01", periods=100, freq="h")
    frame = spark.createDataFrame(pd.DataFrame({"hive_id": "h1", "timestamp": times}))
    found = chronological_split(frame, SPEC, gap_rows=2).orderBy("timestamp").collect()
    assert [r.split for r in found] == ["train"] * 70 + ["validation"] * 15 + ["test"] * 15
    assert [i for i, r in enumerate(found) if r.is_boundary_gap] == [68, 69, 70, 71, 83, 84, 85, 86]


def test_future_event(spark):
    times = pd.date_range("2024-01-01", periods=6, freq="h")
    frame = spark.createDataFrame(pd.DataFrame({"hive_id": "h1", "timestamp": times, "event": [0, 0, 0, 1, 0, 0]}))
    found = future_event(frame, SPEC, "event", 2, "soon").orderBy("timestamp").collect()
    assert [r.soon for r in found] == [0, 1, 1, 0, None, None]
