"""As-of joins, ranking metrics, calibration, lead times and preparation against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SPEC, bounds
from pyspark.sql import functions as F

from sensorloom.operators import preparation, ranking, scores
from sensorloom.operators.asof import as_of_join
from sensorloom.operators.split import with_splits


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- global order --------------------------------------------------------------------------


def test_positions_and_totals_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 50 == 0 else int(rng.integers(4)) if i % 3 else 1, int(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "x int, v long").repartition(6)
    found = ranking.with_positions(df, [F.col("x").desc_nulls_last()], "place").collect()
    assert sorted(r.place for r in found) == list(range(1, 1001))
    by_place = [r.x for r in sorted(found, key=lambda r: r.place)]
    assert by_place == sorted((x for x, _ in rows), key=lambda x: (x is None, -(x or 0)))
    distinct = df.groupBy("x").agg(F.sum("v").alias("v"))
    totals = {r.x: r.v_so_far for r in ranking.with_running_totals(distinct, [F.col("x").asc_nulls_first()], ["v"]).collect()}
    assert totals == {x: sum(v for y, v in rows if y is None or x is not None and y <= x) for x in {x for x, _ in rows}}
    assert ranking.with_positions(df.limit(0), [F.col("x")], "place").count() == 0


def test_no_range_holds_a_common_value(spark):
    df = spark.range(4000).withColumn("x", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")))
    laid, place = ranking.laid_out(df, [F.col("x")])
    sizes = [r["count"] for r in laid.groupBy(ranking.range_of(place)).count().collect()]
    assert max(sizes) < 2000  # two thirds of the rows tie


# --- as-of join -----------------------------------------------------------------------------


def plain_as_of(left, right, tolerance, direction):
    found = []
    for key, at in left:
        some = [(t, n) for k, t, n in right if k is not None and t is not None and k == key and at is not None and (0 <= at - t <= tolerance if direction == "backward" else 0 <= t - at <= tolerance)]
        pick = None
        if some:
            nearest = max(t for t, _ in some) if direction == "backward" else min(t for t, _ in some)
            pick = max(n for t, n in some if t == nearest)
        found.append((key, at, pick))
    return Counter(found)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("limit", [10_000, 20])
def test_as_of_matches_plain_join(spark, direction, limit):
    rng = np.random.default_rng(3)
    key = lambda: None if rng.random() < 0.05 else int(rng.choice([1, 1, 1, 1, 2, 3, 4]))
    at = lambda: None if rng.random() < 0.05 else int(rng.integers(0, 400))
    left = [(key(), at()) for _ in range(500)] + [(1, 100)] * 40 + [(9, 5)]
    right = [(key(), at(), i) for i in range(150)] + [(1, 100, 900 + i) for i in range(30)]
    one = spark.createDataFrame(left, "k int, at int").repartition(3)
    two = spark.createDataFrame(right, "k int, at int, n int").repartition(3)
    with bounds(spark, limit):
        joined = as_of_join(one, two, on=["k"], left_time="at", right_time="at", columns=["n"], tolerance=F.lit(25), direction=direction)
        assert Counter(tuple(r) for r in joined.collect()) == plain_as_of(left, right, 25, direction)


def test_as_of_edges(spark):
    left = spark.createDataFrame([(1, 5, "_at"), (2, None, "x")], "k int, at int, _own string")
    right = spark.createDataFrame([(1, 4, 7)], "k int, at int, n int")
    empty = as_of_join(left, right.limit(0), on=["k"], left_time="at", right_time="at", columns=["n"])
    assert empty.columns == ["k", "at", "_own", "n"] and {r.n for r in empty.collect()} == {None} and empty.count() == 2
    assert as_of_join(left.limit(0), right, on=["k"], left_time="at", right_time="at", columns=["n"]).count() == 0
    unkeyed = as_of_join(left, right, on=[], left_time="at", right_time="at", columns=["n"]).collect()
    assert {(r.k, r.n) for r in unkeyed} == {(1, 7), (2, None)}
    with pytest.raises(ValueError, match="already has at"):
        as_of_join(left, right, on=["k"], left_time="at", right_time="at", columns=["at"])
    with pytest.raises(ValueError, match="direction"):
        as_of_join(left, right, on=["k"], left_time="at", right_time="at", columns=["n"], direction="nearest")


def test_hot_station_is_cut(spark):
    left = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    right = spark.range(0, 3000, 10).select(F.lit(1).alias("k"), F.col("id").alias("seen"), F.col("id").alias("n"))
    with bounds(spark, 100):
        joined = as_of_join(left, right, on=["k"], left_time="at", right_time="seen", columns=["n"])
        assert joined.filter(F.col("n") == F.floor(F.col("at") / 10) * 10).count() == 3000
        assert "_range" in plan_of(joined) and "CartesianProduct" not in plan_of(joined)


# --- ranking, calibration --------------------------------------------------------------------


def scored(spark, seed=5, size=400):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(size):
        s = float(round(rng.random(), 2))
        rows.append((None if rng.random() < 0.03 else float("nan") if rng.random() < 0.03 else s, None if rng.random() < 0.05 else int(rng.random() < s * 0.4)))
    return rows, spark.createDataFrame(rows, "score double, label int").repartition(4)


def usable(rows):
    return [(s, y) for s, y in rows if s is not None and not math.isnan(s) and y is not None]


def test_ranking_metrics_match_definitions(spark):
    rows, df = scored(spark)
    some = usable(rows)
    p, q = sum(y for _, y in some), sum(1 - y for _, y in some)
    area, last = 0.0, 0.0
    for t in sorted({s for s, _ in some}, reverse=True):
        caught, alarms = sum(y for s, y in some if s >= t), sum(s >= t for s, _ in some)
        area, last = area + (caught / p - last) * caught / alarms, caught / p
    pairs = sum((a > b) + 0.5 * (a == b) for a, x in some if x for b, y in some if not y)
    found = scores.ranking_metrics(df, "score", "label", (0.5, 9.0)).first()
    assert (found["rows"], found.positives) == (len(some), p)
    assert found.average_precision == pytest.approx(area) and found.roc_area == pytest.approx(pairs / p / q)
    caught, alarms = sum(y for s, y in some if s >= 0.5), sum(s >= 0.5 for s, _ in some)
    assert (found.recall_0, found.precision_0, found.false_positive_rate_0) == pytest.approx((caught / p, caught / alarms, (alarms - caught) / q))
    assert found.recall_1 == 0 and found.precision_1 is None
    nothing = scores.ranking_metrics(df.filter("label = 7"), "score", "label").first()
    assert nothing["rows"] == 0 and nothing.average_precision is None and nothing.roc_area is None
    alike = scores.ranking_metrics(df.filter("label is not null").withColumn("score", F.lit(1.0)), "score", "label").first()
    assert alike.roc_area == 0.5  # one step


def test_no_window_over_all_rows(spark):
    _, df = scored(spark)
    assert "SinglePartition" not in plan_of(scores.ranking_curve(df, "score", "label").drop("n"))


def plain_isotonic(some):
    blocks = []
    for s in sorted({s for s, _ in some}):
        blocks.append([s, s, sum(t == s for t, _ in some), sum(y for t, y in some if t == s)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            low, _, n, y = blocks[-2]
            blocks[-2:] = [[low, blocks[-1][1], n + blocks[-1][2], y + blocks[-1][3]]]
    return [tuple(b) for b in blocks]


@pytest.mark.parametrize("block", [0, 2, 7])
@pytest.mark.parametrize("shape", ["rising", "falling", "flat"])
def test_calibration_matches_plain_fit(spark, block, shape):
    rows, _ = scored(spark, 8)
    rows = [(s, y if shape == "rising" or y is None or s is None else 1 - y if shape == "falling" else 1) for s, y in rows]
    df = spark.createDataFrame(rows, "score double, label int").repartition(4)
    curve = scores.calibration_curve(df, "score", "label", block=block)
    found = sorted(tuple(r)[:4] for r in curve.collect())
    assert found == plain_isotonic(usable(rows))
    assert scores.calibration_curve(df.limit(0), "score", "label").count() == 0
    served = spark.createDataFrame([(-5.0,), (0.505,), (99.0,), (None,)], "score double")
    rates = {r.score: r.p for r in scores.calibrated(served, curve, "score", "p").collect()}
    assert rates[None] is None and rates[-5.0] == found[0][3] / found[0][2] and rates[99.0] == found[-1][3] / found[-1][2]
    block_ = [b for b in found if b[0] <= 0.505][-1]
    assert rates[0.505] == block_[3] / block_[2]


# --- lead time ----------------------------------------------------------------------------------


def plain_lead(rows, horizon, gap):
    by_entity = defaultdict(lambda: ([], []))
    for entity, t, alarm, event in rows:
        if entity is not None and t is not None:
            by_entity[entity][0].extend([t] * alarm)
            by_entity[entity][1].extend([t] * event)
    events, false = [], []
    for entity, (alarms, happened) in by_entity.items():
        alarms, happened = sorted(set(alarms)), sorted(set(happened))
        begun = [t for i, t in enumerate(alarms) if i == 0 or t - alarms[i - 1] > gap]
        of = {b: next((e for e in happened if b <= e <= b + horizon), None) for b in begun}
        false += [(entity, b) for b, e in of.items() if e is None]
        for e in happened:
            mine = [b for b, x in of.items() if x == e]
            events.append((entity, e, min(mine, default=None), len(mine)))
    return Counter(events), Counter(false)


@pytest.mark.parametrize("limit", [10_000, 25])
def test_lead_times_match_plain_version(spark, limit):
    rng = np.random.default_rng(6)
    rows = [(str(rng.choice(["hot", "hot", "hot", "b", "c"])), int(rng.integers(0, 3000)), bool(rng.random() < 0.15), bool(rng.random() < 0.04)) for _ in range(900)]
    rows += [(None, 5, True, True), ("b", None, True, True), ("only", 7, False, True), ("loud", 7, True, False)]
    start = pd.Timestamp("2024-01-01")
    made = [(e, None if t is None else (start + pd.Timedelta(hours=t)).to_pydatetime(), a, v) for e, t, a, v in rows]
    df = spark.createDataFrame(made, "hive string, ts timestamp_ntz, alarm boolean, event boolean").repartition(4)
    with bounds(spark, limit):
        events, false = scores.event_lead_time(df, SPEC, F.col("event"), F.col("alarm"), F.expr("INTERVAL 72 HOURS"), F.expr("INTERVAL 12 HOURS"))
        hours = lambda t: None if t is None else int((t - start) / pd.Timedelta(hours=1))
        got = Counter((r.hive, hours(r.event_at), hours(r.alarm_at), r.episodes) for r in events.collect())
        wanted, wrong = plain_lead(rows, 72, 12)
        assert got == wanted and Counter((r.hive, hours(r.alarm_at)) for r in false.collect()) == wrong
        assert all(r.lead == r.event_at - r.alarm_at for r in events.filter("alarm_at is not null").collect())


def test_lead_times_read_the_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [("hot" if i % 3 else "b", i // 2, i % 7 == 0, i % 11 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "hive string, ts int, alarm boolean, event boolean").withColumn("ts", F.timestamp_seconds("ts")).repartition(4)
    with bounds(spark, 20):
        events, false = scores.event_lead_time(df.mapInPandas(counted, df.schema), SPEC, F.col("event"), F.col("alarm"), F.expr("INTERVAL 5 SECONDS"), F.expr("INTERVAL 1 SECOND"))
        assert events.count() + false.count() > 30
    assert read.value == 300  # it was read anew for every count, cut and join


# --- preparation ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def parts(spark):
    from conftest import random_panel, to_spark

    frame = random_panel().drop_duplicates(["hive", "ts"])
    return with_splits(to_spark(spark, frame), SPEC, gap_rows=5).cache()


def test_scaling_ignores_other_rows(spark, parts, tmp_path):
    state = preparation.fit_scaling(parts, SPEC)
    train = parts.filter("split = 'train' and not is_boundary_gap").toPandas()
    fitted = {r["column"]: r for r in state.collect()}
    assert fitted["a"].mean == pytest.approx(train.a.mean()) and fitted["a"].std == pytest.approx(train.a.std()) and fitted["flat"].std == 0
    moved = parts.withColumn("a", F.when((F.col("split") == "train") & ~F.col("is_boundary_gap"), F.col("a")).otherwise(1e9))
    assert state.exceptAll(preparation.fit_scaling(moved.repartition(7), SPEC)).select("column", "count", "min", "max", "fingerprint").count() <= 3  # sums differ in the last bit only
    changed = {r["column"]: r for r in preparation.fit_scaling(moved, SPEC).collect()}
    assert all(changed[c].mean == pytest.approx(fitted[c].mean) and changed[c].fingerprint == fitted[c].fingerprint for c in fitted)
    preparation.save_state(state, str(tmp_path / "state"))
    again = preparation.load_state(spark, str(tmp_path / "state"))
    scaled = preparation.apply_scaling(parts, again, SPEC).toPandas()
    assert np.allclose(scaled.a_scaled, (scaled.a - train.a.mean()) / train.a.std(), equal_nan=True) and set(scaled.flat_scaled) == {0.0}
    assert preparation.apply_scaling(parts.drop("split", "is_boundary_gap"), again, SPEC).count() == parts.count()  # serving


def test_scaling_refuses_leaks_and_other_columns(parts):
    state = preparation.fit_scaling(parts, SPEC)
    leaked = parts.withColumn("split", F.when(F.col("split") == "test", "train").otherwise(F.col("split")))
    for df, message in ((leaked, "other training rows"), (parts.drop("b"), "Missing columns: b"), (parts.withColumn("a", F.col("a").cast("float")), "a is float, was double")):
        with pytest.raises(ValueError, match=message):
            preparation.apply_scaling(df, state, SPEC)
    with pytest.raises(ValueError, match="after the split"):
        preparation.fit_scaling(parts.drop("split"), SPEC)


def test_parity_of_features(spark, parts):
    contract = preparation.feature_contract(parts, ["a", "b", "flat"])
    same = {r.feature: (r.status, r["shift"]) for r in preparation.feature_parity(parts.select("flat", "b", "a"), contract).collect()}
    assert same == {"a": ("ok", 0.0), "b": ("ok", 0.0), "flat": ("ok", 0.0)}
    served = parts.select((F.col("a") + 2).alias("a"), F.col("flat").cast("float").alias("flat"), F.lit(1).alias("new"))
    found = {r.feature: r.status for r in preparation.feature_parity(served, contract).collect()}
    assert found == {"a": "shifted", "b": "missing", "flat": "type", "new": "extra"}
    gone = preparation.feature_parity(parts.select("a", F.lit(None).cast("double").alias("b"), "flat"), contract)
    assert {r.feature: r.status for r in gone.collect()}["b"] == "shifted"
    assert preparation.serve(parts, contract).columns == ["a", "b", "flat"]
    for df in (served, parts.drop("b")):
        with pytest.raises(ValueError):
            preparation.serve(df, contract)
    assert preparation.feature_parity(parts.limit(0), contract).count() == 3 + len(parts.columns) - 3


def test_oversampling_is_exact_and_repeatable(parts):
    def bag(df):
        return Counter(map(tuple, df.select("hive", "ts", "e", "split", "copy").collect()))

    found = bag(preparation.oversample(parts, SPEC, "e", 0.25))
    assert found == bag(preparation.oversample(parts.repartition(9), SPEC, "e", 0.25))
    own = parts.filter("split = 'train' and not is_boundary_gap")
    p, q = own.filter("e = 1").count(), own.filter("e = 0").count()
    copies = Counter()
    for (hive, ts, e, split, _), n in found.items():
        copies[hive, ts, e, split] += n
    gaps = {(r.hive, r.ts) for r in parts.filter("is_boundary_gap").collect()}
    repeated = [n for (hive, ts, e, split), n in copies.items() if e == 1 and split == "train" and (hive, ts) not in gaps]
    assert len(repeated) == p and sum(repeated) == round(q * 0.25 / 0.75) and max(repeated) - min(repeated) <= 1
    assert sum(copies.values()) - sum(repeated) == parts.count() - p
    assert bag(preparation.oversample(parts.withColumn("e", F.lit(0)), SPEC, "e", 0.5)).total() == parts.count()
    with pytest.raises(ValueError, match="after the split"):
        preparation.oversample(parts.drop("split"), SPEC, "e", 0.5)
