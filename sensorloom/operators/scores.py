"""How well scores rank and forecast rare labels: ranking metrics, calibration, and lead time of alarms.

Scores are counted per distinct value before anything is ordered, so ties stay together, and totals over
the score order are exact (``ranking``); no window runs over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..settings import checkpoint
from ..spec import PanelSpec
from .asof import FORWARD, as_of_join
from .ordered import Skew, by_time, windowed
from .ranking import unused, with_positions, with_running_totals

# Blocks of scores that one task fits at once.
BLOCKS = 100_000
_BLOCK = "low double, high double, n long, positives long, total double"


def _counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: n, positives, negatives. Rows without score or label do not count."""
    some = df.select(known(df, score).cast("double").alias("score"), F.col(label).cast("int").alias("label")).filter("score is not null and label is not null")
    positive = F.count(F.when(F.col("label") == 1, 1))
    return some.groupBy("score").agg(F.count(F.lit(1)).alias("n"), positive.alias("positives"), (F.count(F.lit(1)) - positive).alias("negatives"))


def ranking_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score as a threshold (alarm where the score is at least that): threshold,
    true_positives, false_positives, recall, precision, false_positive_rate, and n and positives of that score.

    Null where a rate has nothing to divide by. Rows without score (NaN included) or label are left out.
    """
    counts = _counts(df, score, label)
    totals = counts.agg(F.sum("positives").alias("p"), F.sum("negatives").alias("q")).first()
    p, q = totals["p"] or 0, totals["q"] or 0
    found = with_running_totals(counts, [F.col("score").desc()], ["positives", "negatives"])
    caught, false = F.col("positives_so_far"), F.col("negatives_so_far")
    return found.select(
        F.col("score").alias("threshold"), "n", "positives", caught.alias("true_positives"), false.alias("false_positives"),
        F.try_divide(caught, F.lit(p)).alias("recall"), (caught / (caught + false)).alias("precision"), F.try_divide(false, F.lit(q)).alias("false_positive_rate"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """One row: rows, positives, average_precision (area under the precision-recall curve, by steps), roc_area, and
    ``recall_i``, ``precision_i``, ``false_positive_rate_i`` for the i-th threshold.

    Areas treat tied scores as one step. Null where there are no positives, no negatives or no alarms. A table
    without usable rows gives one row of zeros and nulls.
    """
    curve = ranking_curve(df, score, label)
    negatives = F.col("n") - F.col("positives")
    before = F.col("true_positives") - F.col("positives")
    # Pairs ranked rightly, ties half: whole numbers in decimals, so that their sum is exact.
    pairs = (negatives.cast("decimal(19,0)") * (2 * before + F.col("positives")).cast("decimal(19,0)")).cast("decimal(38,0)")
    p, q = F.sum("positives"), F.sum(negatives)
    cells = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(p, F.lit(0)).alias("positives"),
        F.try_divide(F.sum(F.col("positives") * F.col("precision")), p).alias("average_precision"),
        F.try_divide(F.sum(pairs).cast("double"), 2.0 * p * q).alias("roc_area"),
    ]
    for i, limit in enumerate(thresholds):
        alarm = F.col("threshold") >= limit
        caught, alarms = F.sum(F.when(alarm, F.col("positives")).otherwise(0)), F.sum(F.when(alarm, F.col("n")).otherwise(0))
        cells += [F.try_divide(caught, p).alias(f"recall_{i}"), F.try_divide(caught, alarms).alias(f"precision_{i}"), F.try_divide(alarms - caught, q).alias(f"false_positive_rate_{i}")]
    return curve.agg(*cells)


def _pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks whose rates do not grow become one, until all grow."""
    kept: list[list] = []
    for low, high, n, positives, total in blocks.sort_values("low")[["low", "high", "n", "positives", "total"]].itertuples(index=False):
        kept.append([low, high, int(n), int(positives), total])
        while len(kept) > 1 and kept[-2][3] * kept[-1][2] >= kept[-1][3] * kept[-2][2]:
            _, high, n, positives, total = kept.pop()
            kept[-1][1:] = high, kept[-1][2] + n, kept[-1][3] + positives, kept[-1][4] + total
    return pd.DataFrame(kept, columns=["low", "high", "n", "positives", "total"])


def calibration_curve(df: DataFrame, score: str, label: str, block: int = 0) -> DataFrame:
    """The isotonic fit of a label by a score: one row per block of scores with one rate: low, high (its first and last
    score), n, positives, mean_score, rate. Rates grow strictly from block to block.

    Scores are counted per value and dealt to groups of about ``block`` (0: BLOCKS) neighbours, whose violating
    blocks are merged in one task each. Then the groups are cut anew, so that their old edges lie inside,
    until no two neighbours violate the order. Rows without score or label are left out.
    """
    size = block or BLOCKS
    blocks = checkpoint(_counts(df, score, label).select(F.col("score").alias("low"), F.col("score").alias("high"), "n", "positives", (F.col("score") * F.col("n")).alias("total")))
    turn = 0
    while True:
        placed = with_positions(blocks, [F.col("low").asc()], "place")
        group = F.floor((F.col("place") + (size // 2 if turn % 2 else 0)) / size).cast("long")
        pooled = placed.withColumn("part", group).groupBy("part").applyInPandas(lambda part: _pool(part).assign(part=part["part"].iloc[0]), f"{_BLOCK}, part long")
        pooled = checkpoint(pooled)
        blocks = pooled.drop("part")
        # Inside a group rates grow; only the last block of one group and the first of the next may not.
        edge = F.struct("low", "n", "positives")
        ends = pooled.groupBy("part").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
        after = ends.select((F.col("part") - 1).alias("part"), F.col("first").alias("next"))
        exact = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
        wrong = ends.join(after, "part").filter(exact("last.positives", "next.n") >= exact("next.positives", "last.n"))
        turn += 1
        if wrong.isEmpty():
            break
    return blocks.select("low", "high", "n", "positives", (F.col("total") / F.col("n")).alias("mean_score"), (F.col("positives") / F.col("n")).alias("rate"))


def calibrated(df: DataFrame, curve: DataFrame, score: str, output: str) -> DataFrame:
    """The table with the rate that ``curve`` gives each score: that of the last block that begins at or below
    it, for lower scores that of the first block. Null without a score."""
    low = curve.agg(F.min("low").alias("least"), F.min_by("rate", "low").alias("rate")).first()
    found = as_of_join(df, curve.select("low", F.col("rate").alias(output)), on=[], left_time=score, right_time="low", columns=[output])
    return found.withColumn(output, F.when(F.col(score) < F.lit(low["least"]), F.lit(low["rate"])).otherwise(F.col(output)))


def alarm_episodes(df: DataFrame, spec: PanelSpec, alarm: Column, gap: Column, skew: Skew | None = None) -> DataFrame:
    """(entity, timestamp): where an episode of alarms begins, one row each. An alarm more than ``gap`` after the
    one before it begins a new episode. Rows without entity or time raise none."""
    raised = df.filter(alarm).select(*spec.keys).filter(F.col(spec.entity).isNotNull() & F.col(spec.timestamp).isNotNull()).distinct()
    raised = checkpoint(raised)  # read several times below, where entities are long

    def build(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.withColumn("_before", F.lag(spec.timestamp).over(by_time(keys, spec)))

    spaced = windowed(raised, spec, build, before=1, skew=skew)
    return spaced.filter(F.col("_before").isNull() | (F.col(spec.timestamp) - F.col("_before") > gap)).select(*spec.keys)


def event_lead_time(df: DataFrame, spec: PanelSpec, event: Column, alarm: Column, horizon: Column, gap: Column) -> tuple[DataFrame, DataFrame]:
    """Events with the episode of alarms that announced them, and the episodes that announced none.

    An episode announces the first event at or after its begin, if that lies within ``horizon``; of several episodes
    before one event the earliest counts, so that each event and episode is matched once. The first
    table has the entity, event_at, alarm_at and lead (null if missed) and episodes, how many announced
    it; the second the entity and alarm_at of false alarms. The table is read once: its events and alarms are kept in a checkpoint.
    """
    is_event, is_alarm = (unused(df, n) for n in ("_event", "_alarm"))
    marked = df.select(*spec.keys, F.coalesce(event, F.lit(False)).alias(is_event), F.coalesce(alarm, F.lit(False)).alias(is_alarm))
    marked = marked.filter((F.col(is_event) | F.col(is_alarm)) & F.col(spec.entity).isNotNull() & F.col(spec.timestamp).isNotNull())
    marked = checkpoint(marked.groupBy(*spec.keys).agg(F.max(is_event).alias(is_event), F.max(is_alarm).alias(is_alarm)))
    events = marked.filter(is_event).select(*spec.keys)
    begun = checkpoint(alarm_episodes(marked, spec, F.col(is_alarm), gap))
    ahead = checkpoint(
        as_of_join(
            begun, events.select(spec.entity, F.col(spec.timestamp).alias("event_at"), F.col(spec.timestamp).alias("_when")),
            on=[spec.entity], left_time=spec.timestamp, right_time="_when", columns=["event_at"], tolerance=horizon, direction=FORWARD,
        )
    )
    first = ahead.filter("event_at is not null").groupBy(spec.entity, "event_at").agg(F.min(spec.timestamp).alias("alarm_at"), F.count(F.lit(1)).alias("episodes"))
    met = events.select(spec.entity, F.col(spec.timestamp).alias("event_at")).join(first, [spec.entity, "event_at"], "left")
    announced = met.select(spec.entity, "event_at", "alarm_at", (F.col("event_at") - F.col("alarm_at")).alias("lead"), F.coalesce("episodes", F.lit(0)).alias("episodes"))
    return announced, ahead.filter("event_at is null").select(spec.entity, F.col(spec.timestamp).alias("alarm_at"))
