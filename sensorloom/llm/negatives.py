"""Hard negatives by exact integer inner products in a residue number system.

Vectors are whole numbers. Modulo a small prime a product of two matrices stays below 2**24, so float32
matrix products are exact; a few primes together fix the signed product, which is rebuilt by
Chinese remaindering with balanced digits. Anchors meet all rows block by block: both sides are dealt to
a grid of blocks of bounded size, and a block hands on only the best of each anchor. Windows then
choose among those.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import checkpoint
from .rows import importable

LEAST_ROWS, MOST_CELLS = 1024, 1 << 22  # rows of a block at least, numbers of a block at most
INNER = 256  # columns multiplied at once
TILE = 2048
LONG = 2**62
NONE = -(2**63)


def primes_below(limit: int, product: int) -> list[int]:
    """The largest odd primes up to ``limit`` whose product exceeds ``product``."""
    found, total, n = [], 1, limit
    while total <= product:
        if n < 3:
            raise ValueError("scores are too large for a product of small primes")
        if n % 2 and all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
            total *= n
        n -= 1
    return found


def balanced(values: np.ndarray, prime: int) -> np.ndarray:
    """The remainders nearest to zero."""
    half = prime // 2
    return (values + half) % prime - half


def plan_primes(width: int, bound: int) -> list[int]:
    """Primes for scores up to ``bound`` in size: with remainders up to p/2 a sum over INNER columns is below 2**24."""
    return primes_below(2 * int((2**24 / max(1, min(width, INNER))) ** 0.5) - 1, 2 * bound + 1)


def product(one: np.ndarray, two: np.ndarray, primes: list[int]) -> np.ndarray:
    """one @ two.T of whole numbers, exact and signed, where every entry is below half the primes' product."""
    digits: list[np.ndarray] = []
    for i, prime in enumerate(primes):
        a, b = balanced(one, prime).astype(np.float32), balanced(two, prime).astype(np.float32)
        rest = np.zeros((len(one), len(two)), np.int64)
        for start in range(0, one.shape[1], INNER):
            rest += (a[:, start : start + INNER] @ b[:, start : start + INNER].T).astype(np.int64)
        # What the digits so far leave over gives the next digit of the mixed-radix number.
        base = 1
        for digit, earlier in zip(digits, primes[:i]):
            rest -= digit * (base % prime)
            base *= earlier
        digits.append(balanced((rest % prime) * pow(base % prime, -1, prime) if i else rest, prime))
    total, base = np.zeros((len(one), len(two)), np.int64), 1
    for digit, prime in zip(digits, primes):
        total += digit * np.int64(base if base < 2**63 else 0)
        base *= prime
    return total


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> list[np.ndarray]:
    """Per row of scores the indices of the ``keep`` highest that are not NONE, ties by smaller id."""
    if scores.shape[1] > keep:
        cut = np.partition(scores, scores.shape[1] - keep, axis=1)[:, -keep]
    else:
        cut = np.full(len(scores), NONE)
    found = []
    for row, least in zip(scores, cut):
        some = np.flatnonzero((row >= least) & (row != NONE))
        found.append(some[np.lexsort((ids[some], -row[some]))][:keep])
    return found


def _matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    cells = np.zeros((len(frame), width), np.int64)
    for i, vector in enumerate(frame["vector"]):
        cells[i, : len(vector)] = vector
    return cells


def _scorer(width: int, primes: list[int], keep: int, low: int | None, scale: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Best rows of a block for each anchor: of its own label, or (``low`` given) of other labels per known positive."""

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        asking = frame["asks"].to_numpy()
        anchors, rows = frame[asking], frame[~asking].sort_values("row")
        ids = np.array([2**63 - 1 if pd.isna(v) else int(v) for v in rows["vec_id"].tolist()], np.int64)
        labels, keys, left = rows["label"].to_numpy(), rows["row"].to_numpy(), _matrix(anchors, width)
        out = []
        for start in range(0, len(rows), TILE):
            part = slice(start, start + TILE)
            scores = product(left, _matrix(rows.iloc[part], width), primes)
            same = anchors["label"].to_numpy()[:, None] == labels[part][None, :]
            if low is None:
                scores[~same | (anchors["row"].to_numpy()[:, None] == keys[part][None, :])] = NONE
                for i, best in enumerate(_best(scores, ids[part], keep)):
                    out += [(anchors["row"].iat[i], 0, keys[start + j], ids[start + j], scores[i, j]) for j in best]
                continue
            scores[same] = NONE
            wanted = [(i, known) for i, list_ in enumerate(anchors["positives"]) for known in sorted(set(list_))]
            if wanted:
                who, known = (np.array(x, np.int64) for x in zip(*wanted))
                for first in range(0, len(who), 512):
                    some, own = scores[who[first : first + 512]], known[first : first + 512, None]
                    # scale * score >= low * own in whole numbers, without products that overflow
                    least = np.array([-(-low * int(k) // scale) for k in own[:, 0]], np.int64)[:, None]
                    some = np.where((some <= own) & (some >= least), some, NONE)
                    for n, best in enumerate(_best(some, ids[part], keep), first):
                        out += [(anchors["row"].iat[who[n]], known[n], keys[start + j], ids[start + j], some[n - first, j]) for j in best]
        return pd.DataFrame(out, columns=["anchor", "known", "row", "id", "score"])

    return apply


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and the label of each.

    ``vectors`` has vec_id, embedding and label; rows for which ``anchor`` holds ask. Components become
    floor(scale * x). The positives of an anchor are the highest ``positives`` other rows of its label, and for each
    the first ``negatives`` rows of other labels with low/100 of its score up to its score are returned. Higher
    scores come first, ties by smaller vec_id (null ids last, then the row read first). Rows with a null label, a null
    vector or a null or non-finite component take no part; shorter vectors count as filled up with zeros. Repeated rows
    are rows of their own, also as anchors. Empty tables give no rows; scores that do not
    fit a long raise ValueError. Other columns are not read.
    """
    spark = vectors.sparkSession
    importable(spark)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    able = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = able.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        whole.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    rows = checkpoint(rows)
    norm = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("anchors"), F.max(norm).alias("norm"), F.max(F.size("vector")).alias("width")).first()
    if (size["norm"] or 0) >= LONG:
        raise ValueError("inner products must fit a long")
    width = max(1, size["width"] or 0)
    primes = plan_primes(width, int(size["norm"] or 0) + 1)  # |a.b| is at most the larger squared norm

    fits = max(1, MOST_CELLS // width)
    wide = 4 * spark.sparkContext.defaultParallelism
    asked = -(-size["anchors"] // fits) or 1
    held = max(-(-size["n"] // fits), min(-(-size["n"] // LEAST_ROWS), wide), 1)
    grid = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    targets = rows.select("row", "vec_id", "label", "vector", deal(held).alias("held"), F.explode(grid(asked)).alias("asked"), F.lit(False).alias("asks"))

    def against(anchors: DataFrame, low: int | None, keep: int) -> DataFrame:
        dealt = anchors.select("row", "vec_id", "label", "vector", "positives", deal(asked).alias("asked"), F.explode(grid(held)).alias("held"), F.lit(True).alias("asks"))
        both = targets.withColumn("positives", F.lit(None).cast("array<long>")).unionByName(dealt)
        scored = both.groupBy("asked", "held").applyInPandas(_scorer(width, primes, keep, low, 100), "anchor long, known long, row long, id long, score long")
        order = Window.partitionBy("anchor", "known").orderBy(F.desc("score"), "id", "row")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)

    anchors = rows.filter("asks")
    near = checkpoint(against(anchors.withColumn("positives", F.lit(None).cast("array<long>")), None, positives))
    known = near.groupBy("anchor").agg(F.collect_set("score").alias("positives"))  # at most ``positives`` each
    far = against(anchors.join(known.withColumnRenamed("anchor", "row"), "row"), low, negatives)
    real = lambda name: F.when(F.col(name) != 2**63 - 1, F.col(name))
    pairs = near.select("anchor", real("id").alias("positive_id"), F.col("score").alias("known"), F.col("rank").alias("positive_rank")).join(
        far.select("anchor", "known", "rank", real("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "known"]
    )
    named = pairs.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("known").alias("positive_score"), "negative_score", "positive_rank")
