"""Toxic passages: maximum-scoring segments of token log-odds.

Token weights are log-odds of toxic against clean labelled documents with an informative Dirichlet
prior, the token shares of the whole corpus. Over a text's weights, a linear scan finds every maximal scoring
segment. Segment scores become expected counts of chance segments as good (extreme-value statistics of maximal
segments, fitted to the best segments of all texts by their length), and a logistic fit on the labelled rows
turns a document's best one into a score from 0 to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import checkpoint
from .rows import fields, importable, per_text

# The classifier learns from at most this many labelled ids (those with the smallest hash), which are broadcast
# with their labels; only tokens of their texts can have a weight. Token shares and the best segments
# behind the extreme-value fit are those of all documents.
MAX_LABELLED = 20_000
# The prior: so many texts with the corpus's token shares, and half a text for every token, so that
# a token never seen in clean texts has a finite spread.
PRIOR, FLOOR = 500.0, 0.5
CLEAR = 3.0
DRIFT = 0.05
SIGNIFICANT = 0.05
CERTAIN = 7.0  # one chance in a thousand
EDGES = ".,;:!?\"'()[]*_#$%&|<>"
KEPT_TOKENS = 500_000
BIN = 0.25  # of segment scores, in counts by length


@dataclass(frozen=True)
class ToxicModel:
    """Weights of tokens (others weigh ``-drift``), the extreme-value fit (of a text of n tokens, chance segments that
    score x are expected scale * n**growth * exp(-rate * x) times), and the logistic fit."""

    weights: dict[str, float]
    rate: float
    scale: float = 0.1
    growth: float = 1.0
    drift: float = DRIFT
    bias: float = -2.0
    slope: float = 1.0


class _Weights(dict):
    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> float:
        if len(self) > KEPT_TOKENS:
            self.clear()
        value = self[piece] = self.model.weights.get(piece.strip(EDGES), -self.model.drift)
        return value


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass over the positive weights."""
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    held: list[tuple[float, float, int, int]] = []
    for at in np.flatnonzero(weights > 0).tolist():
        left, right, start = sums[at], sums[at + 1], at
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= right:
                held.append((left, right, start, at + 1))
                break
            left, _, start, _ = held[j]
            del held[j:]
    return [(start, end, float(right - left)) for left, right, start, end in held]


_FOUND = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("evidence", T.DoubleType()),
        T.StructField("surprise", T.DoubleType()),
        T.StructField("n_passages", T.LongType()),
        T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def _finder(model: ToxicModel):
    held: list[_Weights] = []

    def find(texts: list[str]) -> Iterable[tuple]:
        if not held:
            held.append(_Weights(model))
        for text in texts:
            tokens = text.lower().split()
            found = segments(np.fromiter(map(held[0].__getitem__, tokens), float, len(tokens)))
            size = math.log(model.scale) + model.growth * math.log(max(1, len(tokens)))
            best = max((s for _, _, s in found), default=0.0)
            clear = [f for f in found if size - model.rate * f[2] <= math.log(SIGNIFICANT)]
            evidence = model.rate * best - size
            yield len(tokens), evidence, surprise(evidence), len(clear), clear

    return find


def surprise(evidence: float) -> float:
    """-log of the chance that a text without toxic passages has a segment as good, by the extreme-value law; beyond
    CERTAIN it grows slowly, so that very long passages do not rule the logistic fit."""
    chance = -math.expm1(-math.exp(min(-evidence, 30.0)))
    found = -math.log(max(chance, 1e-300))
    return found if found <= CERTAIN else CERTAIN + math.log1p(found - CERTAIN)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicModel:
    """A model from labelled rows that are not held out. Rows without id or label teach nothing, an
    id with several labels is toxic if one says so, and of an id with several texts the largest counts. Without
    labels of both kinds no token has weight.
    """
    spark = docs.sparkSession
    importable(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # One text per labelled id, however often rows repeat it: at most ``max_labelled`` rows from here on.
    texts = checkpoint(plain.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"))
    counts = checkpoint(token_counts(texts, plain))
    totals = counts.agg(F.sum("t"), F.sum("c"), F.sum("every")).first()
    n_toxic, n_clean, n_all = (float(x or 0) for x in totals)
    if not n_toxic or not n_clean:
        return ToxicModel({}, 1.0)
    weights, chances = {}, []
    for r in clear_tokens(counts, n_toxic, n_clean, n_all).collect():  # tokens of at most ``max_labelled`` texts
        weights[r["token"]] = float(r["weight"])
        chances.append((float(r["weight"]), r["every"] * r["clean"] / n_all))
    model = ToxicModel(weights, _rate(chances, DRIFT))
    scale, growth = fit_extremes(segment_maxima(plain, model), model.rate)
    model = replace(model, scale=scale, growth=growth)
    found = per_text(spark, _finder(model), _FOUND)
    fitted = texts.select("toxic", found(F.col("text")).alias("f")).select("toxic", "f.surprise").collect()
    rows = np.array(sorted((r["surprise"], r["toxic"]) for r in fitted), float)
    bias, slope = _logistic(rows[:, 0], rows[:, 1])
    return replace(model, bias=bias, slope=max(slope, 0.0))


def token_counts(texts: DataFrame, everything: DataFrame) -> DataFrame:
    """(token, t, c, every): in how many toxic and clean labelled texts and in how many of all texts a token stands."""
    none = F.lit(None).cast("int")
    schema = "token string, t long, c long, every long"
    parts = [texts.select("text", "toxic"), everything.select("text", none.alias("toxic"))]
    return parts[0].mapInArrow(_count, schema).union(parts[1].mapInArrow(_count, schema)).groupBy("token").agg(*[F.sum(n).alias(n) for n in ("t", "c", "every")])


def clear_tokens(counts: DataFrame, n_toxic: float, n_clean: float, n_all: float) -> DataFrame:
    """(token, weight, every, clean): log-odds of toxic against clean texts, where they are clear of chance, and the
    share of clean texts among the labelled ones that hold the token."""
    prior = PRIOR * F.col("every") / n_all + FLOOR
    odds = lambda n, of: F.log((F.col(n) + prior) / (of + PRIOR - F.col(n) - prior))
    clean = (F.col("c") + prior) / (F.col("t") + F.col("c") + 2 * prior)
    seen = counts.filter((F.col("t") > 0) | (F.col("c") > 0))
    weighed = seen.withColumn("weight", odds("t", n_toxic) - odds("c", n_clean)).withColumn("spread", F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior)))
    return weighed.filter(F.abs(F.col("weight") / F.col("spread")) >= CLEAR).select("token", "weight", "every", clean.alias("clean"))


def segment_maxima(texts: DataFrame, model: ToxicModel) -> DataFrame:
    """(length, best, n): how many texts of 2**length tokens or more have a best segment of about ``best``. A few hundred rows."""
    find = per_text(texts.sparkSession, _maxima(model), T.StructType([T.StructField("length", T.IntegerType()), T.StructField("best", T.DoubleType())]))
    return texts.select(find(F.col("text")).alias("m")).select("m.*").filter("length is not null").groupBy("length", "best").agg(F.count(F.lit(1)).alias("n"))


def _maxima(model: ToxicModel):
    held: list[_Weights] = []

    def find(texts: list[str]) -> Iterable[tuple]:
        if not held:
            held.append(_Weights(model))
        for text in texts:
            tokens = text.lower().split()
            best = max((s for _, _, s in segments(np.fromiter(map(held[0].__getitem__, tokens), float, len(tokens)))), default=0.0)
            yield (len(tokens).bit_length() - 1, math.ceil(best / BIN) * BIN) if tokens else (None, None)

    return find


def fit_extremes(maxima: DataFrame, rate: float) -> tuple[float, float]:
    """scale and growth from the best segments of texts by length: the share of texts whose best segment reaches a
    height x is 1 - exp(-scale * n**growth * exp(-rate * x)), so its complementary log-log is a line in log n. The height is
    the median of the best segments of texts that have any."""
    found: dict[int, Counter] = {}
    for r in maxima.collect():
        found.setdefault(r["length"], Counter())[r["best"]] += r["n"]
    heights = sorted((best, sum(c[best] for c in found.values())) for best in {b for c in found.values() for b in c if b > 0})
    if not heights:
        return 0.1, 1.0
    half, seen, height = sum(n for _, n in heights) / 2, 0, heights[-1][0]
    for best, n in heights:
        seen += n
        if seen >= half:
            height = best
            break
    x, y, weight = [], [], []
    for length, counts in sorted(found.items()):
        n, above = counts.total(), sum(k for best, k in counts.items() if best >= height)
        if 0 < above < n:
            x.append(math.log(1.5 * 2**length))
            y.append(math.log(-math.log(1 - above / n)) + rate * height)
            weight.append(above)
    if not x:
        return 0.1, 1.0
    x, y, weight = np.array(x), np.array(y), np.array(weight, float)
    mean_x, mean_y = np.average(x, weights=weight), np.average(y, weights=weight)
    spread = np.average((x - mean_x) ** 2, weights=weight)
    growth = float(np.clip(np.average((x - mean_x) * (y - mean_y), weights=weight) / spread, 0.0, 2.0)) if spread > 1e-9 else 1.0
    return float(math.exp(mean_y - growth * mean_x)), growth


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic, clean and unlabelled texts each token stands. Counters are handed on before they grow large."""
    kinds: dict[int | None, Counter] = {1: Counter(), 0: Counter(), None: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kinds[toxic].update({token.strip(EDGES) for token in text.lower().split()})
        if sum(map(len, kinds.values())) > KEPT_TOKENS:
            yield from _handed_on(kinds)
    yield from _handed_on(kinds)


def _handed_on(kinds: dict[int | None, Counter]) -> Iterator[pa.RecordBatch]:
    tokens = list(set().union(*kinds.values()))
    for start in range(0, len(tokens), 50_000):
        part = tokens[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in kinds.values())], ["token", "t", "c", "every"])
    for counter in kinds.values():
        counter.clear()


def _rate(weights: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum(p * exp(rate * weight)) = 1 over clean tokens."""
    rest = max(1e-9, 1 - sum(p for _, p in weights))

    def over(rate: float) -> float:
        return sum(p * math.exp(min(60.0, rate * w)) for w, p in weights) + rest * math.exp(-rate * drift) - 1

    low, high = 1e-3, 1e-3
    while over(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) < 0 else (low, middle)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one measure with a small ridge, by Newton steps; at most MAX_LABELLED rows."""
    scale = max(float(np.abs(x).max()), 1e-9)
    design = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * w
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-3 * np.eye(2), gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row per document: doc_id, n_tokens, evidence (log odds of the best segment against
    chance), surprise, n_passages, passages (token spans [start, end) with scores that chance rarely gives),
    score and predicted. Null and empty texts have no passage and the lowest score. Repeated rows and
    null ids are scored like others; other columns are not read.
    """
    find = per_text(docs.sparkSession, _finder(model), _FOUND)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text")).alias("f"))
    rows = found.select("doc_id", *fields(found, "f"))
    logit = F.lit(model.bias) + F.lit(model.slope) * F.col("surprise")
    score = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
