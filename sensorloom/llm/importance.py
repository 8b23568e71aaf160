"""Importance resampling towards a target text: hashed n-gram features, one gain a bucket, one noisy score
a document, and the highest scores are drawn.

Texts stay bytes: a table of 256 bytes lower-cases A-Z and blanks what separates words, ``bytes.split``
gives the words, and the checksum of a word, handed on as the start of the next, becomes that of the n-gram
without joining anything. Counters add up the buckets of a batch; only those counts travel.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_positions
from ..settings import checkpoint
from .rows import importable

BUCKETS = 10_000
GRAMS = 2
# Digits, letters and all bytes of characters beyond ASCII make words; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def buckets_of(words: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``grams`` consecutive words, repeats included."""
    sums = list(map(zlib.crc32, words))
    found = list(sums)
    for n in range(1, grams):
        # Each run so far goes on with a space and the next word.
        sums = list(map(zlib.crc32, words[n:], map(zlib.crc32, repeat(b" "), sums[:-1] if n <= len(words) else [])))
        found += sums
    return np.fromiter(found, np.uint32, len(found)) % np.uint32(buckets)


def _batches(texts: Iterable[str | None], size: int = 1 << 18) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for text in texts:
        held.append(buckets_of(words_of(text)))
        if sum(map(len, held)) > size:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for buckets in _batches(batch.column("text").to_pylist()):
            counts.update(buckets.tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket; what reaches the driver is BUCKETS numbers."""
    importable(texts.sparkSession)
    rows = texts.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS, np.int64)
    for row in rows:
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) per bucket."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    shares = [(float(t + 1) * all_source) / (float(s + 1) * all_target) for s, t in zip(source, target)]
    return np.array([math.floor(1000 * math.log(share)) for share in shares], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """The Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight (the floored mean gain) and score."""
    importable(docs.sparkSession)
    schema = "doc_id long, n_words long, n_features long, weight long, score long"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                buckets = buckets_of(words)
                weight = int(gain[buckets].sum()) // len(buckets) if len(buckets) else 0
                rows.append((doc_id, len(words), len(buckets), weight, weight + noise(doc_id, seed)))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_features", "weight", "score"], dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(frame[c].tolist(), pa.int64()) for c in frame], list(frame))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn) and n_words.

    ``percent`` of the documents with ``least_words`` words or more are drawn, those with the highest scores, ties
    to the smaller doc_id (null ids last). Null texts have no words and weight 0; rows without id share one
    noise; repeated rows are drawn one by one. Empty tables of either kind are allowed. Other columns
    are not read.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = checkpoint(score(docs, gain, seed))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = with_positions(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns. Rows are told apart by doc_id; of repeated ids all rows
    stay if one is drawn."""
    ids = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_drawn"]), "left_semi")
