"""Exact deduplication: a tree merge of sorted digest runs.

Each input partition becomes one sorted run of digests. In every binomial round ``radix`` runs
are merged and the digest range is cut into ``radix`` parts, so that the number of groups and
their size stay as they were at the start: no task ever holds more than about one partition's
digests, and a digest that a third of all rows share has one row per run.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import checkpoint
from .rows import importable

RADIX = 8
RUN = "run long, part long, digest binary, best_id long, best_row long, n long"
MISSING = -(2**63)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row number, the partition that read it, and a digest verified by length and a second hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    verified = F.concat(
        F.unhex(F.sha2(text, 256)),
        F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")),
        F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), verified.alias("digest"), F.monotonically_increasing_id().alias("row"))
    return checkpoint(rows).withColumn("run", F.shiftright("row", 33))


def _better(a: tuple, b: tuple) -> tuple:
    return a if a >= b else b


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run of the distinct digests of a partition."""
    held: dict[bytes, tuple] = {}
    run = 0
    for batch in batches:
        columns = batch.to_pydict()
        for digest, doc_id, row, run in zip(columns["digest"], columns["doc_id"], columns["row"], columns["run"]):
            best = (MISSING if doc_id is None else doc_id, row)
            old = held.get(digest)
            held[digest] = (*best, 1) if old is None else (*_better(best, old[:2]), old[2] + 1)
    order = sorted(held)
    for start in range(0, len(order), 50_000):
        part = order[start : start + 50_000]
        values = [held[d] for d in part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([run] * len(part), pa.int64()),
                pa.array([0] * len(part), pa.int64()),
                pa.array(part, pa.binary()),
                *(pa.array([v[i] for v in values], pa.int64()) for i in range(3)),
            ],
            ["run", "part", "digest", "best_id", "best_row", "n"],
        )


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Merges the sorted runs of one range."""
    runs = [sorted(zip(g["digest"], g["best_id"], g["best_row"], g["n"])) for _, g in frame.groupby("source")]
    out = []
    for digest, same in groupby(heapq.merge(*runs), key=lambda entry: entry[0]):
        same = list(same)
        out.append((digest, *max((s[1], s[2]) for s in same), sum(s[3] for s in same)))
    found = pd.DataFrame(out, columns=["digest", "best_id", "best_row", "n"])
    return found.assign(run=int(frame["run"].iloc[0]), part=int(frame["part"].iloc[0]))


def merge_runs(leaves: DataFrame, n_runs: int, radix: int = RADIX) -> DataFrame:
    """One row per distinct digest, after ceil(log_radix(n_runs)) rounds (one at least)."""
    bits = int(math.log2(radix))
    levels = 1
    while radix**levels < n_runs:
        levels += 1
    runs = leaves
    for level in range(1, levels + 1):
        part = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
        runs = (
            runs.withColumn("source", F.col("run"))
            .withColumn("run", F.floor(F.col("run") / radix).cast("long"))
            .withColumn("part", F.shiftrightunsigned(part, 56 - level * bits))
            .groupBy("run", "part")
            .applyInPandas(_merge, RUN)
        )
    return runs


def exact_dedup(docs: DataFrame, radix: int = RADIX) -> DataFrame:
    """Each row with the id that stays for its text, the size of its group and whether it stays.

    Of equal texts the row with the largest ``doc_id`` stays (null ids lose; of rows that repeat
    the largest id, one). Null texts equal empty ones. An empty table gives no rows; other columns
    are not read.
    """
    importable(docs.sparkSession)
    rows = digests(docs)
    leaves = rows.mapInArrow(_first_runs, RUN)
    merged = merge_runs(leaves, rows.rdd.getNumPartitions(), radix).select("digest", "best_id", "best_row", F.col("n").alias("group_size"))
    # Down the tree again: first to the runs (one row per run and digest), then to their rows.
    # A group that a third of all rows share is spread over all runs.
    answers = leaves.select("run", "digest").join(merged, "digest")
    kept = F.col("row") == F.col("best_row")
    return rows.join(answers, ["run", "digest"]).select(
        "doc_id",
        F.when(F.col("best_id") != MISSING, F.col("best_id")).alias("keep_id"),
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )
