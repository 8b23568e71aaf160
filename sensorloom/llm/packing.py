"""Packing documents into sequences: cutting stock by column generation.

Documents are encoded and cut into pieces of the sequence length and a remainder. Only the
histogram of piece lengths (at most one row per length) goes to the driver. A linear program over
patterns of lengths is solved there: a knapsack dynamic program prices new patterns until none
helps or the bound is near. Rounded patterns are laid out as rank intervals per length, and each
piece finds its sequence by its rank among the pieces of its length. The pieces that rounding leaves
over, fewer than a sequence for each pattern, are cut where sequences end; their last sequences
have lengths of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..settings import checkpoint
from .bpe import ByteBpe, default_path, share
from .rows import importable

CAPACITY = 1024
END_ID = 0
# Pricing stops where the patterns pad no more than this part of all ids, where the program's lower bound proves that
# its patterns come as near to the best ones, where no pattern helps, or where STEPS new ones gain less than a tenth of it.
GAP = 2e-3
STEPS = 100
# Patterns with padding that so few sequences would follow are not kept: their pieces are cut with the rest.
FEW = 16


# --- pieces ---------------------------------------------------------------------------


class QuickBpe(ByteBpe):
    """Ids as the tokenizers library gives them; new words are merged by compiled code."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        # The compiled coder takes ids for ranks.
        made = {*self.joined.tolist(), *self.byte_ids.tolist()}
        if (np.diff(self.joined) <= 0).any() or (len(self.joined) and self.byte_ids.max() > self.joined[0]) or made != set(self.ids.values()):
            raise ValueError("the ids of this file do not follow the order of its merge rules")

        self.fast = tiktoken.Encoding("file", pat_str=self.WORDS, mergeable_ranks=self.ids, special_tokens={})

    def _learn(self, pieces: set[str], firsts: list[str]) -> None:
        ids = self.fast.encode_ordinary
        self.spaced.update([(p, array("I", ids(" " + p)).tobytes()) for p in pieces.difference(self.spaced)])
        words = set().union(*map(self.words.findall, firsts)).difference(self.bare)
        self.bare.update([(w, array("I", ids(w)).tobytes()) for w in words])


@lru_cache(maxsize=2)
def quick_coder(path: str) -> QuickBpe:
    return QuickBpe(path)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("run", T.LongType()),
        T.StructField("place", T.LongType()),
    ]
)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the encoded documents (null text: empty), each with its end id.

    ``run`` is the partition that made a piece and ``place`` its number there among the pieces of
    its length; the table is checkpointed, so both stay as they are.
    """
    spark = docs.sparkSession
    importable(spark)
    file = share(spark, path or default_path())
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = quick_coder(SparkFiles.get(file))
        run = TaskContext.get().partitionId()
        places: Counter[int] = Counter()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, encoded in zip(batch.column(0).to_pylist(), coder.encode_all(texts)):
                ids = np.append(encoded, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    n = len(piece)
                    row = (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), run, places[n])
                    rows.append((*row, piece.tolist()) if with_ids else row)
                    places[n] += 1
            columns = list(zip(*rows)) or [()] * len(schema.fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if i < len(PIECES) else pa.list_(pa.int32())) for i, c in enumerate(columns)], schema.fieldNames()
            )

    return checkpoint(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, schema))


# --- the cutting-stock program, on the histogram ---------------------------------------


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over fill."""
    worth = prices > 0
    sizes, values = lengths[worth], prices[worth]
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for fill in range(1, capacity + 1):
        best[fill] = best[fill - 1]
        if fits[fill]:
            totals = best[fill - sizes[: fits[fill]]] + values[: fits[fill]]
            at = int(totals.argmax())
            if totals[at] > best[fill] + 1e-12:
                best[fill], choice[fill] = totals[at], at
    pattern = np.zeros(len(lengths))
    places = np.flatnonzero(worth)
    fill = capacity
    while fill > 0:
        if choice[fill] < 0:
            fill -= 1
        else:
            pattern[places[choice[fill]]] += 1
            fill -= sizes[choice[fill]]
    return float(best[capacity]), pattern


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns to start from, with their inverse: one length repeated, or two lengths that fill a
    sequence together (that pattern takes the column of the rarer one)."""
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1 / (capacity // lengths))
    place = {int(length): i for i, length in enumerate(lengths)}
    for i, length in enumerate(lengths.tolist()):
        j = place.get(capacity - length)
        if j is not None and i < j:
            more, less = (i, j) if demand[i] >= demand[j] else (j, i)
            basis[[more, less], less] = 1
            inverse[less, less] = 1
            inverse[more, less] = -inverse[more, more]
    return basis, inverse


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Without the threads of a linear algebra library, which the driver may share with much else."""
    return np.einsum("ij,j->i", matrix, vector)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, not yet whole numbers."""
    basis, inverse = _first_basis(lengths, demand, capacity)
    full = float((lengths * demand).sum()) / capacity
    totals: list[float] = []
    # Slightly uneven demands keep the program from going in circles between equal bases.
    uneven = demand * (1 + 1e-7 * np.arange(len(demand)) / max(1, len(demand)))
    used = _times(inverse, uneven)
    while True:
        value, pattern = best_pattern(lengths, inverse.sum(axis=0), capacity)
        # Two bounds from below: sequences without any padding, and the priced one. What rounding leaves over is not padded.
        room = capacity - lengths @ basis
        padding = float(np.where(used >= FEW, np.floor(used + 1e-6), 0) @ room) / capacity
        totals.append(float(used.sum()))
        if value <= 1 + 1e-9 or padding <= GAP * full or totals[-1] <= (1 + GAP) * max(full, totals[-1] / value):
            break
        if len(totals) > STEPS and totals[-STEPS - 1] - totals[-1] < GAP / 10 * totals[-1]:
            break
        direction = _times(inverse, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, np.maximum(used, 0) / direction, np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = pattern
        row = inverse[leaves] / direction[leaves]
        inverse -= np.multiply.outer(direction, row)
        inverse[leaves] = row
        used = _times(inverse, uneven)
    return basis, np.maximum(_times(inverse, demand), 0)


def _best_fit(left: Counter[int], capacity: int) -> list[dict[int, int]]:
    """What rounding leaves over (less than one sequence per pattern), longest first."""
    by_room: dict[int, list[dict[int, int]]] = defaultdict(list)
    bins = []
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            if room is None:
                room, found = capacity, {}
                bins.append(found)
            else:
                found = by_room[room].pop()
            found[length] = found.get(length, 0) + 1
            by_room[room - length].append(found)
    return bins


def rounded_plan(histogram: dict[int, int], capacity: int = CAPACITY, least: int = FEW) -> tuple[list[tuple[dict[int, int], int]], Counter[int]]:
    """Patterns ({length: copies}) with how many sequences follow each, rounded down, and the pieces left over. Padded
    patterns are kept from ``least`` sequences on."""
    if not histogram:
        return [], Counter()
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths.tolist()], float)
    basis, used = solve(lengths, demand, capacity)
    left, found = Counter(histogram), []
    for column in np.argsort(-used):
        pattern = {int(lengths[i]): int(basis[i, column]) for i in np.flatnonzero(basis[:, column])}
        times = min(int(used[column] + 1e-6), *(left[n] // c for n, c in pattern.items()))
        if times >= (1 if sum(n * c for n, c in pattern.items()) == capacity else least):
            found.append((pattern, times))
            left.subtract({n: c * times for n, c in pattern.items()})
    return found, +left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns and how many sequences follow each, for pieces that must stay whole; they use every piece once."""
    found, left = rounded_plan(histogram, capacity, 1)
    return found + [(pattern, 1) for pattern in _best_fit(left, capacity)]


def tear(left: Counter[int], capacity: int, base: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, number, from, to, sequence, offset): where the parts of pieces left over lie, by their number among those
    of their length. Sequences are filled one after the other; what does not fill one is laid into sequences
    whose lengths are powers of two. No sequence has any padding."""
    total = sum(n * c for n, c in left.items())
    rest = total % capacity
    sizes = iter([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1])
    rows, sequence, room, size = [], base - 1, 0, 0
    for length in sorted(left, reverse=True):
        for number in range(left[length]):
            at = 0
            while at < length:
                if not room:
                    size = room = next(sizes)
                    sequence += 1
                step = min(room, length - at)
                rows.append((length, number, at, at + step, sequence, size - room))
                at, room = at + step, room - step
    return rows


def intervals(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, ...]]:
    """(length, first rank, end rank, first sequence, copies, offset): where pieces of a rank lie."""
    rows, next_rank, base = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            first = next_rank[length]
            next_rank[length] += copies * times
            rows.append((length, first, next_rank[length], base, copies, offset))
            offset += length * copies
        base += times
    return rows


# --- placement ------------------------------------------------------------------------


def _ranked(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """A piece's rank among those of its length: its place in its partition plus the counts of the
    partitions before it, so no length, however common, is ordered by one task."""
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return cut.join(starts, ["length", "run"]).withColumn("rank", F.col("place") + F.col("before"))


def _placed(ranked: DataFrame, table: list[tuple[int, ...]]) -> DataFrame:
    """The pieces whose ranks lie in the intervals, with ``sequence_id`` and ``offset``.

    The table is bounded by the capacity (about ``capacity`` patterns and as many left-over sequences), not by
    the data, so it is broadcast.
    """
    where = ranked.sparkSession.createDataFrame(table, "length long, first long, end long, base long, copies long, room long")
    among = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(where), "length")
        .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .withColumn("sequence_id", F.col("base") + F.floor(among / F.col("copies")).cast("long"))
        .withColumn("offset", F.col("room") + among % F.col("copies") * F.col("length"))
        .drop("run", "place", "before", "rank", "first", "end", "base", "copies", "room")
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, all of them whole; offsets in a sequence leave no gap. No pieces
    give no rows."""
    counts = cut.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    return _placed(_ranked(cut, counts), intervals(plan(histogram, capacity)))


def _torn_parts(docs: DataFrame, torn: DataFrame, path: str | None) -> DataFrame:
    """The checksums (and ids) of parts of pieces: the few documents they come from are encoded once more."""
    spark = docs.sparkSession
    importable(spark)
    file = share(spark, path or default_path())
    part = "start long, length long, ids_crc32 long, from long, to long"
    lists = torn.groupBy("doc_id").agg(F.collect_set(F.struct("start", "length", "ids_crc32", "from", "to")).alias("parts"))
    named = lists.withColumnRenamed("doc_id", "_torn")
    # At most two parts for each sequence of the rest, so this list is bounded like the plan.
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(named), F.col("doc_id").eqNullSafe(F.col("_torn")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = quick_coder(SparkFiles.get(file))
        for batch in batches:
            rows = []
            for doc_id, wanted, encoded in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), coder.encode_all([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(encoded, np.uint32(END_ID)).astype("<u4")
                for w in wanted:
                    piece = ids[w["start"] : w["start"] + w["length"]]
                    if len(piece) == w["length"] and zlib.crc32(piece.tobytes()) == w["ids_crc32"]:
                        own = piece[w["from"] : w["to"]]
                        rows.append((doc_id, *w.values(), zlib.crc32(own.tobytes()), own.tolist()))
            columns = list(zip(*rows)) or [()] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "from", "to", "part_crc32", "part_ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "part_ids" else pa.int64()) for n, c in zip(names, columns)], names)

    found = some.select("doc_id", "text", "parts").mapInArrow(encode, f"doc_id long, {part}, part_crc32 long, part_ids array<int>")
    return found.dropDuplicates(["doc_id", "start", "length", "ids_crc32", "from", "to"])


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every document has at least its end id, also a null or empty one. Repeated rows are packed each;
    null doc_ids stay null. Other columns are not read. An empty table gives no rows.
    """
    cut = pieces(docs, path, capacity, with_ids)
    counts = cut.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns, left = rounded_plan(histogram, capacity)
    base = sum(times for _, times in patterns)
    placed = _placed(_ranked(cut, counts), intervals(patterns))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    # The ranks beyond the intervals are those of the rest.
    rows = [(n, histogram[n] - left[n] + number, *where) for n, number, *where in tear(left, capacity, base)]
    parts = cut.sparkSession.createDataFrame(rows, "length long, rank long, from long, to long, sequence_id long, offset long")
    rest = checkpoint(_ranked(cut, counts).join(F.broadcast(parts), ["length", "rank"]))
    whole = F.col("to") - F.col("from") == F.col("length")
    key = ["doc_id", "start", "length", "ids_crc32", "from", "to"]
    torn = rest.filter(~whole)
    made = checkpoint(_torn_parts(docs, torn.select(*key), path))  # nothing reads the documents after this
    same = [torn[k].eqNullSafe(made[k]) if k == "doc_id" else torn[k] == made[k] for k in key]
    both = torn.join(made, same).select(
        torn["doc_id"], (torn["start"] + torn["from"]).alias("start"), (torn["to"] - torn["from"]).alias("length"), made["part_crc32"].alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", *([made["part_ids"].alias("ids")] if with_ids else []),
    )
    return placed.select(*columns).union(rest.filter(whole).select(*columns)).union(both.select(*columns))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """The sequences themselves, from pieces with ids: padded to the capacity, except where the
    length is a power of two. A sequence holds at most ``capacity`` ids."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    ids = F.flatten(F.col("held.ids"))
    n = F.size("ids")
    padded = F.when(F.bit_count(n.cast("long")) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n)))
    return (
        packed.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.col("held.doc_id").alias("doc_ids"), ids.alias("ids")).withColumn("n_tokens", n).withColumn("ids", padded)
    )
