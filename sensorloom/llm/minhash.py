"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Documents with the same set form one class; classes are compared, never their copies. A class has
``HASHES`` minima. Bands of whole minima give candidate buckets; of every minimum the low
``BITS`` bits are kept and packed, and two signatures are compared by counting equal cells and
correcting for cells that agree by chance.

Only components are wanted, so no pairs leave a bucket. Its members come together with their sets in
groups of bounded size; there, pairs that the bits do not rule out are confirmed on the full sets,
and a group hands on a spanning forest, fewer links than it has members. First each class goes to its most
crowded bucket only. Then the buckets that still hold several components are searched, the members outside
the main component against all. Nothing is capped: crowded buckets are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import checkpoint
from .rows import fresh, importable, per_text

HASHES = 512
BITS = 4
BANDS = 32
ROWS = 4
# At similarity s the estimate of 512 cells has a standard error of sqrt(s(1-s)/512), 0.019 at 0.8
# after correction. Pairs are confirmed from 4.5 standard errors below the threshold on, and a
# pair at the threshold misses all 32 bands of 4 with probability (1 - 0.8**4)**32 = 5e-8.
MARGIN = 0.085
# Members and shingles (8 bytes each) of one group, about.
BLOCK = 2048
SHINGLES = 1 << 20
KEPT_WORDS = 150_000

_random = np.random.default_rng(20_240_601)
_MULTIPLY = (_random.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _random.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


# --- sets and signatures ----------------------------------------------------------------


class _Words(dict):
    """64-bit hashes of words, kept by a worker."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(_words) > KEPT_WORDS:
        _words.clear()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(words):
        return hashes
    n = min(width, len(words))
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ hashes[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for start in range(0, len(keys), 256):
        np.minimum(least, ((keys[start : start + 256, None] ^ _SHIFT) * _MULTIPLY).min(axis=0), out=least)
    return least


def pack_bits(least: np.ndarray) -> bytes:
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8).reshape(-1, 2)
    return (low[:, 0] | (low[:, 1] << 4)).tobytes()


def band_keys(least: np.ndarray) -> list[int]:
    bands = np.ascontiguousarray(least[: BANDS * ROWS].reshape(BANDS, ROWS))
    return [xxhash.xxh3_64_intdigest(bands[b].tobytes(), seed=b) - 2**63 for b in range(BANDS)]


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature (uint64 cells) and each of several, corrected for cells
    that agree by chance."""
    differ = one ^ many
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    differ &= np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


_SIGNED = T.StructType(
    [
        T.StructField("cls", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SET = T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _class(shingles: np.ndarray) -> int:
    """Number of a class: a 64-bit digest of its set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _signer(width: int):
    def sign(texts: list[str]) -> Iterable[tuple]:
        for text in texts:
            shingles = shingle_set(text, width)
            if len(shingles):
                least = minima(shingles)
                yield _class(shingles), len(shingles), pack_bits(least), band_keys(least)
            else:
                yield None, 0, None, None

    return sign


def _setter(width: int):
    def sets(texts: list[str]) -> Iterable[tuple]:
        for text in texts:
            shingles = shingle_set(text, width)
            yield _class(shingles), shingles.tobytes()

    return sets


# --- links inside one group -------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by ``keys``, one at a time."""
    held: list[pa.RecordBatch] = []
    key: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            own = tuple(c[start] for c in columns)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            key = own
    if held:
        yield pa.Table.from_batches(held)


class _Sets:
    """The full sets of a group. Shingles of one member only are left out of the comparison: nothing shares them."""

    def __init__(self, packed: list[bytes]):
        whole = [np.frombuffer(b, np.uint64) for b in packed]
        self.sizes = np.array([len(w) for w in whole], np.int64)
        _, codes, counts = np.unique(np.concatenate(whole), return_inverse=True, return_counts=True)
        common = counts > 1
        numbers = np.cumsum(common) - 1
        kept = np.split(codes, np.cumsum(self.sizes)[:-1])
        self.codes = [numbers[c[common[c]]] for c in kept]
        self.mark = np.zeros(int(common.sum()) + 1, bool)

    def shared(self, one: int, many: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set and each of several."""
        others = [self.codes[j] for j in many]
        self.mark[self.codes[one]] = True
        running = np.concatenate([[0], np.cumsum(self.mark[np.concatenate(others)], dtype=np.int64)])
        self.mark[self.codes[one]] = False
        ends = np.cumsum([len(o) for o in others])
        return running[ends] - running[np.concatenate([[0], ends[:-1]])]


def _middle(cells: np.ndarray) -> np.ndarray:
    """The commonest value of each cell, packed."""
    nibbles = np.stack([cells & 15, cells >> 4], axis=2).reshape(len(cells), -1)
    common = np.stack([(nibbles == v).sum(axis=0) for v in range(1 << BITS)]).argmax(axis=0).astype(np.uint8)
    return (common[0::2] | (common[1::2] << 4)).view(np.uint64)


TARGET, BOTH, ASKER = 0, 1, 2


def forest(group: pa.Table, low: float, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that unite the members of a group as all its confirmed links would, fewer than it has members.

    Members that ask are compared with the others that lie in another component so far. The packed
    bits rule pairs out, the full sets decide. A pair of two minor members is looked at from its smaller one.
    """
    names, label = group["cls"].to_numpy(), group["component"].to_numpy().copy()
    role, minor = group["role"].to_numpy(), group["minor"].to_numpy(zero_copy_only=False)
    cells = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(names), -1)
    packed, sets, found = cells.view(np.uint64), _Sets(group["shingles"].to_pylist()), []
    targets, askers = np.flatnonzero(role <= BOTH), np.flatnonzero(role >= BOTH)
    if len(askers) > 2:  # the likeliest centres first, so that most others need no comparison of their own
        askers = askers[np.argsort(-estimate(_middle(cells[askers]), packed[askers]), kind="stable")]
    asked = np.zeros(len(names), bool)
    for i in askers:
        some = targets[label[targets] != label[i]]
        # Where both sides ask, the pair is looked at once: in this group by the first, across groups by the smaller name.
        some = some[~asked[some] if role[i] == BOTH else ~minor[some] | (names[some] > names[i])]
        asked[i] = True
        least, most = np.minimum(sets.sizes[some], sets.sizes[i]), np.maximum(sets.sizes[some], sets.sizes[i])
        some = some[100 * least >= percent * most]
        some = some[estimate(packed[i], packed[some]) >= low]
        if not len(some):
            continue
        shared = sets.shared(i, some)
        linked = some[100 * shared >= percent * (sets.sizes[i] + sets.sizes[some] - shared)]
        labels, first = np.unique(label[linked], return_index=True)
        found += [(int(names[i]), int(names[linked[j]])) for j in first]
        label[np.isin(label, labels)] = label[i]
    return found


def _foresters(keys: list[str], low: float, percent: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            found = forest(group, low, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return apply


# --- the graph ------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(cls, component) of classes with links: the smallest class reachable. In each round a class
    takes the smallest label of its neighbours, then the label of that label, until nothing changes."""
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("cls"), F.least("a", "least").alias("component")))
    while True:
        heard = both.join(labels.withColumnRenamed("cls", "b"), "b").select(F.col("a").alias("cls"), "component", F.lit(None).cast("long").alias("old"))
        taken = heard.union(labels.withColumn("old", F.col("component"))).groupBy("cls").agg(F.min("component").alias("next"), F.max("old").alias("old"))
        jump = labels.select(F.col("cls").alias("next"), F.col("component").alias("beyond"))
        moved = checkpoint(taken.join(jump, "next").select("cls", F.least("next", "beyond").alias("component"), "old"))
        labels = moved.drop("old")
        if moved.filter(F.col("component") != F.col("old")).isEmpty():
            return labels


def _candidate_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, n_shingles, signature, shingles) of the wanted classes, each set made from one text.

    Texts are picked in the scan by a bit table of fixed size (at most 2**18 words, whatever the
    data); where it is too full to tell, more texts pass, and the join that uses the sets decides.
    """
    bits = 24
    chosen = checkpoint(classes.join(wanted, "cls", "left_semi").select("cls", "n_shingles", "signature", "text_hash"))
    spot = F.pmod(F.col("text_hash"), F.lit(1 << bits))
    word, bit = F.shiftright(spot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(text_hash, {1 << bits}) % 64 as int))")
    table = chosen.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = docs.select("text", F.xxhash64("text").alias("text_hash")).withColumn("word", F.shiftright(spot, 6))
    picked = rows.join(F.broadcast(checkpoint(table)), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    name = per_text(docs.sparkSession, _setter(width), _SET)
    made = picked.select(name(F.col("text")).alias("made")).select("made.cls", "made.shingles")
    return checkpoint(made.join(chosen.drop("text_hash"), "cls").dropDuplicates(["cls"]))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where their sets of ``width``-word shingles (the whole sequence, if it is
    shorter) have a similarity of ``percent`` or more; ``component_id`` is the smallest doc_id
    reachable and ``kept`` says that it is the row's own. Null and word-less texts have no set and no
    links. Rows without doc_id belong to the component of their text but never name it; a component
    of such rows only has a null id and keeps none. Rows that repeat the smallest id are all kept. An
    empty table gives no rows; other columns are not read.
    """
    signed, classes, labels = _labelled(docs.select("doc_id", "text", F.lit(None).cast("long").alias("row")), width, percent)
    # Classes without links are their own component, so only linked ones meet their labels.
    named = classes.select("cls", F.col("best.doc_id").alias("least")).join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select("cls", "component_id")
    found = signed.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows (doc_id, row, text_hash and the signature), one row a class with its ``best`` row
    (those with an id first, by id, text and row number), and the components of linked classes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.coalesce("text", F.lit("")).alias("text"))
    sign = per_text(docs.sparkSession, _signer(width), _SIGNED)
    signed = checkpoint(docs.select("doc_id", "row", F.xxhash64("text").alias("text_hash"), sign(F.col("text")).alias("s")).select("doc_id", "row", "text_hash", "s.*"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "row")
    same = [F.first(c).alias(c) for c in ("n_shingles", "signature", "bands", "text_hash")]
    classes = checkpoint(signed.filter("cls is not null").groupBy("cls").agg(*same, F.min(order).alias("best")))
    return signed, classes, components(_links(docs, classes, width, percent))


def _blocks(members: DataFrame) -> DataFrame:
    """(bucket, n, blocks): into how many blocks a bucket is cut, so that one holds at most about BLOCK
    members and SHINGLES shingles."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / SHINGLES)).cast("long")
    return members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).select("bucket", "n", blocks.alias("blocks"))


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links between classes, enough of them to give every component."""
    banded = classes.select("cls", "n_shingles", F.explode("bands").alias("bucket"))
    prints = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("mixed"), F.min("cls").alias("one"), F.max("cls").alias("two")
    )
    # Of buckets with the same members one is enough.
    buckets = prints.filter("n > 1").groupBy("n", "mixed", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = checkpoint(banded.join(buckets, "bucket").select("bucket", "cls", "n_shingles", "n"))
    body = _candidate_sets(docs, classes, members.select("cls").distinct(), width)

    # 1. Every class goes once, with its set, to its most crowded bucket.
    home = members.groupBy("cls").agg(F.max(F.struct("n", "bucket")).alias("h"), F.first("n_shingles").alias("n_shingles")).select("cls", "n_shingles", "h.bucket")
    home = checkpoint(home)
    spread = F.xxhash64("cls", "bucket")
    shared = (F.col("blocks") > 1) & (F.pmod(spread, F.col("n")) < 8)  # a few members of all blocks tie them together
    placed = home.join(_blocks(home).filter("n > 1"), "bucket").withColumn(
        "block", F.explode(F.when(shared, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(spread, F.col("blocks")))))
    )
    everyone = placed.select("bucket", "block", "cls", F.col("cls").alias("component"), F.lit(BOTH).alias("role"), F.lit(False).alias("minor"))
    first = _united(everyone, body, ["bucket", "block"], percent)

    # 2. Buckets that still hold several components: all pairs across them that may be linked.
    second = _united(_across(members, components(first)), body, ["bucket", "block", "asker"], percent)
    return first.union(second)


def _united(rows: DataFrame, body: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Forests of all groups. A group is bounded, and a row of it carries its own set only."""
    importable(rows.sparkSession)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.join(body.select("cls", "signature", "shingles"), "cls").repartition(tasks, *keys).sortWithinPartitions(*keys)
    return checkpoint(whole.mapInArrow(_foresters(keys, percent / 100 - MARGIN, percent), "a long, b long"))


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Who meets whom in buckets of several components. The members outside the main component ask; in a bucket of
    several blocks they do so in groups of their own, one for each block of the bucket."""
    labelled = members.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    shares = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("share"), F.sum("n_shingles").alias("shingles"))
    main = shares.groupBy("bucket").agg(
        F.max_by("component", F.struct("share", "component")).alias("main"), F.max_by("shingles", F.struct("share", "component")).alias("main_shingles"),
        F.max("share").alias("share"), F.sum("share").alias("n"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("parts"),
    ).filter("parts > 1")
    cut = lambda n, shingles: F.greatest(F.ceil(F.greatest(n / BLOCK, shingles / SHINGLES)), F.lit(1)).cast("long")
    sized = main.select(
        "bucket", "main", cut(F.col("n"), F.col("shingles")).alias("blocks"), cut(F.col("n") - F.col("share"), F.col("shingles") - F.col("main_shingles")).alias("askers")
    )
    split = labelled.join(sized, "bucket").withColumn("minor", F.col("component") != F.col("main"))
    spread, upto = F.xxhash64("cls", "bucket"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    place = lambda block, asker, role: F.struct(block.alias("block"), asker.alias("asker"), F.lit(role).alias("role"))
    none = F.lit(0).cast("long")
    small = F.array(F.when(F.col("minor"), place(none, none, BOTH)).otherwise(place(none, none, TARGET)))
    target = F.transform(upto("askers"), lambda a: place(F.pmod(spread, F.col("blocks")), a, TARGET))
    asking = F.transform(upto("blocks"), lambda b: place(b, F.pmod(spread, F.col("askers")), ASKER))
    places = F.when(F.col("blocks") == 1, small).when(F.col("minor"), F.concat(target, asking)).otherwise(target)
    return split.select("bucket", "cls", "component", "minor", F.explode(places).alias("p")).select("bucket", "cls", "component", "minor", "p.*")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One text of each component, with its columns as they were, and every row whose text has no set.

    The text with the smallest doc_id stays, where an id has several texts in a component one of them;
    rows that repeat both id and text stay together. Where no row of a component has an id, one stays.
    """
    row, spot = fresh(docs, "row"), fresh(docs, "text_hash")
    # Only rows without id need a key of their own; they are kept by it, so it must not change.
    numbered = checkpoint(docs.filter("doc_id is null").withColumn(row, F.monotonically_increasing_id()))
    identified = docs.filter("doc_id is not null")
    both = identified.select("doc_id", "text", F.lit(None).cast("long").alias("row")).union(numbered.select("doc_id", "text", F.col(row).alias("row")))
    signed, classes, labels = _labelled(both, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "row")
    best = classes.select("cls", "best").join(labels, "cls", "left").groupBy(F.coalesce("component", "cls").alias("component")).agg(F.min("best").alias("best"))
    kept = checkpoint(best.select("best.*").union(signed.filter("cls is null").select(order.alias("best")).select("best.*")))
    ids = kept.filter("not late").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    rows = kept.filter("late").select(F.col("row").alias(row))
    hashed = identified.withColumn(spot, F.xxhash64(F.coalesce("text", F.lit(""))))
    named = hashed.join(ids, (hashed["doc_id"].cast("long") == ids["kept_id"]) & (hashed[spot] == ids["kept_hash"]), "left_semi")
    return named.drop(spot).unionByName(numbered.join(rows, row, "left_semi").drop(row))


def one_row_each(docs: DataFrame) -> DataFrame:
    """The rows with those that repeat both doc_id and text (nulls alike) reduced to one. Only rows of ids that occur
    more than once are exchanged with their texts."""
    key = fresh(docs, "repeated")
    often = checkpoint(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(key)))
    same = docs["doc_id"].eqNullSafe(often[key])
    return docs.join(often, same, "left_anti").unionByName(docs.join(often, same, "left_semi").dropDuplicates(["doc_id", "text"]))
