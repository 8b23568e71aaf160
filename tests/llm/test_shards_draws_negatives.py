"""Sharding, importance resampling and hard negatives on small tables, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import importance, negatives, sharding

DOCS = "doc_id long, text string, lang string, source string"
LONG_TEXT = "Ein langes Wort " * 20_000
EDGE = [(1, None, None, "a"), (2, "", "x", "a"), (None, "x y", "x", None), (3, "x y", "x", "a"), (3, "x y", "x", "a"), (4, "Ünïcode Straße\n\t", "x", "a"), (5, LONG_TEXT, "x", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    clash = ("row", "record", "vslot", "shard", "piece", "slot", "bucket", "rank", "score", "n_words", "asks", "held")
    return spark.createDataFrame(EDGE, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 11 sharding ----------------------------------------------------------------------


def test_shards_of_odd_rows(spark, edge, empty):
    rows = sharding.shard_report(edge).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in EDGE)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert sharding.shard_report(empty).count() == 0


def test_a_row_that_fills_a_third_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 7)  # several pieces a slot
    monkeypatch.setattr(sharding, "SLOTS", 64)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 9).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    found = sharding.shard_report(rows.repartition(5)).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert len(found) == 16 and sum(r.n for r in found) == 6000
    assert all(r.last == r.n - 1 == r.slots - 1 for r in found)
    assert max(r.bytes for r in found) < 1.1 * min(r.bytes for r in found)


def test_map_versions_move_few_slots(spark, tmp_path):
    sizes = spark.range(sharding.SLOTS).select(F.col("id").alias("slot"), (F.col("id") % 97 + 1).alias("bytes"), F.lit(1).cast("long").alias("n"))
    first = sharding.edit_map(sizes, 16)
    assert sharding.save_map(first, str(tmp_path / "map")) == 1
    loads = lambda m: [r[0] for r in m.join(sizes, "slot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert first.count() == sharding.SLOTS and len(loads(first)) == 16 and max(loads(first)) - min(loads(first)) <= 97
    grown = sharding.edit_map(sizes, 17, first)
    moved = grown.join(first.select("slot", F.col("shard").alias("before")), "slot").filter("shard <> before")
    assert len(loads(grown)) == 17 and max(loads(grown)) < 1.05 * min(loads(grown)) and moved.count() < sharding.SLOTS / 10
    assert sharding.save_map(grown, str(tmp_path / "map")) == 2
    same = sharding.edit_map(sizes, 17, grown)
    assert same.select("slot", "shard").exceptAll(grown.select("slot", "shard")).count() == 0  # nothing to mend
    shrunk = sharding.edit_map(sizes, 12, grown)
    assert len(loads(shrunk)) == 12 and max(loads(shrunk)) < 1.1 * min(loads(shrunk))
    assert sharding.load_map(spark, str(tmp_path / "map"), 1).exceptAll(first.select("version", "slot", "shard")).count() == 0
    assert sharding.load_map(spark, str(tmp_path / "map")).select("version").distinct().collect()[0][0] == 2
    with pytest.raises(Exception, match="already exists"):
        sharding.save_map(first, str(tmp_path / "map"))


def test_documents_go_where_the_map_says(spark, edge):
    slotted = sharding.with_slots(sharding.records(edge.dropDuplicates(["doc_id", "text"])))
    mapping = sharding.edit_map(sharding.slot_bytes(slotted), 16)
    wanted = {r.doc_id: r.shard for r in slotted.join(mapping, F.col("vslot") == F.col("slot")).collect()}
    placed = sharding.shard_documents(edge, mapping)
    assert placed.columns == [*edge.columns, "shard_"]
    assert all(r.shard_ == wanted[r.doc_id] for r in placed.collect()) and placed.count() == len(EDGE)


def test_sharding_runs_no_python(spark, edge):
    plan = sharding.shard_report(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- 12 importance resampling ----------------------------------------------------------


def plain_words(text):
    return "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 or c.isdigit() and c.isascii() else " " for c in text or "").split(" ")


def plain_resample(docs, target, percent=25):
    def buckets(text):
        words = [w for w in plain_words(text) if w]
        return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    source, aim = Counter(), Counter()
    for _, text in docs:
        source.update(buckets(text)[1])
    for text in target:
        aim.update(buckets(text)[1])
    s_all, t_all = sum(source.values()) + 10_000, sum(aim.values()) + 10_000
    rows = []
    for doc_id, text in docs:
        words, found = buckets(text)
        gain = [math.floor(1000 * math.log((aim[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in found]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return Counter(map(tuple, rows))


def test_resampling_matches_brute_force(spark, edge, empty):
    rng = np.random.default_rng(4)
    vocabulary = [f"Wort{i}" for i in range(50)] + ["É-é", "x", "A1b2", "ß"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(300)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (1000, None), (1001, ""), (1002, "... --- ..."), (1003, LONG_TEXT)]
    target = [" ".join(vocabulary[:9]), None, ""]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("score", F.lit("clash"))
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(made, aim)
    assert Counter(tuple(r) for r in found.collect()) == plain_resample(docs, target)
    drawn = importance.draw(made, aim)
    assert drawn.columns == made.columns and set(r.doc_id for r in drawn.collect()) == {r.doc_id for r in found.filter("rank is not null").collect()}
    assert importance.resample(edge, aim).count() == len(EDGE)
    assert importance.resample(empty, aim).count() == 0
    assert importance.resample(made, aim.limit(0)).count() == len(docs)


def test_ties_at_the_cut_go_to_smaller_ids(spark):
    rows = spark.range(400).select((399 - F.col("id")).alias("doc_id"), F.lit("same words " * 15).alias("text"))
    aim = spark.createDataFrame([("words",)], "text string")
    scores = {r.doc_id: (r.score, r["rank"]) for r in importance.resample(rows.repartition(7), aim).collect()}
    order = sorted(scores, key=lambda i: (-scores[i][0], i))
    assert [scores[i][1] for i in order] == [*range(1, 101), *[None] * 300]


def test_chained_checksums():
    words = [b"ab", b"\xc3\xa9", b"c3"]
    assert importance.buckets_of(words, grams=3).tolist() == [zlib.crc32(f) % 10_000 for f in (*words, b"ab \xc3\xa9", b"\xc3\xa9 c3", b"ab \xc3\xa9 c3")]
    assert importance.buckets_of([], grams=3).tolist() == [] and len(importance.buckets_of([b"a"], grams=3)) == 1


# --- 13 hard negatives -------------------------------------------------------------------


@pytest.mark.parametrize("width, top", [(1, 3), (64, 200), (700, 40_000), (3, 2**29)])
def test_residue_products_are_exact(width, top):
    rng = np.random.default_rng(width)
    one, two = rng.integers(-top, top + 1, (17, width)), rng.integers(-top, top + 1, (23, width))
    one[0], two[0] = top, -top
    bound = int(max((one.astype(object) ** 2).sum(axis=1).max(), (two.astype(object) ** 2).sum(axis=1).max()))
    found = negatives.product(one, two, negatives.plan_primes(width, bound))
    assert (found == one.astype(object) @ two.astype(object).T).all()


def plain_negatives(rows):
    whole = [(k, i, y, [math.floor(256 * x) for x in v]) for k, (i, y, v) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: math.inf if i is None else i
    found = []
    for k, i, y, v in whole:
        if i is None or i % 100:
            continue
        scored = sorted((-dot(v, w), last(j), m, z) for m, j, z, w in whole if m != k)
        for place, (positive, j, _, _) in enumerate([s for s in scored if s[3] == y][:5]):
            some = [s for s in scored if s[3] != y and -80 * positive <= -100 * s[0] <= -100 * positive][:5]
            found += [(i, None if j == math.inf else j, r + 1, None if s[1] == math.inf else s[1], -positive, -s[0]) for r, s in enumerate(some)]
    return Counter(found)


@pytest.mark.parametrize("least, cells, tile", [(1024, 1 << 22, 2048), (16, 8 * 20, 7)])
def test_negatives_match_brute_force(spark, monkeypatch, least, cells, tile):
    monkeypatch.setattr(negatives, "LEAST_ROWS", least)
    monkeypatch.setattr(negatives, "MOST_CELLS", cells)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), [float(x) for x in base[int(rng.integers(6))] + rng.normal(size=8) * 0.2]) for i in range(420)]
    rows += [(900, 1, [0.0] * 8), (901, 2, [0.0] * 8), (1000, 7, [1.0] * 8), (1100, 1, [0.5, 0.5])]
    rows += [(None, 1, rows[5][2]), (100, 1, rows[100][2]), (100, 1, rows[100][2]), (5, 2, rows[5][2]), (8, None, rows[1][2])]
    rows += [(1200, 1, None), (1300, 1, [float("nan")] * 8), (1400, 2, [None, 1.0]), (1500, 2, [float("inf")] * 8), (1600, 1, [])]
    rows += [(2000 + i, 2, rows[7][2]) for i in range(60)]  # a common vector
    made = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5).withColumn("row", F.lit("clash"))
    found = negatives.hard_negatives(made, F.col("vec_id") % 100 == 0)
    assert Counter(tuple(r)[:6] for r in found.collect()) == plain_negatives(rows)
    assert negatives.hard_negatives(made.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError, match="fit a long"):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e12])], "vec_id long, label int, embedding array<double>"), F.lit(True))
