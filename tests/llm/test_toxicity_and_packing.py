"""Toxic passages and packing against brute force, over the registered queries where SQL has no say."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import packing, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
has_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def brute_segments(weights):
    """Best interval by trying all ends."""
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    return max((sums[b] - sums[a] for a in range(len(sums)) for b in range(a + 1, len(sums))), default=0.0)


def plain_toxicity(docs, labels):
    """The scores from their definitions; only the root finding and the Newton steps are the library's."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and not held(i):
            known[i] = max(known.get(i, 0), int(toxic > 0))
    texts = {}
    for i, text in docs:
        if i in known:
            texts[i] = max(texts.get(i, ""), text or "")
    kinds = lambda text: {t.strip(toxicity.EDGES) for t in text.lower().split()}
    t, c, every = Counter(), Counter(), Counter()
    for i, text in texts.items():
        (t if known[i] else c).update(kinds(text))
    for _, text in docs:
        every.update(kinds(text or ""))
    n_t, n_c, n_all = sum(t.values()), sum(c.values()), sum(every.values())
    weights, clean = {}, {}
    for token in t.keys() | c.keys():
        prior = toxicity.PRIOR * every[token] / n_all + toxicity.FLOOR
        odds = [math.log((k[token] + prior) / (n + toxicity.PRIOR - k[token] - prior)) for k, n in ((t, n_t), (c, n_c))]
        if abs(odds[0] - odds[1]) / math.sqrt(1 / (t[token] + prior) + 1 / (c[token] + prior)) >= toxicity.CLEAR:
            weights[token] = odds[0] - odds[1]
            clean[token] = (c[token] + prior) / (t[token] + c[token] + 2 * prior)
    rate = toxicity._rate([(w, every[token] * clean[token] / n_all) for token, w in weights.items()], toxicity.DRIFT)

    def best(text):
        tokens = text.lower().split()
        of = np.array([weights.get(x.strip(toxicity.EDGES), -toxicity.DRIFT) for x in tokens])
        # Only stretches between and around positive weights matter; all ends are tried on short texts.
        return (max(brute_segments(of), 0.0) if len(of) < 120 else max((s for _, _, s in toxicity.segments(of)), default=0.0)), len(tokens)

    maxima = [best(text or "") for _, text in docs]
    found = Counter((n.bit_length() - 1, math.ceil(b / toxicity.BIN) * toxicity.BIN) for b, n in maxima if n)

    class Rows:
        def collect(self):
            return [{"length": length, "best": b, "n": k} for (length, b), k in found.items()]

    scale, growth = toxicity.fit_extremes(Rows(), rate)

    def evidence(text):
        b, n = best(text)
        expected = scale * max(1, n) ** growth * math.exp(-rate * b)
        value = -math.log(1 - math.exp(-expected)) if expected > 1e-9 else -math.log(expected)
        return value if value <= toxicity.CERTAIN else toxicity.CERTAIN + math.log(1 + value - toxicity.CERTAIN)

    rows = np.array(sorted((evidence(text), known[i]) for i, text in texts.items()))
    bias, slope = toxicity._logistic(rows[:, 0], rows[:, 1])
    score = lambda text: 1 / (1 + math.exp(-(bias + max(slope, 0) * evidence(text))))
    return weights, (rate, scale, growth, bias, max(slope, 0.0)), [(i, held(i), score(text or "")) for i, text in docs]


@has_tables
def test_toxicity_query_matches_definitions(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    weights, numbers, wanted = plain_toxicity(docs, labels)
    model = toxicity.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert model.weights == pytest.approx(weights) and (model.rate, model.scale, model.growth, model.bias, model.slope) == pytest.approx(numbers)
    found = sorted((r.doc_id, r.held_out, r.score) for r in queries.REGISTRY["op10_toxicity"](spark, FOLDER).collect())
    wanted = sorted(wanted)
    assert [f[:2] for f in found] == [w[:2] for w in wanted]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in wanted], abs=1e-6)


def test_an_id_that_fills_a_third_teaches_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"], 12)) + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.union(once.filter("doc_id = 8").withColumn("doc_id", F.explode(F.array_repeat("doc_id", 100))))
    sizes = toxicity.token_counts(once.filter("doc_id % 5 <> 0").withColumn("toxic", F.lit(1)).select("text", "toxic"), once).filter("token = 'vile'").first()
    assert sizes.every == 50 and sizes.c == 0
    one, two = toxicity.learn(once, labels), toxicity.learn(often, labels)
    assert set(one.weights) == set(two.weights) == {"vile"} and two.weights["vile"] == pytest.approx(one.weights["vile"], abs=0.7)
    scores = [(r.score, r.doc_id % 4 == 0) for r in toxicity.toxic_passages(often, two).collect()]
    assert min(s for s, toxic in scores if toxic) > max(s for s, toxic in scores if not toxic)


def test_extreme_values_are_fitted_by_length():
    """Counts drawn from the law itself give its scale and growth back."""

    class Rows:
        def collect(self):
            rows, rng = [], np.random.default_rng(1)
            for length in range(3, 12):
                n = 1.5 * 2**length
                u = rng.random(4000)
                best = (math.log(0.02 * n**0.8) - np.log(-np.log(u))) / 0.7
                for b, k in Counter(np.ceil(np.maximum(best, 0) / toxicity.BIN) * toxicity.BIN).items():
                    rows.append({"length": length, "best": float(b), "n": k})
            return rows

    scale, growth = toxicity.fit_extremes(Rows(), 0.7)
    assert growth == pytest.approx(0.8, abs=0.08) and math.log(scale) == pytest.approx(math.log(0.02), abs=0.4)
    assert toxicity.fit_extremes(type("No", (), {"collect": lambda self: []})(), 1.0) == (0.1, 1.0)


# --- packing ---------------------------------------------------------------------------------------


def packed_well(rows, encoded, capacity=1024):
    """Every id in one piece, right checksums, gapless sequences; the padding they need."""
    pieces, places = Counter(), {}
    for r in rows:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    by_doc = {}
    for (doc_id, start, length, crc, total), n in pieces.items():
        by_doc.setdefault(doc_id, []).append((start, length, crc, total, n))
    for doc_id, ids in encoded.items():
        at = 0
        for start, length, crc, total, n in sorted(by_doc.pop(doc_id)):
            assert start == at and total == len(ids) and n == 1
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not by_doc
    padding = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, encoded.values()))


@has_tables
def test_packing_query_keeps_every_id_and_pads_little(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    encoded = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    assert packed_well(queries.REGISTRY["op4_packing"](spark, FOLDER).collect(), encoded) < 0.003


def test_repeated_rows_and_ids_are_torn_apart_rightly(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    texts = ["one two three " * 90, "four five " * 300, "six", "", None, "seven " * 2000]
    rows = [(i % 4 if i % 5 else None, texts[i % len(texts)]) for i in range(60)] + [(1, texts[0])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("rank", F.lit("clash"))
    found = packing.pack_documents(docs, with_ids=True).collect()
    tokens = Counter()
    for _, text in rows:
        tokens.update([*library.encode(text or "", add_special_tokens=False).ids, 0])
    assert Counter(i for r in found for i in r.ids) == tokens
    places = {}
    for r in found:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        total = sum(n for _, n in spans)
        assert [o for o, _ in sorted(spans)] == [sum(n for o, n in spans if o < p) for p, _ in sorted(spans)] and total <= 1024


def test_torn_rest_has_no_padding():
    rng = np.random.default_rng(2)
    for _ in range(30):
        left = Counter({int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 65, 5)})
        sizes, seen = Counter(), Counter()
        for length, number, start, end, sequence, offset in packing.tear(left, 64, 7):
            assert sequence >= 7 and sizes[sequence] == offset
            sizes[sequence] += end - start
            seen[length, number] += end - start
        assert seen == {(n, k): n for n, c in left.items() for k in range(c)}
        assert all(size == 64 or size & (size - 1) == 0 for size in sizes.values())


def test_files_whose_ids_do_not_follow_their_rules_are_refused(tmp_path):
    import json

    config = json.load(open(packing.default_path(), encoding="utf-8"))
    vocab, merges = config["model"]["vocab"], config["model"]["merges"]
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges[:2]]
    vocab[joined[0]], vocab[joined[1]] = vocab[joined[1]], vocab[joined[0]]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(config))
    with pytest.raises(ValueError, match="order of its merge rules"):
        packing.QuickBpe(str(path))
