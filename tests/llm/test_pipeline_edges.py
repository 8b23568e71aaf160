"""The stages of the pipeline on nulls, repeated rows, clashing names and an empty table."""

from collections import Counter

import numpy as np

import corpus_pipeline
from sensorloom.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_RNG = np.random.default_rng(1)
_WORDS = [f"{a}{b}{c}" for a in ("ber", "tal", "mon", "ris", "fel") for b in ("an", "er", "ol", "ic") for c in ("ta", "den", "mo", "ly", "sh")]
PROSE = "\n".join(" ".join(_RNG.choice(_WORDS, 14)) + "." for _ in range(14))
OTHER = "\n".join(" ".join(_RNG.choice(_WORDS, 14)) + "." for _ in range(14))


def rows():
    texts = [(1, PROSE), (2, PROSE + " Some more."), (3, OTHER), (3, OTHER), (None, OTHER + " Some more."), (None, None), (5, None), (6, ""), (7, "short")]
    return [(i, t, "en", None if i == 3 else "a", None if t is None else len(t)) for i, t in texts]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    for name, value in (("row", 1), ("cls", 2), ("removed", 3), ("secrets", 4), ("repeated", 5), ("failed", 6)):
        docs = docs.withColumn(name, corpus_pipeline.minhash.F.lit(value))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "repeated" in docs.columns
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert kept["quality_rules"] == kept["line_dedup"] == {1: 1, 2: 1, 3: 2, None: 1}
    assert kept["near_duplicates"] == kept["secret_scans"] == {1: 1, 3: 1}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {1, 3} and all(r.length <= 1024 for r in packed)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_each(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "a"), (None, None), (3, None), (3, None)], "doc_id long, text string")
    assert Counter(tuple(r) for r in minhash.one_row_each(docs).collect()) == Counter({(1, "a"): 1, (1, "b"): 1, (2, "a"): 1, (None, "a"): 1, (None, None): 1, (3, None): 1})
