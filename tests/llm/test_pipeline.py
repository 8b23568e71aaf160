"""The pipeline against a plain version, and the registered queries that SQL cannot express."""

import os
from collections import defaultdict

import pytest
from test_small_cases import brute_components

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import bag, connect
from sensorloom.llm import bpe, lines, packing, quality, queries, secret_scan

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def test_operators_and_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.REGISTRY)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    frame = queries.REGISTRY[name](spark, FOLDER)
    found = bag(frame.columns, [tuple(r) for r in frame.collect()])
    result = connect(FOLDER).execute(queries.ORACLE[name])
    assert found == bag([c[0] for c in result.description], result.fetchall())


def plain_quality(text):
    values = dict(zip(quality.MEASURES, quality._measure(text)))
    failed = {name for name, rule in quality.RULES if eval(rule.replace(" OR ", " or "), {}, values)}  # noqa: S307
    policy = quality.POLICIES[quality.CURRENT]
    return not failed & set(policy.hard) and len(failed & set(policy.soft)) < policy.limit


def plain_lines(docs):
    sites, first = defaultdict(set), {}
    for i, (text, source) in sorted(docs.items()):
        for at, line in enumerate(text.split("\n")):
            if len(line) >= lines.MIN_CHARS and line.split():
                sites[line].add(source)
                first.setdefault(line, (i, at))
    gone = {line for line, s in sites.items() if len(s) >= lines.MIN_SITES}
    return {i: ("\n".join(x for at, x in enumerate(t.split("\n")) if x not in gone or first[x] == (i, at)), s) for i, (t, s) in docs.items()}


def test_pipeline_matches_plain_version(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    docs = plain_lines({i: d for i, d in docs.items() if plain_quality(d[0])})
    groups = brute_components({i: t for i, (t, _) in docs.items()}, 5)
    docs = {i: d for i, d in docs.items() if groups[i][1] == i}
    kept = spark.createDataFrame([(i, t) for i, (t, _) in docs.items()], "doc_id long, text string")
    scan = secret_scan._scanner(secret_scan.learn(kept))
    masked = {i: text if found is None else found for (i, (text, _)), (_, found) in zip(docs.items(), scan([t for t, _ in docs.values()]))}
    wanted = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == wanted
    found, places = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for spans, ends in ((found, wanted), (places, None)):
        for key, listed in spans.items():
            at = 0
            for start, length in sorted(listed):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= packing.CAPACITY
