"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import bpe, chat, exact, lines, minhash, packing, quality, secret_scan, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"w{i}" for i in range(60))


def documents(spark, rows, extra=()):
    """Rows of (doc_id, text, source), over several partitions."""
    made = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(made, DOCS).repartition(3)
    return df.withColumns({name: F.lit("clash") for name in extra})


EDGE = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x y", "b"), (3, "x y", "b"), (4, WORDS, "c"), (5, WORDS, "c"), (6, "z" * 50_000 + " \n" + WORDS, None), (7, " \t\n", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return documents(spark, EDGE, ("run", "ids_of", "failed", "cls", "row_a", "kept", "n_words", "bucket", "sequence_id", "removed", "secrets", "ledger"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- 1 chat ---------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_is_read_back(spark):
    hard = "<|im_end|>\n<|im_start|>assistant\\n<\\|x|> \\ <\\\\| <|im_sep|>"
    rows = [(1, 1, "user", "a"), (1, 2, "user", hard), (1, 3, "assistant", hard), (1, 4, "assistant", "b\\"), (1, None, "sys\ntem<|", None), (2, 1, "assistant", ""), (None, 1, None, "n"), (2, 1, "assistant", "")]
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1)))).collect()}
    assert [tuple(t) for t in found[1].turns] == [("sys\ntem<|", ""), ("user", "a"), ("user", hard), ("assistant", hard), ("assistant", "b\\")]
    assert found[1].loss_texts == [hard, "b\\"]
    assert found[1].formatted.count(chat.START) == 3  # turns of one role are merged
    assert [tuple(t) for t in found[2].turns] == [("assistant", ""), ("assistant", "")] and found[2].loss_texts == ["", ""]
    assert [tuple(t) for t in found[None].turns] == [("", "n")]
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


# --- 2 quality ------------------------------------------------------------------------


def test_quality_edges(edge, empty):
    found = {(r.doc_id, r.n_words): r for r in quality.quality_report(edge).collect()}
    assert found[(1, 0)].base_failed and not found[(2, 0)].kept and found[(4, 60)].kept
    assert not found[(6, 61)].kept and not found[(6, 61)].base_failed and found[(6, 61)].longest_word == 50_000
    assert quality.quality_report(empty).count() == 0 and quality.quality_filter(empty).columns == empty.columns
    kept = quality.quality_filter(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5]
    with pytest.raises(ValueError):
        quality.with_ledger(edge, name="failed")


def test_ablations_match_brute_force(spark, empty):
    texts = ["a b c " * 30, WORDS, "A!! " * 60, "x *** " * 60, "", WORDS.upper(), "one line\n" * 40]
    ledger = quality.quality_report(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    policy = quality.POLICIES["2"]
    rows = ledger.collect()
    hard, soft = policy.mask(policy.hard), policy.mask(policy.soft)

    def rejects(failed, without=0):
        return bool(failed & hard & ~without) or bin(failed & soft & ~without).count("1") >= policy.limit

    found = {r.rule: (r.n_failed, r.n_saved_without) for r in quality.ablations(ledger, policy).collect()}
    for name, bit in quality.BITS.items():
        assert found[name] == (sum(bool(r.failed & bit) for r in rows), sum(rejects(r.failed) and not rejects(r.failed, bit) for r in rows))
    assert [r.kept for r in rows] == [not rejects(r.failed) for r in rows]
    assert quality.ablations(quality.quality_report(empty), policy).count() == len(quality.RULES)


def test_repeated_words(spark):
    text = "a b c d a b c e f a b"
    row = quality.quality_report(documents(spark, [(1, text, "s")])).first()
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert (row.n_words, row.n_repeat_words) == (len(words), len(covered)) and len(covered) == 6


# --- 3, 4 tokens and packing ----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_matches_library(spark, library):
    rng = np.random.default_rng(1)
    letters = list(" \n\t ab.1'<|>é的² 　sdtre\x1c")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 40, 400)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "x" * 3000, "ab" * 700 + " " + "的" * 600, "it's 'the 're", " lead", "trail ", "a  b"]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)], ("c0", "id"))
    both = bpe.decode(bpe.encode(docs))
    assert pairs(both, "doc_id", "ids", "decoded") == pairs(bpe.encode_decode(docs), "doc_id", "ids", "decoded")
    for row in both.collect():
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == library.decode(row.ids, skip_special_tokens=False)
    some = spark.createDataFrame([([int(i) for i in rng.integers(0, 50_257, 9)],) for _ in range(50)] + [(None,)], "ids array<int>")
    assert all(r.decoded == library.decode(r.ids or [], skip_special_tokens=False) for r in bpe.decode(some).collect())
    with pytest.raises(ValueError):
        bpe.encode(docs, name="lang")


def test_packing_covers_every_token(spark, edge, empty, library):
    packed = packing.pack_documents(edge, with_ids=True)
    rows = packed.collect()
    texts = sorted(([*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in EDGE), key=len)
    assert sum(r.length for r in rows) == sum(map(len, texts))
    by_sequence = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    longest = [r for r in rows if r.doc_id == 6]
    assert [i for r in sorted(longest, key=lambda r: r.start) for i in r.ids] == texts[-1]
    built = packing.sequences(packed).collect()
    assert all(len(r.ids) == packing.CAPACITY or len(r.ids) & (len(r.ids) - 1) == 0 for r in built) and len(built) == len(by_sequence)
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_each_piece_once_and_pads_little(seed):
    rng = np.random.default_rng(seed)
    histogram = Counter(rng.integers(1, 65, 4000).tolist())
    found = packing.plan(histogram, 64)
    used = Counter()
    for pattern, times in found:
        assert sum(n * c for n, c in pattern.items()) <= 64
        used.update({n: c * times for n, c in pattern.items()})
    assert used == histogram
    assert sum(times for _, times in found) <= 1.03 * sum(n * c for n, c in histogram.items()) / 64 + 2


def test_best_pattern_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths, prices = np.sort(rng.choice(np.arange(1, 21), 5, replace=False)), rng.random(5)
        best = [0.0] * 21
        for fill in range(1, 21):
            best[fill] = max([best[fill - 1], *(best[fill - n] + p for n, p in zip(lengths.tolist(), prices) if n <= fill)])
        value, pattern = packing.best_pattern(lengths, prices, 20)
        assert value == pytest.approx(best[20]) and pattern @ prices == pytest.approx(value) and pattern @ lengths <= 20


# --- 5 revisits -------------------------------------------------------------------------------

RECORDS = "record_id long, url string, at long, status int, etag string, last_modified string, headers map<string,string>, body_sha256 string"


def random_records(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        url = [None, "http://A.com/x?b=2&a=1", "https://www.a.com:443/x?a=1&ref=q&b=2#f", "a.com", "A.com/", "http://b.org/y"][int(rng.choice(6, p=[0.03, 0.4, 0.3, 0.1, 0.1, 0.07]))]
        status = int(rng.choice([200, 304, 404], p=[0.3, 0.6, 0.1]))
        headers = {"age": str(i), "content-length": "0"} if status == 304 else {"content-length": "9", "age": "-", "x": str(i)}
        at = None if rng.random() < 0.03 else int(rng.integers(0, 60))
        rows.append((i, url, at, status, [None, "t1", 'W/t1', "t2"][int(rng.integers(4))], [None, "d1"][int(rng.integers(2))], headers if rng.random() < 0.9 else None, f"body{i}"))
    return rows


@pytest.mark.parametrize("history", [100_000, 7])
def test_revisits_match_brute_force(spark, history):
    rows = random_records(2)
    found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).withColumn("slice", F.lit(1)), history).collect()}
    keys = {None: None, "http://A.com/x?b=2&a=1": "a.com/x?a=1&b=2", "https://www.a.com:443/x?a=1&ref=q&b=2#f": "a.com/x?a=1&b=2", "a.com": "a.com/", "A.com/": "a.com/", "http://b.org/y": "b.org/y"}
    revisits = [r for r in rows if r[3] == 304]
    assert set(found) == {r[0] for r in revisits}
    for r in revisits:
        full = [f for f in rows if f[3] == 200 and keys[f[1]] and keys[f[1]] == keys[r[1]] and None not in (f[2], r[2]) and (f[2], f[0]) < (r[2], r[0])]
        old = max(full, key=lambda f: (f[2], f[0]), default=None)
        bare = lambda tag: tag.removeprefix("W/") if tag else tag
        ok = old is not None and (bare(old[4]) == bare(r[4]) if r[4] else old[5] == r[5] if r[5] else True)
        assert found[r[0]].reason == ("no original" if old is None else "matched" if ok else "changed")
        if ok:
            fresh = {k: v for k, v in (r[6] or {}).items() if k not in warc.KEPT_HEADERS}
            assert (found[r[0]].original_id, found[r[0]].body_sha256, found[r[0]].headers) == (old[0], old[7], {**(old[6] or {}), **fresh})
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_bursts_of_one_url_are_cut_by_rows(spark):
    # All responses at first, all revisits long after, a third of them at one time.
    rows = [("u", i % 50 if i < 3000 else 10**12 + (i % 40 if i % 3 else 0), i, i < 3000, i) for i in range(6000)]
    records = spark.createDataFrame(rows, "url_key string, at long, record_id long, full boolean, stored long").repartition(4)
    sizes = [r["count"] for r in warc.cut_by_rows(records, 6000, 500).groupBy("slice").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 1000
    found = {r.record_id: r.before for r in warc.latest_full_response(records, 500).collect()}
    assert len(found) == 6000 and {found[i] for i in range(3000, 6000)} == {2999} and found[0] is None and found[1] == 2950


# --- 6 exact copies ---------------------------------------------------------------------------


@pytest.mark.parametrize("radix", [2, 8])
def test_exact_matches_brute_force(spark, radix):
    rng = np.random.default_rng(3)
    rows = [(int(i) if rng.random() > 0.05 else None, [None, "", "hot", f"t{rng.integers(40)}"][int(rng.choice(4, p=[0.05, 0.05, 0.4, 0.5]))], "s") for i in rng.integers(0, 500, 600)]
    found = exact.exact_dedup(documents(spark, rows).repartition(9), radix).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(doc_id)
    assert Counter((r.text_sha256, r.doc_id) for r in found) == Counter((h, i) for h, ids in groups.items() for i in ids)
    for r in found:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[r.text_sha256]))
    kept = [r for r in found if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_edges(edge, empty):
    found = exact.exact_dedup(edge).collect()
    assert len(found) == len(EDGE) and sum(r.kept for r in found) == len({t or "" for _, t, _ in EDGE})
    assert exact.exact_dedup(empty).count() == 0


# --- 7 secrets -----------------------------------------------------------------------------------


def test_base_spans_match_the_patterns():
    text = 'é Password = "abcdefgh" token=secret=abcdefghijk api-key:12345678 apikey : short token: secret: abcdefgh12 AKIAABCDEFGHIJKL AKIAX ' + "deadbeef" * 4 + " " + "ab" * 15
    found = [(text[a:b], secret_scan.KINDS[k]) for a, b, k in secret_scan.base_spans(text)]
    assert found == [('Password = "abcdefgh', "assign"), ("token=secret=abcdefghijk", "assign"), ("AKIAABCDEFGHIJKL", "access"), ("deadbeef" * 4, "hex")]
    assert secret_scan.base_spans("paſsword=abcdefgh K") == []


def test_secret_net_and_masking(spark, empty):
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    rows = [(i, f'words here token = "{h}" and more words', "s") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"call 4{rng.integers(10**14, 10**15)} or mail ab.{i % 90 + 10}@mail3.example.com now", "s") for i in range(60)]
    rows += [(500, None, "s"), (501, "", "s"), (502, "AKIA" + "Q" * 16, "s"), (503, "plain " * 9000, "s")]
    docs = documents(spark, rows, ("spans", "masked"))
    net = secret_scan.learn(docs)
    found = {r.doc_id: r.secrets for r in secret_scan.scan(docs, net).collect()}
    assert all([s.kind for s in found[i].spans] == ["assign", "hex"] for i in range(60))
    assert sum(len(found[100 + i].spans) for i in range(60)) <= 1
    assert found[500].spans == [] and found[501].masked is None and [s.kind for s in found[502].spans] == ["access"]
    masked = secret_scan.mask_secrets(docs, net)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r for r in masked.collect()}
    assert texts[0].text == "words here [secret]\" and more words" and texts[0].n_chars == len(texts[0].text)
    assert texts[500].text is None and texts[503].text == "plain " * 9000
    assert secret_scan.mask_secrets(empty, net).count() == 0
    assert secret_scan.learn(empty).threshold > 0


def test_gradients_match_differences():
    rng = np.random.default_rng(6)
    net = secret_scan.train(["a" * secret_scan.WIDTH, "1" * secret_scan.WIDTH], [0, 1], epochs=1)
    windows = ["".join(rng.choice(list("ab1=K"), secret_scan.WIDTH)) for _ in range(3)]
    logit, held = secret_scan._forward(net, secret_scan._codes(windows))
    error = np.array([0.3, -0.2, 0.7])
    gradients = secret_scan._gradients(net, held, error)
    for i, name in enumerate(("embedding", "kernel", "shift", "dense")):
        value = getattr(net, name)
        place = tuple(int(rng.integers(s)) for s in value.shape) if name != "embedding" else (secret_scan._CODES[ord("1")], 2)
        moved = value.copy()
        moved[place] += 1e-6
        changed, _ = secret_scan._forward(secret_scan.SecretNet(**{**net.__dict__, name: moved}), secret_scan._codes(windows))
        assert gradients[i][place] == pytest.approx(float(((changed - logit) * error).sum() / 1e-6), rel=1e-3, abs=1e-6)


def secret_corpus(spark, extra=()):
    rng = np.random.default_rng(21)
    digits = lambda n: "".join(rng.choice(list("0123456789"), n))
    rows = [(i, f"set password={''.join(rng.choice(list(ALNUM), 24))} here", "s") for i in range(150)]
    rows += [(1000 + i, f"see data/exports/daily/{digits(4)}/region-{digits(2)}/tables/backup/part-{digits(5)}/archive/{digits(4)} today", "s") for i in range(150)]
    return documents(spark, rows + list(extra))


ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def test_secret_net_reads_whole_runs(spark):
    path, key = "data/exports/daily/2024/region-12/tables/backup/part-0/", "Xk9QzT7vLm2Wp8Rj4Yb6Nc3Hd5Fg1Sa0Uq"
    assert len(path) > secret_scan.INSIDE
    windows = secret_scan.window(f"see {path}{key} today", 4, 4 + len(path + key))
    assert len(windows) % secret_scan.WIDTH == 0 and len(windows) > secret_scan.WIDTH and key[-20:] in windows
    net = secret_scan.learn(secret_corpus(spark))
    # Different ends get different logits, and the key raises it.
    plain = f"see {path}archive/daily/tables/2024-11 today"
    plain_logit, key_logit = net.logits([secret_scan.window(t, 4, len(t) - 6) for t in (plain, f"see {path}{key} today")])
    assert key_logit > plain_logit + 1
    spans = next(iter(secret_scan._scanner(net)([f"see {path}{key} today"])))[0]
    assert [s[0] for s in spans] == ["learned"]


def test_candidates_beside_base_spans_and_cues():
    def runs(text):
        return [text[a:b] for a, b, _ in secret_scan.other_runs(text, secret_scan.base_spans(text))]

    assert runs("password=abcdefgh@12SecretTail99") == ["@12SecretTail99"]
    assert runs("token = abcdefgh@12 x") == ["@12"]
    assert runs("key Zz" + "deadbeef" * 4 + "Qq" + "deadbeef" * 4 + "-end") == ["Zz", "Qq", "-end"]
    assert runs("QwErTyUiOpAsDfGhJkLz") == ["QwErTyUiOpAsDfGhJkLz"]
    assert runs("password: hunt3r2 or pwd=ab12x") == ["hunt3r2", "ab12x"]
    assert runs("hunt3r2 here") == [] and runs("plain words " * 30) == [] and runs("=" * 40) == []


def test_secret_tails_letters_and_short_keys_are_found(spark):
    prose = [(3000 + i, f"the secret {w} of the {w} and a bearer {w} with token {w} there", "s") for i, w in enumerate(["garden", "message", "history", "people", "service", "number"] * 20)]
    scan = secret_scan._scanner(secret_scan.learn(secret_corpus(spark, prose)))
    texts = ["set password=abcdefgh@12SecretTail99x now", "use QwXrTyZiPpAsDfGhJkLzVbNm now", "login with password: kX7pQ2z and", prose[0][1]]
    found = [[t[s[1] : s[2]] for s in spans if s[0] == "learned"] for t, (spans, _) in zip(texts, scan(texts))]
    assert found == [["@12SecretTail99x"], ["QwXrTyZiPpAsDfGhJkLzVbNm"], ["kX7pQ2z"], []]


def test_secret_threshold_covers_all_findings(spark):
    docs = secret_corpus(spark, [(5000, "use ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF3gH6 and eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0 now", "s")])
    net = secret_scan.learn(docs, max_findings=10)
    counts = secret_scan._corpus_counts(docs, net)
    assert counts.sum(axis=1).tolist() == [150, 150]  # the known formats are no harmless runs
    texts = [r.text for r in docs.collect()]
    scores = [net.scores([secret_scan.window(t, a, b)])[0] for t in texts for a, b, _ in secret_scan.base_spans(t)]
    assert np.mean(np.array(scores) >= net.threshold) >= secret_scan.RECALL
    # A share of 5% below the rest holds the threshold down, whether or not fitting has seen it.
    high, low = secret_scan._bins(np.array([8.0, -4.0]))
    corpus, made = np.zeros((2, 2, secret_scan.BINS), np.int64)
    corpus[1, high], corpus[1, low], corpus[0, 0], made[1, high] = 95, 5, 100, 10
    fitted = secret_scan._calibrated(net, [corpus, made], 0.98)
    assert fitted.threshold <= 1 / (1 + np.exp(4 * fitted.slope - fitted.offset)) < 0.5


# --- 8 lines ------------------------------------------------------------------------------------


@pytest.mark.parametrize("sites", [2, 5])
def test_lines_match_brute_force(spark, sites):
    rng = np.random.default_rng(8)
    common = [f"this line is number {i} of the common ones" for i in range(12)]
    rows = []
    for i in range(150):
        own = [common[int(j)] for j in rng.choice(12, 3, p=np.r_[[0.4], np.full(11, 0.6 / 11)])] + [f"own line number {i} with some more words", "short", "  ", "short"]
        rows.append((i, "\n".join(rng.permutation(own)), None if rng.random() < 0.1 else f"site{int(rng.integers(3 + i % 8))}"))
    rows += [(150, None, "site0"), (151, "", "site1"), (None, common[0], "site2")]
    docs = documents(spark, rows, ("removed", "row_a", "line_a"))
    found = lines.dedup_lines(docs, sites)
    assert found.columns == docs.columns
    where, first = defaultdict(set), {}
    for i, text, site in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for at, line in enumerate((text or "").split("\n")):
            if len(line) >= lines.MIN_CHARS and line.split():
                where[line].add(site)
                first.setdefault(line, (i, at))
    gone = {line for line, s in where.items() if len(s - {None}) >= sites}
    for r in found.collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        kept = None if text is None else "\n".join(line for at, line in enumerate(text.split("\n")) if line not in gone or first[line] == (r.doc_id, at))
        assert r.text == kept and (kept is None or r.n_chars == len(kept))


def test_line_edges(edge, empty):
    assert pairs(lines.dedup_lines(edge), "doc_id", "text") == sorted(((i, t) for i, t, _ in EDGE), key=repr)
    assert lines.line_report(edge).count() == len(EDGE) and lines.dedup_lines(empty).count() == 0


# --- 9 near-duplicates ------------------------------------------------------------------------


def brute_components(texts, width, percent=80):
    sets = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize("width, block", [(2, 1 << 30), (5, 1 << 30), (2, 16)])
def test_near_duplicates_match_brute_force(spark, width, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [list(rng.choice(vocabulary, int(n))) for n in rng.integers(3, 200, 25)]
    texts = {}
    for i in range(220):
        words = list(base[0] if i % 3 == 0 else base[int(rng.integers(25))])
        for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
            words[int(rng.integers(len(words)))] = vocabulary[int(rng.integers(3000))]
        texts[i] = " ".join(words)
    texts |= {300: None, 301: "", 302: " \n", 303: "One", 304: "one", 305: "ONE two", 306: texts[5].upper(), 307: texts[5]}
    docs = documents(spark, [(i, t, "s") for i, t in texts.items()], ("cls", "bucket"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width).collect()}
    assert found == brute_components(texts, width)
    kept = minhash.drop_near_duplicates(docs, width)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in found.items() if c == k)


def test_near_duplicate_edges(spark, edge, empty):
    found = minhash.near_duplicates(edge).collect()
    assert len(found) == len(EDGE)
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].component_id == 4 and not by_id[5].kept and by_id[None].component_id == 3 and by_id[1].n_shingles == 0 and by_id[1].kept
    assert sum(r.doc_id == 3 and r.kept for r in found) == 2
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(edge).collect()) == [1, 2, 3, 3, 4, 7]  # 6 holds the words of 4
    assert minhash.near_duplicates(empty).count() == 0


def test_one_text_of_each_group_stays_without_ids_too(spark):
    near = WORDS.replace("w59", "other")
    other, lone = WORDS.replace("w", "u"), WORDS.replace("w", "q")
    rows = [(None, WORDS, "s"), (None, WORDS, "s"), (None, near, "s"), (None, lone, "s"), (None, None, "s")]
    rows += [(9, other, "s"), (None, other, "s"), (2, other + " end", "s"), (9, WORDS.replace("w", "k"), "s")]
    rows += [(20, WORDS.replace("w", "m"), "s"), (20, WORDS.replace("w", "m") + " end", "s")]
    kept = minhash.drop_near_duplicates(documents(spark, rows, ("row", "text_hash", "kept_id"))).collect()
    found = Counter((r.doc_id, (r.text or "-").split()[0][0]) for r in kept)
    assert found == {(None, "w"): 1, (None, "q"): 1, (None, "-"): 1, (2, "u"): 1, (9, "k"): 1, (20, "m"): 1}


def test_estimate_is_corrected():
    rng = np.random.default_rng(10)
    errors = []
    for share in (0.2, 0.5, 0.8):
        common = rng.integers(0, 2**63, 800, dtype=np.uint64)
        own = [rng.integers(0, 2**63, int(800 * (1 - share) / share / 2), dtype=np.uint64) for _ in range(2)]
        a, b = (np.frombuffer(minhash.pack_bits(minhash.minima(np.unique(np.concatenate([common, o])))), np.uint64) for o in own)
        errors.append(abs(float(minhash.estimate(a, b[None, :])[0]) - share))
    assert max(errors) < 0.09


# --- 10 toxicity -----------------------------------------------------------------------------------


def test_segments_match_definition():
    """A maximal segment has only larger-scoring ends: every proper prefix and suffix sums above zero,
    and no longer segment around it does."""
    rng = np.random.default_rng(12)
    for _ in range(200):
        weights = np.round(rng.normal(-0.2, 1, int(rng.integers(0, 14))), 2)
        n, good = len(weights), []
        for a in range(n):
            for b in range(a + 1, n + 1):
                s = weights[a:b].cumsum()
                if (s > 1e-9).all() and (s[-1] - s[:-1] > 1e-9).all():
                    good.append((a, b))
        wanted = [g for g in good if not any(o != g and o[0] <= g[0] and g[1] <= o[1] for o in good)]
        found = toxicity.segments(weights)
        assert [(a, b) for a, b, _ in found] == wanted
        assert [s for _, _, s in found] == pytest.approx([weights[a:b].sum() for a, b in wanted])


def test_toxicity_held_out_and_edges(spark, edge, empty):
    rng = np.random.default_rng(13)
    plain, bad = [f"p{i}" for i in range(400)], [f"bad{i}" for i in range(6)]
    rows, marks = [], []
    for i in range(500):
        words = list(rng.choice(plain, 40))
        if i % 6 == 0:
            for place in rng.choice(40, 4, replace=False):
                words[place] = bad[int(rng.integers(6))].capitalize() + "!"
        rows.append((i, " ".join(words), "s"))
        marks.append((i, 1, int(i % 6 == 0)))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (499, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    found = toxicity.toxic_passages(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in found if r.held]
    assert len(held) > 60 and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in held]) > 0.97
    passage = next(r for r in found if r.doc_id % 6 == 0 and r.n_passages)
    words = rows[passage.doc_id][1].lower().split()
    assert any("bad" in w for p in passage.passages for w in words[p.start : p.end])
    rest = {r.doc_id: r for r in toxicity.toxic_passages(edge, model).collect()}
    assert rest[1].score <= rest[4].score + 1 and rest[1].n_tokens == 0 and rest[2].predicted == 0
    assert toxicity.toxic_passages(empty, toxicity.learn(empty, labels.limit(0))).count() == 0
    # Held-out labels teach nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, flipped) == model
