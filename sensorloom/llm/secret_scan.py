"""Secret scans: a character convolutional network over candidates and what surrounds them.

Fixed patterns find base secrets, which always stay. Other runs that look random are candidates,
and the network decides on them. It is trained in numpy on findings labelled by the patterns and on
variations of them; calibration and threshold come from all labelled findings of the corpus and made-up
ones it has not seen. The threshold is the highest one that keeps the wanted recall on both.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import fresh, per_text

KINDS = ("assign", "access", "hex", "learned")
# Labelled findings of each sort that go to the driver: those with the smallest hash.
MAX_FINDINGS = 800
RECALL = 0.98
BEFORE, INSIDE, AFTER = 16, 48, 16
WIDTH, EMBEDDING, FILTERS, SPAN = BEFORE + INSIDE + AFTER, 8, 24, 5
# Windows along a longer candidate, and how many of one finding the fitting reads; the scan reads all.
STRIDE, FITTED = INSIDE // 2, 64
MASK = "[secret]"

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=.@-]{16,}")
_ANY_RUN = re.compile(r"[A-Za-z0-9+/_=.@-]+")
_RUN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.@-")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_DIGIT = re.compile(r"[0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
# Words beside which shorter runs are candidates, SHORT characters at least.
_CUES = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "credential", "bearer", "api", "access", "private", "auth")
_CUE = re.compile(r"passw(?:or)?d|passphrase|passcode|pwd|secret|token|credential|bearer|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|auth(?![a-z]*or)", re.ASCII | re.IGNORECASE)
SHORT, LONG = 4, 16
# Keys of known formats are secrets, but not of a base kind.
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|sk-|[spr]k_(?:live|test)_|whsec_|AIza|ya29[.]|eyJ|SG[.]|npm_|pypi-|hf_|dop_v1_|shp(?:at|ca|pa|ss)_|A(?:SIA|KIA|IDA|ROA|GPA|IPA|NPA|NVA)[A-Z0-9])", re.ASCII)
# Whether a candidate is taught as harmless, or left open.
HARMLESS, OPEN = 0, -1

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=:\"'.-_/+@ \n"
_CODES = np.ones(0x110000, np.uint8)
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(2, len(_ALPHABET) + 2)
_SYMBOLS = len(_ALPHABET) + 2


# --- candidates -----------------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds, kinds as numbers of KINDS."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if _may_hold_keys(text):
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def _may_hold_keys(text: str) -> bool:
    """Cheap and never wrong about no: a long word with a digit, a very long one, or AKIA."""
    return any(len(w) >= 16 and (len(w) >= 32 or _DIGIT.search(w)) for w in text.split()) or "AKIA" in text


def _may_hold_runs(text: str) -> bool:
    """Cheap and never wrong about no: a long word."""
    return max(map(len, text.split()), default=0) >= LONG


def _remainders(text: str, base: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """What base spans leave of the runs in which they stand."""
    merged: list[list[int]] = []
    for a, b, _ in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    found = set()
    for i, (a, b) in enumerate(merged):
        left, floor = a, merged[i - 1][1] if i else 0
        while left > floor and text[left - 1] in _RUN_CHARS:
            left -= 1
        rest = _ANY_RUN.match(text, b, merged[i + 1][0] if i + 1 < len(merged) else len(text))
        found |= {(left, a), rest.span() if rest else (b, b)}
    return {(a, b) for a, b in found if _ALNUM.search(text, a, b)}


def _beside_cues(text: str) -> set[tuple[int, int]]:
    """Shorter runs in the sight of a cue; of a run that holds the cue, what is assigned in it."""
    low, found = text.lower(), set()
    if not any(cue in low for cue in _CUES):
        return found
    for cue in _CUE.finditer(text):
        low_end, high_end = max(0, cue.start() - BEFORE - LONG), cue.end() + AFTER + LONG
        for run in _ANY_RUN.finditer(text, low_end, high_end):
            a, b = run.span()
            cut = (a == low_end > 0 and text[a - 1] in _RUN_CHARS) or (b == high_end < len(text) and text[b] in _RUN_CHARS)
            for inner in _CUE.finditer(text, a, b):
                a = text.find("=", inner.end(), b) + 1 or b
            if not cut and SHORT <= b - a < LONG and a - cue.end() <= AFTER and cue.start() - b <= BEFORE and _ALNUM.search(text, a, b):
                found.add((a, b))
    return found


def other_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, HARMLESS or OPEN) of the candidates apart from base spans: runs of LONG characters or
    more, shorter ones beside cues, and what base spans leave of a run. The last sort is open, as are
    short runs that are no plain words and runs with the start of a known key format."""
    apart = lambda a, b: not any(x < b and a < y for x, y, _ in base)
    found = {span: OPEN for span in _remainders(text, base)} if base else {}
    for a, b in _beside_cues(text):
        if apart(a, b):
            found[a, b] = HARMLESS if _WORD.fullmatch(text, a, b) else OPEN
    if _may_hold_runs(text):
        found |= {m.span(): HARMLESS for m in _RUN.finditer(text) if _ALNUM.search(m[0]) and apart(*m.span())}
    return sorted((a, b, OPEN if _KNOWN.search(text, a, b) else label) for (a, b), label in found.items())


def window(text: str, start: int, end: int, most: int | None = None) -> str:
    """What the network sees of a candidate: one window or, where it is longer than INSIDE, overlapping
    ones along all of it, one after the other. ``most`` spreads so many over it instead."""
    last = max(start, end - INSIDE)
    places = [*range(start, last, STRIDE), last]
    if most and len(places) > most:
        places = [places[i * (len(places) - 1) // (most - 1)] for i in range(most)]
    windows = []
    for at in places:
        stop = min(end, at + INSIDE)
        windows.append(text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0") + text[at:stop].ljust(INSIDE, "\0") + text[stop : stop + AFTER].ljust(AFTER, "\0"))
    return "".join(windows)


def _codes(windows: list[str]) -> np.ndarray:
    """One row per window; a finding may have several."""
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    return np.where(points == 0, 0, _CODES[points])


def _starts(windows: list[str]) -> np.ndarray:
    """The row of the first window of each finding."""
    return np.cumsum([0, *(len(w) // WIDTH for w in windows[:-1])])


# --- the network -----------------------------------------------------------------------------


@dataclass(frozen=True)
class SecretNet:
    embedding: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def logits(self, windows: list[str]) -> np.ndarray:
        """The highest logit among the windows of each finding."""
        if not windows:
            return np.zeros(0)
        codes = _codes(windows)
        parts = [_forward(self, codes[i : i + 256])[0] for i in range(0, len(codes), 256)]
        return np.maximum.reduceat(np.concatenate(parts), _starts(windows))

    def scores(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(windows) + self.offset, -30, 30)))


def _forward(net: SecretNet, codes: np.ndarray):
    embedded = net.embedding[codes]
    n = WIDTH - SPAN + 1
    columns = np.concatenate([embedded[:, i : i + n] for i in range(SPAN)], axis=2)
    active = np.maximum(columns @ net.kernel + net.shift, 0)
    top = active.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(active, top[:, None], 1)[:, 0], active.mean(axis=1)], axis=1)
    return pooled @ net.dense + net.bias, (codes, columns, active, top, pooled)


def _gradients(net: SecretNet, held, error: np.ndarray) -> list[np.ndarray]:
    codes, columns, active, top, pooled = held
    back = error[:, None] * net.dense
    spread = np.broadcast_to(back[:, None, FILTERS:] / active.shape[1], active.shape).copy()
    at = np.take_along_axis(spread, top[:, None], 1) + back[:, None, :FILTERS]
    np.put_along_axis(spread, top[:, None], at, 1)
    spread *= active > 0
    kernel = np.tensordot(columns, spread, axes=([0, 1], [0, 1]))
    below = spread @ net.kernel.T
    n = active.shape[1]
    felt = np.zeros((*codes.shape, EMBEDDING))
    for i in range(SPAN):
        felt[:, i : i + n] += below[:, :, i * EMBEDDING : (i + 1) * EMBEDDING]
    flat, felt = codes.ravel(), felt.reshape(-1, EMBEDDING)
    embedding = np.stack([np.bincount(flat, felt[:, j], _SYMBOLS) for j in range(EMBEDDING)], axis=1)
    return [embedding, kernel, spread.sum(axis=(0, 1)), pooled.T @ error, np.array(error.sum())]


def train(windows: list[str], labels: list[int], seed: int = 7, epochs: int = 12, batch: int = 64) -> SecretNet:
    """Adam on the logistic loss, both classes with equal weight; a finding counts by its highest window."""
    rng = np.random.default_rng(seed)
    values = [rng.normal(0, 0.3, (_SYMBOLS, EMBEDDING)), rng.normal(0, 0.15, (SPAN * EMBEDDING, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.array(0.0)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    codes, wanted = _codes(windows), np.array(labels, float)
    first_row, n_rows = _starts(windows), np.array([len(w) // WIDTH for w in windows])
    weight = np.where(wanted == 1, 0.5 / max(1, wanted.sum()), 0.5 / max(1, (1 - wanted).sum())) * len(wanted)
    for _ in range(epochs):
        order = rng.permutation(len(wanted))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            net = SecretNet(*values[:4], float(values[4]))
            rows = first_row[some]
            for i in np.flatnonzero(n_rows[some] > 1):
                rows[i] += int(_forward(net, codes[rows[i] : rows[i] + n_rows[some[i]]])[0].argmax())
            logit, held = _forward(net, codes[rows])
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - wanted[some]) * weight[some] / len(some)
            step += 1
            for i, gradient in enumerate(_gradients(net, held, error)):
                first[i] = 0.9 * first[i] + 0.1 * gradient
                second[i] = 0.999 * second[i] + 0.001 * gradient**2
                values[i] = values[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return SecretNet(*values[:4], float(values[4]))


# Logits are counted in bins of 1/PER up to REACH on both sides.
PER, REACH = 64, 32
BINS = 2 * PER * REACH


def _bins(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((logits + REACH) * PER), 0, BINS - 1).astype(np.int64)


def _calibrated(net: SecretNet, counts: list[np.ndarray], recall: float) -> SecretNet:
    """Platt scaling on the sum of ``counts`` (two rows of bins each: harmless ones, secrets), then the
    highest threshold with the wanted recall on each of them."""
    total = np.sum(counts, axis=0).astype(float)
    weight, x = total / total.sum(), (np.arange(BINS) + 0.5) / PER - REACH
    slope, offset = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        error = weight[0] * p + weight[1] * (p - 1)
        slope = max(slope - 0.05 * float((error * x).sum() + 1e-3 * slope), 1e-2)
        offset -= 0.05 * float(error.sum())
    lowest = BINS - 1
    for _, secrets in counts:
        if secrets.sum():
            above = np.cumsum(secrets[::-1])[::-1]
            lowest = min(lowest, int(np.flatnonzero(above >= recall * secrets.sum()).max()))
    threshold = 1 / (1 + np.exp(-np.clip(slope * (lowest / PER - REACH) + offset, -30, 30)))
    return SecretNet(net.embedding, net.kernel, net.shift, net.dense, net.bias, slope, offset, float(threshold))


def _variations(contexts: list[str], rng: np.random.Generator, n: int) -> tuple[list[str], list[int]]:
    """Random keys of other forms, and harmless runs, in the surroundings of real candidates."""
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda letters, size: "".join(letters[i] for i in rng.integers(0, len(letters), size))
    windows, labels = [], []
    for i in range(n):
        around = contexts[int(rng.integers(len(contexts)))] if contexts else " " * WIDTH
        before, after = around[: rng.integers(0, BEFORE + 1)][-BEFORE:], around[-AFTER:]
        word = pick(alnum[:26], int(rng.integers(4, 10)))
        keys = [pick(alnum, int(rng.integers(20, 45))), "gh" + pick("pousr", 1) + "_" + pick(alnum, 36), pick("0123456789abcdef", int(rng.integers(24, 32))), "xoxb-" + pick(alnum[-10:], 12) + "-" + pick(alnum, 24)]
        path = "/".join(pick(alnum[:26], int(rng.integers(3, 10))) for _ in range(int(rng.integers(6, 12)))) + f"/{pick(alnum[-10:], 4)}/"
        keys += [path + keys[0], keys[0] + "/" + path]
        plain = [
            pick(alnum[-10:], 16),
            f"{word}.{pick(alnum[-10:], 2)}@{word}{pick(alnum[-10:], 1)}.example.com",
            f"{word}-{word}-{pick(alnum[-10:], 4)}-{word}",
            f"www.{word}.com/{word}/{pick(alnum[-10:], 4)}",
            f"20{pick('012', 2)}-0{pick('123456789', 1)}-{pick('12', 2)}T0{pick('0123456789', 1)}.{pick('012345', 2)}",
            word * 3 + pick(alnum[-10:], 1),
            path + word,
        ]
        label = int(i % 2)
        kind = int(rng.integers(4))
        if kind == 0:  # beside a cue
            cue = ["password", "passwd", "secret", "token", "api key", "bearer", "pwd"][int(rng.integers(7))]
            some = pick(alnum[:26], int(rng.integers(3, 8)))
            if label or rng.random() < 0.5:
                before = (before + " " + some + " " + cue + [" ", ": ", "=", " is ", " = "][int(rng.integers(5))])[-int(rng.integers(BEFORE - 6, 2 * BEFORE)) :]
                after = [" " + some + " " + word, after, "\n", ""][int(rng.integers(4))]
            else:
                before = ["", "\n", some + " ", before + " "][int(rng.integers(4))]
                after = [" ", " " + some + " "][int(rng.integers(2))] + cue + [" ", ": ", "=", " is ", " = "][int(rng.integers(5))] + ["", '"'][int(rng.integers(2))] + pick(alnum, 14)
            keys = [pick(alnum, int(rng.integers(6, 16))), word + pick(alnum[-10:], int(rng.integers(1, 4)))]
            plain = [word, word.capitalize(), pick(alnum[:26], int(rng.integers(4, 6)))]
        elif kind == 1:  # what a base span leaves
            before = "=" + pick(alnum, 12) if label else before
            keys = [f"@{pick(alnum, int(rng.integers(6, 30)))}", pick(alnum, int(rng.integers(4, 20)))]
            after = after if label else "_token=" + pick(alnum, 9)
            plain = [f"{word}_", word, f"{word}/{word}/"]
        elif kind == 2:  # letters only
            keys = [pick(alnum[:52], int(rng.integers(16, 45)))]
            plain = [f"{word}/{pick(alnum[:26], 6)}/{word}.html", f"{word}-{pick(alnum[:26], 5)}-{pick(alnum[:26], 7)}", f"{word}{pick('aeiou', 1)}{word}{pick('aeiou', 1)}n", f"{word}.{pick(alnum[:26], 6)}@{word}.example.com"]
        run = keys[int(rng.integers(len(keys)))] if label else plain[int(rng.integers(len(plain)))]
        text = before + run + after
        windows.append(window(text, len(before), len(before) + len(run)))
        labels.append(label)
    return windows, labels


_FINDING = T.StructType([T.StructField("windows", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))])


def _labelled(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return [(a, b, 1) for a, b, _ in base] + [x for x in other_runs(text, base) if x[2] != OPEN]


def _findings(texts: list[str]) -> Iterable[tuple]:
    for text in texts:
        taught = _labelled(text)
        yield [window(text, a, b, FITTED) for a, b, _ in taught], [label for _, _, label in taught]


_BINNED = T.StructType([T.StructField("bins", T.ArrayType(T.LongType()))])


def _binner(net: SecretNet):
    """Bins of the logits of all labelled findings, those of secrets BINS higher."""

    def binned(texts: list[str]) -> Iterable[tuple]:
        for text in texts:
            taught = _labelled(text)
            yield (((_bins(net.logits([window(text, a, b) for a, b, _ in taught])) + BINS * np.array([x[2] for x in taught])).tolist() if taught else []),)

    return binned


def _corpus_counts(docs: DataFrame, net: SecretNet) -> np.ndarray:
    """How many labelled findings of the whole corpus fall into each bin."""
    bins = per_text(docs.sparkSession, _binner(net), _BINNED)
    rows = docs.select(bins(F.col("text")).alias("b")).select(F.explode("b.bins").alias("bin")).groupBy("bin").count().collect()
    counts = np.zeros(2 * BINS, np.int64)
    for r in rows:
        counts[r["bin"]] = r["count"]
    return counts.reshape(2, BINS)


def learn(docs: DataFrame, max_findings: int = MAX_FINDINGS, recall: float = RECALL) -> SecretNet:
    """A network fitted on at most ``max_findings`` labelled findings of each sort and on made-up ones, and
    calibrated on every labelled finding of ``docs`` and made-up ones it has not seen.

    Every document is searched; without any finding the variations alone teach.
    """
    find = per_text(docs.sparkSession, _findings, _FINDING)
    found = docs.select(find(F.col("text")).alias("f")).filter(F.size("f.labels") > 0)
    rows = found.select(F.explode(F.arrays_zip("f.windows", "f.labels")).alias("x")).select(F.col("x.windows").alias("window"), F.col("x.labels").alias("label"))
    # Equal windows (copies) count once; each sort gives its share, so none crowds out the other.
    few = rows.groupBy("window").agg(F.max("label").alias("label"))
    sample = few.filter("label = 1").orderBy(F.xxhash64("window"), "window").limit(max_findings).union(few.filter("label = 0").orderBy(F.xxhash64("window"), "window").limit(max_findings)).collect()
    rng = np.random.default_rng(11)
    windows, labels = [r["window"] for r in sample], [int(r["label"]) for r in sample]
    made, kinds = _variations(sorted(windows), rng, max(2400, len(windows)))
    n = len(made) // 4
    net = train(windows + made[n:], labels + kinds[n:])
    unseen = np.bincount(_bins(net.logits(made[:n])) + BINS * np.array(kinds[:n]), minlength=2 * BINS).reshape(2, BINS)
    return _calibrated(net, [_corpus_counts(docs, net), unseen], recall)


# --- the scan -----------------------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_SCAN = T.StructType([T.StructField("spans", _SPANS), T.StructField("masked", T.StringType())])


def _scanner(net: SecretNet):
    def scan(texts: list[str]) -> Iterable[tuple]:
        for text in texts:
            base = base_spans(text)
            others = other_runs(text, base)
            if not base and not others:
                yield [], None
                continue
            candidates = base + [(a, b, 3) for a, b, _ in others]
            scores = net.scores([window(text, a, b) for a, b, _ in candidates])
            chosen = sorted((a, kind, b, float(s)) for (a, b, kind), s in zip(candidates, scores) if kind < 3 or s >= net.threshold)
            pieces, at = [], 0
            for a, _, b, _ in chosen:
                if a >= at:
                    pieces += [text[at:a], MASK]
                at = max(at, b)
            yield [(KINDS[k], a, b, s) for a, k, b, s in chosen], "".join(pieces) + text[at:] if chosen else None

    return scan


def scan(docs: DataFrame, net: SecretNet, name: str = "secrets") -> DataFrame:
    """``docs`` with a struct: ``spans`` (kind, start, end in code points, score of the network) by
    start and kind, and ``masked``, the text with each span (or overlapping spans) masked, null where
    nothing is. Null and empty texts have no span. ``name`` must be free; other columns pass through.
    """
    if name in docs.columns:
        raise ValueError(f"column {name!r} exists")
    run = per_text(docs.sparkSession, _scanner(net), _SCAN)
    return docs.withColumn(name, run(F.col("text")))


def mask_secrets(docs: DataFrame, net: SecretNet | None = None) -> DataFrame:
    """The documents with their secrets masked (and ``n_chars`` set anew, if there)."""
    name = fresh(docs, "secrets")
    found = scan(docs, net or learn(docs), name)
    masked = F.col(f"`{name}`.masked")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(masked.isNull(), F.col("n_chars")).otherwise(F.char_length(masked).cast("long")))
    return found.withColumn("text", F.coalesce(masked, F.col("text"))).select(*docs.columns)
