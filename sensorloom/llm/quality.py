"""Quality rules: a bitmask ledger.

Every document is measured once and every rule evaluated once: the ledger keeps the
measurements and a bitmask of failed rules. Policies are versioned sets of rules over that
mask, so a new policy or an ablation never reads a text again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import fields, fresh, per_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaim", "longest_word")
SYMBOLS = "#*$%&|<>"
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LOWER = bytes(set(range(256)) - set(range(97, 123)))

# Name and failing condition of each rule; the bit is the position in this list. Append only:
# stored masks stay readable.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "n_upper > n_lower"),
    ("exclamation", "5 * n_exclaim > n_words"),
    ("long_word", "longest_word > 1000"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails a rule of ``hard``, or at least ``limit`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    limit: int = 2

    def mask(self, names: tuple[str, ...]) -> int:
        return sum(BITS[n] for n in set(names))

    def rejects(self, failed: Column, without: int = 0) -> Column:
        hard = failed.bitwiseAND(F.lit(self.mask(self.hard) & ~without).cast("long")) != 0
        soft = F.bit_count(failed.bitwiseAND(F.lit(self.mask(self.soft) & ~without).cast("long"))) >= self.limit
        return hard | soft


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_words")),
        Policy("2", ("few_words", "repeated_words", "symbols", "capitals", "exclamation", "long_word"), ("word_length", "repeated_lines")),
    )
}
CURRENT = "2"


def _measure(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on the six ASCII white-space characters only
    n = len(words)
    repeated = 0
    if n > 2:
        windows = Counter(zip(words, words[1:], words[2:]))
        if len(windows) < n - 2:
            again = np.fromiter((windows[w] > 1 for w in zip(words, words[1:], words[2:])), bool, n - 2)
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= again
            repeated = int(covered.sum())
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (
        n,
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        len(data.translate(None, _NOT_UPPER)),
        len(data.translate(None, _NOT_LOWER)),
        text.count("!"),
        max(map(len, words), default=0),
    )


def _measure_all(texts: list[str]):
    return map(_measure, texts)


def with_ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> DataFrame:
    """``docs`` with a struct column: the measurements and ``failed``, the mask of failed rules.

    Null and empty texts measure zero and fail ``few_words``. Repeated rows, null ids and other
    columns do not matter; ``name`` must not be taken. No shuffle.
    """
    if name in docs.columns:
        raise ValueError(f"column {name!r} exists")
    measure = per_text(docs.sparkSession, _measure_all, T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
    raw = fresh(docs, "measures")
    with_raw = docs.withColumn(raw, measure(F.col(f"`{text}`")))
    lookup = F.struct(*[F.col(f"`{raw}`.{n}").alias(n) for n in MEASURES])
    holder = fresh(with_raw, "holder")
    failed = " + ".join(f"IF({_inside(rule, holder)}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES))
    return (
        with_raw.withColumn(holder, lookup)
        .withColumn(name, F.struct(*[F.col(f"`{holder}`.{n}").alias(n) for n in MEASURES], F.expr(failed).alias("failed")))
        .drop(raw, holder)
    )


def _inside(rule: str, struct: str) -> str:
    return " ".join(f"`{struct}`.{token}" if token in MEASURES else token for token in rule.split())


def judge(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``kept`` under a policy to rows with ``failed``."""
    return ledger.withColumn("kept", ~policy.rejects(F.col("failed")))


def quality_filter(docs: DataFrame, policy: Policy = POLICIES[CURRENT], text: str = "text") -> DataFrame:
    """The documents the policy keeps, with their columns as they were."""
    name = fresh(docs, "ledger")
    return with_ledger(docs, text, name).filter(~policy.rejects(F.col(f"`{name}`.failed"))).drop(name)


def quality_report(docs: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """One row per document: measurements, mask, verdicts."""
    name = fresh(docs, "ledger")
    measured = with_ledger(docs, "text", name)
    rows = measured.select("doc_id", *fields(measured, name))
    return judge(rows, policy).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0)


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """What each rule does under a policy: rows that fail it, and rows kept if it were removed.

    The ledger is first counted per mask (at most 2**len(RULES) rows), the rest is bit arithmetic.
    Every rule has a row, also over an empty ledger.
    """
    masks = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    aggregates = []
    for name, bit in BITS.items():
        fails = F.col("failed").bitwiseAND(F.lit(bit).cast("long")) != 0
        saved = policy.rejects(F.col("failed")) & ~policy.rejects(F.col("failed"), without=bit)
        total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
        aggregates.append(F.struct(F.lit(name).alias("rule"), total(fails).alias("n_failed"), total(saved).alias("n_saved_without")))
    return masks.agg(F.array(*aggregates).alias("rules")).select(F.inline("rules"))
