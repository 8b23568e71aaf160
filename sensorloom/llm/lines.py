"""Line deduplication by spread over distinct sites.

A line that stands on many sites is boilerplate. Its sites are counted by a HyperLogLog sketch that
merges in aggregation; only lines whose estimate is near the threshold get an exact count. Each
boilerplate line stays where it occurs first and goes elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import checkpoint
from .rows import fresh

MIN_SITES = 5
MIN_CHARS = 20
LOG_REGISTERS = 12


def _margin(sites: int) -> float:
    """Far beyond the error of a sketch (relative 1.04 / sqrt(registers))."""
    return 1.5 + 6 * 1.04 / 2 ** (LOG_REGISTERS / 2) * sites


def _row_key(docs: DataFrame, text: Column) -> tuple[Column, Column]:
    """Rows with one id and one text are alike: what is decided for one holds for both."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.xxhash64(text, F.lit(0))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row_a, row_b, doc_id, site, at, line_a, line_b) of the lines that can be boilerplate."""
    row_a, row_b = _row_key(docs, F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("site"), F.col("source").isNull().alias("nowhere"), F.col("text"))
    split = base.select("doc_id", F.when(~F.col("nowhere"), F.col("site")).alias("site"), row_a.alias("row_a"), row_b.alias("row_b"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    can = split.filter((F.char_length("line") >= min_chars) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return can.select("row_a", "row_b", "doc_id", "site", "at", F.xxhash64("line").alias("line_a"), F.xxhash64(F.lit(1), "line", F.char_length("line")).alias("line_b"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line_a, line_b, first) of lines on ``min_sites`` sites or more; ``first`` is the place that
    keeps the line: the smallest (doc_id, row, position), null ids last."""
    lines = _lines(docs, min_chars)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_a", "row_b", "at")
    spread = checkpoint(
        lines.groupBy("line_a", "line_b")
        .agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min(place).alias("first"))
        .select("line_a", "line_b", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
        .filter(F.col("estimate") >= min_sites - _margin(min_sites))
    )
    near = F.col("estimate") <= min_sites + _margin(min_sites)
    unsure = spread.filter(near).select("line_a", "line_b")
    exact = (
        lines.filter("site is not null").select("line_a", "line_b", "site").join(unsure, ["line_a", "line_b"], "left_semi").distinct()
        .groupBy("line_a", "line_b").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("line_a", "line_b")
    )
    return spread.filter(~near).select("line_a", "line_b", "first").union(spread.filter(near).join(exact, ["line_a", "line_b"]).select("line_a", "line_b", "first"))


def with_removed(docs: DataFrame, name: str, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with an array of the positions of lines to remove (null: none)."""
    here = F.struct("row_a", "row_b", "at")
    keeps = F.struct(F.col("first.row_a"), F.col("first.row_b"), F.col("first.at"))
    gone = (
        _lines(docs, min_chars).select("row_a", "row_b", "at", "line_a", "line_b")
        .join(boilerplate(docs, min_sites, min_chars), ["line_a", "line_b"])
        .filter(here != keeps)
        .groupBy("row_a", "row_b").agg(F.sort_array(F.collect_set("at")).alias(name))
    )
    a, b = fresh(docs, "row_a"), fresh(docs, "row_b")
    key_a, key_b = _row_key(docs, F.col("text"))
    keyed = docs.withColumns({a: key_a, b: key_b})
    gone = gone.withColumnRenamed("row_a", a + "_").withColumnRenamed("row_b", b + "_")
    return keyed.join(gone, (F.col(a) == F.col(a + "_")) & (F.col(b) == F.col(b + "_")), "left").drop(a, b, a + "_", b + "_")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text`` (and ``n_chars`` set anew, if there).

    ``source`` is the site; rows without one count for none. Lines without a word or shorter than
    ``min_chars`` stay. Null texts stay null, empty ones empty; no row goes, even if nothing is left
    of it. Rows that repeat id and text keep the same lines. Other columns pass through; an empty
    table gives no rows.
    """
    name = fresh(docs, "removed")
    found = with_removed(docs, name, min_sites, min_chars)
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col(name), i)), "\n")
    changed = found.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return changed.select(*docs.columns)


def line_report(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, and length and digest of what is left of each text."""
    found = with_removed(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), "removed", min_sites, min_chars)
    lines = F.split("text", "\n", -1)
    left = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("removed"), i)), "\n"))
    return found.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.char_length(left).cast("long").alias("left_chars"),
        F.sha2(left, 256).alias("left_sha256"),
    )
