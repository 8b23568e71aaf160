"""Sharding by fixed virtual slots, with DataFrame functions only.

A record belongs for good to one of ``SLOTS`` virtual slots, by the hash of its id and text. Bytes are
added up per slot, and a small table maps slots to shards. Only that table is edited when
shards are added or have grown apart: a new version moves as few slots as it can, and old versions
stay readable. Law: ``bytes``, shards of nearly equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import checkpoint
from .rows import fresh

SLOTS = 4096
# Of a row that is repeated in more than one of HEAVY rows of the table, the copies are spread over slots; at
# most HEAVY different rows can be that common, so their list may be broadcast.
HEAVY = 16_384
PIECE_ROWS = 250_000
MAP = "version long, slot long, shard int"


def _record() -> Column:
    """A 60-bit hash of id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    both = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(both, 1, 15), 16, 10).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """One narrow row per document, kept in a checkpoint: doc_id, size, text_crc32, record (a hash of id and
    text) and row. A null text has no bytes; a size is the bytes of the text in UTF-8, plus 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            _record().alias("record"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def with_slots(rows: DataFrame) -> DataFrame:
    """Add ``vslot``, the virtual slot of each record."""
    counts = rows.groupBy("record").agg(F.count(F.lit(1)).alias("copies"))
    heavy = checkpoint(counts.filter(F.col("copies") > max(1.0, rows.count() / HEAVY)).select("record", F.lit(True).alias("heavy")))
    spread = F.when(F.col("heavy"), F.pmod(F.xxhash64("row"), F.lit(SLOTS))).otherwise(F.pmod("record", F.lit(SLOTS)))
    return rows.join(F.broadcast(heavy), "record", "left").select(*rows.columns, spread.cast("long").alias("vslot"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """(slot, bytes, n): what each virtual slot holds; at most SLOTS rows."""
    return slotted.groupBy(F.col("vslot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def edit_map(sizes: DataFrame, shards: int, old: DataFrame | None = None, tolerance: float = 0.02) -> DataFrame:
    """The next version of the slot-to-shard map: (version, slot, shard) for all SLOTS slots.

    Without an old map every slot is free. Else a shard whose bytes exceed the mean by more than
    ``tolerance`` gives up its largest slots, few of them, until it no longer exceeds the mean, and shards that no longer
    exist give up all; the others stay where they are. Free slots go, largest first, to the shard with the fewest bytes. The
    map has SLOTS rows whatever the data, so one row of arrays carries the edit.
    """
    spark = sizes.sparkSession
    known = spark.range(SLOTS).select(F.col("id").alias("slot")).join(sizes.select("slot", "bytes"), "slot", "left").na.fill(0, ["bytes"])
    if old is None:
        placed = known.select("slot", "bytes", F.lit(None).cast("int").alias("shard"), F.lit(0).cast("long").alias("version"))
    else:
        placed = known.join(old.select("slot", "shard", "version"), "slot", "left").na.fill(0, ["version"])
    everything = Window.partitionBy(F.lit(0))  # SLOTS rows
    own = Window.partitionBy("shard")
    upto = own.orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    weighed = placed.select(
        "slot", "bytes", "shard", F.max("version").over(everything).alias("version"), (F.sum("bytes").over(everything) / shards).alias("mean"),
        F.sum("bytes").over(own).alias("load"), F.sum("bytes").over(upto).alias("upto"),
    )
    over = F.col("load") > F.col("mean") * (1 + tolerance)
    free = F.col("shard").isNull() | (F.col("shard") >= shards) | (over & (F.col("upto") > F.col("mean")))
    decided = weighed.select("version", "slot", "bytes", F.when(~free, F.col("shard")).alias("shard"))
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda sum_, k: sum_ + k["bytes"]))
    lists = decided.agg(
        (F.max("version") + 1).alias("version"),
        F.array_sort(F.collect_list(F.when(F.col("shard").isNull(), F.struct((-F.col("bytes")).alias("less"), "slot")))).alias("loose"),
        F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "bytes", "slot"))).alias("kept"),
    )
    start = F.struct(held.alias("loads"), F.array().cast("array<int>").alias("taken"))

    def lightest(state):
        return F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1

    def give(state, entry):
        loads = F.transform(state["loads"], lambda load, s: F.when(s == lightest(state), load - entry["less"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.array_append(state["taken"], lightest(state)).alias("taken"))

    dealt = lists.select("version", "kept", "loose", F.aggregate("loose", start, give)["taken"].alias("taken"))
    given = F.zip_with("loose", "taken", lambda e, s: F.struct(e["slot"].alias("slot"), s.alias("shard")))
    stay = F.transform("kept", lambda k: F.struct(k["slot"].alias("slot"), k["shard"].alias("shard")))
    return checkpoint(dealt.select("version", F.explode(F.concat(given, stay)).alias("m")).select("version", "m.slot", "m.shard"))


def save_map(mapping: DataFrame, path: str) -> int:
    """Write a version beside the earlier ones; a version that exists is never written over."""
    version = mapping.agg(F.max("version")).first()[0]
    mapping.select("slot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the latest."""
    stored = spark.read.parquet(path).select(F.col("version").cast("long").alias("version"), "slot", "shard")
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def positions(slotted: DataFrame, sizes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``shard`` and ``position``, gapless from 0 in each shard.

    Rows are numbered inside pieces of slots, whose row counts are known beforehand, and slots follow each
    other in their shard; no task orders more than one piece.
    """
    largest = sizes.agg(F.max("n")).first()[0] or 0
    pieced = slotted.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(largest // PIECE_ROWS + 1)))
    counts = pieced.groupBy("vslot", "piece").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("vslot").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    slots = sizes.select(F.col("slot").alias("vslot"), "n").join(mapping.select(F.col("slot").alias("vslot"), "shard"), "vslot")
    starts = slots.select("vslot", "shard", F.coalesce(F.sum("n").over(of_shard), F.lit(0)).alias("start"))
    bases = counts.select("vslot", "piece", F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("base")).join(starts, "vslot")
    local = pieced.withColumn("local", F.row_number().over(Window.partitionBy("vslot", "piece").orderBy("doc_id", "text_crc32", "size", "row")) - 1)
    found = local.join(bases.select("vslot", "piece", "shard", (F.col("base") + F.col("start")).alias("first")), ["vslot", "piece"])
    return found.select(*slotted.columns, "shard", (F.col("first") + F.col("local")).cast("long").alias("position"))


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document, read with a first map: doc_id, size, text_crc32, law, shard, slot (its place in the
    shard, from 0), grown_shard (null: the law is ``bytes``) and vslot.

    Null texts have size 1; null ids take part like others. Rows that repeat id and text share a slot unless they are
    more than one in HEAVY of the table; then their copies are spread. An empty table gives no rows;
    other columns are not read.
    """
    slotted = checkpoint(with_slots(records(docs)))
    sizes = checkpoint(slot_bytes(slotted))
    placed = positions(slotted, sizes, edit_map(sizes, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def shard_documents(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """The documents, all columns as they were, with the shard a stored map gives them as ``shard``
    (or the next free name). A record repeated beyond measure (``with_slots``) stays in the slot of its hash here."""
    slot, shard = fresh(docs, "vslot"), fresh(docs, "shard")
    table = mapping.select(F.col("slot").alias(slot), F.col("shard").alias(shard))  # SLOTS rows
    return docs.withColumn(slot, F.pmod(_record(), F.lit(SLOTS))).join(F.broadcast(table), slot).select(*[f"`{c}`" for c in docs.columns], shard)
