"""Web archive records: resolving not-modified revisits.

A revisit stands for a response whose body was not stored again. Each one is joined, as of its time,
to the latest earlier full response of the same canonical URL. Where their validators agree, the
stored response answers it, with those headers of the revisit that may replace stored ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import checkpoint

# Headers that describe the stored body or one connection: a revisit never replaces them.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
# Parameters that do not change what a page shows.
IGNORED_PARAMETERS = "^(ref|utm_[a-z]+|fbclid|gclid)(=|$)"
# Records of one URL that one task orders; longer histories are cut into slices of about as many.
MAX_HISTORY = 100_000


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, ``www.``, default port and ignored parameters; the host in lower
    case, an empty path as ``/``, parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]|:(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*(/[^?]*)", 1)
    parameters = F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&", -1), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETERS))
    query = F.array_join(F.array_sort(parameters), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _opaque(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def latest_full_response(records: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """``records`` (url_key, at, record_id, full, stored) with ``before``: what the latest earlier full
    response of its ``url_key`` stored, order being (at, record_id).

    A window per URL would put a whole history into one task, so histories of more than ``max_history``
    records are cut into slices of about that many; what a slice starts with is the last full response
    of those before it.
    """
    sizes = records.groupBy("url_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_history)
    total = sizes.agg(F.sum("n")).first()[0]
    order = Window.partitionBy("url_key").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda along: F.last(F.when(F.col("full"), F.col("stored")), True).over(along)
    if not total:
        return records.withColumn("before", before(order))
    crowded = checkpoint(sizes.select("url_key"))  # grows with the archive: a join that Spark plans by its size
    few = records.join(crowded, "url_key", "left_anti").withColumn("before", before(order))
    sliced = cut_by_rows(records.join(crowded, "url_key", "left_semi"), total, max_history)
    ends = sliced.filter("full").groupBy("url_key", "slice").agg(F.max_by("stored", F.struct("at", "record_id")).alias("end"))
    along = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.select("url_key", "slice").distinct().join(ends, ["url_key", "slice"], "left").select("url_key", "slice", F.last("end", True).over(along).alias("carried"))
    inside = Window.partitionBy("url_key", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = sliced.withColumn("near", before(inside)).join(starts, ["url_key", "slice"])
    return few.unionByName(found.withColumn("before", F.coalesce("near", "carried")).drop("near", "carried", "slice"))


def cut_by_rows(records: DataFrame, total: int, max_history: int) -> DataFrame:
    """``records`` with ``slice``: quantiles of their rows by (url_key, at, record_id), so that bursts and
    equal times are cut too."""
    slices = math.ceil(total / max_history) + 1
    ranged = records.repartitionByRange(slices, "url_key", "at", "record_id")
    # The cuts come from a sample, so they are fixed before anything depends on them.
    return checkpoint(ranged.withColumn("slice", F.spark_partition_id()))


def resolve_revisits(records: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """One row per revisit: record_id, canonical_url, original_id, resolved, reason, body_sha256, headers.

    ``records`` has record_id, url, at, status, etag, last_modified, headers (names in lower case) and
    body_sha256; 304 marks a revisit, 200 a full response, others are passed by. The validators agree
    if the entity tags do (weakly) or, where the revisit has none, the modification dates; a revisit
    without validators agrees with anything. Reasons: ``matched``, ``changed``, ``no original``. Rows
    without url, time or id resolve to nothing and answer nothing. Rows at one time are ordered by
    id; repeated rows give repeated results. An empty table gives no rows; extra columns are ignored.
    """
    usable = F.col("url").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    stored = F.struct(F.col("record_id").alias("id"), "etag", "last_modified", "headers", "body_sha256")
    base = records.filter(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "at", "etag", "last_modified", "headers", (F.col("status") == 304).alias("revisit"), ((F.col("status") == 200) & usable).alias("full"), usable.alias("usable"), stored.alias("stored")
    )
    answered = latest_full_response(base.filter("usable"), max_history).filter("revisit")
    lost = base.filter("revisit and not usable").withColumn("before", F.lit(None).cast(base.schema["stored"].dataType))
    rows = answered.unionByName(lost)
    old = F.col("before")
    agrees = F.when(F.col("etag").isNotNull(), _opaque(F.col("etag")).eqNullSafe(_opaque(old["etag"]))).when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(old["last_modified"])).otherwise(True)
    reason = F.when(old.isNull(), "no original").when(agrees, "matched").otherwise("changed")
    nothing = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", nothing), lambda k, v: ~k.isin(*KEPT_HEADERS))
    kept = F.map_filter(F.coalesce(old["headers"], nothing), lambda k, v: ~F.map_contains_key(fresh, k))
    resolved = F.col("reason") == "matched"
    return rows.withColumn("reason", reason).select(
        "record_id",
        F.col("url_key").alias("canonical_url"),
        F.when(resolved, old["id"]).alias("original_id"),
        resolved.alias("resolved"),
        "reason",
        F.when(resolved, old["body_sha256"]).alias("body_sha256"),
        F.when(resolved, F.map_concat(kept, fresh)).alias("headers"),
    )
