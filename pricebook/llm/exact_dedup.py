"""Exact dedup with a heavy-hitter split.

Texts are equal when they are the same without ASCII white space. One pass over the texts leaves a narrow table
(id, digest, length), written once; the texts themselves are never shuffled. A Misra-Gries summary (Spark's frequent-item
sketch, a Misra-Gries counter table that drops its lower half when full) is built per task, merged in ``MERGES`` groups
and then once. Every digest that more than ``7 / counters`` of the rows hold is among its at most ``HEAVY`` candidates.
The candidates are verified: a map-side aggregate counts their rows exactly and finds the row that stays. Those winners,
at most ``HEAVY`` times the 64-bit collisions of a candidate, are broadcast and settle the rows of heavy digests where
they lie. All other digests go through an ordinary shuffle, in which no digest has more than that share of the rows.

Of equal texts the longest (code points) stays, then the least doc_id, then the least content hash, then the first row as
written. DataFrame functions only.

Defined cases: a null text counts as empty; texts of white space alone equal the empty one; a null doc_id comes after
all others; of repeated rows one stays; an empty table gives no rows; other columns, whatever their names, are not read by
``report`` and pass through ``dedup`` untouched (columns that Spark cannot hash, such as maps, do not break ties).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.llm.common import SPACE, row_key, stored

COUNTERS = 8192             # counters of the summary; a power of two
HEAVY = 1024                # no more digests can be above the guaranteed share (7 / 8192 of the rows)
MERGES = 32
ORDER = ("rank", "lost_id", "doc_id", "tie", "uid")


def _hashable(docs):
    return [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, rank, lost_id, tie, uid, k) per row; the least (rank, lost_id, doc_id, tie, uid) of a digest stays."""
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, SPACE, "")
    d = docs.select("doc_id", F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"), (-F.length(text)).alias("rank"),
                    F.col("doc_id").isNull().alias("lost_id"), row_key(*_hashable(docs)).alias("k"))
    d = d.select("*", F.xxhash64("k").alias("tie"), F.monotonically_increasing_id().alias("uid"))
    return stored(d, "dedup-digests")


def frequent(d: DataFrame, counters=COUNTERS, heavy=HEAVY) -> DataFrame:
    """(h): 64-bit hashes of the digests that a Misra-Gries summary with so many counters finds frequent."""
    items = counters * 3 // 4                                # the sketch keeps its table three quarters full
    each = (d.select(F.xxhash64("digest").alias("h"), (F.spark_partition_id() % MERGES).alias("g"))
            .groupBy("g").agg(F.expr(f"approx_top_k_accumulate(h, {items})").alias("s")))
    top = each.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {items})").alias("s"))
    return top.select(F.explode(F.expr(f"approx_top_k_estimate(s, {min(heavy, items)})")).alias("x")).select(F.col("x.item").alias("h"))


def winners(d: DataFrame, counters=COUNTERS, heavy=HEAVY) -> DataFrame:
    """(digest, keep_id, keep_uid, group_size) of the frequent digests, counted exactly; at most ``heavy`` hashes."""
    few = F.broadcast(frequent(d, counters, heavy))
    rows = d.withColumn("h", F.xxhash64("digest")).join(few, "h", "left_semi")
    w = rows.groupBy("digest").agg(F.min(F.struct(*ORDER)).alias("w"), F.count("*").alias("group_size"))
    return w.where("group_size > 1").select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.uid").alias("keep_uid"), "group_size")


def _settled(docs, counters, heavy):
    """Every row of the digest table with keep_id, group_size and kept."""
    d = digests(docs)
    w = stored(winners(d, counters, heavy), "dedup-winners")
    by_map = d.join(F.broadcast(w), "digest").withColumn("kept", F.col("uid") == F.col("keep_uid")).drop("keep_uid")
    rest = d.join(F.broadcast(w.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    first = F.row_number().over(group.orderBy(*ORDER)) == 1
    keep = F.first("doc_id").over(group.orderBy(*ORDER))
    rest = (rest.select("*", keep.alias("keep_id"), first.alias("kept")).select("*", F.count("*").over(group).alias("group_size"))
            .select(*by_map.columns))
    return by_map.union(rest)


def report(docs: DataFrame, counters=COUNTERS, heavy=HEAVY) -> DataFrame:
    """Per document row: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    return _settled(docs, counters, heavy).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, counters=COUNTERS, heavy=HEAVY) -> DataFrame:
    """One document of each group of equal texts, with all its columns.

    Texts stay where they are: only the keys of rows to drop are joined to them. Rows that are repeated in every column
    share a key; they alone are reduced to one by a map-side aggregate.
    """
    s = stored(_settled(docs, counters, heavy).where("group_size > 1").select("k", "kept"), "dedup-marks")
    keys = s.groupBy("k").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).select(F.col("k").alias("_k"), "_kept", "_n")
    keys = stored(keys, "dedup-keys")
    rows = docs.select(F.struct("*").alias("_doc"), row_key(*_hashable(docs)).alias("_k"))
    out = rows.join(keys.where("not _kept or _n > 1").select("_k"), "_k", "left_anti").select("_doc.*")
    again = keys.where("_kept and _n > 1").select("_k")
    if not again.isEmpty():
        out = out.union(rows.join(again, "_k", "left_semi").groupBy("_k").agg(F.first("_doc").alias("_doc")).select("_doc.*"))
    return out
