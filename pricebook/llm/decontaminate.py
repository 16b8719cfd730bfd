"""Benchmark decontamination: a hash set of normalised test n-grams is scanned over every token window.

Main path in DataFrame functions only. The windows of the benchmark (10 words; an item with fewer words is one
window) become a table keyed by a 64-bit hash. Every document position makes one hash per window length in use and
looks it up; equal hashes are verified by comparing the words. Only verified hits leave the scan, so what is
shuffled follows the number of hits, not of words.

Size of the broadcast: the window table is counted first. Up to ``BROADCAST_WINDOWS`` rows (about 200 bytes each) it
is broadcast; beyond that the same join runs without the hint as a shuffled join.

Defined cases: a null or empty text has no words and no hits; a null or empty item has no window; a null doc_id is
a value like any other; a repeated row is reported once per repetition; an empty benchmark hits nothing; other
columns, whatever their names, pass through ``decontaminate`` untouched.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import alnum_words, row_key

N = 10
BROADCAST_WINDOWS = 200_000


def windows(benchmark: DataFrame, n=N) -> DataFrame:
    """(item_id, len, words, h): the distinct windows of each item."""
    w = benchmark.select("item_id", alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return (w.select("item_id", "w", F.explode(starts).alias("i"))
            .select("item_id", F.slice("w", F.col("i"), n).alias("words"))
            .select("item_id", F.size("words").alias("len"), F.array_join("words", " ").alias("words"),
                    F.xxhash64("words").alias("h"))
            .distinct())


def hits(docs: DataFrame, benchmark: DataFrame, n=N) -> DataFrame:
    """One row per document row and verified window, plus one with position 0 for the document itself.

    Columns: k (content key), doc_id, n_words, pos (first word, from 1; 0 for the document), len, words.
    """
    grams = windows(benchmark, n).select("len", "words", "h").distinct()
    seen = grams.groupBy("len").agg(F.count("*").alias("c")).collect()      # at most n rows
    lengths = sorted(r["len"] for r in seen)
    table = grams.select(F.col("h").alias("g_h"), F.col("words").alias("g_words"), F.col("len").alias("g_len"))
    small = sum(r["c"] for r in seen) <= BROADCAST_WINDOWS
    table = F.broadcast(table) if small else table
    d = docs.select("doc_id", row_key("doc_id", "text").alias("k"), alnum_words(F.col("text")).alias("w"))
    d = d.select("doc_id", "k", "w", F.size("w").alias("n_words"))
    d = d.select("*", F.explode_outer(F.sequence(F.lit(0), "n_words")).alias("pos"))
    parts = []
    for m in lengths:
        here = (F.col("pos") > 0) & (F.col("pos") + m - 1 <= F.col("n_words"))
        parts.append(F.when(here, F.xxhash64(F.slice("w", F.col("pos"), m))))
    if len(parts) > 1:
        d = d.select("*", F.posexplode_outer(F.array(*parts)).alias("li", "h"))
        d = d.withColumn("len", F.element_at(F.array(*[F.lit(m) for m in lengths]), F.col("li") + 1))
        d = d.where((F.col("li") == 0) | F.col("h").isNotNull())
    else:
        d = d.withColumn("li", F.lit(0)).withColumn("len", F.lit(lengths[0] if lengths else 0))
        d = d.where((F.col("pos") == 0) | (F.col("pos") + F.col("len") - 1 <= F.col("n_words")))
        d = d.withColumn("h", parts[0] if parts else F.lit(None).cast("long"))
    own = F.array_join(F.slice("w", F.greatest("pos", F.lit(1)), F.col("len")), " ")
    if not small:
        # a shuffled position carries its own words, not those of the whole document
        d = d.withColumn("own", F.when(F.col("h").isNotNull(), own)).drop("w")
        own = F.col("own")
    same = ((F.col("h") == F.col("g_h")) & (F.col("len") == F.col("g_len"))
            & (own == F.col("g_words")))
    return (d.join(table, same, "left")
            .where((F.col("pos") == 0) & (F.col("li") == 0) | F.col("g_words").isNotNull())
            .select("k", "doc_id", "n_words", "pos", F.col("g_len").alias("len"), F.col("g_words").alias("words")))


def _covered(spans):
    """Words inside the union of sorted (pos, len) spans."""
    end = lambda s: s["pos"] + s["len"] - 1
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["last"], end(s)).alias("last"),
        (a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["last"], s["pos"] - 1))).cast("long").alias("n")))["n"]


def report(docs: DataFrame, benchmark: DataFrame, n=N) -> DataFrame:
    """Per document row: k, doc_id, n_words, n_hit, n_items, items (sorted ids as strings), spans, contaminated."""
    found = hits(docs, benchmark, n)
    span = F.struct("pos", "len")
    per = found.groupBy("k").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sum((F.col("pos") == 0).cast("long")).alias("times"),
        F.sort_array(F.collect_set(F.when(F.col("pos") > 0, span))).alias("spans"))
    real = found.where("pos > 0")
    owners = windows(benchmark, n).select("words", F.col("item_id").cast("string").alias("item_id")).distinct()
    items = (real.select("k", "words").distinct().join(owners, "words").select("k", "item_id").distinct()
             .groupBy("k").agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    out = per.join(items, "k", "left").select(
        "k", "doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", "times")
    return (out.withColumn("contaminated", F.col("n_hit") > 0)
            .withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode="documents", n=N) -> DataFrame:
    """The documents without contaminated ones (``documents``), or without the hit words (``spans``).

    A cut span leaves the text on both sides; the separator in front of each cut word goes with it.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    real = hits(docs, benchmark, n).where("pos > 0")
    rows = docs.select(F.struct("*").alias("_doc"), row_key("doc_id", "text").alias("_k"))
    if mode == "documents":
        return rows.join(real.select(F.col("k").alias("_k")).distinct(), "_k", "left_anti").select("_doc.*")
    cut = (real.groupBy(F.col("k").alias("_k"))
           .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1))))
                .alias("_cut")))
    text = F.col("_doc.text")
    raw = F.split(text, r"(?<=[0-9A-Za-z\x80-\x{10FFFF}])(?=[^0-9A-Za-z\x80-\x{10FFFF}])")   # word with its separator
    kept = F.array_join(F.filter(raw, lambda x, i: ~F.array_contains("_cut", i + 1)), "")
    new = F.when(F.col("_cut").isNull(), text).otherwise(kept)
    joined = rows.join(cut, "_k", "left").withColumn("_text", new)
    return joined.select(*[F.col("_text").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
