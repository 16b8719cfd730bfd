"""Line dedup by an exact set-similarity join.

A line is the set of its words. Its tokens are ordered by rarity (corpus counts of 65,536 hash buckets; any order
gives the same result, a good one fewer candidates). Two lines whose Jaccard similarity reaches 4/5 share a token in
the prefixes of that order, differ little in length, and leave enough tokens behind the shared one; the parity of
token bits bounds their symmetric difference: 64 bits inside the join, 256 on the distinct pairs it finds. Pairs that
pass all filters are verified on the words themselves. A line with an earlier line (by doc_id, line number) that is
similar to it is removed, whether or not that one stays.

Equal sets are one class, named by its first line; only classes are joined. A class needs one earlier match, not all:
first each class is compared with the first class that shares a pair of its rarest tokens, which settles groups of
near copies in linear work; the join then looks for matches of the classes left. Sets of up to ``EQUAL_ONLY`` words
reach 4/5 with equal sets alone, so their class settles them and they take no part in the joins.

DataFrame functions only. Words are hashed once; the classes carry their prefix, and words are read again only for
candidates. The documents that hold them are counted: up to ``BROADCAST_KEYS`` of them are broadcast with the line
numbers wanted, beyond that the same join is shuffled.

Defined cases: lines of fewer than ``least`` words (``LEAST`` if not given, 1 in the query: every line with a word) are
left alone, lines without a word always; null and empty texts have no line; null
doc_ids come last; rows with equal doc_id and text are one document and all get its result; an empty table has no
rows; other columns pass through ``dedup_lines`` untouched.
"""

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import SPACE, computed, row_key, stored

LEAST, EQUAL_ONLY, BUCKETS, BROADCAST_KEYS = 5, 3, 65_536, 500_000


def _parts(line):
    """Words of a line; a pattern is tried only where it holds white space other than spaces."""
    other = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in "\t\x0b\x0c\r"])
    return F.array_remove(F.when(other, F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def _words(line):
    return F.array_distinct(_parts(line))


def rarity(docs: DataFrame) -> list:
    """Logarithmic corpus count of each hash bucket; 65,536 rows at most go to the driver."""
    w = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(_parts(F.col("line"))).alias("w"))
    w = w.select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b"))
    seen = {r["b"]: r["r"] for r in w.groupBy("b").agg(F.floor(F.log2(F.count("*")) * 2).cast("int").alias("r")).collect()}
    return [min(seen.get(b, 0), 120) for b in range(BUCKETS)]


def lines(docs: DataFrame, least=LEAST) -> DataFrame:
    """A row per line of ``least`` words or more: place, class key, size, parity bits and prefix tokens."""
    rank = F.from_json(F.lit(json.dumps(rarity(docs))), "array<tinyint>")
    d = docs.select(row_key("doc_id", "text").alias("k"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    d = d.select("k", "doc_id", F.posexplode_outer("l").alias("pos", "line"))
    d = d.select("k", "doc_id", "pos", F.transform(_parts(F.col("line")), lambda x: F.xxhash64(x)).alias("h"))
    d = computed(d, "h").where(F.size("h") >= max(least, 1))
    # rarity in the highest bits, 57 bits of the hash below: one sort of longs gives the order
    key = lambda h: F.shiftleft(F.get(rank, F.pmod(h, F.lit(BUCKETS)).cast("int")).cast("long"), 57).bitwiseOR(F.shiftrightunsigned(h, 7))
    d = d.select("k", "doc_id", "pos", F.sort_array(F.array_distinct(F.transform("h", key))).alias("o"))
    n = F.size("o")
    d = d.select("k", "doc_id", "pos", "o", n.alias("n"), (n - F.ceil(n * 4 / 5).cast("int") + 1).alias("p"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(63).cast("int"))
    lane = lambda j: F.aggregate("o", F.lit(0).cast("long"), lambda a, x: F.when(x.bitwiseAND(3) == j, a.bitwiseXOR(bit(x))).otherwise(a))
    wide = [lane(j).alias(f"b{j}") for j in range(4)]
    pre = F.transform(F.slice("o", 1, F.col("p")), lambda x: F.hash(x))
    return d.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos", "k").alias("at"),
                 row_key("o").alias("c"), "n", F.struct(*wide).alias("wide"), pre.alias("pre"))


def classes(found: DataFrame) -> DataFrame:
    """The first line of each class, with an id."""
    first = found.groupBy("c").agg(F.min(F.struct("at", "n", "wide", "pre")).alias("f")).select("f.*")
    return stored(first.withColumn("id", F.monotonically_increasing_id()), "line-classes")


def _most(n, m):
    """Bound of the symmetric difference of similar sets of these sizes."""
    return n + m - 2 * F.ceil((n + m) * 4 / 9)


def _may(n, m, bits, other):
    """Length filter and bound of the symmetric difference."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (F.bit_count(bits.bitwiseXOR(other)) <= _most(n, m))


def _bits():
    """The 256 parity bits folded to 64."""
    return F.col("wide.b0").bitwiseXOR(F.col("wide.b1")).bitwiseXOR(F.col("wide.b2")).bitwiseXOR(F.col("wide.b3"))


def near(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The distinct pairs that all 256 parity bits let pass."""
    both = named.select("id", "n", "wide")
    c = lambda s: F.col(s)
    found = pairs.select("x", "y").distinct().join(both.alias("p"), c("x") == c("p.id")).join(both.alias("q"), c("y") == c("q.id"))
    apart = sum(F.bit_count(c(f"p.wide.b{j}").bitwiseXOR(c(f"q.wide.b{j}"))) for j in range(4))
    return found.where(apart <= _most(c("p.n"), c("q.n"))).select("x", "y")


def verified(docs: DataFrame, pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Ids x of the pairs (x, y) whose lines are similar, judged on the words."""
    pairs = stored(pairs, "line-pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    want = ids.join(named.select("id", F.col("at.k").alias("k"), F.col("at.pos").alias("pos")), "id")
    want = stored(want.groupBy("k").agg(F.collect_list(F.struct("pos", "id")).alias("own")), "line-wanted")
    want = F.broadcast(want) if want.count() <= BROADCAST_KEYS else want
    texts = docs.select(row_key("doc_id", "text").alias("k"), F.split("text", "\n").alias("l")).join(want, "k").select("l", F.explode("own").alias("o"))
    texts = texts.select("o.id", F.get("l", F.col("o.pos")).alias("line"))
    sets = stored(texts.dropDuplicates(["id"]).select("id", _words(F.col("line")).alias("w")), "line-sets")
    a, b = sets.select(F.col("id").alias("x"), F.col("w").alias("a")), sets.select(F.col("id").alias("y"), F.col("w").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, "x").join(b, "y").where(5 * both >= 4 * (F.size("a") + F.size("b") - both)).select(F.col("x").alias("id")).distinct())


def matched(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Ids of the classes whose first line has an earlier similar line."""
    named = named.where(F.col("n") > EQUAL_ONLY)
    # the first class for each pair of rare tokens
    two = [F.when(F.size("pre") > 2 * j + 1, F.xxhash64(F.get("pre", F.lit(2 * j)), F.get("pre", F.lit(2 * j + 1)))) for j in range(2)]
    short = named.select("id", "at.none", "at.doc_id", "at.pos", "n", _bits().alias("bits"), F.explode(F.array_compact(F.array(*two))).alias("t"))
    heads = short.groupBy("t").agg(F.min(F.struct("none", "doc_id", "pos", "id", "n", "bits")).alias("h"), F.count("*").alias("m")).where("m > 1")
    close = short.join(heads, "t").where((F.col("id") != F.col("h.id")) & _may(F.col("n"), F.col("h.n"), F.col("bits"), F.col("h.bits")))
    first = stored(verified(docs, near(close.select(F.col("id").alias("x"), F.col("h.id").alias("y")), named), named), "line-first")
    # size, place of the token, whether the class is settled and whether it has no doc_id share a long: the rows of this exchange are the most
    m = F.col("n").cast("long") * 2 ** 33 + F.col("i").cast("long") * 4 + F.col("done").cast("long") * 2 + F.col("none").cast("long")
    rows = (named.join(first.withColumn("done", F.lit(True)), "id", "left")
            .select("id", "at.none", "at.doc_id", "at.pos", "n", _bits().alias("bits"), F.coalesce("done", F.lit(False)).alias("done"), F.posexplode("pre").alias("i", "t"))
            .select("t", m.alias("m"), "bits", "doc_id", "pos", "id"))
    c = lambda s: F.col(s)
    n = lambda s: F.shiftright(c(f"{s}.m"), 33)
    left = lambda s: n(s) - F.shiftright(c(f"{s}.m").bitwiseAND(2 ** 33 - 1), 2) - 1
    place = lambda s: F.struct(c(f"{s}.m").bitwiseAND(1), c(f"{s}.doc_id"), c(f"{s}.pos"), c(f"{s}.id"))
    need = F.ceil((n("x") + n("y")) * 4 / 9)
    # the conditions name the columns of both sides alike, so that one exchange of the prefix rows serves both
    pairs = rows.alias("x").join(rows.alias("y"), (c("x.t") == c("y.t")) & ~((c("x.m").bitwiseAND(2) > 0) & (c("y.m") > 0)) & (c("x.id") != c("y.id"))
                                 & _may(n("x"), n("y"), c("x.bits"), c("y.bits")) & (1 + F.least(left("x"), left("y")) >= need) & (place("y") < place("x")))
    second = verified(docs, near(pairs.select(c("x.id").alias("x"), c("y.id").alias("y")), named), named)
    return first.union(second)


def kept(docs: DataFrame, least=LEAST) -> DataFrame:
    """(k, stay): the numbers of the lines that stay in each document that has any, of those with ``least`` words or more."""
    named = classes(lines(docs, least))
    stay = named.select("id", "at").join(matched(docs, named), "id", "left_anti")
    return stay.groupBy(F.col("at.k").alias("k")).agg(F.collect_list("at.pos").alias("stay"))


def _places(text, least):
    """The numbers of the lines of ``least`` words or more."""
    has = r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (max(least, 1) - 1)
    return F.array_compact(F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(has), i)))


def _cut():
    """The numbers of the lines that do not stay; null if there are none."""
    cut = F.array_except("places", F.coalesce("stay", F.array().cast("array<int>")))
    return F.when(F.size(cut) > 0, cut)


def report(docs: DataFrame, least=LEAST) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined)."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.size(F.split("text", "\n")).alias("n"), _places(F.col("text"), least).alias("places"))
    out = rows.join(kept(docs, least), "k", "left").select("doc_id", "n", _cut().alias("cut"))
    return out.select("doc_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join(F.col("cut").cast("array<string>"), ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, least=LEAST) -> DataFrame:
    """The documents without the removed lines."""
    rows = docs.select(F.struct("*").alias("_doc"), row_key("doc_id", "text").alias("k"), _places(F.col("text"), least).alias("places"))
    out = rows.join(kept(docs, least), "k", "left").select("_doc", _cut().alias("cut"))
    left = F.filter(F.split(F.col("_doc.text"), "\n"), lambda x, i: ~F.array_contains("cut", i))
    text = F.when(F.col("cut").isNull(), F.col("_doc.text")).otherwise(F.array_join(left, "\n"))
    return out.select(*[text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
