"""Mixing sources to target weights by temperature.

A source with token share p gets a weight in proportion to p ** x. The exponent x in [0, 1] (1: as found, 0: all
equal) is bisected: ``max_repeats`` looks for the flattest mix in which no source is repeated more than so often
against the least repeated one, ``entropy`` for the mix whose entropy (in nats) is nearest above the target. Each round
halves the bracket 6 times at once: 64 exponents are tried in one small aggregate over the sources, and five rounds
leave 2 ** -30 of the bracket.

The weights are realised as budgeted block permutations: a source with quota q and t tokens is read in blocks; each
block is a permutation of all its documents by a keyed hash, the last one is cut where the quota is met. Without a
budget, the total is chosen so that the least repeated source is read exactly once and no document is lost.

A source may hold any share of the rows. Running sums inside a block go over 4,096 hash ranges of the permutation:
sums of whole ranges are chained in a table of sources x 4,096 rows, rows only inside their range.

DataFrame functions only. Defined cases: null sources are one source; a document without tokens takes no budget and
comes with each block; no documents give no rows; repeated rows are separate documents at the same place; other
columns pass through ``mix`` untouched.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.llm.common import row_key, space_words, stored

MAX_REPEATS, TRIES, ROUNDS, SEED = 2.0, 64, 5, 42
CELLS = 3                   # leading hex digits of a hash that name its range: 4,096 ranges


def source_tokens(docs: DataFrame, tokens) -> DataFrame:
    """(source, t, n): tokens and documents of each source; null sources are one."""
    return docs.groupBy("source").agg(F.sum(tokens).cast("long").alias("t"), F.count("*").alias("n"))


def weights(sources: DataFrame, max_repeats=MAX_REPEATS, entropy=None) -> DataFrame:
    """(source, t, weight, repeats) of the sources with tokens; repeats is relative to the least repeated source."""
    spark = sources.sparkSession
    s = sources.where("t > 0").select("source", "t")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = spark.range(TRIES + 1).select("id", (F.lit(low) + F.col("id") * ((high - low) / TRIES)).alias("x"))
        # log weight against the largest source keeps every power at or below one
        grid = s.crossJoin(F.broadcast(s.agg(F.max("t").alias("top")))).crossJoin(F.broadcast(tried))
        log = F.log(F.col("t") / F.col("top"))
        seen = (grid.groupBy("id", "x")
                .agg(F.sum(F.exp(F.col("x") * log)).alias("z"), F.sum(F.exp(F.col("x") * log) * F.col("x") * log).alias("e"),
                     F.max((F.col("x") - 1) * log).alias("most"))
                .select("id", "x", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), F.exp("most").alias("repeats"))
                .orderBy("id").collect())                                    # TRIES + 1 rows
        if not seen:
            break
        # both goals hold on one side: repeats falls and entropy falls as x grows
        fits = [r["id"] for r in seen if (r["repeats"] <= max_repeats + 1e-12 if entropy is None else r["entropy"] < entropy)]
        first = fits[0] if fits else TRIES
        low, high = seen[max(first - 1, 0)]["x"], seen[first]["x"]
    x = round(high, 6)
    total = s.crossJoin(F.broadcast(s.agg(F.max("t").alias("top"))))
    raw = total.select("source", "t", F.exp(F.lit(x) * F.log(F.col("t") / F.col("top"))).alias("w"),
                       F.exp(F.lit(x - 1) * F.log(F.col("t") / F.col("top"))).alias("repeats"))
    return (raw.crossJoin(F.broadcast(raw.agg(F.sum("w").alias("z"))))
            .select("source", "t", (F.col("w") / F.col("z")).alias("weight"), "repeats"))


def quotas(sources: DataFrame, max_repeats=MAX_REPEATS, entropy=None, budget=None) -> DataFrame:
    """(source, t, weight, quota): tokens to draw from each source."""
    w = weights(sources, max_repeats, entropy)
    # without a budget the largest source, the least repeated one, is read once
    q = F.floor(F.col("t") * F.col("repeats") + 1e-6) if budget is None else F.floor(F.col("weight") * budget + 1e-6)
    return w.select("source", "t", "weight", q.cast("long").alias("quota"))


def _key():
    """Content key of a document row; null and empty, and values that only meet differently, have different keys."""
    parts = [F.col(c).cast("string") for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("|", *[F.when(c.isNull(), "n").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in parts]))


def _place(seed, block, k):
    """Rank of a row in the permutation of a block: a keyed hash, so ties are as good as impossible."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(block).cast("string"), F.col(k)))


def _places(docs: DataFrame, quota: DataFrame, seed) -> DataFrame:
    """(k, block, place): the blocks in which the row with content key k is drawn, and its rank in the permutation.

    ``docs`` holds k, source, tokens. A row is drawn in every full block, and in the last one if the tokens before it
    in that block's permutation are below what is left of the quota.
    """
    q = quota.select("source", "quota", "t", F.floor(F.col("quota") / F.col("t")).alias("full"))
    d = docs.join(q, docs["source"].eqNullSafe(q["source"]), "left").drop(q["source"])
    whole = F.coalesce("full", F.lit(1)).cast("int")               # a source without tokens is passed on once
    rest = F.coalesce(F.col("quota") - F.col("full") * F.col("t"), F.lit(0))
    d = d.select("k", "source", "tokens", whole.alias("full"), rest.alias("rest"))
    always = d.where("full > 0").select("k", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("block"))
    part = d.where("rest > 0").select("k", "source", "tokens", "full", "rest", _place(seed, "full", "k").alias("h"))
    part = part.withColumn("cell", F.substring("h", 1, CELLS))      # the order of cells is the order of hashes
    sums = part.groupBy("source", "cell").agg(F.sum("tokens").alias("m"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    part = part.join(sums, part["source"].eqNullSafe(sums["s"]) & (part["cell"] == sums["c"])).drop("s", "c")
    inside = Window.partitionBy("source", "cell").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    cut = part.select("k", F.col("full").alias("block"), ahead.alias("ahead"), "rest").where("ahead < rest").select("k", "block")
    return always.union(cut).withColumn("place", _place(seed, "block", "k"))


def plan(docs: DataFrame, tokens=None, max_repeats=MAX_REPEATS, entropy=None, budget=None, seed=SEED) -> DataFrame:
    """(doc_id, source, tokens, block, place) for every drawing; sort by (block, place) for the training order."""
    d, places = _drawn(docs, tokens, max_repeats, entropy, budget, seed)
    return d.join(places, "k").select("doc_id", "source", "tokens", "block", "place")


def _drawn(docs, tokens, max_repeats, entropy, budget, seed):
    tokens = F.size(space_words(F.col("text"))) if tokens is None else tokens
    d = docs.select("doc_id", "source", _key().alias("k"), tokens.cast("long").alias("tokens"))
    # repeated rows are numbered, so that each is drawn on its own
    one = d.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"),
                             F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    one = one.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "k")
    one = one.select("doc_id", "source", "tokens", F.concat_ws(".", "k", F.col("i").cast("string")).alias("k"))
    d = stored(one, "mix-docs")
    q = stored(quotas(source_tokens(d, F.col("tokens")), max_repeats, entropy, budget), "mix-quotas")
    return d, _places(d, q, seed)


def mix(docs: DataFrame, tokens=None, max_repeats=MAX_REPEATS, entropy=None, budget=None, seed=SEED) -> DataFrame:
    """The drawn documents with all their columns, once per drawing.

    Rows of one id, source and text may differ in other columns: the drawings of their key are dealt to them in turn of a
    hash of the whole row. Only rows repeated in every column are drawn from one of them.
    """
    _, places = _drawn(docs, tokens, max_repeats, entropy, budget, seed)
    plain = [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    rows = docs.select(F.struct("*").alias("_doc"), _key().alias("_k"), row_key(*plain).alias("_v"))
    kinds = rows.groupBy("_k", "_v").agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.select("_k", "_v", "_m", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_b"))
    drawn = places.groupBy(F.substring_index("k", ".", 1).alias("_k"), F.substring_index("k", ".", -1).cast("long").alias("_i")).agg(F.count("*").alias("_n"))
    mine = (F.col("_i") > F.col("_b")) & (F.col("_i") <= F.col("_b") + F.col("_m"))
    draws = stored(kinds.join(drawn, "_k").where(mine).groupBy("_v", "_m").agg(F.sum("_n").alias("_n")), "mix-draws")

    def dealt(some, many):
        return (some.join(draws.where("_m > 1" if many else "_m = 1").select("_v", "_n"), "_v")
                .select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")).select("_doc.*"))

    out = dealt(rows, False)
    if draws.where("_m > 1").isEmpty():
        return out
    again = rows.join(draws.where("_m > 1").select("_v"), "_v", "left_semi").groupBy("_v").agg(F.first("_doc").alias("_doc"))
    return out.union(dealt(again, True))
