"""Search, suggestions and similarity over the flat element view."""

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.functions.text import (confidence_level, has, jaccard, query_terms, rx,
                                      sequence_ratio, tokenize, trigrams)
from pricebook.operators.scale import staged

# Weight of a hit per searched column.
WEIGHTS = (("designation", 10), ("description", 5), ("titre_section", 3))


def _sum(cols):
    return functools.reduce(operator.add, cols)


def _any(conds):
    return functools.reduce(operator.or_, conds)


def apply_filters(df: DataFrame, client_id=None, dpgf_id=None, lot_id=None, lot_numero=None, section_id=None,
                  min_price=None, max_price=None) -> DataFrame:
    """Conjunction of the given criteria; price bounds are inclusive."""
    equal = {"id_client": client_id, "id_dpgf": dpgf_id, "id_lot": lot_id, "numero_lot": lot_numero,
             "id_section": section_id}
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    if min_price is not None:
        df = df.filter(F.col("prix_unitaire") >= F.lit(min_price))
    if max_price is not None:
        df = df.filter(F.col("prix_unitaire") <= F.lit(max_price))
    return df


def text_condition(terms, collation=None):
    """Every term must match: long ones anywhere, two-letter ones as a spaced word outside titles."""
    conds = []
    for t in terms:
        if len(t) >= 3:
            conds.append(_any([has(c, t, collation) for c, _ in WEIGHTS]))
        else:
            conds.append(_any([has(c, f" {t} ", collation) for c, _ in WEIGHTS[:2]]))
    return functools.reduce(operator.and_, conds) if conds else F.lit(True)


def relevance(terms, collation=None):
    """10 / 5 / 3 points per long term found in designation / description / section title."""
    parts = [F.when(has(c, t, collation), w).otherwise(0) for t in terms if len(t) >= 3 for c, w in WEIGHTS]
    return _sum(parts) if parts else F.lit(0)


def designation_hits(terms, collation=None):
    parts = [F.when(has("designation", t, collation), 1).otherwise(0) for t in terms]
    return _sum(parts) if parts else F.lit(0)


SORTS = {
    "price": ["prix_unitaire"], "date": ["created_at"], "designation": ["designation"],
    "dpgf": ["nom_projet"], "lot": ["numero_lot", "nom_lot"], "section": ["numero_section", "titre_section"],
}


def apply_sort(df: DataFrame, sort_by="relevance", descending=True) -> DataFrame:
    """Order by the mode, then designation, then id so that pages are stable."""
    if sort_by == "relevance":
        keys = [F.desc("relevance_score")] if "relevance_score" in df.columns else []
    else:
        keys = [F.desc(c) if descending else F.asc(c) for c in SORTS[sort_by]]
    if sort_by != "designation":
        keys.append(F.asc("designation"))
    return df.orderBy(*keys, F.asc("id_element"))


def search_matches(flat, query=None, collation=None, **filters):
    """All matching rows with their score; ``collation`` decides whether accents count."""
    terms = query_terms(query) if query else []
    df = apply_filters(flat, **filters)
    if terms:
        df = df.filter(text_condition(terms, collation))
        long_terms = [t for t in terms if len(t) >= 3]
        df = df.withColumn("relevance_score", relevance(terms, collation) if long_terms else designation_hits(terms, collation))
    return df


def search_elements(flat, query=None, sort_by="relevance", descending=True, skip=0, limit=50, collation=None, **filters):
    """One page of the multi-criteria search and the total, as two frames of the same plan."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    found = search_matches(flat, query, collation, **filters)
    return (apply_sort(found, sort_by, descending).offset(skip).limit(limit),
            found.agg(F.count("*").alias("total")))


def suggest(flat, sections_lots, q, limit=10, client_id=None, dpgf_id=None, lot_id=None, collation=None):
    """Completions: designations, then elements found by description, then section titles.

    A query of fewer than two characters gives nothing.
    """
    q = q.lower().strip()
    if len(q) < 2:
        flat, sections_lots = flat.filter("false"), sections_lots.filter("false")
    df = apply_filters(flat, client_id=client_id, dpgf_id=dpgf_id, lot_id=lot_id)
    text = F.col("designation").alias("text")
    one = (df.filter(has("designation", q, collation)).groupBy(text)
           .agg(F.min("id_element").alias("id"))
           .select(F.lit(1).alias("stage"), "text", "id", F.length("text").alias("len"), F.lit("designation").alias("type")))
    two = (df.filter(has("description", q, collation) & ~has("designation", q, collation)).groupBy(text)
           .agg(F.min("id_element").alias("id"), F.min(F.length("description")).alias("len"))
           .select(F.lit(2).alias("stage"), "text", "id", "len", F.lit("description").alias("type")))
    out = one.unionByName(two)
    if lot_id is None:
        s = apply_filters(sections_lots, client_id=client_id, dpgf_id=dpgf_id).filter(has("titre_section", q, collation))
        out = out.unionByName(s.select(
            F.lit(3).alias("stage"),
            F.concat(F.lit("Section "), F.col("numero_section"), F.lit(": "), F.col("titre_section")).alias("text"),
            F.col("id_section").alias("id"), F.lit(0).alias("len"), F.lit("section").alias("type")))
    return out.orderBy("stage", "len", "text", "id").limit(limit)


def similar_elements(flat, reference: DataFrame, limit=10, with_ratio=True):
    """Elements sharing a long term with one reference row, same lot and section first.

    ``reference`` is one row selected by its primary key.
    """
    terms = F.filter(F.concat(tokenize("designation"), tokenize("description")), lambda t: F.length(t) >= 3)
    ref = reference.limit(1).select(F.col("id_element").alias("_id"), F.col("id_lot").alias("_lot"),
                                    F.col("id_section").alias("_sec"), F.col("designation").alias("_text"),
                                    terms.alias("_terms"))
    shared = F.exists("_terms", lambda t: F.lower("designation").contains(t)
                      | F.coalesce(F.lower("description").contains(t), F.lit(False)))
    same_lot = F.coalesce(F.col("id_lot") == F.col("_lot"), F.lit(False))
    same_sec = F.coalesce(F.col("id_section") == F.col("_sec"), F.lit(False))
    found = (flat.join(F.broadcast(ref), (F.col("id_element") != F.col("_id"))
                       & ((F.size("_terms") == 0) | shared))
             .withColumn("similarity_score", F.when(same_lot & same_sec, 30).when(same_lot, 20)
                         .when(same_sec, 10).otherwise(0))
             .orderBy(F.desc("similarity_score"), "id_element").limit(limit))
    if with_ratio:
        found = found.withColumn("text_similarity", F.bround(sequence_ratio("_text", "designation") * 100))
    return found.drop("_id", "_lot", "_sec", "_text", "_terms")


def match_score(text):
    """Points of a row for a text's tokens, as a share of all designation points."""
    tokens = query_terms(text)
    return relevance(tokens).cast("double") / (max(1, len(tokens)) * 10.0) * 100.0


def match_text(flat, text, limit=10, **filters):
    """Elements hit by any long token of a text, scored 0-100 with a confidence class."""
    tokens = query_terms(text)
    long_tokens = [t for t in tokens if len(t) >= 3]
    df = apply_filters(flat, **filters)
    if long_tokens:
        df = df.filter(_any([has(c, t) for t in long_tokens for c, _ in WEIGHTS]))
    raw = match_score(text)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(raw)))
    return (df.withColumn("_raw", raw).withColumn("match_confidence", score.cast("int"))
            .withColumn("confidence_level", confidence_level(score))
            .orderBy(F.desc("_raw"), "id_element").limit(limit).drop("_raw"))


def search_similar(df, q, threshold=0.7, limit=50, text="designation", method="trigram", texts=None):
    """Rows whose text is close to ``q``: trigram share above, or sequence ratio at least, the threshold.

    Designations repeat, so each distinct text is scored once and the few close
    ones are joined back. ``texts`` may name a cheaper frame that holds all
    texts of ``df`` (the stored elements, say).
    """
    # the score reads the count, else the filter would be pushed below the aggregate and run per row
    t = (df if texts is None else texts).groupBy(text).agg(F.count("*").alias("_n"))
    if method == "trigram":
        scored = t.withColumn("similarity", F.when(F.col("_n") > 0, jaccard(trigrams(text), trigrams(F.lit(q.strip().lower())))))
        scored = scored.filter(F.col("similarity") > threshold)
    else:
        # exact bound of the ratio by length, tested before any Python work: 2*min/(a+b) >= ratio
        a, b = F.length(F.trim(F.col(text))), F.lit(len(q.strip()))
        scored = (t.filter(2 * F.least(a, b) >= threshold * (a + b))
                  .withColumn("similarity", sequence_ratio(F.lit(q), F.col(text)))
                  .filter(F.col("similarity") >= threshold))
    found = df.join(scored.drop("_n"), text)
    return found.orderBy(F.desc("similarity"), "id_element").limit(limit) if limit else found


def fuzzy_search(flat, paths, q, threshold=70.0, limit=None, texts=None):
    """Similar elements with project, lot and section path, best first."""
    hits = search_similar(flat, q, threshold / 100.0, limit, texts=texts)
    return (hits.join(paths.select("id_section", "chemin"), "id_section", "left")
            .select("id_element", "designation", "unite", "quantite", "prix_unitaire",
                    (F.col("similarity") * 100).alias("score"), F.col("nom_projet").alias("dpgf_source"),
                    F.col("nom_lot").alias("lot"), F.coalesce("chemin", F.lit("Inconnue")).alias("section"))
            .orderBy(F.desc("score"), "id_element"))


HOT = 1000      # a gram is hot from one part in so many of all rows, so at most so many are broadcast


def _hot(counts, weight, least):
    """Grams that hold at least 1/HOT of all rows (and ``least`` rows): at most HOT of them, with the total beside."""
    total = counts.agg(F.sum(weight).alias("total"))
    return counts.crossJoin(F.broadcast(total)).filter((weight * HOT > F.col("total")) & (weight >= least))   # one row


def _ranked_grams(texts, hot_rows):
    """(id, l, r, n, o): the grams of each text from rare to frequent; hot grams get their count without a shuffle."""
    grams = texts.select("id", "l", "r", F.explode("grams").alias("g"))
    counts = staged(grams.groupBy("g").agg(F.count("*").alias("freq")), "gram-counts")
    hot = _hot(counts, F.col("freq"), hot_rows).select("g", "freq")
    marked = grams.join(F.broadcast(hot), "g", "left")                       # at most HOT rows
    rest = marked.filter("freq is null").drop("freq").join(counts.join(F.broadcast(hot), "g", "left_anti"), "g")
    lists = (marked.filter("freq is not null").unionByName(rest)
             .groupBy("id", "l", "r").agg(F.array_sort(F.collect_list(F.struct("freq", "g"))).alias("o")))    # the grams of one text
    return lists.select("id", "l", "r", F.size("o").alias("n"), "o")


def _split_hot(left, right, hot_rows):
    """Posting rows of both sides with a cell: a hot gram's lists are cut into ranges that meet pairwise, each in a cell."""
    counts = staged(left.select("g", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(right.select("g", F.lit(0), F.lit(1)))
                    .groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "gram-postings")

    def ranges(c):
        return F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(c) * HOT / F.col("total")))).cast("int")

    hot = F.broadcast(_hot(counts, F.col("a") + F.col("b"), hot_rows).select("g", ranges("a").alias("la"), ranges("b").alias("rb")))
    l, r = left.join(hot, "g", "left"), right.join(hot, "g", "left")
    one = F.lit(1)
    mine = F.pmod(F.xxhash64("lid"), F.coalesce("la", one)), F.pmod(F.xxhash64("rid"), F.coalesce("rb", one))
    l = l.withColumn("i", mine[0].cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("rb", one) - 1)))
    r = r.withColumn("j", mine[1].cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce("la", one) - 1)))
    return l.drop("la", "rb"), r.drop("la", "rb")


def fuzzy_text_pairs(left: DataFrame, right: DataFrame, threshold=0.7, hot_rows=10000) -> DataFrame:
    """All pairs of distinct texts with trigram share above the threshold, without a cross join.

    Each distinct text of both sides is cut into grams once and stored under a number. Exact filters: with grams
    ordered from rare to frequent, two sets with share > t have a gram in common among their first
    ``n - ceil(t * n) + 1``; their sizes differ by at most 1/t; and after their first common gram enough grams must be
    left. Numbers meet on prefix grams only, then the pairs left are verified on the full sets. A gram in a large share
    of the texts is counted by a broadcast and its lists meet in cells, so no gram is one task (``hot_rows``: from which
    length on). Nulls and texts without a letter or digit match nothing.
    """
    def side(df, l):
        return df.select(F.lower("text").alias("text"), F.lit(l).alias("l"), F.lit(not l).alias("r"))

    both = side(left, True).unionAll(side(right, False)).filter("text <> ''")
    texts = staged(both.groupBy("text").agg(F.max("l").alias("l"), F.max("r").alias("r"))
                   .select(F.monotonically_increasing_id().alias("id"), "text", "l", "r", trigrams("text").alias("grams")), "texts")
    n = F.col("n")
    keep = F.greatest(n - F.ceil(F.lit(threshold) * n).cast("int") + 1, F.lit(1))
    prefix = staged(_ranked_grams(texts, hot_rows).select("id", "l", "r", "n", F.posexplode(F.slice("o", F.lit(1), keep)).alias("pos", "s"))
                    .select("id", "l", "r", "n", "pos", F.col("s.g").alias("g")), "prefix-grams")
    lp = prefix.filter("l").select("g", F.col("id").alias("lid"), F.col("n").alias("ln"), F.col("pos").alias("lpos"))
    rp = prefix.filter("r").select("g", F.col("id").alias("rid"), F.col("n").alias("rn"), F.col("pos").alias("rpos"))
    lp, rp = _split_hot(lp, rp, hot_rows)
    sizes = (F.col("rn") >= threshold * F.col("ln")) & (F.col("ln") >= threshold * F.col("rn"))
    left_over = F.least(F.col("ln") - F.col("lpos"), F.col("rn") - F.col("rpos"))      # positions from 0: this gram counts
    enough = left_over * (1 + threshold) >= threshold * (F.col("ln") + F.col("rn")) - 1e-6
    pairs = lp.join(rp, ["g", "i", "j"]).filter(sizes & enough).select("lid", "rid").distinct()
    lt = texts.filter("l").select(F.col("id").alias("lid"), F.col("text").alias("ltext"), F.col("grams").alias("lg"))
    rt = texts.filter("r").select(F.col("id").alias("rid"), F.col("text").alias("rtext"), F.col("grams").alias("rg"))
    return (pairs.join(lt, "lid").join(rt, "rid")
            .withColumn("similarity", jaccard(F.col("lg"), F.col("rg")))
            .filter(F.col("similarity") > threshold).select("ltext", "rtext", "similarity"))


def _links(items, base, threshold):
    """Items beside the rows of ``base`` (with their text as ``rtext``) whose text is close: the rows of the answer.

    Close texts are written once; only elements that have one, and their narrow columns, meet the items. Nothing after
    the last join moves its rows, as they are as many as items times elements.
    """
    pairs = staged(fuzzy_text_pairs(items.select(F.col("designation").alias("text")),
                                    base.select(F.col("rtext").alias("text")), threshold / 100.0), "text-pairs")
    src = (items.select(F.col("id_item"), F.lower("designation").alias("ltext")).join(pairs, "ltext")
           .select("rtext", "id_item", (F.col("similarity") * 100).alias("score")))
    return src, base.join(pairs.select("rtext").distinct(), "rtext", "left_semi")


def fuzzy_match_document(items, flat, threshold=70.0):
    """Every match above the threshold for the lines of incoming documents.

    The text work is done once per distinct text; the join back to elements
    produces exactly the rows of the answer.
    """
    src, base = _links(items, flat.withColumn("rtext", F.lower("designation")), threshold)
    return src.join(base, "rtext").select("id_item", *flat.columns, "score")


def fuzzy_match_report(items, flat, paths, threshold=70.0):
    """The matches with their project, lot and section path, as a document's report lists them.

    Elements get the path of their section before they meet the items.
    """
    base = flat.select("id_element", "id_section", "designation", "unite", "quantite", "prix_unitaire", "nom_projet", "nom_lot",
                       F.lower("designation").alias("rtext"))
    src, base = _links(items, base, threshold)
    base = (base.join(paths.select("id_section", "chemin"), "id_section", "left")
            .select("rtext", "id_element", "designation", "unite", "quantite", "prix_unitaire", F.col("nom_projet").alias("dpgf_source"),
                    F.col("nom_lot").alias("lot"), F.coalesce("chemin", F.lit("Inconnue")).alias("section")))
    return src.join(base, "rtext").select("id_item", "id_element", "designation", "unite", "quantite", "prix_unitaire", "score", "dpgf_source", "lot", "section")


def fuzzy_match_classes(items, flat, paths, threshold=70.0):
    """The report's matches without multiplying copies: pairs of distinct texts with their score, and who has which text.

    Rows of kind ``pair`` (class, other, score), ``item`` (id, class, links: elements matched) and ``element`` (id, class
    and its project, lot and section). An item's matches are the elements of the classes paired with its own.
    """
    pairs = staged(fuzzy_text_pairs(items.select(F.col("designation").alias("text")),
                                    flat.select(F.col("designation").alias("text")), threshold / 100.0), "text-pairs")
    base = flat.select("id_element", "id_section", F.lower("designation").alias("class"), "nom_projet", "nom_lot")
    sizes = base.groupBy("class").agg(F.count("*").alias("n"))
    links = (pairs.join(sizes, pairs["rtext"] == sizes["class"]).groupBy(F.col("ltext").alias("class"))
             .agg(F.sum("n").alias("links")))
    no = {c: F.lit(None).cast(t).alias(c) for c, t in (("id", "bigint"), ("other", "string"), ("score", "double"), ("links", "bigint"),
                                                       ("dpgf_source", "string"), ("lot", "string"), ("section", "string"))}
    two = pairs.select(F.lit("pair").alias("kind"), no["id"], F.col("ltext").alias("class"), F.col("rtext").alias("other"),
                       (F.col("similarity") * 100).alias("score"), no["links"], no["dpgf_source"], no["lot"], no["section"])
    one = (items.select(F.col("id_item").alias("id"), F.lower("designation").alias("class")).join(links, "class")
           .select(F.lit("item").alias("kind"), "id", "class", no["other"], no["score"], "links", no["dpgf_source"], no["lot"], no["section"]))
    hit = base.join(pairs.select(F.col("rtext").alias("class")).distinct(), "class", "left_semi")
    elements = (hit.join(paths.select("id_section", "chemin"), "id_section", "left")
                .select(F.lit("element").alias("kind"), F.col("id_element").alias("id"), "class", no["other"], no["score"], no["links"],
                        F.col("nom_projet").alias("dpgf_source"), F.col("nom_lot").alias("lot"), F.coalesce("chemin", F.lit("Inconnue")).alias("section")))
    return two.unionByName(one).unionByName(elements)


def fuzzy_match_summary(items, flat, threshold=70.0):
    """Matches of incoming texts against the base, one row per text pair with base statistics."""
    pairs = fuzzy_text_pairs(items, flat.select(F.col("designation").alias("text")), threshold / 100.0)
    base = flat.groupBy(F.lower("designation").alias("rtext")).agg(
        F.count("*").alias("elements"), F.min("prix_unitaire").alias("min_price"), F.max("prix_unitaire").alias("max_price"))
    return pairs.join(base, "rtext").withColumn("score", F.col("similarity") * 100).drop("similarity")


def similar_price(flat, target, unite=None, tolerance=20.0, limit=20):
    """Elements within a percentage of a target price, nearest first."""
    lo, hi = target * (1 - tolerance / 100.0), target * (1 + tolerance / 100.0)
    df = flat.filter(F.col("prix_unitaire").cast("double").between(lo, hi))
    if unite is not None:
        df = df.filter(F.col("unite") == unite)
    return (df.withColumn("ecart", F.abs(F.col("prix_unitaire").cast("double") - target))
            .orderBy("ecart", "id_element").limit(limit))


def price_history(flat, q, min_similarity=70, texts=None):
    """Count and price statistics of similar elements, per year and overall (year NULL)."""
    hits = search_similar(flat, q, min_similarity / 100.0, None, texts=texts).withColumn("annee", F.year("date_dpgf"))
    return hits.rollup("annee").agg(
        F.count("*").alias("elements"),
        (F.sum("prix_unitaire").cast("double") / F.count("prix_unitaire")).alias("average_price"),
        F.min("prix_unitaire").alias("min_price"), F.max("prix_unitaire").alias("max_price"))


def fuzzy_listing(flat, q, min_similarity=70, limit=50, texts=None):
    return search_similar(flat, q, min_similarity / 100.0, limit, texts=texts).select(
        "id_element", "designation", "unite", "prix_unitaire", "nom_projet", F.year("date_dpgf").alias("annee"),
        (F.col("similarity") * 100).alias("score"))
