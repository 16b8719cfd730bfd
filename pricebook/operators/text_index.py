"""Search on a stored inverted index: the rows of the scanning searches, read in proportion to the hits.

The index holds, for the searched columns of a flat view:

* ``texts``: each distinct text once, by hash bucket of its id (60 bits of a digest), with its number of grams;
* ``grams``: posting lists. A posting row is one gram, one range of text ids and the sorted ids in it. Two kinds of grams:
  three letters anywhere in the lower-case text (for substring search), and padded three letters of its words (for
  trigram similarity). Rows lie in hash buckets of the gram, sorted by it, so a query reads the row groups of its grams;
* ``rows``: the flat rows, once, in buckets of the text id of the first searched column, sorted by the ids of all of them;
* ``pairs``: for each further column, which texts of it stand in rows with which texts of the first.

A query looks up the document frequencies of its grams, intersects the posting lists of its rarest term range by range
(only ranges that every gram has are joined), verifies the texts found, and fetches their rows. All conditions are then
tested on the rows themselves by the functions of ``search``, so that the result is that of the scan.

``update`` replaces the rows of changed documents in their buckets and adds the texts and postings that are new; texts
that no row uses any more stay in the lists and find nothing. Versions are published in one commit (``sources.versions``).
"""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebook.functions.text import jaccard, query_terms, trigrams
from pricebook.operators import search as S
from pricebook.operators.scale import freed_shuffles, scratch_path, write_step
from pricebook.sources import versions

FIELDS = tuple(c for c, _ in S.WEIGHTS)
BUCKETS = 64
RANGE_TEXTS = 50_000        # texts aimed at per range of ids: a posting row holds ids of one range
LOOKUP = 10_000             # so many text ids are looked up by value; more are joined
IDS = 1 << 60               # text ids are below
ROUNDS, ROUND_ROWS = 4, 1_000_000       # many rows are moved in up to so many rounds, each with its share of the shuffle on disk


def _bucket(col):
    return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int")


def _anywhere(text):
    """All three-letter stretches of a lower-case text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(3))), lambda g: F.length(g) == 3))


def _with_ids(flat: DataFrame) -> DataFrame:
    return flat.select("*", *[F.shiftrightunsigned(F.xxhash64(F.coalesce(c, F.lit(""))), 4).alias(f"_{c}") for c in FIELDS])


def _texts(rows: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.col(f"_{c}").alias("text_id"), F.lower(c).alias("text")) for c in FIELDS])
    t = rows.select(F.explode(each).alias("x")).select("x.*").filter("text <> ''")
    # ids are of the text as written; the lists are of its lower-case form
    t = t.groupBy("text_id").agg(F.first("text").alias("text"))
    return t.select("text_id", "text", F.size(trigrams("text")).alias("n_words"), _bucket("text_id").alias("bucket"))


def _postings(texts: DataFrame, ranges: int) -> DataFrame:
    kinds = F.array(F.struct(F.lit("any").alias("kind"), _anywhere(F.col("text")).alias("gs")),
                    F.struct(F.lit("word").alias("kind"), trigrams("text").alias("gs")))
    g = texts.select("text_id", F.explode(kinds).alias("k")).select("text_id", "k.kind", F.explode("k.gs").alias("gram"))
    part = F.floor(F.col("text_id") / F.lit(IDS // ranges)).cast("int")
    lists = g.groupBy("kind", "gram", part.alias("part")).agg(F.sort_array(F.collect_list("text_id")).alias("ids"))
    return lists.select("kind", "gram", "part", "ids", F.size("ids").alias("n"), _bucket("gram").alias("bucket"))


def _pairs(rows: DataFrame, field: str) -> DataFrame:
    return rows.select(F.col(f"_{field}").alias("text_id"), f"_{FIELDS[0]}").distinct().withColumn("bucket", _bucket("text_id"))


def _write(df: DataFrame, warehouse, table, tag, sort, old=None, spread=()):
    """Write a table in bucket folders; {bucket: folders} of what was written, after the old ones.

    ``spread``: columns by which a bucket is divided among tasks where the session has more partitions than buckets.
    """
    path, spark = f"{table}/{tag}", df.sparkSession
    more = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS) if spread else 1
    by = ["bucket"] if more == 1 else ["bucket", F.pmod(F.xxhash64(*spread), F.lit(more))]
    with freed_shuffles(spark):
        (df.repartition(BUCKETS * more, *by).sortWithinPartitions("bucket", *sort).write.mode("append").option("compression", "zstd")
         .partitionBy("bucket").parquet(f"{warehouse}/{path}"))
    out = {k: list(v) for k, v in (old or {}).items()}
    for k in range(BUCKETS):
        out.setdefault(str(k), [])
    for r in spark.read.schema("bucket int").parquet(f"{warehouse}/{path}").select("bucket").distinct().collect():
        if (made := f"{path}/bucket={r['bucket']}") not in out[str(r["bucket"])]:
            out[str(r["bucket"])].append(made)
    return out


def rounds(rows: int) -> int:
    return min(ROUNDS, 1 + rows // ROUND_ROWS)


def _write_rows(rows: DataFrame, warehouse, tag, old=None, n=1):
    """Write rows with text ids, in ``n`` rounds of buckets, so that only a share of them is on disk between two tasks."""
    ids, first = [f"_{f}" for f in FIELDS], f"rows_{FIELDS[0]}"
    rows, out = rows.withColumn("bucket", _bucket(ids[0])), old
    for k in range(n):
        out = _write(rows.filter(F.pmod("bucket", F.lit(n)) == k), warehouse, first, tag, ids, out, ids)
    return out


class Index:
    """An index of a flat view at a folder, as of its newest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path, versions.version(spark, path)
        self.schema = spark.read.parquet(f"{path}/_schema").schema

    def table(self, name, schema, buckets=None):
        parts = None if buckets is None else [str(b) for b in buckets]
        return versions.read(self.spark, self.path, self.version, name, schema, parts)

    def texts(self, buckets=None):
        return self.table("texts", "text_id long, text string, n_words int", buckets)

    def postings(self, kind, grams):
        """The posting rows of some grams; only their buckets and row groups are read."""
        b = self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket("gram").alias("b")).collect()
        lists = self.table("grams", "kind string, gram string, part int, ids array<long>, n int", sorted({r["b"] for r in b}))
        return lists.filter((F.col("kind") == kind) & F.col("gram").isin(list(grams)))

    def frequencies(self, kind, grams):
        """Texts per gram, 0 for grams that do not occur; as many rows as the query has grams."""
        seen = self.postings(kind, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        return {g: 0 for g in grams} | {r["gram"]: r["n"] for r in seen}

    def _known(self, found, about):
        """(text_id, text, n_words) of found text ids; up to LOOKUP of them by value, in their buckets only."""
        if about <= LOOKUP:
            ids = [r[0] for r in found.select("text_id").distinct().limit(LOOKUP + 1).collect()]
            if len(ids) <= LOOKUP:
                buckets = self.spark.createDataFrame([(i,) for i in ids], "i long").select(_bucket("i").alias("b")).distinct().collect() if ids else []
                return self.texts([r["b"] for r in buckets]).filter(F.col("text_id").isin(ids))
        return self.texts().join(found.select("text_id").distinct(), "text_id", "left_semi")

    def containing(self, term):
        """Texts that contain a lower-case term, verified."""
        grams = sorted({term[i:i + 3] for i in range(len(term) - 2)})
        if not grams:                                           # shorter than a gram: every text is read
            return self.texts().filter(F.col("text").contains(term))
        seen = self.frequencies("any", grams)
        lists = self.postings("any", grams)
        whole = lists.groupBy("part", "gram").agg(F.flatten(F.collect_list("ids")).alias("ids"))        # later rows hold other texts
        # a range in which a gram is missing holds no text with all of them
        both = whole.groupBy("part").agg(F.count("*").alias("m"), F.collect_list("ids").alias("l")).filter(F.col("m") == len(grams))
        shared = F.aggregate(F.slice("l", 2, len(grams)), F.get("l", F.lit(0)), lambda a, x: F.array_intersect(a, x))
        found = both.select(F.explode(shared).alias("text_id"))
        return self._known(found, min(seen.values())).filter(F.col("text").contains(term))

    def close(self, q, threshold):
        """(text_id, text, similarity) of texts whose trigram share with ``q`` is above the threshold."""
        mine = sorted(self.spark.range(1).select(trigrams(F.lit(q.strip().lower()))).first()[0])
        if not mine:
            return self.texts([]).withColumn("similarity", F.lit(0.0))
        seen = self.frequencies("word", mine)
        # a share above t needs one of the n - ceil(t n) + 1 rarest grams
        rare = sorted(mine, key=lambda g: (seen[g], g))[:max(1, len(mine) - _ceil(threshold * len(mine)) + 1)]
        found = self.postings("word", rare).select(F.explode("ids").alias("text_id"))
        texts = self._known(found, sum(seen[g] for g in rare))
        n = float(len(mine))
        texts = texts.filter((F.col("n_words") >= threshold * n) & (n >= threshold * F.col("n_words")))
        # the count of grams keeps the score from being computed below the filter on it
        scored = texts.withColumn("similarity", F.when(F.col("n_words") > 0, jaccard(trigrams("text"), F.lit(mine))))
        return scored.filter(F.col("similarity") > threshold)

    def _few(self, texts, column="text_id"):
        """Up to LOOKUP ids of a frame with their buckets, or nothing when there are more."""
        ids = [r[0] for r in texts.select(column).distinct().limit(LOOKUP + 1).collect()]
        if len(ids) > LOOKUP:
            return None, None
        buckets = self.spark.createDataFrame([(i,) for i in ids], "i long").select(_bucket("i").alias("b")).distinct().collect() if ids else []
        return ids, [r["b"] for r in buckets]

    def rows(self, fields, texts, about=None):
        """The flat rows whose text in a field, or in one of several fields, is one of the given; a row comes once."""
        fields, name = [fields] if isinstance(fields, str) else list(fields), f"rows_{FIELDS[0]}"
        ids, buckets = self._few(texts) if about is None or about <= LOOKUP else (None, None)
        if ids is None:
            found, more = self.table(name, self.schema), texts.select(F.col("text_id").alias("_id"), F.lit(True).alias("_in")).distinct()
            for f in fields:
                found = found.join(more.withColumnsRenamed({"_id": f"_{f}", "_in": f"_in_{f}"}), f"_{f}", "left")
            return found.filter(reduce(lambda a, b: a | b, [F.coalesce(f"_in_{f}", F.lit(False)) for f in fields])).select(*self.columns)
        where = set(buckets) if FIELDS[0] in fields else set()
        for f in fields:
            if f != FIELDS[0] and where is not None:
                pairs = self.table(f"pairs_{f}", f"text_id long, _{FIELDS[0]} long", buckets).filter(F.col("text_id").isin(ids))
                near = self._few(pairs, f"_{FIELDS[0]}")[1]
                where = None if near is None else where | set(near)
        found = self.table(name, self.schema, None if where is None else sorted(where))
        return found.filter(reduce(lambda a, b: a | b, [F.col(f"_{f}").isin(ids) for f in fields])).select(*self.columns)

    @property
    def columns(self):
        return [c for c in self.schema.names if c not in {f"_{f}" for f in FIELDS}]

    def with_term(self, term, fields=FIELDS):
        """The flat rows that contain a term in one of the fields."""
        return self.rows(fields, self.containing(term))


def _ceil(x):
    return -int(-x // 1)


def build(flat: DataFrame, path: str, by=None, rows_about=0) -> Index:
    """Index the rows of a flat view (id_element, id_dpgf and the searched columns among them).

    The view is computed once; where it has many rows (``rows_about``), in rounds of the hash of the column ``by``, a key
    of its joins, so that a round shuffles its share.
    """
    spark, rows = flat.sparkSession, _with_ids(flat)
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")
    v, tag = versions.version(spark, path), uuid.uuid4().hex
    first, held, n = f"rows_{FIELDS[0]}", scratch_path(spark, "index-rows"), rounds(rows_about) if by else 1
    for k in range(n):
        write_step(rows if n == 1 else rows.filter(F.pmod(F.xxhash64(by), F.lit(n)) == k), held, "append")
    kept = spark.read.schema(rows.schema).parquet(held)
    new = {first: _write_rows(kept, path, tag, n=rounds(kept.count()))}
    folders = [f"{path}/{x}" for k in new[first].values() for x in k]
    made = spark.read.schema(rows.schema).parquet(*folders) if folders else rows
    new |= {f"pairs_{f}": _write(_pairs(made, f), path, f"pairs_{f}", tag, ["text_id"]) for f in FIELDS[1:]}
    new["texts"] = _write(_texts(made), path, "texts", tag, ["text_id"])
    texts = _read_bucketed(spark, path, new["texts"], "text_id long, text string, n_words int")
    ranges = 1 << (texts.count() // RANGE_TEXTS).bit_length()
    new["grams"] = _write(_postings(texts, ranges), path, "grams", tag, ["kind", "gram", "part"])
    if versions.commit(spark, path, v, new, {"ranges": ranges}) is None:
        raise RuntimeError(f"{path} was indexed by another writer")
    return Index(spark, path)


def _read_bucketed(spark, path, parts, schema):
    folders = [f"{path}/{x}" for k in parts.values() for x in k]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def update(index: Index, documents: DataFrame, flat: DataFrame) -> Index:
    """Replace the rows of the changed ``documents`` (id_dpgf) by those of ``flat``; only new texts get postings."""
    spark, path, v, tag = index.spark, index.path, index.version, uuid.uuid4().hex
    ids = [f"_{f}" for f in FIELDS]
    fresh = _with_ids(flat).select(*index.schema.names)
    new = {}
    name, first = f"rows_{FIELDS[0]}", f"_{FIELDS[0]}"
    old = dict(v.tables[name])
    stale = index.table(name, index.schema).join(documents.select("id_dpgf").distinct(), "id_dpgf", "left_semi")
    touched = {r["b"] for part in (stale, fresh) for r in part.select(_bucket(first).alias("b")).distinct().collect()}     # at most BUCKETS
    kept = index.table(name, index.schema, touched).join(documents.select("id_dpgf").distinct(), "id_dpgf", "left_anti")
    old.update({str(b): [] for b in touched})
    new[name] = _write_rows(kept.unionByName(fresh), path, tag, old)
    # pairs that no row has any more find nothing
    new |= {f"pairs_{f}": _write(_pairs(fresh, f), path, f"pairs_{f}", tag, ["text_id"], v.tables[f"pairs_{f}"]) for f in FIELDS[1:]}
    texts = _texts(fresh.select(*ids, *FIELDS)).join(index.texts().select("text_id"), "text_id", "left_anti")
    new["texts"] = _write(texts, path, "texts", tag, ["text_id"], v.tables["texts"])
    added = spark.read.schema("text_id long, text string, n_words int").parquet(f"{path}/texts/{tag}") if not texts.isEmpty() else texts.drop("bucket")
    new["grams"] = _write(_postings(added, v.batches["ranges"]), path, "grams", tag, ["kind", "gram", "part"], v.tables["grams"])
    if versions.commit(spark, path, v, new) is None:
        raise RuntimeError(f"{path} was updated by another writer")
    return Index(spark, path)


def search_matches(index: Index, query, **filters) -> DataFrame:
    """``search.search_matches`` of the indexed view: rows of the rarest term, then all conditions."""
    terms = query_terms(query) if query else []
    if not terms:
        return S.search_matches(index.table("rows_" + FIELDS[0], index.schema).select(*index.columns), query, **filters)
    # a two-letter term stands between spaces in designation or description
    forms = {t: t if len(t) >= 3 else f" {t} " for t in terms}
    grams = sorted({f[i:i + 3] for f in forms.values() for i in range(len(f) - 2)})
    seen = index.frequencies("any", grams)
    rare = min(terms, key=lambda t: (min(seen[forms[t][i:i + 3]] for i in range(len(forms[t]) - 2)), t))
    fields = FIELDS if len(rare) >= 3 else FIELDS[:2]
    # only rows that meet all conditions are compared by id
    return S.search_matches(index.with_term(forms[rare], fields), query, **filters).dropDuplicates(["id_element"])


def search_elements(index: Index, query, sort_by="relevance", descending=True, skip=0, limit=50, **filters):
    """One page and the total, as ``search.search_elements`` gives them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    found = search_matches(index, query, **filters)
    return S.apply_sort(found, sort_by, descending).offset(skip).limit(limit), found.agg(F.count("*").alias("total"))


def match_text(index: Index, text, limit=10, **filters) -> DataFrame:
    """``search.match_text`` of the indexed view."""
    long_tokens = [t for t in query_terms(text) if len(t) >= 3]
    if not long_tokens:
        return S.match_text(index.table("rows_" + FIELDS[0], index.schema).select(*index.columns), text, limit, **filters)
    hit = reduce(DataFrame.union, [index.containing(t) for t in sorted(set(long_tokens))]).dropDuplicates(["text_id"])
    rows = S.apply_filters(index.rows(FIELDS, hit), **filters)
    # ids and scores alone find the best ids; only their rows are fetched whole
    best = (rows.select("id_element", S.match_score(text).alias("_best")).groupBy("id_element").agg(F.max("_best").alias("_best"))
            .orderBy(F.desc("_best"), "id_element").limit(limit))
    top = rows.join(F.broadcast(best.select(F.col("id_element").alias("_id"))), F.col("id_element").eqNullSafe(F.col("_id"))).drop("_id")
    return S.match_text(top.dropDuplicates(["id_element"]), text, limit)


def search_similar(index: Index, q, threshold=0.7, limit=50) -> DataFrame:
    """``search.search_similar`` on designations: rows above the trigram share, best first."""
    texts = index.close(q, threshold)
    scores = texts.select(F.col("text").alias("_low"), "similarity").dropDuplicates(["_low"])
    rows = index.rows(FIELDS[0], texts).withColumn("_low", F.lower(FIELDS[0]))
    few = texts.select("text_id").limit(LOOKUP + 1).count() <= LOOKUP         # then the rows found stay where they are
    found = rows.join(F.broadcast(scores) if few else scores, "_low").drop("_low")
    return found.orderBy(F.desc("similarity"), "id_element").limit(limit) if limit else found
