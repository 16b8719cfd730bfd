"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text: the values of assignments, access keys, long hexadecimal runs, and other mixed
runs of 20 characters or more. Their hashes are counted over the corpus by distinct repositories and owners. A value
that ``COPIED_OWNERS`` or more owners or ``COPIED_REPOS`` or more repositories hold is a copied example; one that stays with
fewer and looks random (enough different characters, a digit among them) is live-looking. Spans of the first three kinds
are always reported; mixed runs only where they are live-looking and touch none of those.

DataFrame functions only. Texts are read once and never shuffled: per document only its candidates are stored.
Counts are taken in two steps (hash, owner, repository; then hash), so that a value in every document is summed in
the tasks first.

Positions count code points, the end is exclusive. Defined cases: a null or empty text has no span; null owners or
repositories count as one each; repeated rows are the same repository; empty tables give no rows; other columns are
not read.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import stored

ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run too short to count leaves nothing behind in which a longer one could start, so the length can stand here
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
COPIED_OWNERS, COPIED_REPOS = 3, 10
LEAST_CHARACTERS = 8
SPAN = 512                  # lengths summed at once: lists are only appended to inside such a part


def _let(value, use):
    """use(value), with the value evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(lengths):
    """Running sums of a list."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out"))
    return F.aggregate(lengths, begin, add, lambda a: a["out"])


def _ends(lengths):
    """Running sums of a list of any size, in parts whose totals are summed first; linear in effect."""
    firsts = lambda x: F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(SPAN))
    parts = _let(lengths, lambda x: F.transform(firsts(x), lambda i: _sums(F.slice(x, i, SPAN))))

    def shifted(parts):
        totals = _sums(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
        return F.flatten(F.zip_with(parts, totals, lambda p, end: F.transform(
            p, lambda v: v + end - F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0)))))
    return _let(parts, shifted)


def _found(text, kind, pattern):
    """Matches of a pattern with their places, from the pieces between them; linear in the text."""
    pieces = F.split(text, pattern, -1)
    texts = F.expr("regexp_extract_all(_t, '%s', 0)" % pattern.replace("\\", "\\\\").replace("'", "\\'"))
    texts = F.when(F.size(pieces) > 1, texts).otherwise(F.array().cast("array<string>"))
    pairs = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), texts,
                       lambda p, m: F.struct((F.length(p) + F.length(m)).alias("step"), F.length(m).alias("n"), m.alias("v")))
    one = lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(KINDS.index(kind)).alias("ko"), end.alias("end"),
                                  F.lit(kind).alias("kind"), x["v"].alias("v"))
    return _let(pairs, lambda xs: F.zip_with(xs, _ends(F.transform(xs, lambda x: x["step"])), one))


def candidates(docs: DataFrame, repo="doc_id", owner="source") -> DataFrame:
    """One stored row per document row: rid, doc_id, repo, owner, base (spans), mixed (spans)."""
    d = docs.select("doc_id", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"),
                    F.coalesce("text", F.lit("")).alias("_t"))
    t = F.col("_t")
    d = d.select("doc_id", "repo", "owner", _found(t, "assign", ASSIGN).alias("a"), _found(t, "access", ACCESS).alias("k"),
                 _found(t, "hex", HEX).alias("h"), _found(t, "mixed", MIXED).alias("m"))
    valued = F.transform("a", lambda x: x.withField("v", F.regexp_extract(x["v"], ASSIGN, 2)))
    d = d.select("doc_id", "repo", "owner", "m",
                 F.sort_array(F.concat(F.filter(valued, lambda x: F.length(x["v"]) >= 6), F.col("k"), F.col("h"))).alias("base"))
    random = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= LEAST_CHARACTERS) & v.rlike("[0-9]")
    hashed = lambda x: F.struct(x["start"].alias("start"), x["ko"].alias("ko"), x["end"].alias("end"), x["kind"].alias("kind"),
                                F.sha2(x["v"].cast("binary"), 256).alias("hash"), random(x["v"]).alias("random"))
    alone = F.filter("m", lambda x: random(x["v"]) & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]")
                     & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    d = d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "repo", "owner",
                 F.transform("base", hashed).alias("base"), F.transform(alone, hashed).alias("mixed"))
    return stored(d, "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over the whole corpus."""
    each = found.select("repo", "owner", F.explode(F.concat("base", "mixed")).alias("c"))
    each = each.select(F.col("c.hash").alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, repo="doc_id", owner="source", copied=COPIED_OWNERS, found=None, copied_repos=COPIED_REPOS) -> DataFrame:
    """A row per span: rid, doc_id, kind, start, end, hash, n_repos, n_owners, verdict (copied, live, plain)."""
    found = candidates(docs, repo, owner) if found is None else found
    each = found.select("rid", "doc_id", F.explode(F.concat("base", "mixed")).alias("c")).select("rid", "doc_id", "c.*")
    many = (F.col("n_owners") >= copied) | (F.col("n_repos") >= copied_repos)
    verdict = F.when(many, "copied").when(F.col("random"), "live").otherwise("plain")
    out = each.join(ownership(found), "hash").withColumn("verdict", verdict)
    out = out.where((F.col("kind") != "mixed") | (F.col("verdict") == "live"))
    return out.select("rid", "doc_id", "kind", "ko", "start", "end", "hash", "n_repos", "n_owners", "verdict")


def digest(docs: DataFrame, copied_repos=COPIED_REPOS) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_spans, spans, n_live, n_copied."""
    found = candidates(docs)
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    span = F.struct("start", "ko", "end", "kind")
    per = (scan(docs, found=found, copied_repos=copied_repos).groupBy("rid").agg(
        F.sort_array(F.collect_list(span)).alias("s"),
        F.sum((F.col("verdict") == "live").cast("long")).alias("n_live"),
        F.sum((F.col("verdict") == "copied").cast("long")).alias("n_copied")))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.join(per, "rid", "left").select(
        "doc_id", n("assign"), n("access"), n("hex"), text(F.col("base")).alias("base_spans"),
        F.coalesce(text(F.col("s")), F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
