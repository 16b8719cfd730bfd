"""Quality rules with risk-controlled thresholds.

A document is described by exact counts; each rule compares one ratio of them with a cutoff ("above is bad"). For
every stratum and rule the strictest cutoff of a fixed grid is chosen for which labelled good documents prove that
few good documents are rejected: with k of n good ones above it, P(Bin(n, alpha / rules) <= k) must be at most
delta / (strata x rules). The p-value is exact. Cutoffs are tested from lenient to strict and k never falls on the
way, so the first failure ends the sequence and needs no correction; strata and rules are corrected by Bonferroni.
With probability 1 - delta all chosen cutoffs together reject at most ``alpha`` of the good documents of each stratum.
A stratum with too few labels to prove anything keeps everything that the base rule keeps.

DataFrame functions only. Counts are made inside the row; calibration shuffles one partial sum per task and stratum.

Defined cases: a null or empty text has zero words and fails the base rule; null strata are one stratum; labels with
a null quality or doc_id are ignored, of several labels of a document the lowest counts; empty tables give no cutoff;
a repeated row gets its result each time; other columns pass through ``keep_documents`` untouched.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import computed, space_words, stored

SYMBOLS = "#*$%&|<>"
ALPHA, DELTA = 0.02, 0.05
SMALL = 64
# rule: (ratio, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols / word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "long_words": ("word_chars / n_words", (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
    "upper": ("n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(col, chars):
    return F.length(F.translate(col, chars, ""))


def _repeat_words(w):
    """Words inside 3-word windows that occur twice or more; windows are compared by a 64-bit hash."""
    h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) >= 4, h).otherwise(F.array().cast("array<bigint>"))


def with_counts(docs: DataFrame, text="text", keep=("doc_id",)) -> DataFrame:
    """The kept columns and one struct column ``_c`` with the counts of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    d = docs.select(*keep, t.alias("_t"), space_words(F.col(text)).alias("_w"), lines.alias("_l"))
    d = d.select(*keep, "_t", "_w", "_l", _repeat_words(F.col("_w")).alias("_h"))
    d = d.select(*keep, "_t", "_w", "_l", "_h", F.sort_array("_h").alias("_s"))
    s = F.col("_s")
    again = F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    d = d.select(*keep, "_t", "_w", "_l", "_h", again.alias("_again"))
    at = F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    few = F.transform(F.filter(at, lambda x: F.array_contains("_again", x["h"])), lambda x: x["i"])
    order = F.sort_array(at)
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    d = d.select(
        *keep, "_t", "_w", "_l", "_again",
        F.when(F.size("_again") == 0, F.array().cast("array<int>")).when(F.size("_again") <= SMALL, few).alias("_few"),
        F.when(F.size("_again") > SMALL, order).alias("_o"))
    o = F.col("_o")
    many = F.sort_array(F.transform(F.filter(o, lambda x, i: same(x, F.get(o, i - 1)) | same(x, F.get(o, i + 1))),
                                    lambda x: x["i"]))
    d = d.select(*keep, "_t", "_w", "_l", F.coalesce("_few", many).alias("_p"))
    p = F.col("_p")
    gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    n = lambda c, name: c.cast("long").alias(name)
    counts = F.struct(
        n(F.size("_w"), "n_words"), n(_without("_t", " \t\n\x0b\f\r"), "word_chars"),
        n(F.length("_t") - _without("_t", SYMBOLS), "n_symbols"),
        n(F.size("_l") - F.size(F.array_distinct("_l")), "n_dup_lines"),
        n(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), "n_repeat_words"),
        n(F.size("_l"), "n_lines"),
        n(F.length("_t") - _without("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_upper"))
    return d.select(*keep, counts.alias("_c"))


def base_failed(c):
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def ratio(c, rule):
    """The rule's ratio; a zero denominator gives zero."""
    top, below = RULES[rule][0].split(" / ")
    return F.when(c[below] > 0, c[top] / c[below]).otherwise(F.lit(0.0))


def binomial_cdf(k, n, p):
    """P(Bin(n, p) <= k), summed exactly; at or above the mean, where no cutoff can pass, it is given as 1."""
    first = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def step(a, i):
        t = a["t"] + F.log((n - i) / (i + 1)) + F.log(F.lit(p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, step)["s"])


def calibrate(counts: DataFrame, labels: DataFrame, stratum="lang", alpha=ALPHA, delta=DELTA) -> DataFrame:
    """(stratum, n_good, one cutoff column per rule, null where nothing is proven) from (doc_id, stratum, _c).

    Only good documents that pass the base rule are at stake; the base rule itself is fixed.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    rows = (counts.where(~base_failed(F.col("_c")))
            .select("doc_id", F.col(stratum).alias("_stratum"), *[ratio(F.col("_c"), r).alias(r) for r in RULES])
            .join(good.select("doc_id"), "doc_id", "left_semi"))
    above = [F.sum((F.col(r) > x).cast("long")).alias(f"{r}_{i}") for r in RULES for i, x in enumerate(RULES[r][1])]
    per = rows.groupBy("_stratum").agg(F.count("*").alias("n_good"), *above)
    per = per.crossJoin(F.broadcast(per.agg(F.count("*").alias("_strata"))))        # one row
    level = F.lit(float(delta)) / (F.col("_strata") * len(RULES))
    cut = {}
    for r, (_, grid) in RULES.items():
        passed = [F.when(binomial_cdf(F.col(f"{r}_{i}"), F.col("n_good"), alpha / len(RULES)) <= level, F.lit(float(x)))
                  for i, x in enumerate(grid)]
        cut[r] = F.coalesce(*reversed(passed))
    return per.select(F.col("_stratum"), "n_good", *[c.alias(r) for r, c in cut.items()])


def verdict(judged: DataFrame, cutoffs: DataFrame, stratum) -> DataFrame:
    """Adds ``_kept`` to rows with ``_c``; the cutoffs are one row per stratum, so the join moves no text when small."""
    c = cutoffs.select(F.col("_stratum"), F.struct(*RULES).alias("_cut"))
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(ratio(F.col("_c"), r) > F.col("_cut")[r], F.lit(False))
    return (judged.join(c, stratum.eqNullSafe(F.col("_stratum")), "left")
            .withColumn("_kept", ~base_failed(F.col("_c")) & ~bad).drop("_stratum", "_cut"))


def judge(docs: DataFrame, labels: DataFrame, stratum="lang", alpha=ALPHA, delta=DELTA) -> DataFrame:
    """Per document row: doc_id, the counts, base_failed and kept."""
    counts = stored(with_counts(docs, keep=("doc_id", stratum)), "quality-counts")
    out = verdict(counts, calibrate(counts, labels, stratum, alpha, delta), F.col(stratum))
    return out.select("doc_id", *[F.col("_c")[x].alias(x) for x in COUNTS],
                      base_failed(F.col("_c")).alias("base_failed"), F.col("_kept").alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, stratum="lang", alpha=ALPHA, delta=DELTA) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are not shuffled: the rows are judged where they lie."""
    counts = stored(with_counts(docs, keep=("doc_id", stratum)), "quality-counts")
    cutoffs = stored(calibrate(counts, labels, stratum, alpha, delta), "quality-cutoffs")
    rows = with_counts(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), "_text", keep=("_doc",))
    out = verdict(rows, cutoffs, F.col("_doc")[stratum])
    return computed(out.select("_doc", "_kept"), "_kept").where("_kept").select("_doc.*")
