"""Very long texts, null against empty, and copies inside one source."""

from pyspark.sql import functions as F

from pricebook.llm import mixing, secret_scan, surrogates
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_very_long_texts(spark):
    n = 20000
    texts = ["x@" + "a." * n + "a", "token=abcdefgh1 " * n, "a.b-c_" * n, "+49 " + "12 " * n, "1" * 10 * n, "AB12 " + "ABCD " * n, "Mr. " * n, "1.2.3." * n, "plain"]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, plain.sha(r.base_spans)) for r in secret_scan.digest(d).collect()}
    assert got == {i: plain.secrets(t) for i, t in enumerate(texts)}
    made = {r.doc_id: r.text for r in surrogates.pseudonymise(d.select("doc_id", "text")).collect()}
    assert made[8] == "plain" and made[0] != texts[0] and made[0].count(".") == n


def test_null_and_empty_are_different_rows(spark):
    rows = [(1, "t one", None, None, 1), (1, "t one", None, "", 2), (1, "t one", None, "", 3), (1, None, None, "t one", 4), (1, "t one|", None, "x", 5),
            (1, "one|", None, "x|t ", 6), (None, "", None, "a", 7), (None, None, None, "a", 8), (None, None, None, "a", 8)]
    d = spark.createDataFrame(rows, SCHEMA)
    left = [tuple(r) for r in mixing.mix(d, max_repeats=1.0).collect()]
    assert sorted(map(str, left)) == sorted(map(str, rows))
    drawn = mixing.plan(d, max_repeats=1.0)
    assert drawn.count() == len(rows) and drawn.select("place").distinct().count() == len(rows)


def test_copies_in_one_source_are_copied(spark):
    value = 'token = "a1b2c3d4e5f6" Zx9Kq2Lm8Pv4Rt6Yw1Bn'
    d = spark.range(secret_scan.COPIED_REPOS + 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, value).otherwise("secret: q9w8e7r6t5y4").alias("text"),
                                                        F.lit("en").alias("lang"), F.lit("one").alias("source"))
    got = {r.doc_id: (r.n_live, r.n_copied, r.spans) for r in secret_scan.digest(d).collect()}
    assert got.pop(0)[:2] == (1, 0) and set(got.values()) == {(0, 1, "assign:0:21")}
