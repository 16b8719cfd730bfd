"""The stored search index and the order index give what the scans give, and read little."""

import pytest
from pyspark.sql import functions as F

from pricebook.operators import pages
from pricebook.operators import search as S
from pricebook.operators import text_index as X

WORDS = ("porte", "fenêtre", "acier", "béton", "mur", "dalle", "pose", "laqué", "inox", "gaine", "a1", "m2")


@pytest.fixture(scope="module")
def flat(spark):
    i = F.col("id")
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    return spark.range(3000).select(
        i.alias("id_element"), (i % 40).alias("id_dpgf"), (i % 100).alias("id_lot"),
        F.when(i % 500 == 7, F.concat(F.lit("Écluse "), i.cast("string"))).otherwise(F.concat_ws(" ", F.initcap(word(1)), word(2), word(3))).alias("designation"),
        F.when(i % 3 == 0, F.concat_ws(" ", word(4), F.lit("en"), word(5))).alias("description"),
        F.concat(F.lit("Section "), word(6)).alias("titre_section"), (i % 997).cast("double").alias("prix_unitaire"))


@pytest.fixture(scope="module")
def index(flat, tmp_path_factory):
    return X.build(flat, str(tmp_path_factory.mktemp("index") / "x"))


def ids(df):
    return sorted(r["id_element"] for r in df.select("id_element").collect())


def same_searches(index, flat):
    for q, filters in (("acier porte", {}), ("béton", {"max_price": 300.0}), ("écluse", {}), ("m2 pose", {}), ("absent", {}), ("inox a1", {"lot_id": 3})):
        assert ids(X.search_matches(index, q, **filters)) == ids(S.search_matches(flat, q, **filters)), q
    for q in ("fourniture écluse ou gaine", "zz"):
        assert [tuple(r) for r in X.match_text(index, q, 50).select("id_element", "match_confidence").collect()] == [
            tuple(r) for r in S.match_text(flat, q, 50).select("id_element", "match_confidence").collect()], q
    for q, t in (("porte acier mur", 0.5), ("ecluse 7", 0.6), ("écluse 1007", 0.7)):
        want = S.search_similar(flat, q, t, 200).select("id_element", "similarity")
        assert [tuple(r) for r in X.search_similar(index, q, t, 200).select("id_element", "similarity").collect()] == [tuple(r) for r in want.collect()], q


def test_index_equals_scan(index, flat):
    same_searches(index, flat)


def test_index_reads_what_it_finds(index):
    everything = len(index.table("rows_designation", index.schema).inputFiles())
    assert len(index.postings("any", ["écl", "clu"]).inputFiles()) <= 2
    few = index.rows("designation", index.containing("écluse 1007"))
    assert few.count() == 1 and len(few.inputFiles()) == 1 and everything > 20


def test_index_of_changed_documents(spark, flat, tmp_path):
    first = X.build(flat, str(tmp_path / "x"))
    changed = flat.filter("id_dpgf in (3, 5) and id_element % 3 = 0").withColumn("designation", F.concat(F.lit("Portail neuf "), F.col("id_element") % 7))
    gone = spark.createDataFrame([(3,), (5,)], "id_dpgf long")
    after = X.update(first, gone, changed)
    same_searches(after, flat.filter("id_dpgf not in (3, 5)").unionByName(changed))
    q = "portail neuf"
    assert ids(X.search_matches(after, q)) == ids(changed) and ids(X.search_matches(first, q)) == []
    assert after.texts().count() == first.texts().count() + 7


def test_pages(spark, flat, tmp_path):
    order = [F.desc("prix_unitaire"), F.asc("designation"), F.asc("id_element")]
    path = str(tmp_path / "p")
    pages.write_order_index(flat, path, order, range_rows=200)
    want = [r["id_element"] for r in flat.orderBy(*order).collect()]
    for skip, limit in ((0, 10), (195, 10), (1490, 100), (2995, 50), (3000, 10), (0, 500)):
        assert [r["id_element"] for r in pages.page_at(spark, path, order, skip, limit).collect()] == want[skip:skip + limit]
    assert len(pages.ranges_of(spark, path, 2500, 50)) <= 2 and pages.page_at(spark, path, order, 9999, 5).count() == 0
    pages.write_order_index(flat.limit(0), str(tmp_path / "e"), order)
    assert pages.page_at(spark, str(tmp_path / "e"), order).count() == 0
