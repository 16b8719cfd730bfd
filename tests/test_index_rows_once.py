"""The index holds each row once, written in rounds or not, and finds it by every searched column."""

from pyspark.sql import functions as F

from pricebook.operators import search as S
from pricebook.operators import text_index as X


def test_rows_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "ROUND_ROWS", 100)
    i = F.col("id")
    flat = spark.range(150).select(
        i.alias("id_element"), (i % 7).alias("id_dpgf"), (i % 11).alias("id_lot"), (i % 50).cast("double").alias("prix_unitaire"),
        F.when(i % 9 > 0, F.concat(F.lit("red bolt "), i % 5)).alias("designation"),
        F.when(i % 4 > 0, F.concat(F.lit("promo ring "), i % 3)).alias("description"), F.concat(F.lit("brand "), i % 6).alias("titre_section"))
    flat = flat.unionByName(flat.filter("id_element = 8").withColumn("id_lot", F.lit(None).cast("long")))
    index = X.build(flat, str(tmp_path / "x"), "id_lot", 150)
    stored = [n for n in index.version.tables if n.startswith("rows")]
    assert stored == ["rows_designation"] and index.table(stored[0], index.schema).count() == 151
    for q, more in (("promo red", {}), ("brand", {"min_price": 20.0}), ("ring 2", {"lot_id": 3})):
        got, want = X.search_matches(index, q, **more), S.search_matches(flat, q, **more)
        assert sorted(r[0] for r in got.select("id_element").collect()) == sorted({r[0] for r in want.select("id_element").collect()}), q
    best, scan = (f("promo brand", 60) for f in (lambda q, n: X.match_text(index, q, n), lambda q, n: S.match_text(flat.dropDuplicates(["id_element"]), q, n)))
    assert best.select("id_element", "match_confidence").collect() == scan.select("id_element", "match_confidence").collect()
    monkeypatch.setattr(X, "LOOKUP", 1)         # more texts than are looked up by value
    every = X.Index(spark, index.path).rows(X.FIELDS, index.containing("promo"), 9)
    assert sorted(r[0] for r in every.select("id_element").collect()) == sorted(r[0] for r in flat.filter("description like '%promo%'").select("id_element").collect())
