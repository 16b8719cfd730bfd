"""The match report as pairs of texts and membership says all that the row form says, in as many rows as there are inputs."""

from pyspark.sql import functions as F

from pricebook.operators import search as S


def test_copies_are_members_not_pairs(spark):
    items = spark.range(30).select(F.col("id").alias("id_item"), F.lit("Red Bolt").alias("designation"))
    flat = spark.range(40).select(
        (F.col("id") + 100).alias("id_element"), F.lit(1).alias("id_section"), F.when(F.col("id") < 25, "red bolt").otherwise("gear").alias("designation"),
        F.lit("u").alias("unite"), F.lit(1.0).alias("quantite"), F.lit(2.0).alias("prix_unitaire"), F.lit("P").alias("nom_projet"), F.lit("L").alias("nom_lot"))
    paths = spark.createDataFrame([(1, "A → B")], "id_section int, chemin string")
    got = S.fuzzy_match_classes(items, flat, paths, 90.0).collect()
    assert len(got) == 1 + 30 + 25 and {r["links"] for r in got if r["kind"] == "item"} == {25}
    pairs = {(r["class"], r["other"]): r["score"] for r in got if r["kind"] == "pair"}
    member = [(r["id"], r["class"], r["dpgf_source"], r["lot"], r["section"]) for r in got if r["kind"] == "element"]
    whole = {(i["id"], e[0], s, *e[2:]) for i in got if i["kind"] == "item" for e in member for (a, b), s in pairs.items() if (a, b) == (i["class"], e[1])}
    want = S.fuzzy_match_report(items, flat, paths, 90.0).select("id_item", "id_element", "score", "dpgf_source", "lot", "section")
    assert whole == {tuple(r) for r in want.collect()}
