"""What the searches on the stored index move: few texts are broadcast, only ids and scores meet for the best rows."""

from pyspark.sql import functions as F

from pricebook.operators import search as S
from pricebook.operators import text_index as X


def test_rows_found_stay_where_they_are(spark, tmp_path):
    flat = spark.range(60).select(
        F.col("id").alias("id_element"), (F.col("id") % 7).alias("id_dpgf"), F.lit(1.0).alias("prix_unitaire"),
        F.concat(F.lit("red widget "), F.col("id") % 4).alias("designation"), F.concat(F.lit("promo "), F.col("id") % 3).alias("description"),
        F.lit("bolts").alias("titre_section"))
    index = X.build(flat, str(tmp_path / "x"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = X.search_similar(index, "red widgets", 0.3, 100)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert [tuple(r) for r in found.select("id_element", "similarity").collect()] == [
            tuple(r) for r in S.search_similar(flat, "red widgets", 0.3, 100).select("id_element", "similarity").collect()]
        best = X.match_text(index, "red promo", 9).select("id_element", "match_confidence")
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        assert "max(_best" in plan                  # ids and scores meet, not whole rows
        assert best.collect() == S.match_text(flat, "red promo", 9).select("id_element", "match_confidence").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
