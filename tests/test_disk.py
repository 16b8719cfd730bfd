"""What large runs leave on disk: joins and parses run once, elements move twice, written steps keep no shuffle files."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricebook.operators import evaluate as E
from pricebook.operators import quality as Q
from pricebook.operators import relational as R
from pricebook.operators import search as C
from pricebook.operators import stats as D
from pricebook.operators.scale import chunked_lists, staged
from pricebook.plans import q_evaluate, q_search
from tests.conftest import SF


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.startswith("shuffle_") for d in dirs for _, _, names in os.walk(d.getPath()) for f in names)


@pytest.fixture()
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


class Small:
    """Entity tables with null, lost and repeated keys."""

    def __init__(self, spark):
        self.spark = spark
        rows = [(k, None if k % 5 == 0 else k % 4, k % 6, f"bolt {k % 3}", "d", "u", 1.0, float(k), 2.0, None, True) for k in range(20)]
        self.elements = spark.createDataFrame(rows, "id_element long, id_section long, id_lot long, designation_exacte string, description string, unite string, "
                                              "quantite double, prix_unitaire_ht double, prix_total_ht double, created_at timestamp, offre_acceptee boolean")
        self.lots = spark.createDataFrame([(1, 10, "01", "A"), (2, 10, "02", "B"), (2, 11, "02", "C"), (3, None, "03", "D"), (4, 12, "04", "E"), (None, 10, "05", "F")],
                                          "id_lot long, id_dpgf long, numero_lot string, nom_lot string")
        self.sections = spark.createDataFrame([(1, "1", "x"), (2, "2", "y"), (2, "2b", "z"), (None, "3", "n")], "id_section long, numero_section string, titre_section string")
        self.dpgf = spark.createDataFrame([(10, 7, "P", None, "f"), (11, 8, "Q", None, "g"), (11, 8, "Q2", None, "h"), (12, 99, "R", None, "i")],
                                          "id_dpgf long, id_client long, nom_projet string, date_dpgf date, fichier_source string")
        self.clients = spark.createDataFrame([(7, "c7"), (8, "c8"), (8, "c8b"), (None, "n")], "id_client long, nom_client string")

    def flat(self):
        return R.elements_flat(self.elements, self.lots, self.sections, self.dpgf, self.clients)


def test_flat_view_moves_an_element_twice(spark, no_broadcast):
    t = Small(spark)
    got = t.flat()
    lot = t.lots.select("id_lot", "id_dpgf", "numero_lot", "nom_lot")
    want = (t.elements.join(lot, "id_lot").join(t.sections, "id_section", "left").join(t.dpgf, "id_dpgf").join(t.clients, "id_client")
            .withColumnsRenamed({"designation_exacte": "designation", "prix_unitaire_ht": "prix_unitaire", "prix_total_ht": "prix_total"}).select(got.columns))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 10
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert "id_lot" in joins[0] and "id_section" in joins[1]        # the documents and clients hang on the lots


def test_written_steps_keep_no_shuffle_files(spark):
    kept = shuffle_files(spark)
    df = staged(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")), "freed")
    until = time.time() + 20
    while shuffle_files(spark) > kept and time.time() < until:       # files go in the background
        time.sleep(0.2)
    assert shuffle_files(spark) <= kept
    assert df.count() == 100 and df.agg(F.sum("n")).first()[0] == 5000


def test_price_bands_read_the_view_once(spark):
    flat = spark.range(100).select(
        F.col("id").alias("id_element"), F.lit("x").alias("designation"), F.lit("u").alias("unite"), F.col("id").cast("double").alias("prix_unitaire"),
        F.col("id").cast("double").alias("prix_total"))
    bands = D.price_bands(flat)
    assert "Range (" not in bands._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["elements_count"] for r in bands.collect()) == sorted([7, 29, 28, 29, 7])


def test_every_order_reads_the_same_rows(spark, monkeypatch):
    flat, seen = Small(spark).flat(), []
    monkeypatch.setattr(q_search, "flat", lambda t: seen.append(1) or flat)
    out = q_search._sorts(None)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and len(seen) == 1
    rows = [(r["mode"], r["id_element"]) for r in out.collect()]
    for mode, column, down in (("price", "prix_unitaire", True), ("section", "numero_section", False)):
        order = F.desc(column) if down else F.asc(column)
        more = ["titre_section"] if mode == "section" else []
        want = [r["id_element"] for r in flat.orderBy(order, *more, "designation", "id_element").limit(50).collect()]
        assert [i for m, i in rows if m == mode] == want


def test_quality_report_counts_once(spark, no_broadcast):
    t = Small(spark)
    report = Q.quality_report(t.dpgf, t.lots, t.sections.withColumn("id_lot", F.col("id_section") + 1), t.elements, t.clients)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4             # rules and counts are read from files
    rows = report.collect()
    kinds = {(r["id_dpgf"], p["id_lot"], p["type"], p["id_section"]) for r in rows for p in r["problems"]}
    assert kinds == {(10, 0, "lot_sans_elements", 0), (10, 0, "lot_sans_sections", 0), (10, 1, "lot_sans_sections", 0),
                     (12, 4, "elements_sans_section", 0), (12, 4, "lot_sans_sections", 0)}


def test_short_lists_move_once(spark, no_broadcast):
    df = spark.range(60).select(F.when(F.col("id") > 3, F.when(F.col("id") < 40, 1).otherwise(F.col("id") % 4)).alias("k"), "id")
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        want.setdefault(r["k"], []).append(r["id"])
    for size in (100, 10):
        out = chunked_lists(df, ["k"], F.struct("id"), F.col("id"), size)
        got = {(r["k"], r["part"]): [x["id"] for x in r["items"]] for r in out.collect()}
        assert got == {(k, i // size): v[i:i + size] for k, v in want.items() for i in range(0, len(v), size)}
        if size == 100:
            plan = chunked_lists(df, ["k"], F.struct("id"), F.col("id"), size)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1


def test_match_report_gives_every_link_and_moves_none(spark, no_broadcast):
    t = Small(spark)
    items = spark.createDataFrame([(1, "Bolt 1"), (2, "bolt 1"), (3, "bolt 2"), (4, None), (5, "gear"), (5, "bolt 1")], "id_item long, designation string")
    paths = t.sections.select("id_section", F.col("titre_section").alias("chemin"))
    out = C.fuzzy_match_report(items, t.flat(), paths, 90.0)
    path = {}
    for r in paths.collect():
        path.setdefault(r["id_section"], []).append(r["chemin"])
    want = [(i["id_item"], e["id_element"], 100.0, e["nom_projet"], e["nom_lot"], c) for i in items.collect() for e in t.flat().collect()
            if i["designation"] and i["designation"].lower() == e["designation"] for c in (path.get(e["id_section"], ["Inconnue"]) if e["id_section"] is not None else ["Inconnue"])]
    got = out.select("id_item", "id_element", "score", "dpgf_source", "lot", "section").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    plan = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert "rtext" in plan[0] and "id_section" not in plan[0]       # the last join makes the rows


def test_registered_report_is_the_row_form(spark):
    assert entry.queries()["c15_fuzzy_match_report"](spark, SF).columns == ["id_item", "id_element", "score", "dpgf_source", "lot", "section"]


def test_profiles_are_compared_from_one_parse(spark, monkeypatch):
    cols = "file_id long, sheet string, row int, type string, pattern string, prix_total double"
    it = spark.createDataFrame([(1, "a", 1, "section", "numbered", None), (1, "a", 1, "element", None, 2.5), (1, "a", 2, "section", "upper", None), (1, "a", 3, "element", None, 1.0),
                                (2, "a", 1, "section", "upper", None), (2, "a", 1, "element", None, 4.0), (None, "a", 1, "element", None, 3.0), (3, None, 1, "section", "upper", None)], cols)
    seen = []
    monkeypatch.setattr(q_evaluate, "items", lambda t: seen.append(1) or it)
    out = q_evaluate._compared(None)
    assert len(seen) == 1 and "LocalTableScan" not in out._jdf.queryExecution().executedPlan().toString()
    names = ["file_id", "sections_a", "elements_a", "sections_b", "elements_b", "total_a", "total_b", "differences"]
    assert {tuple(r[c] for c in names) for r in out.collect()} == {
        (1, 2, 2, 1, 2, 3.5, 3.5, 1), (2, 1, 1, 0, 1, 4.0, 4.0, 1), (None, 0, 1, 0, 1, 3.0, 3.0, 2), (3, 1, 0, 0, 0, 0.0, 0.0, 1)}
    few = E.compare_profiles(it, it.filter("file_id = 1 and row = 1 and type = 'element'")).collect()
    assert {r["file_id"]: r["differences"] for r in few}[1] == 3
