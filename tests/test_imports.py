"""The import job: one commit for all tables, stops, races, folders of equal names, sheets, routes, and the stream."""

import shutil
import threading

import pytest
from pyspark.sql import functions as F

from pricebook.operators import grid as G
from pricebook.operators import load as L
from pricebook.sources import versions, workbooks
from pricebook.streaming import monitor as M
from tests.test_jobs import BODY, write_xlsx

TABLES = ("clients", "dpgf", "lots", "sections", "elements", "documents", "errors")
COVER = {0: ["Client : Ville de Lyon"]}


def book(folder, name="DPGF Lot 06 - Métallerie.xlsx", sheets=None):
    folder.mkdir(parents=True, exist_ok=True)
    write_xlsx(folder / name, sheets or {"Page de garde": COVER, "Lot 06": BODY})
    return str(folder)


def imported(spark, src, wh, run, **options):
    return {r["counter"]: r["n"] for r in L.import_documents(spark, str(src), str(wh), run, today="2025-07-01", **options).collect()}


def counts(spark, wh):
    return {name: L.stored(spark, str(wh), name).count() for name in TABLES}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """What detection finds in three folders: two with files of one name, one with another lot; done once."""
    src = tmp_path_factory.mktemp("in")
    for d, name in (("a", "DPGF Lot 06 - Métallerie.xlsx"), ("b", "DPGF Lot 06 - Métallerie.xlsx"), ("c", "DPGF Lot 07 - Bois.xlsx")):
        book(src / d, name)
    f = L.detect_workbooks(spark, workbooks.read_workbook_rows(spark, str(src)), "all")

    def of(d):
        mine = F.col("path").contains(f"/{d}/")
        facts = f.facts.filter(mine)
        return f._replace(rows=f.rows.filter(mine), facts=facts, items=f.items.join(facts.select("file_id").distinct(), "file_id", "left_semi"),
                          damaged=f.damaged.filter(mine))
    return {d: of(d) for d in "abc"}


def loaded(spark, f, wh, run, **options):
    return {r["counter"]: r["n"] for r in L.load_found(spark, f, str(wh), run, today="2025-07-01", **options).collect()}


@pytest.fixture(scope="module")
def first(spark, found, tmp_path_factory):
    """A warehouse with the first folder, to be copied."""
    wh = tmp_path_factory.mktemp("wh") / "first"
    assert loaded(spark, found["a"], wh, "one")["elements_created"] == 3
    return wh


def test_two_folders_in_two_runs_lose_nothing(spark, found, first, tmp_path):
    wh = shutil.copytree(first, tmp_path / "wh")
    loaded(spark, found["b"], wh, "two")
    now = counts(spark, wh)
    assert now["elements"] == 6 and now["dpgf"] == 2 == now["documents"] and now["clients"] == 1 and now["lots"] == 2
    assert L.stored_elements(spark, str(wh)).select("id_dpgf").distinct().count() == 2
    r = L.stored(spark, str(wh), "dpgf").first()
    assert r["fichier_source"] == "DPGF Lot 06 - Métallerie.xlsx" and r["nom_projet"].endswith(" - " + r["fichier_source"])
    # the first folder again, with an item less: its own rows go, the other folder's stay
    fewer = found["a"]._replace(items=found["a"].items.filter("designation is null or designation not like 'porte%'"))
    again = loaded(spark, fewer, wh, "three")
    assert again["dpgf_created"] == 0 and counts(spark, wh)["elements"] == 5
    # and nothing left in it
    loaded(spark, fewer._replace(items=fewer.items.filter("false")), wh, "four")
    assert counts(spark, wh)["elements"] == 3


def test_project_names_tell_files_apart(spark):
    u = spark.range(1).select(L.unique_project(F.lit("Projet f.xlsx"), F.lit("f.xlsx")).alias("a"), L.unique_project(F.lit("P"), F.lit("f.xlsx")).alias("b")).first()
    assert tuple(u) == ("Projet f.xlsx", "P - f.xlsx")


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ("clients", "dpgf", "lots", "sections", "elements", "commit"))
def test_a_stop_after_any_step_leaves_the_old_state(spark, found, first, tmp_path, monkeypatch, step):
    wh = shutil.copytree(first, tmp_path / "wh")
    before = counts(spark, wh)
    if step == "commit":
        def stop(*a, **k):
            raise Stop
        monkeypatch.setattr(versions, "commit", stop)
    else:
        stage = L._stage

        def stage_then_stop(spark, df, base, name):
            out = stage(spark, df, base, name)
            if name == step:
                raise Stop
            return out
        monkeypatch.setattr(L, "_stage", stage_then_stop)
    with pytest.raises(Stop):
        loaded(spark, found["c"], wh, "two")
    assert counts(spark, wh) == before and versions.version(spark, str(wh)).number == 1


def test_two_imports_at_once_number_apart(spark, found, tmp_path, monkeypatch):
    wh, meet, commit, lost = tmp_path / "wh", threading.Barrier(2, timeout=120), versions.commit, []

    def commit_together(*a, **k):
        if not lost and not meet.broken:
            try:
                meet.wait()
            except threading.BrokenBarrierError:
                pass
        out = commit(*a, **k)
        if out is None:
            lost.append(1)
            meet.abort()
        return out

    monkeypatch.setattr(versions, "commit", commit_together)
    jobs = [threading.Thread(target=loaded, args=(spark, found[d], wh, d)) for d in ("a", "c")]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert lost == [1] and versions.version(spark, str(wh)).number == 2
    for name, key in (("dpgf", "id_dpgf"), ("lots", "id_lot"), ("sections", "id_section"), ("elements", "id_element"), ("clients", "id_client")):
        ids = [r[0] for r in L.stored(spark, str(wh), name).select(key).collect()]
        assert len(ids) == len(set(ids)) > 0
    assert counts(spark, wh)["elements"] == 6 and counts(spark, wh)["sections"] == 4


def test_versions(spark, tmp_path):
    wh = str(tmp_path / "wh")
    v0 = versions.version(spark, wh)
    assert v0 == (0, {}, {}) and versions.read(spark, wh, v0, "t", "a int").count() == 0
    spark.range(3).write.parquet(f"{wh}/t/x")
    v1 = versions.commit(spark, wh, v0, {"t": {"": ["t/x"]}})
    assert v1.number == 1 and versions.commit(spark, wh, v0, {"t": {"": ["t/y"]}}) is None
    spark.range(5).write.parquet(f"{wh}/t/z")
    v2 = versions.commit(spark, wh, v1, {"t": {"": ["t/z"]}}, {"s": 4})
    assert versions.version(spark, wh) == v2 and v2.batches == {"s": 4}
    assert versions.read(spark, wh, versions.version(spark, wh, 1), "t", "id bigint").count() == 3
    assert versions.unused(spark, wh, keep=2, hours=0) == [] and versions.unused(spark, wh, keep=1, hours=1) == []
    assert versions.remove_unused(spark, wh, keep=1, hours=-1) == ["t/x"] and versions.read(spark, wh, v2, "t", "id bigint").count() == 5


def test_many_folders_are_put_together(spark, found, first, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MANY", 1)
    wh = shutil.copytree(first, tmp_path / "wh")
    loaded(spark, found["c"], wh, "two")
    v = versions.version(spark, str(wh))
    assert len(versions.folders(v, "dpgf")) == 1 and counts(spark, wh)["dpgf"] == 2 and counts(spark, wh)["elements"] == 6


def test_routes(spark, tmp_path):
    """One sheet per lot, a saved mapping, a lot known from elsewhere, and columns that are not sure."""
    other = {0: ["LOT 07 - Menuiserie bois"], **{k + 1: v for k, v in BODY.items() if k > 1}}
    src = book(tmp_path / "in", "DPGF tous corps.xlsx", {"Page de garde": COVER, "Lot 06 Métallerie": BODY, "Lot 07": other, "Notes": {0: ["a relire"]}})
    sheet = {0: ["ignored", "Désignation", "Unité", "Quantité", "P.U. HT"], 1: ["1.1 Murs"], 2: ["fourniture mur béton", "", "m2", 3, 10], 3: ["pose dalle béton", "", "m2", 2, 20]}
    book(tmp_path / "in", "Marché.xlsx", {"Feuille": sheet})
    book(tmp_path / "in", "DPGF Lot 03 - Vague.xlsx", {"Feuille": {i: ["remarque libre sans rapport avec le reste", "x"] for i in range(12)}})
    rows = workbooks.read_workbook_rows(spark, src)
    files = rows.select("file_id", "path").distinct().withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).filter("name = 'Marché.xlsx'")
    none = spark.createDataFrame([], "signature string, designation int, unite int, quantite int, prix_unitaire int, prix_total int")
    heads = G.map_columns(G.find_header_row(rows.join(files.select("file_id"), "file_id", "left_semi")))
    saved = G.apply_saved_mappings(heads, files, none).select(
        "signature", F.lit(0).alias("designation"), F.lit(2).alias("unite"), F.lit(3).alias("quantite"), F.lit(4).alias("prix_unitaire"), F.lit(None).cast("int").alias("prix_total"))
    outer = files.select("file_id", F.lit("12").alias("numero_lot"), F.lit("Chauffage").alias("nom_lot"))
    wh = str(tmp_path / "wh")
    got = imported(spark, src, wh, "one", sheets="all", saved=saved, external=outer)
    lots, e = L.stored(spark, wh, "lots"), L.stored_elements(spark, wh)
    names = {(r["numero_lot"], r["nom_lot"]) for r in lots.collect()}
    assert {("06", "Métallerie"), ("07", "Menuiserie bois"), ("12", "Chauffage")} <= names
    per = {r["nom_lot"]: r["count"] for r in e.join(lots, "id_lot").groupBy("nom_lot").count().collect()}
    assert per["Métallerie"] == 3 == per["Menuiserie bois"]
    assert {r["designation_exacte"] for r in e.join(lots.filter("numero_lot = '12'"), "id_lot").collect()} >= {"fourniture mur béton", "pose dalle béton"}
    errors = L.stored(spark, wh, "errors").collect()
    assert got["errors"] == 0 and [r["error_type"] for r in errors] == ["LowConfidence"] and errors[0]["filename"].endswith("Vague.xlsx")
    with pytest.raises(ValueError):
        L.schedule_sheets(rows, None, "some")


def test_shared_form_without_header(spark):
    form = [(1, "Lot 1", i, [f"{i // 5 + 1}.{i % 5 + 1}", f"article {i} en acier laqué", "", str(2 + i % 3), f"{100 + i},50"]) for i in range(12)]
    rows = spark.createDataFrame(form, "file_id bigint, sheet string, row int, cells array<string>")
    m = L.layout(rows).first()
    assert (m["designation"], m["header_row"], m["manual"]) == (1, None, False) and m["prix_unitaire"] is not None


# ---- the stream ------------------------------------------------------------------------------------------

def stream_of_two(spark, found, tmp_path, monkeypatch):
    """A stream over two files; detection is done before, per set of files."""
    src = book(tmp_path / "in", "DPGF Lot 07 - Bois.xlsx")
    monkeypatch.setattr(L, "detect_workbooks", lambda spark, grid, run, **how: found["c"] if grid.count() else None)
    return lambda wh: M.import_new_files(spark, src, str(wh), str(tmp_path / "ck"), today="2025-07-01").awaitTermination(300)


def test_stream_imports_each_file_once(spark, found, tmp_path, monkeypatch):
    wh, go = tmp_path / "wh", stream_of_two(spark, found, tmp_path, monkeypatch)
    go(wh)
    go(wh)
    assert counts(spark, wh)["elements"] == 3 and versions.version(spark, str(wh)).batches == {"import": 0}


@pytest.mark.parametrize("when", ("before", "after"))
def test_stream_stopped_around_the_commit(spark, found, tmp_path, monkeypatch, when):
    """The batch comes again after the restart; the result is that of one batch import of the same files."""
    wh, go, commit = tmp_path / "wh", stream_of_two(spark, found, tmp_path, monkeypatch), versions.commit

    def stop(*a, **k):
        if when == "after":
            assert commit(*a, **k)
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", stop)
        with pytest.raises(Exception):
            go(wh)
    assert versions.version(spark, str(wh)).number == (1 if when == "after" else 0)
    go(wh)
    assert versions.version(spark, str(wh)).number == 1
    loaded(spark, found["c"], tmp_path / "batch", "one")
    key = lambda w: sorted(map(str, L.stored_elements(spark, str(w)).collect()))
    assert key(wh) == key(tmp_path / "batch") and counts(spark, wh) == counts(spark, tmp_path / "batch")
