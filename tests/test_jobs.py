"""Workbook round trip, sources and sinks, batches, carried state, corrections, streaming."""

import datetime
import json
import random
import re
import zipfile

from pyspark.sql import functions as F

from pricebook.operators import correct as C
from pricebook.operators import items as T
from pricebook.operators import load as L
from pricebook.operators import relational as R
from pricebook.operators import runs
from pricebook.operators import search
from pricebook.operators.scale import carry_last, chunked_lists, dense_ids
from pricebook.sources import files, reports, workbooks
from pricebook.streaming import monitor as M

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_xlsx(path, sheets):
    """Minimal workbook: shared strings for even rows, inline strings for odd ones, plain numbers."""
    shared, parts = [], []
    for rows in sheets.values():
        xml = []
        for r, row in sorted(rows.items()):
            cells = []
            for c, v in enumerate(row):
                ref = f"{chr(65 + c)}{r + 1}"
                if isinstance(v, (int, float)):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif v and r % 2:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                elif v:
                    shared.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            xml.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        parts.append(f"<worksheet {NS}><sheetData>{''.join(xml)}</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS} {RNS}><sheets>" + "".join(
            f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, p in enumerate(parts):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", p)


BODY = {0: ["LOT 06 - Métallerie"], 2: ["Désignation", "Unité", "Quantité", "P.U. HT", "Montant HT"], 3: ["1.1 Escaliers"],
        4: ["fourniture escalier acier", "u", 2, 100, 200], 5: ["y compris pose"], 6: ["garde-corps inox", "ml", 3, "10,50", ""],
        7: ["1.2 Portes"], 8: ["porte acier", "ens", "", 50, 150]}


def corpus(folder):
    folder.mkdir(exist_ok=True)
    write_xlsx(folder / "DPGF Lot 06 - Métallerie.xlsx", {"Page de garde": {0: ["Client : Ville de Lyon"]}, "Lot 06": BODY})
    (folder / "DPGF abime.xlsx").write_bytes(b"not a zip")
    (folder / "DPGF ancien.xls").write_bytes(b"\xd0\xcf")
    return str(folder)


def test_workbook_rows(spark, tmp_path):
    r = workbooks.read_workbook_rows(spark, corpus(tmp_path / "in"))
    got = {(x["sheet"], x["row"]): list(x["cells"]) for x in r.filter("error is null").collect()}
    assert got[("Lot 06", 4)] == ["fourniture escalier acier", "u", "2", "100", "200"]
    assert ("Lot 06", 1) not in got
    assert r.filter("error is not null").count() == 2
    c = workbooks.read_workbook_cells(spark, str(tmp_path / "in"))
    assert c.filter("num = 100").count() == 1


def test_import_job_is_idempotent(spark, tmp_path):
    src, wh = corpus(tmp_path / "in"), str(tmp_path / "wh")
    first = {r["counter"]: r["n"] for r in L.import_documents(spark, src, wh, "a", today="2025-07-01").collect()}
    assert first["elements_created"] == 3 and first["errors"] == 2 and first["sections_created"] == 2
    again = {r["counter"]: r["n"] for r in L.import_documents(spark, src, wh, "b", today="2025-07-01").collect()}
    assert again["clients_created"] == 0 and again["lots_reused"] == 1
    e = {r["designation_exacte"]: r for r in L.stored_elements(spark, wh).collect()}
    assert len(e) == 3 and L.stored_elements(spark, wh).count() == 3
    assert "fourniture escalier acier y compris pose" in e
    assert float(e["garde-corps inox"]["prix_total_ht"]) == 31.5
    assert float(e["porte acier"]["quantite"]) == 3.0
    assert L.stored(spark, wh, "lots").first()["numero_lot"] == "06"
    assert {r["numero_section"] for r in L.stored(spark, wh, "sections").collect()} == {"1.1", "1.2"}


def _import(spark, src, wh, run):
    return {r["counter"]: r["n"] for r in L.import_documents(spark, str(src), str(wh), run, today="2025-07-01").collect()}


def test_import_same_name_in_two_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for d in ("a", "b"):
        corpus(tmp_path / "in" / d)
    _import(spark, tmp_path / "in", tmp_path / "wh", "two")
    ids = [r["id_element"] for r in L.stored_elements(spark, tmp_path / "wh").collect()]
    assert len(ids) == 6 == len(set(ids))


def test_import_skips_damaged_and_replaces_emptied_workbooks(spark, tmp_path):
    src, wh = tmp_path / "in", tmp_path / "wh"
    src.mkdir()
    book = src / "DPGF Lot 06 - Métallerie.xlsx"
    write_xlsx(book, {"Page de garde": {0: ["Client : Ville de Lyon"]}, "Lot 06": BODY})
    assert _import(spark, src, wh, "one")["elements_created"] == 3
    with zipfile.ZipFile(book) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(src / "DPGF Lot 07 - Coupe.xlsx", "w") as z:
        for n, b in parts.items():
            z.writestr(n, b[:len(b) // 2] if n.endswith("sheet2.xml") else b)
    got = _import(spark, src, wh, "two")
    assert got["errors"] == 1 and got["elements_created"] == 3 and L.stored_elements(spark, wh).count() == 3
    logged = L.stored(spark, wh, "errors").collect()
    assert len(logged) == 1 and logged[0]["filename"].endswith("Coupe.xlsx")
    (src / "DPGF Lot 07 - Coupe.xlsx").unlink()
    write_xlsx(book, {"Page de garde": {0: ["Client : Ville de Lyon"]}, "Lot 06": {k: v for k, v in BODY.items() if k < 3}})
    _import(spark, src, wh, "three")
    assert L.stored_elements(spark, wh).count() == 0


def test_redetect_without_header_and_repeated_labels(spark):
    rows = spark.createDataFrame([(1, "Lot 06", i, c) for i, c in enumerate(
        [["1.1 Escaliers", "", "", "", ""], ["fourniture escalier acier", "u", "2", "100", "200"], ["garde-corps inox", "ml", "3", "10,50", "31,50"],
         ["1.2 Portes", "", "", "", ""], ["porte acier", "ens", "1", "50", "50"]] * 3)], "file_id bigint, sheet string, row int, cells array<string>")
    files_ = spark.createDataFrame([(1, "DPGF Lot 06 - Métallerie.xlsx"), (2, "x.xlsx")], "file_id bigint, name string").withColumn("path", F.concat(F.lit("/a/"), "name"))
    lots, sections = C.redetect(files_.select("file_id").limit(1), files_, rows)
    assert {r["numero_section"] for r in sections.collect()} == {"1.1", "1.2"} and lots.first()["numero_lot"] == "06"
    cache = spark.createDataFrame([("f", "b"), ("f", "a")], "fingerprint string, label string")
    hit = T.apply_label_cache(spark.createDataFrame([(1, "f"), (2, "g")], "block int, fingerprint string"), cache).collect()
    assert sorted((r["block"], r["label"], r["hit"]) for r in hit) == [(1, "a", True), (2, None, False)]


def test_deep_trees_and_cycles(spark):
    rows = [(i, i - 1 if i % 100 else None, str(i), f"T{i}") for i in range(200)] + [(500, 502, "a", "A"), (501, 500, "b", "B"), (502, 501, "c", "C"), (503, 501, "d", "D")]
    s = spark.createDataFrame(rows, "id_section int, section_parent_id int, numero_section string, titre_section string")
    p = {r["id_section"]: r for r in R.section_path(s).collect()}
    assert all(p[i]["complete"] and p[i]["chemin"].count("→") == i % 100 for i in range(200)) and len(p) == 204
    assert all(not p[i]["complete"] and "→" not in p[i]["chemin"] for i in range(500, 504))


def test_listing(spark, tmp_path):
    src = corpus(tmp_path / "in")
    assert files.list_files(spark, src).count() == 3
    assert files.list_files(spark, src, exts=(".xlsx",)).count() == 2
    assert files.list_files(spark, src, max_files=1).count() == 1


def test_log_lines_across_splits(spark, tmp_path):
    lines = [f"ligne {i} 2024-01-01 10:00:{i % 60:02d}" for i in range(2000)]
    (tmp_path / "run.log").write_text("\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["line_no"]: r["text"] for r in reports.read_log_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines))


def test_reports_and_errors(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"detailed_results": [
        {"folder_path": "/a", "identified_files": [{"path": "/a/x.xlsx", "name": "x.xlsx", "type": "DPGF", "confidence": 0.8,
                                                   "import_info": {"status": "success", "lots_imported": 0}}, {"name": "y.xlsx", "type": "DPGF"}]},
        {"folder_path": "/b", "identified_files": []}]}, indent=1))
    rep = reports.read_run_reports(spark, str(tmp_path / "r"))
    assert rep.count() == 3
    kinds = {r["type"] for r in runs.report_issues(rep).collect()}
    assert kinds == {"import_technique_sans_donnees", "import_non_tente"}
    err = spark.createDataFrame([("2025-07-07", 'a "b", c.xlsx', 3, "X", "m", "")], reports.ERROR_SCHEMA)
    for _ in range(2):
        reports.append_errors(err, str(tmp_path / "e"))
    assert [r["filename"] for r in reports.read_errors(spark, str(tmp_path / "e")).collect()] == ['a "b", c.xlsx'] * 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "DPGF", 0.5), ("b", "BPU", 0.9)], "name string, doc_type string, confidence double")
    for fmt in ("csv", "json", "text"):
        reports.write_identification_report(df, str(tmp_path / fmt), fmt)
    reports.write_identification_report(df, str(tmp_path / "t"), "csv", by_type=True)
    assert spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path / "t")).columns == ["name", "doc_type", "confidence"]
    reports.write_problem_report(spark.createDataFrame([("f", "p", "d")], "file string, problem_type string, description string"), str(tmp_path / "p"))
    p = spark.createDataFrame([(1, [("x",)])], "id_dpgf int, problems array<struct<type:string>>")
    for fmt in ("csv", "json", "text"):
        reports.write_quality_report(df, p, str(tmp_path / ("q" + fmt)), fmt)
    assert spark.read.json(str(tmp_path / "qjson" / "problems")).count() == 1


def greedy(sizes, limit, n):
    batches, cur, used = [], [], 0
    for i, s in enumerate(sizes):
        if s > limit:
            if cur:
                batches.append(cur)
            batches.append([i])
            cur, used = [], 0
            continue
        if used + s > limit or len(cur) >= n:
            if cur:
                batches.append(cur)
            cur, used = [], 0
        cur.append(i)
        used += s
    return batches + ([cur] if cur else [])


def test_batches_equal_the_greedy_scan(spark):
    rnd, mb = random.Random(3), 1024 * 1024
    for n, block in ((6, 4), (400, 16), (1000, 50)):
        sizes = [rnd.choice([1, 2, 3, 5, 12]) * mb for _ in range(n)]
        df = spark.createDataFrame([("f", i * 3, s) for i, s in enumerate(sizes)], "folder string, file_id bigint, size bigint")
        got = {}
        for r in runs.pack_batches(df, 10, 4, block_rows=block).collect():
            got.setdefault(r["batch"], []).append(r["file_id"] // 3)
        assert [sorted(got[b]) for b in sorted(got)] == greedy(sizes, 10 * mb, 4)


def test_carry_last_across_ranges(spark):
    rnd = random.Random(1)
    rows = [(k, p, rnd.choice([None, None, str(p)])) for k in ("a", "b") for p in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "k string, p bigint, v string")
    got = {(r["k"], r["p"]): r["last"] for r in carry_last(df, ["k"], "p", {"last": "v"}, chunk_rows=17).collect()}
    last = {}
    for k, p, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[(k, p)] == last[k]


def test_dense_ids_and_parts(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    ids = sorted(r["id"] for r in dense_ids(df, ["k"], spark.sql("select 10L as max_id")).collect())
    assert ids == list(range(11, 5011))
    parts = chunked_lists(df.withColumn("g", F.lit(1)), ["g"], F.struct("k"), F.col("k"), 500).select("part", F.size("items").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 5000 and len(parts) == 10


def test_chunked_lists_keep_reading_order(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i % 3, i) for i in range(1000)], "g int, k int").repartition(7)
    got = chunked_lists(df, ["g"], F.struct("k"), F.col("k"), 10).collect()
    for g in (None, 0, 1, 2):
        read = [x["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["part"]) for x in r["items"]]
        assert read == [i for i in range(1000) if (None if i % 10 == 0 else i % 3) == g]
    assert all(len(r["items"]) <= 10 for r in got)


def test_tree_orphans_and_depth(spark):
    s = spark.createDataFrame([(1, None, "1", "A"), (2, 1, "2", ""), (3, 2, "3", "C"), (4, 99, "4", "D")],
                              "id_section int, section_parent_id int, numero_section string, titre_section string")
    p = {r["id_section"]: (r["chemin"], r["complete"]) for r in R.section_path(s).collect()}
    assert p == {1: ("A", True), 2: ("A → Section 2", True), 3: ("A → Section 2 → C", True), 4: ("D", False)}
    ids = spark.createDataFrame([(3,), (77,)], "id_section int")
    assert {r["chemin"] for r in R.lookup_paths(ids, s).collect()} == {"A → Section 2 → C", "Section inconnue"}


def test_text_pairs_equal_brute_force(spark):
    def grams(x):
        return {w[i:i + 3] for t in x.split() for w in ["  " + t + " "] for i in range(len(w) - 2)}
    left = ["porte acier", "porte bois", "fenetre pvc", "garde corps inox"]
    right = ["porte en acier", "porte bois massif", "fenetres pvc", "corps", "garde corps en inox"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    for t in (0.3, 0.5, 0.7):
        want = {(a, b) for a in left for b in right if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > t}
        assert {(r["ltext"], r["rtext"]) for r in search.fuzzy_text_pairs(frame(left), frame(right), t).collect()} == want


def test_text_pairs_with_hot_grams(spark):
    """Nine texts of ten share a word, some are made of frequent words only; hot lists are cut into cells from one row on."""
    def grams(x):
        return {w[i:i + 3] for t in x.split() for w in ["  " + t + " "] for i in range(len(w) - 2)}
    rng = random.Random(5)
    words = ["beton", "acier", "bois", "zinc", "pvc", "laine"] + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    texts = ["ml" + "".join(" " + rng.choice(words[:6 if i % 3 else 46]) for _ in range(i % 5)) for i in range(300)]
    left, right = texts[:200] + ["", None, "--", "ml"], texts[150:] + [None, "--", "", "ml ml"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    distinct = lambda xs: {x for x in xs if x and grams(x.replace("-", " "))}
    for t in (0.4, 0.7):
        want = {(a, b) for a in distinct(left) for b in distinct(right) if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) > t}
        for hot in (1, 10000):
            got = search.fuzzy_text_pairs(frame(left), frame(right), t, hot_rows=hot).collect()
            assert {(r["ltext"], r["rtext"]) for r in got} == want and len(got) == len(want)
    assert search.fuzzy_text_pairs(frame([]), frame(right), 0.5).count() == 0


def test_hot_lists_are_cut(spark):
    left = spark.range(4000).select(F.lit("g").alias("g"), F.col("id").alias("lid"))
    right = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").alias("rid"))
    l, r = search._split_hot(left, right, 100)
    cells = l.groupBy("i", "j").count().agg(F.count("*"), F.max("count")).first()
    assert cells[0] > 300 and cells[1] < 400               # 26 ranges of the left list against 19 of the right
    assert l.join(r, ["g", "i", "j"]).count() == 4000 * 2000


def test_lot_and_section_corrections(spark):
    lots = spark.sql("select * from values (1L, 1L, '00', 'Lot par défaut'), (2L, 2L, '01', 'Ancien') as t(id_lot, id_dpgf, numero_lot, nom_lot)")
    sections = spark.sql("select * from values (1L, 1L, '00', 'Divers', 1), (2L, 2L, '1', 'Murs', 1) as t(id_section, id_lot, numero_section, titre_section, niveau_hierarchique)")
    elements = spark.sql("select * from values (1L, 1L, 1L), (2L, null, 1L), (3L, 2L, 2L) as t(id_element, id_section, id_lot)")
    red = spark.sql("select * from values (1L, '06', 'Métallerie'), (2L, '01', 'Gros oeuvre') as t(id_dpgf, numero_lot, nom_lot)")
    l2, s2, e2, _ = C.correct_lots(lots, sections, elements, red)
    assert {(r["numero_lot"], r["nom_lot"]) for r in l2.collect()} == {("06", "Métallerie"), ("01", "Gros oeuvre")}
    assert {r["id_element"]: r["id_lot"] for r in e2.collect()} == {1: 3, 2: 3, 3: 2}
    news = spark.sql("select 1L as id_lot, '1.1' as numero_section, 'Escaliers' as titre_section, 2 as niveau_hierarchique")
    s3, e3, moved = C.correct_sections(sections, elements, news)
    assert {r["numero_section"] for r in s3.filter("id_lot = 1").collect()} == {"1.1"}
    assert {r["id_element"]: r["id_section"] for r in e3.collect()} == {1: 3, 2: 3, 3: 2} and moved.count() == 2


# ---- streaming ----------------------------------------------------------------------------------------

def stream_of(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def run(df, name, mode, ckpt):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(ckpt)).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, t, tmp_path):
    lines = t.log_lines
    s = stream_of(spark, lines, tmp_path / "lines")
    batch = M.extract_metrics(lines)
    got = run(M.threshold_alerts(M.extract_metrics(s)), "alerts", "append", tmp_path / "c1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.threshold_alerts(batch).collect()))
    metrics = M.extract_metrics(lines)
    hs = run(M.health_stream(M.extract_metrics(s)), "health", "complete", tmp_path / "c4")
    assert sorted(map(str, hs.collect())) == sorted(map(str, M.health_stream(metrics).collect())) and hs.count() > 0
    assert M.health_alerts(hs).count() == hs.filter("status <> 'healthy'").count()
    ms = run(M.metric_summary_stream(stream_of(spark, t.metrics.select("name", "value", "ts"), tmp_path / "m"), "1 hour", "1 hour"),
             "summary", "complete", tmp_path / "c3")
    assert ms.agg(F.sum("n")).first()[0] == t.metrics.count()


def test_first_matches_by_window(spark, t, tmp_path):
    """Many small batches in shuffled order, a window at a time: the stream sends what the batch form finds, once."""
    base = datetime.datetime(2024, 1, 1, 8)
    rows = [(f"f{i % 2}.log", i, base + datetime.timedelta(seconds=7 * i), "timeout timeout" if i % 3 else f"import error {i}")
            for i in range(0, 400, 2)]
    rows += [("f0.log", 4, base, "out of memory"), ("f0.log", 4, base, "timeout again")]      # a repeated number
    schema = "file string, line_no int, ts timestamp, text string"
    random.Random(3).shuffle(rows)
    path, end = str(tmp_path / "in"), base + datetime.timedelta(days=1)
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def feed(some):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
        sent = []
        (M.error_alerts_stream(src, delay="2 hours").writeStream.foreachBatch(lambda df, i: sent.extend(df.collect()))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120))
        return sent

    for at in range(0, len(rows), 70):
        sent = feed(rows[at:at + 70])
    assert sent == []
    sent = feed([("end.log", 1, end, "quiet")])             # closes every window
    want = M.error_alerts_stream(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, sent)) == sorted(map(str, want)) and max(len(r["matches"]) for r in want) == 5
    for r in want:
        mine = sorted((n, x) for f, n, ts, x in rows if f == r["source_file"] and r["start"] <= ts < r["end"] and re.search(
            {"timeout_issues": "timeout", "import_failures": "import", "memory_issues": "memory"}[r["error_type"]], x))
        assert r["matches"] == [x for _, x in mine[:5]] and r["occurrences"] == sum(max(1, x.count("timeout")) for _, x in mine)
    assert feed([("f0.log", 1, base, "timeout late")]) == []        # its window was sent; a new run sends nothing again


def test_history_state(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("m", base + datetime.timedelta(seconds=i), float(i)) for i in range(30)], "name string, ts timestamp, value double")
    got = run(M.metric_history_stream(stream_of(spark, df, tmp_path / "h"), 10), "history", "update", tmp_path / "c")
    assert tuple(got.first()) == ("m", 10, 24.5, 29.0)


def test_repeated_lines_once(spark, t, tmp_path):
    lines = t.log_lines
    s = stream_of(spark, lines.unionByName(lines), tmp_path / "d")
    assert run(M.dedupe_lines(s), "once", "append", tmp_path / "c").count() == lines.count()


def test_new_files_once(spark, tmp_path):
    src, seen = corpus(tmp_path / "in"), []
    for _ in range(2):
        M.watch_folder(spark, src, str(tmp_path / "ck"), lambda df, i: seen.extend(r["path"] for r in df.collect())).awaitTermination(120)
    assert len(seen) == 3
    write_xlsx(tmp_path / "in" / "BPU neuf.xlsx", {"a": BODY})
    M.watch_folder(spark, src, str(tmp_path / "ck"), lambda df, i: seen.extend(r["path"] for r in df.collect())).awaitTermination(120)
    assert len(seen) == 4
