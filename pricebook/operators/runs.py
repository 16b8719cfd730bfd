"""Import-run analytics over log lines ``(file, line_no, text, ts)``, reports and batches.

A log may hold most of all lines: carried state is scanned in ranges of line
numbers (``carry_last``), neighbouring lines are met by an equality join on the
line number, and "last n lines" is trimmed before the shuffle.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.functions.scalars import to_double
from pricebook.functions.text import any_word, first_rule, rx
from pricebook.operators.scale import carry_last, last_rows

# Error families and their patterns.
FAMILIES = {
    "import_technique": (r"import technique.*aucune donnée", r"fichier.*traité.*0 lots.*0 sections.*0 éléments", r"traitement.*terminé.*sans données utiles"),
    "erreur_excel": (r"erreur.*lecture.*excel", r"xlrd.*error", r"openpyxl.*error", r"engine.*not.*supported"),
    "erreur_reseau": (r"timeout", r"connection.*error", r"network.*error", r"sharepoint.*inaccessible"),
    "erreur_structure": (r"structure.*non.*reconnue", r"colonnes.*manquantes", r"format.*invalide", r"en-têtes.*introuvables"),
    "erreur_donnees": (r"données.*corrompues", r"valeurs.*manquantes", r"format.*prix.*invalide", r"quantités.*invalides"),
    "succes_import": (r"import.*réussi", r"lots.*créés.*\d+", r"sections.*créées.*\d+", r"éléments.*créés.*\d+"),
}
FILE_NAMED = r"(?:traitement|analyse|import).*?([A-Za-z0-9_\-\.]+\.xlsx?)"
WORKBOOK = r"([^/\s]+\.(?:xlsx|xlsm|xls))"
# Events of the run log: type, pattern, severity, names a file.
RUN_EVENTS = (
    ("import_technique_sans_donnees", r"Import technique réussi mais AUCUNE DONNÉE.*?" + WORKBOOK, "warning", True),
    ("echec_import", r"Échec import.*?" + WORKBOOK, "error", True),
    ("import_reussi", r"Import réussi.*?" + WORKBOOK, "info", True),
    ("fichier_identifie", r"Fichier identifié.*?" + WORKBOOK, "info", True),
    ("structure_non_reconnue", r"structure non reconnue.*?" + WORKBOOK, "info", True),
    ("lots_sections_elements", r"((\d+) lots?,\s*(\d+) sections?,\s*(\d+) éléments)", "info", False),
    ("timeout_sharepoint", r"(timeout.*sharepoint)", "info", False),
    ("erreur_reseau", r"(erreur.*réseau|network.*error|connection.*error)", "info", False),
)
STATUS = {"import_technique_sans_donnees": "import_technique", "echec_import": "echec", "import_reussi": "reussi"}
RELEVANT = ("orchestrat", "workflow", "dpgf", "import technique", "sharepoint", "identified_files")
METHODS = ("filename", "gemini", "content")


def _has(text):
    return F.col("text").contains(text)


def with_current_file(lines: DataFrame) -> DataFrame:
    """Workbook named in brackets on this or the nearest earlier line of the log."""
    name = F.regexp_extract("text", r"\[(.*?)\]", 1)
    marked = lines.withColumn("_named", F.when(name.contains(".xls"), name))
    return carry_last(marked, ["file"], "line_no", {"current_file": "_named"}).drop("_named")


def import_log_stats(lines: DataFrame) -> DataFrame:
    """Counts per log: files, lot and section trouble, detection methods."""
    c = with_current_file(lines).filter("current_file is not null")
    found = _has("LOT DÉTECTÉ - Méthode:")
    return c.groupBy("file").agg(
        F.count_distinct("current_file").alias("files_processed"), F.count_if(_has("LOT NON DÉTECTÉ")).alias("files_with_lot_issues"),
        F.count_if(_has("Aucune section détectée")).alias("files_with_section_issues"),
        *[F.count_if(found & _has(f"Méthode: {m}")).alias(f"method_{m}") for m in METHODS],
        F.count_if(_has("LOT PAR DÉFAUT CRÉÉ")).alias("default_lots_created"),
        F.count_if(_has("SECTION PAR DÉFAUT CRÉÉE")).alias("default_sections_created"))


def import_log_problems(lines):
    """Problem lines with the workbook they belong to."""
    kind = first_rule([(_has("LOT NON DÉTECTÉ"), "Lot non détecté"), (_has("LOT PAR DÉFAUT CRÉÉ"), "Lot par défaut créé"),
                       (_has("SECTION PAR DÉFAUT CRÉÉE"), "Section par défaut créée"), (_has("Aucune section détectée"), "Problème de section")])
    return (with_current_file(lines).withColumn("problem_type", kind).filter("problem_type is not null and current_file is not null")
            .select(F.col("current_file").alias("file"), "problem_type", F.trim("text").alias("description"), F.col("file").alias("log"), "line_no"))


def latest_logs(logs: DataFrame) -> DataFrame:
    """Newest log per workbook from ``(file_name, file, modified)``, with the number of imports."""
    return logs.groupBy("file_name").agg(F.max_by("file", F.struct("modified", "file")).alias("file"), F.count("*").alias("imports"))


def file_log_events(lines: DataFrame) -> DataFrame:
    """Lot and section events of per-file logs, read in the phase they appear in."""
    phase = F.when(_has("==== DÉTECTION DE LOT ===="), "lot").when(_has("==== DÉTECTION DES SECTIONS ET ÉLÉMENTS ===="), "section")
    c = carry_last(lines.withColumn("_p", phase), ["file"], "line_no", {"phase": "_p"}).filter("_p is null and phase is not null")
    lot, sec = F.col("phase") == "lot", F.col("phase") == "section"
    event = first_rule([
        (lot & _has("LOT DÉTECTÉ"), "detected"), (lot & _has("LOT NON DÉTECTÉ"), "not_detected"), (lot & _has("ÉCHEC DE DÉTECTION"), "failed"),
        (sec & _has("SECTION DÉTECTÉE"), "detected"), (sec & _has("SECTION NON DÉTECTÉE"), "not_detected"),
        (sec & _has("SECTION PAR DÉFAUT CRÉÉE"), "default_created")])
    problem = (lot & F.col("event").isin("not_detected", "failed")) | (sec & (F.col("event") == "default_created"))
    return (c.withColumn("event", event).filter("event is not null").withColumn("is_problem", problem)
            .select("file", "line_no", "phase", "event", "is_problem", "text"))


def error_family_counts(lines: DataFrame) -> DataFrame:
    """Matches per log and error family (all patterns of the family added)."""
    sums = [F.sum(sum((F.regexp_count("text", F.lit(rx(p))) for p in ps[1:]), F.regexp_count("text", F.lit(rx(ps[0]))))).alias(f)
            for f, ps in FAMILIES.items()]
    wide = lines.groupBy("file").agg(*sums)
    return wide.unpivot(["file"], list(FAMILIES), "family", "n").filter("n > 0")


def files_in_logs(lines):
    return lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(rx(FILE_NAMED)), 1)).alias("file_name")).distinct()


def import_totals(families, files):
    """Per log: files named, successes, technical imports, failures (raw value may be negative)."""
    f = files.groupBy("file").agg(F.count("*").alias("total_files"))
    k = families.groupBy("file").agg(*[F.sum(F.when(F.col("family") == c, F.col("n")).otherwise(0)).alias(a) for c, a in (
        ("succes_import", "successful_imports"), ("import_technique", "technical_imports"))])
    j = f.join(k, "file", "full").fillna(0)
    raw = F.col("total_files") - F.col("successful_imports") - F.col("technical_imports")
    return j.withColumn("failed_raw", raw).withColumn("failed_imports", F.greatest(F.lit(0), raw))


def report_success(reports):
    """Success rate per folder of each report; the report's own rate is the total over its files."""
    ok = F.col("import_status") == "success"
    return reports.rollup("report_file", "folder").agg(F.count("*").alias("files"), F.count_if(ok).alias("successful")).filter(
        "report_file is not null").withColumn("success_rate", F.coalesce(F.try_divide(F.col("successful") * 100.0, F.col("files").cast("double")), F.lit(0.0)).cast("double"))


def error_distribution(families, n=5):
    return families.groupBy("family").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "family").limit(n)


def problem_files(families, files):
    """Files named in logs that show workbook or structure errors, by number of such logs."""
    bad = families.filter(F.col("family").isin("erreur_excel", "erreur_structure")).select("file").distinct()
    return files.join(bad, "file", "left_semi").groupBy("file_name").agg(F.count("*").alias("logs"))


def analysis_period(df, ts="ts"):
    return df.agg(F.min(ts).alias("start_date"), F.max(ts).alias("end_date"),
                  F.floor((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))) / 86400).alias("duration_days"))


# Recommendation rules: metric, comparison, bound, type, priority, title.
RECOMMENDATIONS = (
    ("erreur_excel", ">", 0.0, "excel_handling", "high", "Améliorer la gestion des fichiers Excel"),
    ("import_technique", ">", 0.0, "data_quality", "medium", "Réduire les imports techniques sans données"),
    ("erreur_reseau", ">", 0.0, "network_robustness", "high", "Renforcer la robustesse réseau"),
    ("average_success_rate", "<", 80.0, "success_rate", "high", "Améliorer le taux de succès global"),
    ("problematic_files", ">", 0.0, "problematic_files", "medium", "Traiter les fichiers problématiques récurrents"),
    ("processing_time", ">", 300.0, "performance", "medium", "Optimiser les temps de traitement"),
    ("success_rate", "<", 0.8, "reliability", "high", "Améliorer la fiabilité"),
)


def recommend(metrics: DataFrame, rules=RECOMMENDATIONS) -> DataFrame:
    """Advice whose rule holds for a metric ``(metric, value)``."""
    table = metrics.sparkSession.createDataFrame(list(rules), "metric string, op string, bound double, type string, priority string, title string")
    holds = F.when(F.col("op") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    return metrics.join(F.broadcast(table), "metric").filter(holds).select("type", "priority", "title", "metric", "value")   # a few literal rules


def run_log_events(lines: DataFrame) -> DataFrame:
    """Every event of the run log with its file and severity."""
    hits = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(rx(p)), 1), _event(t, s, named)) for t, p, s, named in RUN_EVENTS])
    return lines.select("file", "line_no", "ts", "text", F.explode(hits).alias("e")).select(
        "file", "line_no", "ts", "e.type", "e.severity", "e.file_name", F.trim("text").alias("message"))


def _event(kind, severity, named):
    return lambda m: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                              (m if named else F.lit(None).cast("string")).alias("file_name"))


COUNTS = r"(\d+) lots?,\s*(\d+) sections?,\s*(\d+) éléments"


def run_log_counts(lines: DataFrame) -> DataFrame:
    """Lots, sections and elements per file; the file is named on the line or one of the three before.

    Lines naming a file are offered to the next three line numbers and met by
    an equality join; the earliest name in reach is taken.
    """
    c = lines.filter(F.col("text").rlike(rx(COUNTS))).select(
        "file", "line_no", *[F.regexp_extract("text", rx(COUNTS), i + 1).cast("bigint").alias(n) for i, n in enumerate(("lots", "sections", "elements"))])
    near = lines.filter(F.col("text").rlike(rx(WORKBOOK))).select(
        "file", F.regexp_extract("text", rx(WORKBOOK), 1).alias("file_name"), F.col("line_no").alias("at"),
        F.explode(F.sequence(F.col("line_no"), F.col("line_no") + 3)).alias("line_no"))
    first = near.groupBy("file", "line_no").agg(F.min_by("file_name", "at").alias("file_name"))
    tied = c.join(first, ["file", "line_no"])
    return tied.groupBy("file_name").agg(F.max_by(F.struct("lots", "sections", "elements"), F.struct("file", "line_no")).alias("c")).select("file_name", "c.*")


def run_file_status(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Last status per file, its counts, and whether it needs a look."""
    status = first_rule([(F.col("type") == t, s) for t, s in STATUS.items()])
    s = (events.withColumn("status", status).filter("status is not null and file_name is not null")
         .groupBy("file_name").agg(F.max_by("status", F.struct("file", "line_no")).alias("status")))
    j = s.join(counts, "file_name", "full").fillna("unknown", ["status"]).fillna(0, ["lots", "sections", "elements"])
    problem = (F.col("status") == "import_technique") | ((F.col("lots") == 0) & (F.col("sections") == 0) & (F.col("status") != "echec"))
    return j.withColumn("is_problem", problem)


def files_by_status(status):
    return status.groupBy("status").agg(F.count("*").alias("files"), F.count_if("is_problem").alias("problems"))


def top_issues(issues, n=10, kind="type"):
    return issues.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(n)


def relevant_logs(lines):
    """Logs whose first ten lines speak of an import run."""
    return lines.filter(F.col("line_no") < 10).groupBy("file").agg(F.bool_or(F.lower("text").rlike(any_word(RELEVANT))).alias("relevant"))


def report_issues(reports: DataFrame) -> DataFrame:
    """Schedules identified but imported empty, failed or not tried."""
    empty = (F.coalesce("lots_imported", F.lit(0)) == 0) & (F.coalesce("sections_imported", F.lit(0)) == 0) & (F.coalesce("elements_imported", F.lit(0)) == 0)
    st = F.col("import_status")
    kind = F.when((st == "success") & empty, "import_technique_sans_donnees").when(st == "failed", "import_echec").when(
        st.isin("unknown", "not_attempted"), "import_non_tente")
    return (reports.filter("type = 'DPGF'").withColumn("issue", kind).filter("issue is not null")
            .select("report_file", "folder", "path", F.col("name").alias("file_name"), "confidence", F.col("issue").alias("type")))


def report_issue_summary(issues, n=10):
    """Issues by type, and the files with most of them."""
    files = top_issues(issues, n, "file_name").select(F.lit("file").alias("level"), F.col("file_name").alias("key"), "n")
    types = issues.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("level"), F.col("type").alias("key"), "n")
    return files.unionByName(types)


def folder_run_totals(reports):
    """Per folder and overall (folder NULL): files, workbooks, identified, imported, errors."""
    return reports.rollup("folder").agg(
        F.count("*").alias("files_found"), F.count_if(F.lower("name").rlike(r"\.(xlsx|xlsm|xls)$")).alias("excel_files"),
        F.count_if(F.col("type").isin("DPGF", "BPU", "DQE")).alias("identified"), F.count_if(F.col("import_status") == "success").alias("imported"),
        F.count_if(F.col("import_status") == "failed").alias("errors"))


def run_totals(reports):
    ok = F.col("import_status") == "success"
    return reports.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(F.col("import_status") == "failed").alias("failed"),
                       *[F.sum(F.when(ok, F.col(f"{e}_imported")).otherwise(0)).alias(e) for e in ("lots", "sections", "elements")]).withColumn(
        "success_rate", F.coalesce(F.try_divide(F.col("successful").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def timing_report(results, slow=30):
    """Totals, mean time and size, and numbers of slow and failed files."""
    t = results.agg(F.count("*").alias("files"), F.sum("seconds").alias("_s"), F.sum("size").alias("_b"),
                    F.count_if(F.col("seconds") > slow).alias("slow_files"), F.count_if(F.col("import_status") == "failed").alias("failed_files"))
    n = F.col("files").cast("double")
    return t.select("files", F.try_divide(F.col("_s").cast("double"), n).alias("mean_seconds"),
                    F.try_divide(F.col("_b").cast("double"), n).alias("mean_bytes"), "slow_files", "failed_files")


def time_saved(results, budget=600):
    """Seconds saved against a fixed budget by successful files, and how many of them needed retries."""
    ok = F.col("import_status") == "success"
    return results.agg(F.sum(F.when(ok & (F.col("seconds") < budget), budget - F.col("seconds")).otherwise(0)).alias("time_saved"),
                       F.count_if(ok & (F.col("attempts") > 1)).alias("retried"))


# ---- batches ---------------------------------------------------------------------------------------

def with_position(df: DataFrame, keys, order, chunk_rows=65536, name="pos") -> DataFrame:
    """0-based position per key in order of a unique integer column, without one window per key."""
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    n = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    off = n.select(*keys, "_chunk", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_n")).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    return (df.withColumn("_rn", rn).join(off, [*keys, "_chunk"])
            .withColumn(name, F.col("_off") + F.col("_rn") - 1).drop("_chunk", "_rn", "_off"))


def fixed_slices(df, keys, order, n=10):
    return with_position(df, keys, order).withColumn("batch", F.floor(F.col("pos") / n))


def _starts(sizes, entry, n_own, max_bytes, max_n):
    """Positions where a batch starts, walking from ``entry`` over a block and its look-ahead."""
    out, i, total = [], entry, len(sizes)
    while i < n_own:
        out.append(i)
        used, j = sizes[i], i + 1
        if sizes[i] <= max_bytes:
            while j < total and j - i < max_n and sizes[j] <= max_bytes and used + sizes[j] <= max_bytes:
                used += sizes[j]
                j += 1
        i = j
    return out, i - n_own


def pack_batches(files: DataFrame, max_mb=100, max_n=10, order="file_id", block_rows=20000) -> DataFrame:
    """Greedy batches per folder, in order: bounded by size and count; an oversize file stands alone.

    The packing is sequential, yet a batch holds at most ``max_n`` files, so
    what a block of files needs to know of the blocks before it is one of
    ``max_n`` possible entry points. Every block computes its exit for each
    entry in parallel; chaining these small tables (one row per block) gives
    the true entries, and the blocks then place their batches in parallel.
    """
    max_bytes = max_mb * 1024 * 1024
    f = with_position(files.select("folder", order, "size"), ["folder"], order).withColumn("block", F.floor(F.col("pos") / block_rows))
    ahead = f.filter((F.col("block") > 0) & (F.col("pos") % block_rows < max_n)).withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))
    blocks = f.withColumn("own", F.lit(True)).unionByName(ahead)

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n_own, sizes = int(pdf["own"].sum()), pdf["size"].tolist()
        t = [_starts(sizes, e, n_own, max_bytes, max_n) if e < n_own else ([], e - n_own) for e in range(max_n + 1)]
        return pd.DataFrame([(pdf["folder"].iloc[0], int(pdf["block"].iloc[0]), [x[1] for x in t], [len(x[0]) for x in t])],
                            columns=["folder", "block", "exits", "counts"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, done, out = 0, 0, []
        for r in pdf.sort_values("block").itertuples():
            out.append((r.folder, r.block, entry, done))
            done += int(r.counts[entry])
            entry = int(r.exits[entry])
        return pd.DataFrame(out, columns=["folder", "block", "entry", "done"])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        n_own = int(pdf["own"].sum())
        starts, _ = _starts(pdf["size"].tolist(), int(pdf["entry"].iloc[0]), n_own, max_bytes, max_n)
        flag = pd.Series(0, index=range(len(pdf)))
        flag.loc[starts] = 1
        pdf["batch"] = flag.cumsum() + int(pdf["done"].iloc[0]) - 1
        return pdf.loc[pdf["own"], ["folder", order, "batch"]]

    tables = blocks.groupBy("folder", "block").applyInPandas(exits, "folder string, block bigint, exits array<int>, counts array<int>")
    entries = tables.groupBy("folder").applyInPandas(chain, "folder string, block bigint, entry int, done bigint")
    placed = (blocks.join(entries, ["folder", "block"]).groupBy("folder", "block")
              .applyInPandas(place, f"folder string, {order} bigint, batch bigint"))
    return files.join(placed, ["folder", order])


def batch_progress(batches: DataFrame, run="run", order="batch", chunk_rows=65536) -> DataFrame:
    """Running totals per run and the time left by the mean batch time so far."""
    cols = ("files", "imported", "failed", "seconds")
    b = batches.withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    local = Window.partitionBy(run, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = b.groupBy(run, "_chunk").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in cols])
    before = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(run, "_chunk", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_h{c}") for c in ("n", *cols)])
    total = sums.groupBy(run).agg(F.sum("_n").alias("_total"))
    r = b.withColumn("_rn", F.row_number().over(Window.partitionBy(run, "_chunk").orderBy(order)))
    for c in cols:
        r = r.withColumn(f"_l{c}", F.sum(c).over(local))
    r = r.join(heads, [run, "_chunk"]).join(total, run)
    k = F.col("_rn") + F.col("_hn")
    return r.select(run, order, *[(F.col(f"_l{c}") + F.col(f"_h{c}")).alias(f"cum_{c}") for c in cols],
                    F.when(k > 1, (F.col("_lseconds") + F.col("_hseconds")).cast("double") / k * (F.col("_total") - k)).otherwise(0.0).alias("estimated_remaining"))


# Retention in days per file class.
RETENTION = (("log", r"\.log$", 30), ("report", r"\.json$", 90))


def expired_files(files, now, policy=RETENTION):
    """Files past the retention of their class, and the space they hold."""
    kind = first_rule([(F.lower("name").rlike(p), k) for k, p, _ in policy])
    days = first_rule([(F.col("class") == k, d) for k, _, d in policy])
    return (files.withColumn("class", kind).filter("class is not null").withColumn("_d", days)
            .filter(F.col("modified") < F.lit(now).cast("timestamp") - F.make_interval(days=F.col("_d"))).drop("_d"))


def critical_errors(errors, marker="mapping_confidence", level="CRITICAL_ERROR"):
    """Critical error lines that hold a marker, by message."""
    return errors.filter(F.col("text").contains(marker) & F.col("text").contains(level)).groupBy(F.trim("text").alias("message")).agg(F.count("*").alias("n"))


def recent_error_density(lines, last=100, limit=5, least=1000):
    """Errors in the last lines of long logs, and whether they are many."""
    tail = last_rows(lines, ["file"], [F.desc("line_no")], last, "_rn")
    long_logs = lines.groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select("file")
    bad = F.col("text").contains("ERROR") | F.col("text").contains("ERREUR")
    return tail.join(long_logs, "file", "left_semi").groupBy("file").agg(F.count_if(bad).alias("errors")).withColumn("many", F.col("errors") > limit)


def parse_listing(lines, min_conf=0.3):
    """File name and confidence of listing lines that hold both."""
    low = F.lower("text")
    words = F.split("text", r"\s+")
    names = F.filter(words, lambda w: w.rlike(r"\.(xlsx|xls|xlsm)$"))
    conf = to_double(F.replace(F.regexp_extract("text", r"(?i)confidence:\S*\s+(\S+)", 1), F.lit(")"), F.lit("")))
    return (lines.filter(low.contains("confidence:") & low.contains(".xls")).select(
        "file", "line_no", F.get(names, F.size(names) - 1).alias("name"), F.coalesce(conf, F.lit(0.0)).alias("confidence"))
        .filter(F.col("name").isNotNull() & (F.col("confidence") >= min_conf)))
