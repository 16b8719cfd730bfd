"""Registered queries: file listings (A3-A7), workbooks, logs, reports and error tables as round trips (A1, A2, A8, A10, A11,
A13, A15)."""

import uuid

from pyspark.sql import functions as F

from pricebook.plans.fixtures import oracle
from pricebook.session import checkpoint_dir
from pricebook.sources import files as S
from pricebook.sources import reports as P
from pricebook.sources import workbooks as B
from pricebook.sources.workbook_writer import write_workbooks

PLANS = {}


def reg(name, fn, sql, *views):
    PLANS[name] = (fn, oracle(sql, *views))


reg("a03_filter_files", lambda t: S.filter_files(t.files, {**S.RULES, "max_mb": 3, "excluded": ("TEMPLATE", "EXEMPLE", "TEST", "URGENT")}).select("path", "file_id", "size"),
    r"""select path, file_id, size from files where regexp_matches(lower(name), '(\.xlsx|\.xls|\.xlsm)$') and size between 10240 and 3145728
    and regexp_matches(upper(name), 'DPGF|BPU|DQE|LOT') and not regexp_matches(upper(name), 'TEMPLATE|EXEMPLE|TEST|URGENT')""", "files")
reg("a04_new_files", lambda t: S.new_files(t.files, "1998-06-01").select("path", "file_id"),
    "select path, file_id from files where modified >= timestamp '1998-06-01' and (ends_with(lower(name), '.xlsx') or ends_with(lower(name), '.xls'))", "files")


def _ledger(t):
    return t.files.filter("folder < '/src/4' and modified < timestamp '1997-01-01'").select("path").distinct().withColumn("processed_name", F.lit("ancien"))


reg("a05_pending_files", lambda t: S.pending_files(t.files, _ledger(t)).select("path", "file_id"),
    "select path, file_id from files where path not in (select path from files where folder < '/src/4' and modified < timestamp '1997-01-01')", "files")
reg("a05_mark_processed", lambda t: S.mark_processed(t.files, _ledger(t), "2025-07-01 10:20:30"),
    """with l as (select distinct path from files where folder < '/src/4' and modified < timestamp '1997-01-01')
    select path, 'ancien' as processed_name from l union all
    select distinct path, regexp_replace(name, '\\.[^.]*$', '') || '_traite_20250701_102030' || regexp_extract(name, '(\\.[^.]*)$', 1) from files where path not in (select path from l)""", "files")
reg("a06_list_folders", lambda t: S.list_folders(t.files, ["1", "3", "7"]),
    "select regexp_extract(folder, '([^/]*)$', 1) as name, folder as full_path, count(*) as files from files where regexp_matches(regexp_extract(folder, '([^/]*)$', 1), '1|3|7') group by 1, 2", "files")
reg("a07_folder_summary", lambda t: S.folder_summary(t.files), """
    with f as (select folder from (select distinct folder from files) order by folder limit 5),
    k as (select *, row_number() over (partition by folder order by path, file_id) as rn from files where folder in (select folder from f))
    select folder, count(*) as sample_files, count(*) filter (where ends_with(lower(name), '.xlsx')) as excel_files, count(*) * 5 as estimated_files,
    (select count(distinct folder) from files) as total_folders from k where rn <= 10 group by 1""", "files")


# ---- round trips: a view is written in the source's form, read back by the operator and compared with the view

def _folder(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _books(t):
    path = _folder(t, "workbooks")
    rows = t.rows.withColumn("path", F.concat(F.col("file_id") % 7, F.lit("/"), "file_id", F.lit(".xlsx")))
    write_workbooks(rows.withColumn("sheet_no", F.substring("sheet", 5, 9).try_cast("int")), path)
    return path


def _file_id():
    return F.regexp_extract("path", r"/(\d+)\.xlsx$", 1).cast("bigint").alias("file_id")


reg("a01_read_workbooks", lambda t: B.read_workbook_rows(t.spark, _books(t)).select(_file_id(), "sheet", "row", "cells", "error"), """
    select file_id::bigint as file_id, sheet, row, cells, null::varchar as error from rows where len(list_filter(cells, lambda c: c <> '')) > 0""", "rows")
reg("a02_list_workbooks", lambda t: S.list_files(t.spark, _books(t)).filter("size > 0").select(_file_id(), "name", S.base_name("folder").alias("folder")), """
    select distinct file_id::bigint as file_id, file_id || '.xlsx' as name, (file_id % 7)::varchar as folder from rows""", "rows")


def _log_files(t):
    path = _folder(t, "logs")
    (t.log_lines.select("file", "line_no", F.col("text").alias("value")).repartition("file").sortWithinPartitions("file", "line_no")
     .select("file", "value").write.partitionBy("file").text(path))
    return P.read_log_lines(t.spark, path).select(F.regexp_extract("file", r"file=([^/]+)", 1).alias("file"), "line_no", "text")


reg("a08_read_log_lines", _log_files, """
    select file, row_number() over (partition by file order by line_no) - 1 as line_no, text from log_lines""", "log_lines")


def _report_files(t):
    path = _folder(t, "reports")
    info = F.struct(F.col("import_status").alias("status"), *[F.col(f"{c}_imported").cast("bigint").alias(f"{c}_imported") for c in ("lots", "sections", "elements")])
    one = F.struct("path", "name", "type", "confidence", info.alias("import_info"))
    folders = (t.report_files.groupBy("report_file", "folder").agg(F.collect_list(one).alias("identified_files"), F.count("*").alias("excel_files"))
               .select("report_file", F.struct(F.col("folder").alias("folder_path"), F.lit("ok").alias("status"), "excel_files", "identified_files").alias("d")))
    (folders.groupBy("report_file").agg(F.collect_list("d").alias("detailed_results"))
     .repartition("report_file").write.partitionBy("report_file").json(path))
    return P.read_run_reports(t.spark, path).select(
        F.regexp_extract(F.url_decode("report_file"), r"report_file=([^/]+)", 1).alias("report_file"), "folder", "status", "excel_files",
        "path", "name", "type", "confidence", "import_status", "lots_imported", "sections_imported", "elements_imported")


reg("a10_read_run_reports", _report_files, """
    select report_file, folder, 'ok' as status, count(*) over (partition by report_file, folder) as excel_files, path, name, type, confidence,
    import_status, lots_imported::bigint as lots_imported, sections_imported::bigint as sections_imported, elements_imported::bigint as elements_imported
    from report_files""", "report_files")


def _errors(t):
    path = _folder(t, "errors")
    bad = t.log_lines.filter("lower(text) rlike 'error|échec'").select(
        F.lit("2024-01-01 10:00:00").alias("timestamp"), F.col("file").alias("filename"), F.col("line_no").cast("int").alias("line_number"),
        F.lit("LogError").alias("error_type"), F.concat(F.lit('"'), "text", F.lit('", suite')).alias("error_message"), F.col("text").alias("raw_data"))
    P.append_errors(bad.filter("line_number % 2 = 0"), path)
    P.append_errors(bad.filter("line_number % 2 = 1"), path)
    return P.read_errors(t.spark, path)


reg("a11_errors_round_trip", _errors, """
    select '2024-01-01 10:00:00' as timestamp, file as filename, line_no::int as line_number, 'LogError' as error_type,
    '"' || text || '", suite' as error_message, text as raw_data from log_lines where regexp_matches(lower(text), 'error|échec')""", "log_lines")


def _identification(t):
    path = _folder(t, "identified")
    P.write_identification_report(t.report_files.select("name", F.col("type").alias("doc_type"), "confidence", "path", "seq"), path, by_type=True)
    return t.spark.read.option("header", "true").option("sep", ";").schema("name string, doc_type string, confidence double, path string, seq bigint").csv(path)


reg("a13_identification_report", _identification,
    "select name, type as doc_type, confidence, path, seq from report_files", "report_files")


def _problems(t):
    path = _folder(t, "problems")
    P.write_problem_report(t.report_files.filter("import_status <> 'success'").select(
        F.col("path").alias("file"), F.col("import_status").alias("problem_type"), F.concat("name", F.lit(" : "), F.col("seq").cast("string")).alias("description")), path)
    return t.spark.read.option("header", "true").csv(path)


reg("a15_problem_report", _problems, """
    select path as file, import_status as problem_type, name || ' : ' || seq as description from report_files where import_status <> 'success'""", "report_files")
