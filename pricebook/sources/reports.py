"""Logs, run reports and error tables in; identification, quality and problem reports out."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ERROR_SCHEMA = "timestamp string, filename string, line_number int, error_type string, error_message string, raw_data string"
REPORT_SCHEMA = """metadata struct<generated_at:string,version:string>,
    statistics struct<folders_processed:bigint,total_files_found:bigint,total_identified_files:bigint,total_imported_files:bigint>,
    session_summary struct<total_folders_scanned:bigint,total_files_found:bigint,successful_imports:bigint,technical_imports:bigint,failed_imports:bigint>,
    detailed_results array<struct<folder_path:string,folder_name:string,status:string,files_found:bigint,excel_files:bigint,
        identified_files:array<struct<path:string,name:string,type:string,confidence:double,
            import_info:struct<status:string,lots_imported:bigint,sections_imported:bigint,elements_imported:bigint,error:string>>>>>"""


def read_log_lines(spark, path) -> DataFrame:
    """Lines of log files with their 0-based number.

    Large files are read in splits: lines are numbered inside their split and
    shifted by the line counts of the splits before it, so no file has to fit
    one task.
    """
    t = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_replace("value", "\r$", "").alias("text"), F.monotonically_increasing_id().alias("_m"))
    counts = t.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block")           # one row per split
    offsets = counts.select("file", "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_m"))
    return (t.withColumn("_rn", local).join(offsets, ["file", "_block"])
            .select("file", (F.col("_off") + F.col("_rn") - 1).alias("line_no"), "text",
                    F.try_to_timestamp(F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1)).alias("ts")))


def read_run_reports(spark, path) -> DataFrame:
    """One row per identified file of every run report; folders without files keep one row."""
    r = (spark.read.schema(REPORT_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
         .withColumn("report_file", F.input_file_name()))
    f = r.select("report_file", F.explode_outer("detailed_results").alias("d"))
    return f.select("report_file", F.col("d.folder_path").alias("folder"), "d.status", "d.files_found", "d.excel_files",
                    F.explode_outer("d.identified_files").alias("i")).select(
        "report_file", "folder", "status", "files_found", "excel_files", "i.path", "i.name", "i.type", "i.confidence",
        F.coalesce("i.import_info.status", F.lit("unknown")).alias("import_status"), "i.import_info.lots_imported",
        "i.import_info.sections_imported", "i.import_info.elements_imported", "i.import_info.error")


def read_errors(spark, path):
    return spark.read.schema(ERROR_SCHEMA).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def append_errors(df, path):
    cols = [c.split()[0] for c in ERROR_SCHEMA.split(", ")]
    df.select(*cols).write.mode("append").option("header", "true").option("escape", '"').csv(path)


def _write(df, path, fmt, sep=","):
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").option("sep", sep).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        df.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")
                  ).write.mode("overwrite").text(path)


def write_identification_report(df, path, fmt="csv", by_type=False):
    """Identified files, best confidence first (or by type, with ``;``)."""
    order = [F.asc("doc_type"), F.desc("confidence")] if by_type else [F.desc("confidence")]
    flat = df.select(*[c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))])
    _write(flat.orderBy(*order, "name"), path, fmt, ";" if by_type else ",")


def write_quality_report(summary, problems, path, fmt="json"):
    """Summary and problem rows side by side; nested issues stay nested in JSON, else as text."""
    if fmt != "json":
        problems = problems.withColumn("problems", F.to_json("problems"))
    _write(summary, f"{path}/summary", fmt)
    _write(problems, f"{path}/problems", fmt)


def write_problem_report(df, path):
    _write(df.select("file", "problem_type", "description").orderBy("file", "problem_type"), path, "csv")
