"""File listings: inventory, rules, increments, ledger, folders."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.functions.text import any_word, one_of
from pricebook.operators.scale import hash_id

# Listing rules.
RULES = {"extensions": (".xlsx", ".xls", ".xlsm"), "min_kb": 10, "max_mb": 100,
         "required": ("DPGF", "BPU", "DQE", "LOT"), "excluded": ("TEMPLATE", "EXEMPLE", "TEST")}


def base_name(path="path"):
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def list_files(spark, path, exts=RULES["extensions"], exclude_dirs=(), max_files=None) -> DataFrame:
    """Recursive listing; the content column is never read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
          .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")))
    df = df.filter(F.lower("path").rlike(one_of(exts) + "$"))
    if exclude_dirs:
        df = df.filter(~F.lower("path").rlike("/" + one_of([d.lower() for d in exclude_dirs]) + "/"))
    df = df.withColumn("name", base_name()).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    df = df.withColumn("file_id", hash_id("path"))
    return df.orderBy("path").limit(max_files) if max_files else df


def filter_files(files: DataFrame, rules=RULES) -> DataFrame:
    upper = F.upper("name")
    return files.filter(
        F.lower("name").rlike(one_of(rules["extensions"]) + "$")
        & F.col("size").between(rules["min_kb"] * 1024, rules["max_mb"] * 1024 * 1024)
        & upper.rlike(any_word(rules["required"])) & ~upper.rlike(any_word(rules["excluded"])))


def new_files(files, since, exts=(".xlsx", ".xls")):
    return files.filter((F.col("modified") >= F.lit(since).cast("timestamp")) & F.lower("name").rlike(one_of(exts) + "$"))


def pending_files(files, ledger):
    return files.join(ledger.select("path"), "path", "left_anti")


def mark_processed(files, ledger, at):
    """Ledger with the given files added under their dated name."""
    stamp = F.date_format(F.lit(at).cast("timestamp"), "yyyyMMdd_HHmmss")
    done = files.select("path", F.concat(
        F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_traite_"), stamp, F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("processed_name"))
    return ledger.unionByName(done.join(ledger.select("path"), "path", "left_anti").dropDuplicates(["path"]), allowMissingColumns=True)


def list_folders(files, filters=None):
    """Folders with their name, full path and number of files; names may be filtered by words."""
    f = files.groupBy("folder").agg(F.count("*").alias("files")).withColumn("name", base_name("folder"))
    if filters:
        f = f.filter(F.lower("name").rlike(any_word([x.lower() for x in filters])))
    return f.select("name", F.col("folder").alias("full_path"), "files")


def folder_summary(files, sample=5, first=10, exts=RULES["extensions"]):
    """First folders by name: listed files (at most ``first``), workbooks among them, estimate."""
    n = files.select("folder").distinct().agg(F.count("*").alias("total_folders"))
    folders = files.select("folder").distinct().orderBy("folder").limit(sample)
    w = Window.partitionBy("folder").orderBy("path", "file_id")
    s = (files.join(F.broadcast(folders), "folder").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first)
         .groupBy("folder").agg(F.count("*").alias("sample_files"),
                                F.count_if(F.lower("name").rlike(one_of(exts) + "$")).alias("excel_files")))
    return s.withColumn("estimated_files", F.col("sample_files") * 5).crossJoin(F.broadcast(n))
