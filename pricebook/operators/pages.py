"""Pages of a large ordering: a stored order index, so that a page far back costs as much as the first.

The rows are written once in ranges of the order (``repartitionByRange`` on the keys, which must end in a unique one) with
the number of rows before each range. A page is found from these numbers: at most the ranges it lies in are read, and
only their rows are sorted. ``offset`` on the whole table would send all skipped rows through one task.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 50_000         # aimed at; a page reads one or two ranges


def write_order_index(df: DataFrame, path: str, order, range_rows=RANGE_ROWS) -> None:
    """Store ``df`` in ranges of ``order`` (columns, the last one unique) and the count of rows before each range."""
    n = max(1, -(-df.count() // range_rows))
    laid = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    laid.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    counts = _rows(df.sparkSession, path).groupBy("_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")         # one row per range
    counts.select("_range", "n", before.alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def _rows(spark, path):
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def ranges_of(spark: SparkSession, path: str, skip: int, limit: int) -> list:
    """(range, rows before it) of the ranges that a page lies in, in order."""
    touched = spark.read.parquet(f"{path}/counts").filter((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip))
    return [(r["_range"], r["before"]) for r in touched.orderBy("_range").collect()]      # two, or limit / range_rows of them


def page_at(spark: SparkSession, path: str, order, skip=0, limit=100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of the order; an empty frame beyond the end."""
    rows, touched = _rows(spark, path), ranges_of(spark, path, skip, limit)
    if not touched:
        return rows.drop("_range").filter("false")
    here = rows.filter(F.col("_range").isin([r for r, _ in touched])).drop("_range")
    return here.orderBy(*order).offset(skip - touched[0][1]).limit(limit)
