"""Building blocks that keep ordered work distributed when one key is hot."""

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricebook.session import checkpoint_dir

ID_BUCKETS = 1024


def scratch_path(spark, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark):
    """Inside, each write removes the shuffle files of its own run when it ends: its result is in the files written."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def write_step(df: DataFrame, path: str, mode="errorifexists") -> None:
    """Write a step's rows to a folder, compact, and leave no shuffle files behind."""
    with freed_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and go on from its files: short lineage, nothing computed twice."""
    path = scratch_path(df.sparkSession, name)
    write_step(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_text(*cols):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in cols])


def hash_id(*cols):
    """60-bit id of a natural key: no shuffle, same value on every retry."""
    return F.conv(F.substring(F.md5(key_text(*cols)), 1, 15), 16, 10).cast("bigint")


def dense_ids(df: DataFrame, keys, start: DataFrame, name="id", buckets=ID_BUCKETS) -> DataFrame:
    """Number rows with distinct ``keys`` from ``max_id + 1`` without one global window.

    Keys are hashed into a fixed number of buckets, rows are numbered inside
    their bucket and shifted by the running count of the buckets before it.
    ``start`` holds one row with the column ``max_id``.
    """
    b = F.pmod(F.conv(F.substring(F.md5(key_text(*keys)), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    df = df.withColumn("_b", b)
    # at most `buckets` rows reach this window
    offsets = (df.groupBy("_b").agg(F.count("*").alias("_n"))
               .withColumn("_off", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))
               .select("_b", "_off"))
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)))
    return (numbered.join(F.broadcast(offsets), "_b").crossJoin(F.broadcast(start))
            .withColumn(name, F.coalesce(F.col("max_id"), F.lit(0)) + F.col("_off") + F.col("_rn"))
            .drop("_b", "_off", "_rn", "max_id"))


def last_rows(df: DataFrame, keys, order, n, rank, buckets=64) -> DataFrame:
    """First ``n`` rows per key in ``order`` with their rank; each of a key's hash buckets is cut to ``n`` rows first."""
    cols = df.columns
    df = df.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))).filter(F.col("_rn") <= n)
    return (df.drop("_b", "_rn").withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(rank) <= n))


def carry_last(df: DataFrame, keys, pos, carried, chunk_rows=65536) -> DataFrame:
    """Last non-null value at or before each row, per key in order of ``pos``.

    ``carried`` maps an output column to the column whose value is carried. A
    key is cut into ranges of ``pos``; each range is scanned on its own, then
    the last values of the earlier ranges (one small row each) fill the head.
    """
    df = df.withColumn("_chunk", F.floor(F.col(pos) / chunk_rows))
    by = list(keys) + ["_chunk"]
    local = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    tails = df.groupBy(*by).agg(*[
        F.max_by(F.col(src), F.when(F.col(src).isNotNull(), F.col(pos))).alias(f"_t_{out}")
        for out, src in carried.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*by, *[F.last(f"_t_{o}", ignorenulls=True).over(before).alias(f"_h_{o}") for o in carried])
    scanned = df
    for out, src in carried.items():
        scanned = scanned.withColumn(f"_l_{out}", F.last(src, ignorenulls=True).over(local))
    joined = scanned.join(tails, by, "left")
    return joined.select(*[c for c in df.columns if c != "_chunk" and c not in carried],
                         *[F.coalesce(f"_l_{o}", f"_h_{o}").alias(o) for o in carried])


def chunked_lists(df: DataFrame, keys, item, order, size=10000) -> DataFrame:
    """Collect structs per key in reading order, in parts of at most ``size`` rows, so no row grows unbounded.

    A key of up to ``size`` rows is one part. The rows of longer ones are laid out in ranges of (key, order). Only the
    counts per key and range are chained; rows are numbered inside their range, so a hot key is never one task.
    """
    laid = df.withColumn("_o", order).withColumn("_item", item).select(*keys, "_o", "_item")
    long = staged(laid.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > size)
                  .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "long-lists")
    is_long = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("_o", "_item"))), lambda x: x["_item"]).alias("items")
    if long.isEmpty():
        return laid.groupBy(*keys).agg(in_order).select(*keys, F.lit(0).alias("part"), "items")
    short = laid.join(long, is_long, "left_anti")               # few keys: Spark knows the size of their file
    parts = _numbered(laid.join(long, is_long, "left_semi"), keys, size)
    return (short.withColumn("part", F.lit(0)).unionByName(parts).groupBy(*keys, "part").agg(in_order))


def _numbered(laid, keys, size):
    laid = staged(laid.repartitionByRange(*keys, "_o").withColumn("_range", F.spark_partition_id()), "chunks")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (laid.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
              .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_o"))
    part = F.floor((F.col("_before") + rank - 1) / size).cast("int")
    return laid.join(counts, same).withColumn("part", part).select(*keys, "_o", "_item", "part")
