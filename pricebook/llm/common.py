"""Helpers shared by the operators: word splitting, barriers and tables in the shared folder."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# what stands between words: everything ASCII but digits and (lower-case) letters; or white space alone
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, UPPER, LOWER)


def alnum_words(col):
    """Lower-cased words of digits, letters and non-ASCII characters; a null text has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(col), F.lit("")), NOT_ALNUM), "")


def space_words(col):
    """Words between ASCII white space, case kept; a null text has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE), "")


def row_key(*cols):
    """128 bits from a row's content, equal on every attempt and in every branch of a plan."""
    return F.struct(F.xxhash64(*cols, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def computed(df: DataFrame, *cols) -> DataFrame:
    """Keep what stands above from being pushed below the given columns, so that each is evaluated once."""
    for c in cols:
        df = df.select(*[x for x in df.columns if x != c], F.explode_outer(F.array(c)).alias(c))
    return df


def scratch(spark, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from its files, not from its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
