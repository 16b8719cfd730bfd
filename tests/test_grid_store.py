"""The stored grid: rows of the SQL view, laid out in buckets of whole sheets."""

import datetime

import duckdb
from pyspark.sql import functions as F

from pricebook.plans.fixtures import Tables, oracle

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_rows_by_sheet_without_a_shuffle(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    parts = [(1, "red bolt", "Brand#1", "LARGE", 3), (2, "old ring", "Brand#13", "LARGE", 4), (3, "hot rod", "Brand#2", "STANDARD", 6),
             (4, "cold rod", "Brand#3", "UNKNOWN", 7), (5, "big gear", "Brand#14", "SMALL", 1)]
    lines = [(k % 9, k % 5 + 1, k % 4, k % 8, float(k % 3 + 1), 10.5 + k, "ANR"[k % 3], "OF"[k % 2], day) for k in range(200)]
    tables = {"part": spark.createDataFrame(parts, PARTS), "lineitem": spark.createDataFrame(lines, LINES),
              "supplier": spark.createDataFrame([(k, k) for k in range(4)], "s_suppkey long, s_nationkey int"),
              "nation": spark.createDataFrame([(k, f"N{k}") for k in range(4)], "n_nationkey int, n_name string")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rows = Tables(spark, str(tmp_path)).rows
    want = con.execute(oracle("select file_id, sheet, row, cells from rows", "rows")).fetchall()
    assert sorted(map(repr, ((*r[:3], list(r[3])) for r in rows.collect()))) == sorted(map(repr, ((*r[:3], list(r[3])) for r in want)))
    sheets = rows.groupBy("file_id", "sheet").agg(F.max("row"))
    assert "Exchange" not in sheets._jdf.queryExecution().executedPlan().toString()
