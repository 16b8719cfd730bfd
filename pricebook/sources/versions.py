"""Versions of a warehouse: one commit file names the Parquet folders that make up every table.

Writers put new folders next to the old ones and publish all of them with one file, ``_commits/<number>.json``, which
only one writer can create. Readers see the tables of the newest commit, whole. A writer that loses the race reads the
newer version and does its work again. A commit can carry the number of a stream's batch, so that a batch that comes
again after a restart is known.

Needs a file system on which renaming onto an existing file fails (HDFS and the like); on a local one a hard link does it.
"""

import json
import os
import re
import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"
MANY = 64                   # folders of a table after which a writer should put it together


class Version(NamedTuple):
    number: int             # 0: nothing committed yet
    tables: dict            # table -> part -> folders below the warehouse
    batches: dict           # stream -> last batch loaded


def _fs(spark, path):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark, warehouse):
    fs, p = _fs(spark, f"{warehouse}/{COMMITS}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))


def _file(warehouse, number):
    return f"{warehouse}/{COMMITS}/{number:012d}.json"


def version(spark: SparkSession, warehouse, number=None) -> Version:
    """The newest version, or the one with a number."""
    if number is None:
        number = max(_numbers(spark, warehouse), default=0)
    if number == 0:
        return Version(0, {}, {})
    text = spark.read.option("wholetext", "true").text(_file(warehouse, number)).first()[0]
    state = json.loads(text)
    return Version(number, state["tables"], state["batches"])


def commit(spark, warehouse, base: Version, tables: dict, batches: dict | None = None) -> Version | None:
    """Publish new folders on top of a version; None if another writer has published the next version already."""
    new = Version(base.number + 1, {**base.tables, **tables}, {**base.batches, **(batches or {})})
    fs, target = _fs(spark, _file(warehouse, new.number))
    fs.mkdirs(target.getParent())
    _, held = _fs(spark, f"{warehouse}/{COMMITS}/.{uuid.uuid4().hex}")
    out = fs.create(held, False)
    out.write(json.dumps({"tables": new.tables, "batches": new.batches}).encode())
    out.close()
    try:
        if fs.getUri().getScheme() == "file":           # here a rename would replace the other writer's file
            os.link(held.toUri().getPath(), target.toUri().getPath())
            done = True
        else:
            done = fs.rename(held, target)
    except FileExistsError:
        done = False
    fs.delete(held, False)
    return new if done else None


def folders(v: Version, name) -> list:
    return [f for part in v.tables.get(name, {}).values() for f in part]


def read(spark, warehouse, v: Version, name, schema, parts=None) -> DataFrame:
    """A table of a version, or some of its parts; empty where nothing is stored."""
    of = v.tables.get(name, {})
    paths = [f"{warehouse}/{f}" for k in (of if parts is None else parts) for f in of.get(k, [])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def unused(spark, warehouse, keep=10, hours=24.0) -> list:
    """Folders that none of the last ``keep`` versions names and that are older than a running import can be."""
    named = {f.split("/bucket=")[0] for n in _numbers(spark, warehouse)[-keep:] for t in version(spark, warehouse, n).tables.values()
             for part in t.values() for f in part}
    fs, root = _fs(spark, warehouse)
    out = []
    for table in fs.listStatus(root) if fs.exists(root) else []:
        if table.isDirectory() and not table.getPath().getName().startswith("_"):
            for s in fs.listStatus(table.getPath()):
                rel = f"{table.getPath().getName()}/{s.getPath().getName()}"
                if rel not in named and s.getModificationTime() < (time.time() - hours * 3600) * 1000:
                    out.append(rel)
    return sorted(out)


def remove_unused(spark, warehouse, keep=10, hours=24.0) -> list:
    gone = unused(spark, warehouse, keep, hours)
    for f in gone:
        fs, p = _fs(spark, f"{warehouse}/{f}")
        fs.delete(p, True)
    return gone
