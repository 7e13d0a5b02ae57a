"""Versions of a table: folders that never change, and a log that says which of them are whole.

A version is written in full before its entry is put into the log under the next number. The entry appears by one rename that fails
where another has that number, so a run that stops in between leaves a folder that nobody reads, and never half a version. What belongs to
a version (a batch's number, say) is part of its entry. Readers take a version's folders from the log once and stay with them.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "number long, folder string, layouts string, note string, at double"


class Version(NamedTuple):
    """number: from 1, without gaps; folder: its data; layouts: name -> (columns, buckets); note: what the writer said."""

    number: int
    folder: str
    layouts: dict[str, tuple[list[str], int]]
    note: dict
    at: float


class Conflict(RuntimeError):
    """Another writer has committed since ``after`` was read."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return jvm, conf, fs, fs.makeQualified(p)


def history(spark: SparkSession, root: str) -> list[Version]:
    """The versions that the log has, oldest first. It has one small entry a version, up to ``expire``'s horizon."""
    try:
        rows = spark.read.schema(ENTRY).json(f"{root}/log").collect()
    except AnalysisException:
        return []
    found = [Version(r["number"], r["folder"], {k: (v[0], v[1]) for k, v in json.loads(r["layouts"]).items()}, json.loads(r["note"]), r["at"]) for r in rows]
    return sorted(found)


def newest(spark: SparkSession, root: str) -> Version | None:
    found = history(spark, root)
    return found[-1] if found else None


def write_folder(tables: dict[str, tuple[DataFrame, list[str], int]], root: str) -> str:
    """Writes what a version to come consists of: each (rows, columns, buckets) under its name, bucketed by the columns, or plain where there are none."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    for name, (df, columns, buckets) in tables.items():
        if not columns:
            df.write.parquet(f"{folder}/{name}")
            continue
        table = f"writes_{uuid.uuid4().hex}"
        rows = df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns)
        rows.format("parquet").option("path", f"{folder}/{name}").saveAsTable(table)
        df.sparkSession.sql(f"DROP TABLE {table}")  # the files are not the catalogue's and stay
    return folder


def enter(spark: SparkSession, root: str, folder: str, layouts: dict, note: dict, after: int) -> Version:
    """Puts a written folder into the log as version ``after`` + 1; ``Conflict`` where there is one."""
    jvm, conf, fs, log = _files(spark, f"{root}/log")
    fs.mkdirs(log)
    at = time.time()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(log, name)
    draft = path(f"_{uuid.uuid4().hex}")  # readers pass over names with _
    out = fs.create(draft, False)
    entry = {"number": after + 1, "folder": folder, "layouts": json.dumps(layouts), "note": json.dumps(note), "at": at}
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(log.toUri(), conf)
    try:
        context.rename(draft, path(f"{after + 1:020d}.json"), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {after + 1} of {root} is there already") from e
        raise
    return Version(after + 1, folder, layouts, note, at)


def commit_tables(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str], int]], root: str, note: dict | None = None, after: int | None = None) -> Version:
    """Writes ``tables`` as the next version. ``after``: the version it was made from, if another must not have come between."""
    folder = write_folder(tables, root)
    if after is None:
        last = newest(spark, root)
        after = last.number if last else 0
    return enter(spark, root, folder, {k: (list(c), n) for k, (_, c, n) in tables.items()}, note or {}, after)


def commit(df: DataFrame, root: str, layouts: dict[str, tuple[list[str], int]] | None = None, note: dict | None = None, after: int | None = None) -> Version:
    """Writes ``df`` as the next version, once for each layout (columns, buckets); as it is for none. See ``commit_tables``."""
    tables = {name: (df, columns, buckets) for name, (columns, buckets) in (layouts or {"rows": ([], 0)}).items()}
    return commit_tables(df.sparkSession, tables, root, note, after)


def read(spark: SparkSession, version: Version | None, schema: str, layout: str | None = None) -> DataFrame:
    """A version's rows in one of its layouts; an empty table for no version.

    A bucketed layout keeps its partitioning: a join or grouping by its columns does not shuffle these rows.
    """
    kind = StructType.fromDDL(schema)
    if version is None:
        return spark.createDataFrame([], kind)
    layout = layout or next(iter(version.layouts))
    columns, buckets = version.layouts[layout]
    at = f"{version.folder}/{layout}"
    if not columns:
        return spark.read.schema(kind).parquet(at)
    table, ddl, by = f"reads_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}'")
    df = spark.table(table)
    df.schema  # resolved with its files and buckets; the catalogue has done its part
    spark.sql(f"DROP TABLE {table}")
    return df


def expire(spark: SparkSession, root: str, keep: int, older_than: float = 7 * 86_400.0) -> list[int]:
    """Removes versions but the newest ``keep``, if they are older than ``older_than`` seconds (readers may still hold younger ones), and folders of
    that age that no entry names. Entries go before their folders. Returns the numbers removed."""
    if keep < 1:
        raise ValueError("the newest version stays")
    jvm, _, fs, base = _files(spark, root)
    path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((root, *p)))
    found, limit = history(spark, root), time.time() - older_than
    gone = [v for v in found[:-keep] if v.at <= limit]
    for v in gone:
        fs.delete(path("log", f"{v.number:020d}.json"), False)
    named = {v.folder.rsplit("/", 1)[-1] for v in found} - {v.folder.rsplit("/", 1)[-1] for v in gone}
    if fs.exists(path("data")):
        for s in fs.listStatus(path("data")):
            if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= limit:
                fs.delete(s.getPath(), True)
    return [v.number for v in gone]


def last_note(spark: SparkSession, root: str, key: str):
    """The newest version's note of ``key``; None where there is none."""
    last = newest(spark, root)
    return last.note.get(key) if last else None


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: rows of ``new`` that ``old`` lacks (added) or has otherwise (changed), and keys that ``new`` lacks (removed).

    Both may be bucketed by the key, and are then not shuffled. Keys are unique in each.
    """
    digest = lambda df, n: df.select(F.col(key).alias(key), F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias(n))
    both = digest(old, "a").join(digest(new, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")
