"""Queries over files and streams. They write into a new folder of the shared checkpoint directory."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sync as S
from ..sources import files, versions
from ..sources.shared import shared_folder
from ..streaming import streams
from . import records, syncing
from .tables import table


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def catalogue_roundtrip(spark, sf_dir):
    at = _scratch(spark)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("keys"))
    files.write_snapshot(p.limit(0), at)
    files.write_snapshot(p, at)
    return files.read_snapshot(spark, at, "id long, title string, keys array<string>").select("id", "title", F.array_join("keys", "|").alias("keys"))


def csv_roundtrip(spark, sf_dir):
    at = _scratch(spark)
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit('say "hi", '), "c_name").alias("t"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("s"))
    files.export_csv(d, at)
    return spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(at).select(F.col("k").cast("long").alias("k"), "t", F.coalesce("s", F.lit("")).alias("s"))


def csv_lines(spark, sf_dir):
    return files.csv_lines(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name").alias("n")))


def binary_digest(spark, sf_dir):
    """Files of ten pages' addresses each, of which every third begins as a PDF file does."""
    at = _scratch(spark)
    k = F.floor(F.col("page_id") / 10)
    p = table(spark, sf_dir, "pages").select(k.alias("k"), "page_id", F.when((k % 3 == 0) & (F.col("page_id") % 10 == 0), F.concat(F.lit("%PDF-1.7 "), "url")).otherwise(F.col("url")).alias("line"))
    p.repartition("k").sortWithinPartitions("k", "page_id").select("k", "line").write.partitionBy("k").text(at)
    f = files.ingest_binary(spark, at, "part-*")
    return f.select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"), "length", "sha256", "is_pdf")


def run_report(spark, sf_dir):
    now, prev = syncing._snapshots(spark, sf_dir)
    out = S.sync(now, prev, F.expr(syncing.TODAY))
    return files.run_report(S.run_stats(out, prev, now), syncing.sync_gaps(spark, sf_dir).withColumn("id", F.col("id").cast("string")), S.removed_rows(prev, out))


def catalogue_read(spark, sf_dir):
    """Catalogue files of two lists each, one document a file, read as two tables."""
    at = _scratch(spark)
    p = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 50).alias("file"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")).alias("f"))
    both = p.groupBy("file").agg(F.collect_list("f").alias("forms"), F.collect_list(F.struct(F.col("f.id").alias("id"))).alias("leaflets"))
    both.write.partitionBy("file").json(at)  # a document a file
    forms, leaflets = files.read_catalogue(spark, at, "id long, title string", "id long")
    none = files.read_json_table(spark, f"{at}/no-such-file", "id long, title string", "forms")
    return forms.join(leaflets, "id").unionByName(none)


def stream_sync(spark, sf_dir):
    """Two listings arrive one after the other, the second without some sources; the snapshot after both."""
    at = _scratch(spark)
    now, prev = syncing._snapshots(spark, sf_dir)
    first = prev.select(F.row_number().over(Window.partitionBy("source").orderBy("id")).alias("ord"), "source", "title", "group", "url", "sha", F.lit(None).cast("string").alias("error"), F.lit(True).alias("file_present"))
    for part in (first, now.filter("source <> 'src5'").select(*first.columns)):
        part.write.mode("append").parquet(f"{at}/in")
        streams.sync_stream(spark, f"{at}/in", f"{at}/state", F.expr(syncing.TODAY)).awaitTermination()
    out = S.stored(spark, versions.newest(spark, f"{at}/state/catalogue")).by_id
    return out.select("source", F.regexp_extract("url", "([0-9]+)(-moved)?$", 1).cast("long").alias("doc_id"), "sha", "updated")


def sync_stored(spark, sf_dir):
    """The previous listing committed as version 1, read back by its layouts, synchronised, and the result committed as version 2."""
    at = _scratch(spark)
    now, prev = syncing._snapshots(spark, sf_dir)
    one = S.store(prev, at)
    two = S.store(S.next_rows(S.sync(now, S.stored(spark, one), F.expr(syncing.TODAY))), at, after=one.number)
    return S.stored(spark, two).by_url.select("id", "source", "sha", "updated")


def version_changes(spark, sf_dir):
    """What one version of a snapshot has otherwise than the one before, by id."""
    at = _scratch(spark)
    now, prev = syncing._snapshots(spark, sf_dir)
    one = S.store(prev, at)
    two = S.store(S.next_rows(S.sync(now, prev, F.expr(syncing.TODAY))), at, after=one.number)
    return versions.changes(S.stored(spark, one).by_id.select("id", "source", "sha", "updated"), S.stored(spark, two).by_id.select("id", "source", "sha", "updated"), "id")


def stream_extract(spark, sf_dir):
    at = _scratch(spark)
    records._notes(spark, sf_dir).write.parquet(f"{at}/in")
    streams.extract_stream(spark, f"{at}/in", f"{at}/out", F.expr(records.AS_OF)).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("note_id", "surname", "forenames", "dob", "nhs", "mrn", "sex")


QUERIES = {f.__name__: f for f in (catalogue_roundtrip, catalogue_read, csv_roundtrip, csv_lines, binary_digest, run_report, sync_stored, version_changes, stream_sync, stream_extract)}
ORACLE = {
    "catalogue_roundtrip": "SELECT p_partkey AS id, p_name AS title, p_brand || '|' || p_type AS keys FROM part",
    "binary_digest": """SELECT k, strlen(t) AS length, sha256(t) AS sha256, starts_with(t, '%PDF') AS is_pdf FROM (
        SELECT page_id // 10 AS k, string_agg(CASE WHEN page_id % 30 = 0 THEN '%PDF-1.7 ' || url ELSE url END || chr(10), '' ORDER BY page_id) AS t FROM pages GROUP BY 1)""",
    "catalogue_read": "SELECT s_suppkey AS id, s_name AS title FROM supplier",
    "csv_roundtrip": "SELECT c_custkey AS k, 'say \"hi\", ' || c_name AS t, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS s FROM customer",
    "csv_lines": "SELECT '\"' || c_custkey || '\",\"\"\"' || c_name || '\"' AS line FROM customer",
    # the first listing is all new; of the second, src5 is missing and so stays as it was
    "stream_sync": f"""WITH {syncing._SNAP} SELECT source, doc_id, sha, CASE change WHEN 'held' THEN {syncing.TODAY} ELSE coalesce(nullif(updated, DATE '2024-01-01'), {syncing.TODAY}) END AS updated
        FROM c WHERE kept AND source <> 'src5' UNION ALL SELECT source, doc_id, sha, {syncing.TODAY} FROM prev WHERE source = 'src5'""",
    "run_report": f"""WITH {syncing._SNAP}, {syncing._STATS}, r AS (
        SELECT 1 AS section, source, source || ': ' || listed || ' listed, ' || added || ' added, ' || updated || ' updated, ' || removed || ' removed' AS line FROM st
        UNION ALL SELECT 2, substr(id::VARCHAR, 1, 2), id || ': ' || gaps FROM ({syncing.ORACLE['sync_gaps']})
        UNION ALL SELECT 3, source, 'removed ' || id FROM prev WHERE id NOT IN (SELECT id FROM c WHERE kept))
        SELECT section, source, cast(row_number() OVER (PARTITION BY section, source ORDER BY line) AS INT) AS line_ord, line FROM r""",
    "sync_stored": f"WITH {syncing._SNAP} SELECT id, source, sha, updated FROM c WHERE kept",
    "version_changes": f"""WITH {syncing._SNAP}, k AS (SELECT * FROM c WHERE kept) SELECT coalesce(p.id, k.id) AS id,
        CASE WHEN p.id IS NULL THEN 'added' WHEN k.id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM prev p FULL JOIN k ON p.id = k.id WHERE p.id IS NULL OR k.id IS NULL OR k.sha <> p.sha OR k.updated <> DATE '2024-01-01'""",
    "stream_extract": records.ORACLE["id_extract"],
}
