"""The same work on arriving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_identifiers
from ..operators import sync as S
from ..sources import versions

LISTING = "ord int, source string, title string, `group` string, url string, sha string, error string, file_present boolean"
SNAPSHOT = S.STORED


def sync_stream(spark: SparkSession, source_dir: str, state_dir: str, today: Column, buckets: int = 8, keep: int = 10):
    """Listings that arrive as Parquet files are synchronised with the newest snapshot; each batch commits the next.

    The batch's number is part of the version's entry in the log, so snapshot and number appear together or not at all: a
    batch that was committed is passed over, one that stopped before is done again from the same version. Sources that a batch does
    not list, or lists too short, keep their rows. Versions beyond the newest ``keep`` go after a week.
    """
    at = f"{state_dir}/catalogue"

    def batch(df: DataFrame, number: int) -> None:
        last = versions.newest(spark, at)
        if last and last.note.get("batch", -1) >= number:
            return
        rows = S.next_rows(S.sync(df, S.stored(spark, last), today))
        S.store(rows, at, buckets, {"batch": number}, last.number if last else 0)
        versions.expire(spark, at, keep)

    stream = spark.readStream.schema(LISTING).parquet(source_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()


def extract_stream(spark: SparkSession, notes_dir: str, out_dir: str, as_of: Column):
    """Identifiers of notes (note_id, source, text) as they arrive, appended as Parquet."""
    notes = spark.readStream.schema("note_id long, source string, text string").parquet(notes_dir)
    return extract_identifiers(notes, as_of).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", f"{out_dir}-checkpoint").trigger(availableNow=True).start()
