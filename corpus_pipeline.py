"""The training-data pipeline: four filters over ``documents``, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import decontaminate, linededup, packing, quality, simhash
from ledgerleaf.llm.common import shared_folder
from ledgerleaf.plans.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject; trusted are those labelled of quality 1.

    Null and empty texts stay, and all where nothing is trusted; equal rows fare alike, also without an id. No documents
    give none; extra columns stay as they are, whatever their names.
    """
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.accepted(docs, quality.classify(docs, trusted))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold too; n_chars follows the text. No document goes.

    Null texts stay null, documents without an id and repeated rows stay, rows that repeat an id count as one
    holder. No documents give none; extra columns stay as they are, whatever their names.
    """
    into = next(c for c in ("line_dedup", *(f"line_dedup_{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    kept = linededup.apply_bitmaps(linededup.dedup_lines(docs, into=into), of=into)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more): the smallest id.

    Documents without an id stay only where their group has none with one; of equal rows one stays. Null, empty
    and blank texts are copies of each other. No documents give none; extra columns stay as they are.
    """
    return simhash.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, neither as it stands nor with other names and numbers.

    Null and empty texts hold none; repeated rows and rows without an id are judged each by their text. No documents
    give none, an empty benchmark takes none away; extra columns stay as they are.
    """
    return decontaminate.without_leaks(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens; a null or empty text is its end id alone.

    Repeated rows and rows without an id are packed each. No documents give no pieces; extra columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results between stages go to the shared folder of ``spark.checkpoint.dir``."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
