"""Reading and writing catalogues and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from . import versions


def read_json_table(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON file of documents; with ``field``, of that array inside it. A missing or malformed file has none."""
    inner = StructType.fromDDL(schema)
    outer = StructType.fromDDL(f"`{field}` array<{inner.simpleString()}>") if field else inner
    try:
        raw = spark.read.schema(outer).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        return raw.select(F.explode(field).alias("r")).select("r.*") if field else raw
    except AnalysisException:
        return spark.createDataFrame([], inner)


def read_catalogue(spark: SparkSession, path: str, forms: str, leaflets: str) -> tuple[DataFrame, DataFrame]:
    return read_json_table(spark, path, forms, "forms"), read_json_table(spark, path, leaflets, "leaflets")


def write_snapshot(df: DataFrame, root: str) -> int:
    """Commits ``df`` as a new version under ``root``; the version being read is never overwritten. Returns its number."""
    return versions.commit(df, root).number


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version; an empty table where there is none."""
    return versions.read(spark, versions.newest(spark, root), schema)


def export_csv(df: DataFrame, path: str) -> None:
    """Header, every field quoted, quotes doubled, nulls as \"\", lines ended by CR LF."""
    texts = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    texts.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """line: the rows as they stand in such a file."""
    return df.select(F.array_join(F.array(*[F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]), ",").alias("line"))


def ingest_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, sha256, is_pdf of the files under ``path``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), F.startswith(F.col("content"), F.encode(F.lit("%PDF"), "UTF-8")).alias("is_pdf"))


def run_report(stats: DataFrame, gaps: DataFrame, removed: DataFrame) -> DataFrame:
    """section, source, line_ord, line: the report of a run, as rows. Lines are numbered within a section and source (of
    gaps: within the first two characters of the id), so that no section is one task's work; read it by section, source and number."""
    from pyspark.sql import Window

    rows = stats.select(F.lit(1).alias("section"), "source", F.format_string("%s: %d listed, %d added, %d updated, %d removed", "source", "listed", "added", "updated", "removed").alias("line"))
    rows = rows.unionByName(gaps.select(F.lit(2).alias("section"), F.substring("id", 1, 2).alias("source"), F.concat_ws(": ", "id", "gaps").alias("line")))
    rows = rows.unionByName(removed.select(F.lit(3).alias("section"), "source", F.concat(F.lit("removed "), "id").alias("line")))
    nth = F.row_number().over(Window.partitionBy("section", "source").orderBy("line"))
    return rows.select("section", "source", nth.alias("line_ord"), "line")
