"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the contracts: space and TAB to CR.
WS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no earlier work.

    The folder is the one of ``shared_folder``.
    """
    sc: SparkContext = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Only a local master, whose executors are
    the driver, may do without: it gets a temporary one. Anywhere else a missing setting is an error."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased; all other characters stay."""
    return F.translate(col, UPPER, LOWER)


def per_text(
    df: DataFrame, fn: Callable[[object, str], list[tuple]], schema: StructType, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows that ``fn(id, text)`` returns for each row, through Arrow batches. A null text counts as empty."""
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += fn(key, text or "")
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def with_id_type(df: DataFrame, rest: str, id_col: str = "doc_id") -> StructType:
    """The schema of ``id_col`` as in ``df``, followed by the columns of the DDL string ``rest``."""
    return StructType([df.schema[id_col], *StructType.fromDDL(rest).fields])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def counted(df: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """``df``, kept; to be broadcast if it has up to ``most_rows`` rows, else joined by shuffle."""
    df = reliable(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def known(df: DataFrame, ids: DataFrame, on: str, most: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``. ``ids`` is counted first: up to ``most`` rows are broadcast,
    beyond that both sides are shuffled."""
    ids = ids.select(on).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, on, "left_semi")


def give_back() -> None:
    """Free memory goes back to the system, so that a worker's peaks do not add up beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)
