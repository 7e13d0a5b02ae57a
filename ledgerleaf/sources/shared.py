"""What operators write between steps, and sides small enough for every executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Only a local master may do without: it gets a temporary one."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir"):
        return at
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def kept(df: DataFrame) -> DataFrame:
    """``df`` made once and written to the shared folder: later steps read it, and a lost executor costs no earlier work."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *by: str, times: int = 4) -> DataFrame:
    """``df``, dealt by the columns ``by`` into ``times`` tasks a core: Spark splits files by bytes, and a small file of many short rows would keep one task busy."""
    return df.repartition(times * df.sparkSession.sparkContext.defaultParallelism, *by)


#: Bytes of text a task is to have: what is sorted of them, many times as large, fits into a task's memory.
TASK_BYTES = 4_000_000


def spread_texts(df: DataFrame, text: str, *by: str) -> DataFrame:
    """``df``, dealt by the columns ``by`` into tasks of about ``TASK_BYTES`` of ``text`` each, eight a core at least: more text makes more tasks, not larger ones."""
    n = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(8 * df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_BYTES)), *by)


def small(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``df``, kept and counted: for a broadcast up to ``most`` rows, beyond that for a join by shuffle."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= most else df
