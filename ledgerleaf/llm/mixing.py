"""A mix of sources to target weights, in an order of training that follows each source's schedule."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WS, counted, reliable, shuffle_partitions

#: How a source's weight goes over the time of training, 0 to 1: (time, factor) knots, straight between. One for each of the weights.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def n_words(col: Column) -> Column:
    """Runs of characters that are no white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(col, f"[{WS}]+"), lambda x: x != "")), F.lit(0)).cast("long")


def running_sums(df: DataFrame, group: list[str], value: str, order: list, into: str = "before", rows_each: int = 1_000_000) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over the rows that stand before a row in its group, by ``order``.

    Rows are range-partitioned by group and order, so a group of a third of all rows goes over many partitions. Each
    partition adds up as it streams; what earlier partitions hold of a group is added afterwards, from one row for each
    partition and group. Rows that tie in all of ``order`` stand in any order. ``value`` is a long without nulls; null groups are one.
    """
    df = reliable(df)  # else the sample for the ranges makes it once more
    parts = max(shuffle_partitions(df.sparkSession), -(-df.count() // rows_each))
    names = [f"__g{k}" for k in range(len(group))]
    ranged = df.withColumns({n: F.xxhash64(F.col(g).isNull(), g) for n, g in zip(names, group, strict=True)})
    ranged = ranged.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order).withColumn("__part", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, *StructType.fromDDL(f"`{into}` long").fields])
    out, at = to_arrow_schema(schema), ranged.columns.index(value)
    keys = [ranged.columns.index(n) for n in names]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], 1) if keys else np.zeros((b.num_rows, 1), np.int64)
            v = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.ones(len(v), bool)
            new[1:] = (k[1:] != k[:-1]).any(1)
            new[0] = held is None or tuple(k[0]) != held
            before = np.cumsum(v) - v
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1  # -1: goes on from the batch before
            before = np.where(run < 0, before + total, before - before[starts[run]] if len(starts) else before)
            held, total = tuple(k[-1]), int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], schema=out)

    laid = reliable(ranged.mapInArrow(add_up, schema))
    each = laid.groupBy("__part", *names).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if names else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    each = counted(each.select("__part", *names, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier")))
    return laid.join(each, ["__part", *names]).withColumn(into, F.col(into) + F.col("__earlier")).select(*df.columns, into)


def fair_level(sources: DataFrame, words: float) -> float:
    """The level L at which min(L * weight, cap) of all sources add up to ``words``.

    Starts with every source open and reshares what capped ones leave until none is above its cap. Each
    round is one sum over ``sources`` (weight, cap); only the level comes back. It rises from round to round, so the rounds end.
    """
    level = 0.0
    while True:
        full = F.lit(level) * F.col("weight") > F.col("cap")
        r = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not r["weight"]:
            return level
        if (after := (words - r["cap"]) / r["weight"]) <= level:
            return level
        level = after


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the weight through ``knots`` reaches ``share`` of its whole."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or min(w for _, w in knots) < 0:
        raise ValueError("knots rise in time from 0 to 1 and are not below 0")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    if not (whole := sum(areas)):
        raise ValueError("a schedule without weight")
    need, done, out = share * F.lit(whole), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        rest = F.greatest(need - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest, F.lit(0.0)))
        at = F.least(F.lit(t0) + F.when(rest > 0, 2 * rest / (F.lit(w0) + root)).otherwise(0.0), F.lit(t1))
        done += area
        out = F.when(need <= F.lit(done), at) if out is None else out.when(need <= F.lit(done), at)
    return out.otherwise(F.lit(1.0))


def mix(
    df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shapes: Sequence = SHAPES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken, pieces array<struct<copy, words, position>>.

    Sources by code point, null last, have ``weights`` in turn (so many times, and ``shapes`` likewise) and share ``share`` times
    all words; a target stops at ``most`` times its source's size and what is over is reshared by weight. A source's
    documents stand in a fixed order of hashes, laid end to end again and again; those before the target are taken,
    and the one that crosses it is cut there, so the words taken are the target, rounded. A piece's position (0 to 1) is the time
    at which the source's schedule has asked for the words up to its middle. Sizes are in words (``n_words``).

    Null and empty texts have size 0 and are not taken. Equal rows are documents of their own, in either order; null
    ids too. Without documents or words nothing is taken. Other columns are ignored, whatever their names. Two runs over equal rows give equal results.
    """
    small = df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("size"),
        F.xxhash64(F.lit("mix"), F.col(id_col).cast("string"), text_col).alias("dealt"),
    )
    laid = running_sums(small, ["source"], "size", ["dealt", "id"], "start")
    each = reliable(laid.groupBy("source").agg(F.sum("size").alias("source_size")))
    nth = running_sums(each.withColumn("one", F.lit(1).cast("long")), [], "one", [F.col("source").asc_nulls_last()], "nth")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("nth") % len(xs) + 1).cast("int"))
    each = reliable(nth.select("source", "source_size", pick([float(w) for w in weights]).alias("weight"), pick(list(range(len(shapes)))).alias("shape"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    words = share * float(each.agg(F.sum("source_size")).first()[0] or 0)
    each = each.withColumn("target", F.least(F.lit(fair_level(each, words)) * F.col("weight"), F.col("cap"))).withColumn("goal", F.round("target").cast("long"))
    told = counted(each.select(F.col("source").alias("of"), "source_size", "target", "goal", "shape"))
    rows = laid.join(told, F.col("source").eqNullSafe(F.col("of")))

    def piece(k: int) -> Column:
        begin = F.col("start") + F.lit(k) * F.col("source_size")
        got = F.greatest(F.least(F.col("size"), F.col("goal") - begin), F.lit(0))
        middle = (begin + got / F.lit(2.0)) / F.greatest(F.col("goal"), F.lit(1))
        at = F.coalesce(*[F.when(F.col("shape") == s, time_of(middle, knots)) for s, knots in enumerate(shapes)])
        return F.when(got > 0, F.struct(F.lit(k).alias("copy"), got.cast("long").alias("words"), at.alias("position")))

    pieces = F.array_compact(F.array(*[piece(k) for k in range(-int(-most // 1))]))
    rows = rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", pieces.alias("pieces"))
    return rows.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]))


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces of ``mix``'s rows in the order of training: id, copy, words, position; range-partitioned and sorted by position.

    Pieces of one position stand by id and copy. Rows that take nothing have no piece.
    """
    return mixed.select(id_col, F.inline("pieces")).orderBy("position", id_col, "copy")
