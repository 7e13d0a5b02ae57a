"""Running sums and numbers within groups of any size, and folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept, small


def running_sum(df: DataFrame, group: list[str], value: str, order: list, into: str, most: int = 1_000_000) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over the rows before a row in its group, by ``order``, whose rows do not tie.

    Where no group has more than ``most`` rows, a window by group. Beyond that rows are range-partitioned by group and order, a
    window adds up by group and range, and what earlier ranges of the group hold is added: one row a range and group. Null groups are one.
    """
    df = kept(df)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    span = lambda by, on: F.coalesce(F.sum(value).over(before.partitionBy(*by).orderBy(*on)), F.lit(0)).cast("long")
    n, largest = df.groupBy(*group).count().agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) <= most:
        return df.withColumn(into, span(group, order))
    laid = kept(df.repartitionByRange(-(-n // most) * 2, *group, *order).withColumn("__range", F.spark_partition_id()))
    laid = laid.withColumn(into, span([*group, "__range"], order))
    each = laid.groupBy(*group, "__range").agg(F.sum(value).alias("__sum"))
    whole = F.coalesce(F.sum("__sum").over(before.partitionBy(*group).orderBy("__range")), F.lit(0))
    each = small(each.select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("__range").alias("__at"), whole.alias("__earlier")))
    same = [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in group]
    on = F.col("__range") == F.col("__at")
    for s in same:
        on = on & s
    return laid.join(each, on).withColumn(into, F.col(into) + F.col("__earlier")).select(*df.columns, into)


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], of: str, block: int = 16) -> Column:
    """An array with a value, of the type ``of``, for each of ``items``: ``step(state, item)`` gives the state after the item, and its value.

    Spark copies an array to lengthen it, so values are gathered by blocks of items: the work grows with the items and not with their square.
    """
    none = lambda kind: F.expr(f"cast(array() AS array<{kind}>)")

    def add(a: Column, item: Column) -> Column:
        after, value = step(a["state"], item)
        return F.struct(after.alias("state"), F.array_append(a["values"], value).alias("values"))

    def add_block(a: Column, at: Column) -> Column:
        whole = lambda g: F.struct(g["state"].alias("state"), F.array_append(a["blocks"], g["values"]).alias("blocks"))
        return F.aggregate(F.slice(items, at, block), F.struct(a["state"].alias("state"), none(of).alias("values")), add, whole)

    firsts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(block))
    return F.flatten(F.aggregate(firsts, F.struct(start.alias("state"), none(f"array<{of}>").alias("blocks")), add_block)["blocks"])
