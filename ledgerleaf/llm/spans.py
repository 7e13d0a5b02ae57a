"""Places of pattern matches as columns, by built-in functions only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_names = itertools.count()
#: Matches whose places are added up in one list; lists of more are made of such runs, so that adding to a
#: list, which copies it, costs no more than this for each match.
RUN = 256


def with_matches(df: DataFrame, text_col: str, name: str, pattern: str, trigger: str | None = None, group: int = 0, around: bool = False) -> DataFrame:
    """Adds ``name``: array of (s, e, x) of the pattern's matches, leftmost and non-overlapping, in order.

    s and e are code points, e exclusive; x is the match, or its ``group``. With ``around`` also l and r:
    what stands before and after the match on its line, up to the next match. Texts without the literal
    ``trigger`` are not searched. Splitting at the pattern gives what lies between the matches, so the
    lengths of both add up to the places: within runs of RUN matches, then over the runs, so the work is in
    proportion to the matches however many there are. The pattern must not match the empty string.
    """
    n = next(_names)
    m, g, x, runs, starts, at = (f"__{c}{n}" for c in ("m", "g", "x", "runs", "starts", "at"))
    text, p = F.col(text_col), F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    empty = F.array().cast("array<string>")
    found = F.coalesce(found if trigger is None else F.when(F.contains(text, F.lit(trigger)), found).otherwise(empty), empty)
    df = df.withColumn(m, found)
    some = F.size(m) > 0
    df = df.withColumn(g, F.when(some, F.split(text, pattern, -1)).otherwise(empty))
    df = df.withColumn(x, F.when(some, F.regexp_extract_all(text, p, F.lit(group))).otherwise(empty) if group else F.col(m))
    zero = "named_struct('at', 0, 'out', cast(array() AS array<int>))"
    none = f"cast(array() AS array<struct<s:int,e:int,x:string{',l:string,r:string' * around}>>)"
    lists = {
        runs: f"""if(size({m}) = 0, cast(array() AS array<struct<at:int,out:array<int>>>), transform(sequence(0, (size({m}) - 1) div {RUN}), c ->
            aggregate(sequence(c * {RUN}, least(size({m}), (c + 1) * {RUN}) - 1), {zero},
              (a, k) -> named_struct('at', a.at + length({g}[k]) + length({m}[k]), 'out', array_append(a.out, a.at + length({g}[k]))))))""",
        starts: f"aggregate({runs}, {zero}, (a, c) -> named_struct('at', a.at + c.at, 'out', array_append(a.out, a.at)), a -> a.out)",
        # a list that a function reads by index is read twice or more, or is an argument: else the planner puts its making inside
        at: f"flatten(zip_with({runs}, {starts}, (c, start) -> transform(c.out, p -> p + start)))",
        name: f"""if(size({m}) = 0, {none}, zip_with({x}, transform({m}, (y, k) -> named_struct('s', {at}[k], 'e', {at}[k] + length(y)
            {f", 'l', substring_index({g}[k], chr(10), -1), 'r', substring_index({g}[k + 1], chr(10), 1)" * around})),
            (v, i) -> named_struct('s', i.s, 'e', i.e, 'x', v{", 'l', i.l, 'r', i.r" * around})))""",
    }
    for c, sql in lists.items():
        df = df.withColumn(c, F.expr(sql))
    return df.drop(m, g, x, runs, starts, at)


def tagged(spans: str, kind: str, order: int, test: str = "true", around: bool = False) -> Column:
    """``spans`` that pass ``test`` (of i) as structs (s, e, k, kind, x); k is the kind's rank."""
    more = ", 'l', i.l, 'r', i.r" * around
    return F.expr(f"transform(filter({spans}, i -> {test}), i -> named_struct('s', i.s, 'e', i.e, 'k', {order}, 'kind', '{kind}', 'x', i.x{more}))")


def joined(spans: Column, by_kind: bool) -> Column:
    """kind:start:end, joined by commas: by start, then kind, or by kind, then start."""
    sort = F.array_sort(F.transform(spans, lambda i: F.struct((i["k"] if by_kind else i["s"]).alias("a"), (i["s"] if by_kind else i["k"]).alias("b"), i["e"].alias("e"), i["s"].alias("s"), i["kind"].alias("kind"))))
    return F.array_join(F.transform(sort, lambda i: F.concat(i["kind"], F.lit(":"), i["s"].cast("string"), F.lit(":"), i["e"].cast("string"))), ",")
