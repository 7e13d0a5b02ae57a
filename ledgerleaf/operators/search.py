"""Search by parts of words over a stored index of grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.shared import spread

#: Grams of the index: of this many characters; shorter terms are met by grams of their own length.
LONGEST = 3


def searched_text(cols: tuple[str, ...] = ("title", "group")) -> Column:
    """What a term is looked for in: the columns in lower case, a blank between."""
    return F.lower(F.concat_ws(" ", *cols))


def grams(text: str, n: int = LONGEST) -> list[str]:
    """The different runs of ``n`` characters of a term, or the whole of a shorter one."""
    n = min(n, len(text))
    return sorted({text[i : i + n] for i in range(len(text) - n + 1)})


def text_grams(text: Column, longest: int = LONGEST) -> Column:
    """All different runs of 1 to ``longest`` characters."""
    size = F.length(text)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, longest + 1)])))


def build_index(docs: DataFrame, root: str, key: str = "doc_id", cols: tuple[str, ...] = ("title", "group"), buckets: int = 32) -> versions.Version:
    """Commits an index of ``docs`` under ``root``: postings (gram, key) and gram counts, bucketed by gram, and the rows, bucketed by key.

    ``buckets`` grows with the data. A gram that most rows hold is spread as its bucket's rows are: it is read only if a search has no rarer one.
    """
    # a row makes a hundred postings, so rows are dealt before
    posted = spread(docs.select(key, *cols), key).select(F.explode(text_grams(searched_text(cols))).alias("gram"), F.col(key))
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    tables = {"postings": (posted, ["gram"], buckets), "counts": (counts, ["gram"], buckets), "rows": (docs, [key], buckets)}
    return versions.commit_tables(docs.sparkSession, tables, root, {"key": key, "cols": list(cols), "kinds": {"key": docs.schema[key].dataType.simpleString(), "rows": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)}})


def search(spark: SparkSession, index: versions.Version, q: str) -> DataFrame:
    """The rows whose text holds every word of ``q``: the postings of the rarest gram of all its words give the candidates, which are then checked.

    Counts and postings are read from the buckets of the grams asked for alone. A search without words has all rows; one with a gram
    that the index lacks has none.
    """
    key, cols, kinds = index.note["key"], tuple(index.note["cols"]), index.note["kinds"]
    rows = versions.read(spark, index, kinds["rows"], "rows")
    terms = sorted(set(q.lower().split()))
    if not terms:
        return rows
    asked = sorted({g for t in terms for g in grams(t)})
    counts = versions.read(spark, index, "gram string, n long", "counts").filter(F.col("gram").isin(*asked)).collect()  # a row for each gram of the search
    if len(counts) < len(asked):
        return rows.limit(0)
    rarest = min(counts, key=lambda r: (r["n"], r["gram"]))["gram"]
    met = versions.read(spark, index, f"gram string, `{key}` {kinds['key']}", "postings").filter(F.col("gram") == rarest).select(key)
    holds = reduce(lambda a, t: a & F.contains(searched_text(cols), F.lit(t)), terms, F.lit(True))
    return rows.join(met, key, "left_semi").filter(holds)
