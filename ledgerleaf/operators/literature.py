"""Filters and summaries of article tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term(col: Column, text: str) -> Column:
    """The word or phrase occurs, bounded by characters that are no word's; a last ``*`` stands for any ending."""
    stem = text.endswith("*")
    body = re.escape(text.rstrip("*"))
    tail = r"[\p{L}\p{N}_]*" if stem else ""
    return col.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}_]){body}{tail}([^\p{{L}}\p{{N}}_]|$)")


def text_predicate(spec, col: Column, tags: Column | None = None, leaf=term) -> Column:
    """A test from nested data: a string is a term; {'any': [...]}, {'all': [...]} and {'not': x} combine; {'tag': t} asks for a heading.

    ``leaf(col, term)`` tests one term: a search each, so for more than a few terms see ``terms.find_terms``.
    """
    if isinstance(spec, str):
        return leaf(col, spec)
    (kind, value), *rest = spec.items()
    if rest:
        raise ValueError("one key a node")
    if kind == "tag":
        if tags is None:
            raise ValueError("no tags given")
        return F.array_contains(tags, value)
    if kind == "not":
        return ~text_predicate(value, col, tags, leaf)
    parts = [text_predicate(v, col, tags, leaf) for v in value]
    if kind == "any":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    if kind == "all":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    raise ValueError(f"unknown node {kind!r}")


def published_within(col: Column, days: int, as_of: Column) -> Column:
    return col >= F.date_sub(as_of, days)


def publication_type(types: Column, kinds: list[str]) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, kinds)))


def latest(df: DataFrame, date: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows; ties go to the smallest key."""
    return df.orderBy(F.desc(date), key).limit(n)


def authors_short(names: Column, n: int = 3) -> Column:
    """The first ``n`` names; ``et al.`` where there are more."""
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), F.when(F.size(names) > n, F.lit(" et al.")).otherwise(F.lit("")))


def summarise_articles(raw: DataFrame) -> DataFrame:
    """pmid, doi, title, authors_short, authors_full, journal, date, type; rows without a title go.

    ``raw`` has pmid, title, source, pubdate, authors array<struct<name>>, articleids
    array<struct<idtype,value>>, pubtype array<string>.
    """
    names = F.transform("authors", lambda a: a["name"])
    doi = F.get(F.filter("articleids", lambda a: a["idtype"] == "doi"), 0)["value"]
    return raw.filter(F.coalesce(F.col("title"), F.lit("")) != "").select(
        "pmid", F.coalesce(doi, F.lit("")).alias("doi"), F.regexp_replace("title", r"\.$", "").alias("title"),
        authors_short(names).alias("authors_short"), F.array_join(names, ", ").alias("authors_full"),
        F.col("source").alias("journal"), F.col("pubdate").alias("date"), F.array_join("pubtype", "; ").alias("type"),
    )


def high_impact(journal: Column, names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(journal, F.lit(n)) for n in names], F.lit(False))


def citation(df: DataFrame) -> Column:
    """All authors, title, journal and date, then the PMID and, where there is one, the doi."""
    ids = F.concat_ws(". ", F.concat(F.lit("PMID: "), "pmid"), F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")))
    return F.concat(F.concat_ws(". ", "authors_full", "title", "journal", "date", ids), F.lit("."))


def journal_in(col: Column, selected: list[str]) -> Column:
    """One of the selected journals; none selected means all."""
    return col.isin(*selected) if selected else F.lit(True)


def journal_presets(journals: DataFrame) -> DataFrame:
    """preset, keys: the journals of each category, in their order; ``default`` those that are on at first, ``all`` all. A dimension of some tens of rows."""
    by = journals.select(
        "key", "ord", F.explode(F.array_compact(F.array(F.lit("all"), F.col("category"), F.when(F.col("default_on"), F.lit("default"))))).alias("preset")
    )
    return by.groupBy("preset").agg(F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("k")).select("preset", F.transform("k", lambda x: x["key"]).alias("keys"))


def sort_feed(df: DataFrame, by: str = "date", date: str = "date", journal: str = "journal", order: str = "ord") -> DataFrame:
    """Newest first, or by journal (as a reader sorts names: case and accents count last) and then newest first; ties by ``order``."""
    first = [] if by == "date" else [F.collate(F.col(journal), "UNICODE")]
    return df.orderBy(*first, F.desc(date), order)


def contained_words(words: DataFrame, names: DataFrame, longest: int = 3) -> DataFrame:
    """word, name: every name (``names``: name) that holds a word (``words``: word) as a substring; both distinct, words not empty.

    Each word is met by one of its grams, of ``longest`` characters or its own length: the one that the fewest names hold. Names
    give all their grams, so the meeting is an equi-join, and what meets is then checked. Grams that names share are counted
    before the choice; a word that no name has a gram of is gone there.
    """
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n))
    size = lambda c: F.least(F.length(c), F.lit(longest))
    of_word = words.select("word", F.explode(F.array_distinct(grams(F.col("word"), size("word")))).alias("gram"))
    lengths = F.sequence(F.lit(1), F.greatest(size("name"), F.lit(1)))
    of_name = names.filter(F.length("name") > 0).select("name", F.explode(F.array_distinct(F.flatten(F.transform(lengths, lambda n: grams(F.col("name"), n))))).alias("gram"))
    wanted = of_name.join(of_word.select("gram").distinct(), "gram", "left_semi")
    rare = wanted.groupBy("gram").agg(F.count("*").alias("n"))
    best = of_word.join(rare, "gram").groupBy("word").agg(F.min(F.struct("n", "gram")).alias("g")).select("word", F.col("g.gram").alias("gram"))
    return best.join(wanted, "gram").filter(F.contains("name", F.col("word"))).select("word", "name")


def tag_journal(articles: DataFrame, journals: DataFrame, key: str) -> DataFrame:
    """Adds short and color of the first journal (by ord) whose first word occurs in ``journal`` or the reverse, in either case.

    Distinct journal names of the articles meet the distinct names of ``journals`` (ord, name, short, color; ords differ) by an index of grams, see
    ``contained_words``, in both directions: equi-joins at any size of either side. An empty first word, of a name that begins with a
    blank, is part of every name: it needs only the first such journal, or the first of all. An empty journal is no journal's.
    """
    first = lambda c: F.element_at(F.split(F.lower(c), " "), 1)
    d = journals.select("ord", F.lower("name").alias("name"), first("name").alias("word"))
    own = articles.select("journal").filter("journal <> ''").distinct().select("journal", F.lower("journal").alias("name"), first("journal").alias("word"))
    by_word = d.filter("word <> ''").groupBy("word").agg(F.min("ord").alias("ord"))
    there = contained_words(by_word.select("word"), own.select("name").distinct()).join(by_word, "word").groupBy("name").agg(F.min("ord").alias("ord"))
    hits = own.select("journal", "name").join(there, "name").select("journal", "ord")
    by_name = d.groupBy("name").agg(F.min("ord").alias("ord"))
    back = contained_words(own.select("word").filter("word <> ''").distinct(), by_name.select("name")).join(by_name, "name").groupBy("word").agg(F.min("ord").alias("ord"))
    hits = hits.unionByName(own.select("journal", "word").join(back, "word").select("journal", "ord"))
    every = d.agg(F.min(F.when(F.col("word") == "", F.col("ord"))).alias("a"), F.min("ord").alias("b"))  # one row
    hits = hits.unionByName(own.join(F.broadcast(every)).select("journal", F.least("a", F.when(F.col("word") == "", F.col("b"))).alias("ord")).filter("ord IS NOT NULL"))
    best = hits.groupBy("journal").agg(F.min("ord").alias("ord")).join(journals.select("ord", "short", "color"), "ord").drop("ord")
    return articles.join(best, "journal", "left").select(*articles.columns, "short", "color")


def filter_any(cols: list[str], q: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(q.lower()))


def assemble_abstract(parts: DataFrame, key: str, default: str = "No abstract.") -> DataFrame:
    """key, abstract: the parts in order, ``Label: text``, a blank line between."""
    line = F.when(F.coalesce("label", F.lit("")) != "", F.concat("label", F.lit(": "), "text")).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return parts.groupBy(key).agg(text.alias("abstract")).withColumn("abstract", F.when(F.col("abstract") == "", default).otherwise(F.col("abstract")))
