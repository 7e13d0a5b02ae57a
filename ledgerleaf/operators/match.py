"""Phrases of a small reference list found in titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fold_accents, padded_words


#: What parts the aliases inside brackets: marks, and words that stand alone; words that join the drugs of a regimen.
MARKS, PARTERS, JOINERS = (",", "/"), ("or", "also called"), ("and", "with")


def leaflet_keys(title: Column) -> Column:
    """The title without its brackets, and the aliases inside them, as padded-word keys of 3 or more letters."""
    t = F.lower(F.regexp_replace(fold_accents(F.coalesce(title, F.lit(""))), "[®™]", ""))
    main = F.regexp_replace(t, r"\(.*?\)", " ")
    parter = f"[{''.join(MARKS)}]|(?<![a-z0-9_])(?:{'|'.join(PARTERS)})(?![a-z0-9_])"
    inside = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"\((.*?)\)"), F.lit(1)), lambda x: F.split(x, parter)))
    keys = F.transform(F.concat(F.array(main), inside), lambda k: F.btrim(padded_words(k)))
    return F.array_distinct(F.filter(keys, lambda k: F.length(F.replace(k, F.lit(" "), F.lit(""))) >= 3))


def capital_run(parts: Column) -> Column:
    """The longest run of a word's hyphened parts that are capitals and digits, the first one beginning with a capital, in characters.

    Hyphens between parts count, and that before a part which no longer is of capitals: AC-based has 3.
    """
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
    upper = lambda p: (p != "") & (F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "") == "")

    def add(a: Column, p: Column) -> Column:
        joined = F.when((a["run"] > 0) & (p != ""), a["run"] + 1).otherwise(0)  # with the hyphen before this part
        opens = F.when(joined > 0, joined + F.length(p)).when(p.rlike("^[A-Z]"), F.length(p)).otherwise(0)
        run = F.when(upper(p), opens).when((p == "") & (a["run"] > 0), a["run"] + 1).otherwise(0)  # nothing between two hyphens
        return F.struct(run.cast("int").alias("run"), F.greatest(a["most"], F.when(p != "", run), joined).cast("int").alias("most"))

    return F.aggregate(parts, start, add)["most"]


def is_regimen(title: Column) -> Column:
    """Three capitals or more (or digits and hyphens behind the first) at a word's or a hyphened part's beginning, outside brackets; a joining word; a dash between spaces."""
    words = F.split(F.regexp_replace(title, "[(][^)]*[)]", " "), "[^0-9A-Za-z_-]+")
    acronym = F.exists(words, lambda w: capital_run(F.split(w, "-")) >= 3)
    joined = F.exists(F.split(F.lower(title), "[^0-9a-z_]+"), lambda w: w.isin(*JOINERS))
    return acronym | joined | F.contains(title, F.lit(" - "))


def phrase_hits(forms: DataFrame, keys: DataFrame) -> DataFrame:
    """form_id, leaflet_id, key_ord, key, pos, len: keys that occur on word boundaries of the title.

    ``forms``: form_id, title. ``keys``: leaflet_id, leaflet_ord, key_ord, key, regimen. Titles go to
    runs of as many words as keys have, with their places, and meet the keys in an equi-join, so no title
    is compared with every key. The numbers of words that occur are few and small; they are read first.
    """
    sizes = sorted(r[0] for r in keys.filter("key IS NOT NULL").select(F.size(F.split("key", " "))).distinct().collect())
    words = forms.select("form_id", F.split(F.btrim(padded_words(F.col("title"))), " ").alias("w"))
    starts = words.select("form_id", "w", F.posexplode("w").alias("i", "_"))
    runs = starts.select("form_id", "w", "i", F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size("w") - F.col("i"))).alias("n"))
    grams = runs.select(
        "form_id", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("key"),
        F.aggregate(F.slice("w", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x) + 1).alias("pos"),
    )
    few = keys.count() <= 200_000
    return grams.join(F.broadcast(keys) if few else keys, "key").withColumn("len", F.length("key"))


def best_key_per_pair(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("form_id", "leaflet_id").orderBy(F.desc("len"), "key_ord", "pos")
    return hits.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def suppress_contained(hits: DataFrame) -> DataFrame:
    """Hits that are no regimen and lie inside another, longer hit of the form go."""
    o = hits.select(F.col("form_id").alias("f2"), F.col("pos").alias("p2"), F.col("len").alias("l2"))
    inside = (F.col("form_id") == F.col("f2")) & ~F.col("regimen") & (F.col("l2") > F.col("len")) & (F.col("pos") >= F.col("p2")) & (F.col("pos") + F.col("len") <= F.col("p2") + F.col("l2"))
    return hits.join(o, inside, "left_anti")


def top_suggestions(hits: DataFrame, k: int = 5) -> DataFrame:
    """form_id, rank, leaflet_id: regimens first, then by place, then by the leaflets' order; at most ``k``."""
    w = Window.partitionBy("form_id").orderBy(F.desc("regimen"), "pos", "leaflet_ord", "leaflet_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("form_id", "rank", "leaflet_id")


def suggest(forms: DataFrame, leaflets: DataFrame, k: int = 5) -> DataFrame:
    """All steps: ``leaflets`` has leaflet_id, leaflet_ord, title and may have keys; those that are null are made."""
    have = F.col("keys") if "keys" in leaflets.columns else F.lit(None).cast("array<string>")
    keys = leaflets.select("leaflet_id", "leaflet_ord", is_regimen(F.col("title")).alias("regimen"), F.posexplode(F.coalesce(have, leaflet_keys(F.col("title")))).alias("key_ord", "key"))
    return top_suggestions(suppress_contained(best_key_per_pair(phrase_hits(forms, keys))), k)
