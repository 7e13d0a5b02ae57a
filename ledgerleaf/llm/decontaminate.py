"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, reliable, text_or_empty

#: Units of measure that count as placeholders when they follow a number.
UNITS = (
    "kg", "g", "mg", "lb", "lbs", "oz", "ton", "tons", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "yd",
    "l", "ml", "litre", "litres", "liter", "liters", "gal", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes",
    "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kph", "usd", "eur", "dollars",
    "euros", "cents", "percent", "degrees",
)
#: Placeholders sort before all words; POINT stands for a point or comma inside a number.
NAME, NUMBER, UNIT, POINT = "\u0002", "\u0003", "\u0004", "\u0005"
#: What words are made of: letters with their marks, and digits.
_IN_WORD = rf"\p{{L}}\p{{M}}\p{{N}}{POINT}"
_UNIT = f"(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![{_IN_WORD}])"


def marked(text: Column) -> Column:
    """The text with points inside numbers kept as a word character and units, in either case, set off from numbers."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", POINT), f"(?<=[0-9])(?=(?i:{_UNIT}))", " ")


def template(text: Column) -> Column:
    """``marked`` text with whole words replaced by placeholders. A name is any capitalised word, wherever it stands, so a copy
    has the same template in the middle of a sentence, after a line break or a quote."""
    return numbered(F.regexp_replace(text, rf"(?<![{_IN_WORD}])[\p{{Lu}}\p{{Lt}}][\p{{L}}\p{{M}}]*+(?![{_IN_WORD}])", NAME))


def numbered(text: Column) -> Column:
    """``marked`` text with numbers and units replaced by placeholders, names as they stand."""
    t = F.regexp_replace(text, f"(?<![{_IN_WORD}])[0-9][0-9{POINT}]*+(?![{_IN_WORD}])", NUMBER)
    return F.regexp_replace(t, f"({NUMBER}\\s+){_UNIT}", f"$1{UNIT}")


def words(text: Column) -> Column:
    """Words and placeholders, lower-cased. A template and its marked text have equally many: placeholders stand for whole words, and a
    letter whose lower case is several characters becomes a letter with marks, which are part of words."""
    return F.filter(F.split(F.lower(text), f"[^{_IN_WORD}{NAME}-{UNIT}]+", -1), lambda w: w != "")


def window_hashes(tw: str, rw: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of the template ``tw``; none where there are fewer. A run of nothing but placeholders
    counts by its values in ``rw``, so that a table of numbers isn't every other one."""
    runs = F.sequence(F.lit(0), F.size(tw) - size)  # words are taken one by one: a slice would copy the whole list
    at = lambda c, i: [F.get(F.col(c), i + k) for k in range(size)]

    def one(i):
        ws = at(tw, i)
        bare = F.greatest(*ws) <= UNIT if size > 1 else ws[0] <= UNIT
        return F.when(~bare, F.xxhash64(*ws)).otherwise(F.xxhash64(F.lit(1), *at(rw, i)))

    return F.when(F.size(tw) >= size, F.transform(runs, one)).otherwise(F.array().cast("array<bigint>"))


def short_hashes(rw: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words by their values, with the size in them."""
    runs = F.sequence(F.lit(0), F.size(rw) - size)
    return F.when(F.size(rw) >= size, F.transform(runs, lambda i: F.xxhash64(F.lit(-size), *[F.get(F.col(rw), i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def with_words(df: DataFrame, text: Column, bare: int | None = None) -> DataFrame:
    """Adds tw and rw: words of the template and of the text. Columns, so that functions over them read them and don't make them anew.

    With ``bare``, rw is null where the template has no run of so many placeholders, which alone count by their values.
    """
    df = df.withColumn("m", marked(text)).withColumn("tm", template(F.col("m")))
    mark, gap = f"[{NAME}-{UNIT}]", f"[^{_IN_WORD}{NAME}-{UNIT}]*+"
    own = words(F.col("m"))
    rw = own if bare is None else F.when(F.col("tm").rlike(f"(?:{mark}{gap}){{{bare}}}"), own)
    return df.withColumn("tw", words(F.col("tm"))).withColumn("rw", rw).drop("m", "tm")


def leaks(
    df: DataFrame, benchmark: DataFrame, size: int = 5, coverage: float = 0.8, most_windows: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item: id, row, item, n_windows, n_found, coverage, n_slots, kind.

    Texts become templates; windows of ``size`` words are hashed and joined with those of the items.
    The windows of a document and item on one diagonal must fill the item's placeholders consistently:
    an item's value always by the same value of the document. A pair is a leak where consistent windows
    make up ``coverage`` of the item's. kind: ``exact`` where all values are the item's own, else
    ``template``: a question with new parameters. An item of fewer than ``size`` words is one window of
    its own length and is found only with its own values: short templates would be met by chance.

    An item has three views: its template; its words in lower case with numbers and units as placeholders, as a copy all in lower case has no
    names; and its values, as a copy in capitals is a run of names, which counts by its values. A document is made into one template, and a pair is a
    leak if one view finds it.

    Items' windows are counted first: up to ``most_windows`` of them are broadcast; more are joined by
    shuffle. Documents are never compared with each other. ``row`` hashes the text.

    Null and empty texts, and items without a word, match nothing. Items that repeat match each by its
    own id; null item ids are dropped. Rows that repeat an id are judged each by its text, equal rows
    give one leak. Null ids are kept. An empty table on either side gives an empty result. Other columns are ignored.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), text_or_empty(item_text_col).alias("t"))
    items = with_words(items.withColumn("lw", words(numbered(marked(F.col("t"))))), F.col("t")).filter(F.size("rw") > 0)
    long_ = items.filter(F.size("tw") >= size)
    plain = long_.select(F.struct(F.lit(0).alias("view"), "item").alias("item"), "tw", "rw", window_hashes("tw", "rw", size).alias("hs"))
    lower = long_.filter(F.col("lw") != F.col("tw")).select(F.struct(F.lit(1).alias("view"), "item").alias("item"), F.col("lw").alias("tw"), "rw").withColumn("hs", window_hashes("tw", "rw", size))
    valued = F.transform(F.sequence(F.lit(0), F.size("rw") - size), lambda i: F.xxhash64(F.lit(1), *[F.get(F.col("rw"), i + k) for k in range(size)]))
    none = F.expr("cast(array() AS array<struct<j:int,w:string,v:string>>)")
    slots = F.expr(f"filter(transform(slice(tw, q + 1, {size}), (w, j) -> if(w <= '{UNIT}', named_struct('j', j, 'w', w, 'v', rw[q + j]), NULL)), x -> x IS NOT NULL)")
    of_item = plain.unionByName(lower).select("item", "tw", "rw", F.posexplode_outer("hs").alias("q", "h")).filter("h IS NOT NULL").select("item", "q", "h", slots.alias("slots"))
    own = long_.select(F.struct(F.lit(2).alias("view"), "item").alias("item"), F.posexplode_outer(valued).alias("q", "h")).filter("h IS NOT NULL")
    of_item = of_item.unionByName(own.withColumn("slots", none))
    short = reliable(items.filter(F.size("tw") < size).select("item", F.size("rw").alias("n"), "rw"))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # under ``size`` numbers
    for n in lengths:
        one = short.filter(F.col("n") == n).select(F.struct(F.lit(0).alias("view"), "item").alias("item"), F.posexplode(short_hashes("rw", n)).alias("q", "h"))
        of_item = of_item.unionByName(one.withColumn("slots", none))
    of_item = reliable(of_item)
    sizes = of_item.groupBy("item").agg(F.countDistinct("h").alias("n_windows"))
    few = of_item.count() <= most_windows
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)

    text = F.col(text_col).cast("string")
    docs = with_words(df.filter(F.length(text) > 0).select(F.col(id_col), F.xxhash64(text).alias("row"), text.alias("t")), F.col("t"), None if lengths else size)
    hashes = [window_hashes("tw", "rw", size), *[short_hashes("rw", n) for n in lengths]]
    hashed = docs.select(id_col, "row", (F.concat(*hashes) if lengths else hashes[0]).alias("hs"))
    # outer: else a test that the list isn't empty would go below, and make the list a second time, word by word
    met = hashed.select(id_col, "row", F.posexplode_outer("hs").alias("p", "h")).join(small(of_item), "h")
    met = met.select(id_col, "row", "item", "p", "q", "h", (F.col("p") - F.col("q")).alias("diagonal"), "slots")
    met = reliable(met.dropDuplicates([id_col, "row", "item", "p", "q"]))  # few rows, read several times below

    # coverage before the placeholders are looked at; only what passes is read again for its values
    enough = reliable(
        met.groupBy(id_col, "row", "item").agg(F.countDistinct("h").alias("n"), F.max(F.size("slots")).alias("any_slots"))
        .join(small(sizes), "item").filter(F.col("n") >= coverage * F.col("n_windows"))
        .select(id_col, "row", "item", "n_windows", "any_slots")
    )
    key = [id_col, "row", "item"]
    c = F.col
    same = lambda a, b: c(f"{a}.{id_col}").eqNullSafe(c(f"{b}.{id_col}")) & (c(f"{a}.row") == c(f"{b}.row")) & (c(f"{a}.item") == c(f"{b}.item"))
    m, e = met.alias("m"), enough.alias("e")
    kept = m.join(e, same("m", "e")).select(*[F.col(f"m.{c}") for c in [*key, "p", "q", "h", "diagonal", "slots"]], "e.n_windows")
    # the ids are counted: up to two million are broadcast, so that no text is shuffled
    ids = counted(enough.filter("any_slots > 0").select(c(id_col).alias("__id"), c("row").alias("__row")).distinct())
    whole = df.filter(F.length(text) > 0).select(F.col(id_col), F.xxhash64(text).alias("row"), text.alias("__text"))
    again = whole.join(ids, c(id_col).eqNullSafe(c("__id")) & (c("row") == c("__row")), "left_semi")
    raw = reliable(again.select(F.col(id_col).alias("__id"), F.col("row").alias("__row"), words(marked(F.col("__text"))).alias("rw")).dropDuplicates(["__id", "__row"]))
    full = kept.join(raw, c(id_col).eqNullSafe(c("__id")) & (c("row") == c("__row")), "left")
    filled = full.select(*key, "n_windows", "diagonal", "h", "q", F.explode_outer(F.expr("transform(slots, s -> named_struct('at', q + s.j, 'w', s.w, 'v', s.v, 'd', rw[p + s.j]))")).alias("s"))
    # one document value for each item value, on each diagonal
    values = filled.groupBy(*key, "diagonal", "s.w", "s.v").agg(F.countDistinct("s.d").alias("n_values"), F.max(F.coalesce(F.col("s.d") != F.col("s.v"), F.lit(False))).alias("new"), F.countDistinct("s.at").alias("n_at"))
    lines = values.groupBy(*key, "diagonal").agg(F.max("n_values").alias("most"), F.max("new").alias("new"), F.sum("n_at").alias("n_slots"))
    good = lines.filter("most <= 1")
    k, g = kept.alias("k"), good.alias("g")
    joined = k.join(g, same("k", "g") & (c("k.diagonal") == c("g.diagonal"))).select(*[F.col(f"k.{c}") for c in [*key, "n_windows", "h"]], "g.new", "g.n_slots")
    out = joined.groupBy(*key, "n_windows").agg(
        F.countDistinct("h").alias("n_found"), F.max("n_slots").alias("n_slots"), F.min("new").alias("new")
    ).filter(F.col("n_found") >= coverage * F.col("n_windows"))
    # of the views that find an item the one that finds most, the template before others
    of = F.struct((F.col("n_found") / F.col("n_windows")).alias("coverage"), (-F.col("item.view")).alias("v"), "n_windows", "n_found", "n_slots", "new")
    out = out.groupBy(id_col, "row", F.col("item.item").alias("item")).agg(F.max(of).alias("o"))
    return out.select(
        id_col, "row", F.col("item").alias(item_col), F.col("o.n_windows").cast("long").alias("n_windows"), F.col("o.n_found").cast("long").alias("n_found"),
        "o.coverage", F.col("o.n_slots").cast("long").alias("n_slots"), F.when(F.col("o.new"), "template").otherwise("exact").alias("kind"),
    )


def without_leaks(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2_000_000) -> DataFrame:
    """The rows of ``df`` that no leak of ``found`` names, with all their columns; broadcast up to ``most`` leaks, else shuffled."""
    bad = counted(found.select(F.col(id_col).alias("id"), "row").distinct(), most)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col).cast("string")).alias("own_row"))
    return own.join(bad, F.col("own_id").eqNullSafe(bad["id"]) & (F.col("own_row") == bad["row"]), "left_anti").select("own.*")
