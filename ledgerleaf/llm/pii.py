"""Personal data: patterns, and terms that give an entity away by their co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, reliable, text_or_empty
from .spans import joined, tagged, with_matches

#: A local part is taken whole from its first character or from the end of the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: 13 digits or more; shorter runs have no longer part. Runs begin where no digit comes before.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}][\p{L}\p{N}]{2,}+"


def luhn(digits: str) -> str:
    """SQL that tests a string of digits by the Luhn sum."""
    at = f"cast(substring({digits}, length({digits}) - j, 1) AS int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, j) -> a + if(j % 2 = 0, {at}, if({at} > 4, 2 * {at} - 9, 2 * {at}))) % 10 = 0"


def base_spans(df: DataFrame, text_col: str, around: bool = False) -> DataFrame:
    """Adds ``base``: array of (s, e, k, kind, x) of the kinds email, ip, card and phone; with ``around`` also l and r, see ``with_matches``."""
    df = with_matches(df, text_col, "__email", EMAIL, trigger="@", around=around)
    df = with_matches(df, text_col, "__ip", IP, trigger=".", around=around)
    df = with_matches(df, text_col, "__card", CARD, around=around)
    df = with_matches(df, text_col, "__phone", PHONE, trigger="+", around=around)
    digits = "regexp_replace(i.x, '[^0-9]', '')"
    byte = "forall(split(i.x, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(right(concat('000', ltrim('0', p)), 3) AS int) <= 255)"
    card = f"length({digits}) <= 19 AND {luhn(digits)}"
    base = F.concat(
        tagged("__email", "email", 0, around=around), tagged("__ip", "ip", 1, byte, around), tagged("__card", "card", 2, card, around),
        tagged("__phone", "phone", 3, f"length({digits}) BETWEEN 9 AND 15", around),
    )
    return df.withColumn("base", base).drop("__email", "__ip", "__card", "__phone")


def entities(rows: DataFrame, window: int) -> DataFrame:
    """One row for each entity: id, at (hash of the text), h (hash of the entity), near (distinct lower-case terms beside it).

    Beside are the ``window`` terms on either side that stand on its line, up to the next entity of its kind,
    so each stretch of text is looked at twice at most for each kind.
    """
    one = rows.select("id", "at", F.explode_outer("base").alias("b")).filter("b IS NOT NULL")
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    one = one.select("id", "at", F.xxhash64(F.lower("b.x"), "b.kind").alias("h"), terms("b.l").alias("l"), terms("b.r").alias("r"))
    last = F.slice("l", F.greatest(F.size("l") - window + 1, F.lit(1)), window)
    return one.select("id", "at", "h", F.array_distinct(F.concat(last, F.slice("r", 1, window))).alias("near"))


def disclosures(found: DataFrame, rows: DataFrame, min_texts: int, share: float, most: int = 500_000) -> DataFrame:
    """t, h, pmi, ic, removed: terms whose pointwise information about an entity reaches ``share`` of what
    the entity itself carries, beside it in ``min_texts`` different texts or more.

    All counts are of different texts (copies count once): n_te that have the term beside the entity, n_e that have the
    entity, n_t that have the term anywhere, n of all. pmi = log2(n_te n / (n_e n_t)), ic = log2(n / n_e). The term goes where every text with
    it has it beside the entity, so that it tells as much as the entity.
    """
    seen = found.select("h", "at", F.explode("near").alias("t")).distinct()
    joint = seen.groupBy("t", "h").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= min_texts)
    each = found.select("h", "at").distinct().groupBy("h").agg(F.count("*").alias("n_e"))
    joint = reliable(joint.join(each, "h"))
    # all words of all texts are counted, so that what is passed on grows with the texts, whichever terms stand beside entities
    again = counted(rows.groupBy("at").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("at").alias("again")), most)
    copied = F.col("at") == F.col("again")
    once = rows.join(again, copied, "left_anti").select("at", "text").unionByName(rows.join(again, copied, "left_semi").select("at", "text").dropDuplicates(["at"]))
    words = once.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("t")).filter("t IS NOT NULL")
    held = words.groupBy("t").agg(F.count("*").alias("n_t"))
    total = rows.select("at").distinct().agg(F.count("*").alias("n"))  # one row
    told = joint.join(held, "t").crossJoin(F.broadcast(total))
    told = told.withColumn("pmi", F.log2(F.col("n_te") * F.col("n") / (F.col("n_e") * F.col("n_t")))).withColumn("ic", F.log2(F.col("n") / F.col("n_e")))
    return told.filter(F.col("pmi") >= share * F.col("ic")).select("t", "h", "pmi", "ic", (F.col("n_te") == F.col("n_t")).alias("removed"))


def find(
    df: DataFrame, window: int = 8, min_texts: int = 3, share: float = 0.5, most_rows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows' personal data and the terms that give it away: id, at (hash of the text), base, terms.

    base: array of (s, e, k, kind, x). terms: spans of kind ``term``, wherever they stand in a text that has an entity which they
    disclose: ``share`` of its information or more, beside it in ``min_texts`` different texts. x says what
    to do with it: ``remove`` where the term tells as much as the entity, else ``generalise``.

    Null and empty texts have no spans. Rows that repeat an id with the same text are searched once and
    given again; null ids are kept. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("at"), text.alias("text"))
    based = base_spans(rows, "text").select("id", "at", "base")
    found = reliable(entities(base_spans(rows, "text", around=True), window))
    said = reliable(disclosures(found, rows, min_texts, share).select("t", "h", "removed"))
    # the terms that each text must lose, then their places in these texts alone
    asked = reliable(found.select("at", "h").distinct().join(said, "h").groupBy("at", "t").agg(F.max("removed").alias("removed")))
    texts = counted(asked.select(F.col("at").alias("wanted")).distinct(), most_rows)
    again = with_matches(rows.join(texts, F.col("at") == F.col("wanted"), "left_semi"), "text", "found", TERM)
    places = again.select("id", "at", F.explode_outer("found").alias("w")).filter("w IS NOT NULL").select("id", "at", "w.s", "w.e", F.lower("w.x").alias("t"))
    marks = places.join(F.broadcast(asked) if asked.count() <= most_rows else asked, ["at", "t"])
    span = F.struct("s", "e", F.lit(4).alias("k"), F.lit("term").alias("kind"), F.when(F.col("removed"), "remove").otherwise("generalise").alias("x"))
    by_row = marks.groupBy(F.col("id").alias("m_id"), F.col("at").alias("m_at")).agg(F.array_sort(F.collect_set(span)).alias("terms"))
    out = based.join(by_row, based["id"].eqNullSafe(by_row["m_id"]) & (based["at"] == by_row["m_at"]), "left")
    none = F.expr("cast(array() AS array<struct<s:int,e:int,k:int,kind:string,x:string>>)")
    return out.select(F.col("id").alias(id_col), "at", "base", F.coalesce("terms", none).alias("terms"))


def shape(x: Column) -> Column:
    """What a term is generalised to: its kind by its characters."""
    return F.when(x.rlike(r"\p{N}"), "code").when(x.rlike(r"^\p{Lu}{2,}$"), "acronym").when(x.rlike(r"^\p{Lu}"), "name").otherwise("word")


def sanitised(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, and ``text_col`` without what ``find`` found in it.

    Spans that touch are one place, which gets the kind of the first in angle brackets. Terms to be
    generalised get their shape (``name``, ``acronym``, ``code``, ``word``); a place of terms to be removed only goes. Null texts stay
    null. Texts without spans are passed on as they are, without a shuffle: the ids of the others are counted, up to two million broadcast. Those others
    meet their places in a join by id and hash.
    """
    spans = found.select(F.col(id_col).alias("id"), "at", F.explode_outer(F.concat("base", "terms")).alias("i")).filter("i IS NOT NULL").select("id", "at", "i.s", "i.e", "i.k", "i.kind", "i.x").distinct()
    w = Window.partitionBy("id", "at").orderBy("s", "k", "e")
    spans = spans.withColumn("reached", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("place", F.sum((F.col("reached").isNull() | (F.col("s") >= F.col("reached"))).cast("int")).over(w))
    spans = spans.groupBy("id", "at", "place").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by(F.struct("kind", "x"), F.struct("s", "k")).alias("first"), F.bool_and(F.col("x") == "remove").alias("goes"))
    cuts = spans.groupBy(F.col("id").alias("c_id"), F.col("at").alias("c_at")).agg(F.array_sort(F.collect_list(F.struct("s", "e", "first", F.coalesce("goes", F.lit(False)).alias("goes")))).alias("cuts"))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(id_col).alias("own_id"), F.xxhash64(text_or_empty(text_col)).alias("own_at"))
    same = lambda of, at: F.col("own_id").eqNullSafe(F.col(of)) & (F.col("own_at") == F.col(at))
    cuts = reliable(cuts)
    some = counted(cuts.select(F.col("c_id").alias("s_id"), F.col("c_at").alias("s_at")))
    out = own.join(some, same("s_id", "s_at"), "left_semi").join(cuts, same("c_id", "c_at"))
    text = F.col("own")[text_col].cast("string")
    piece = lambda a, z: F.when(z > a, F.substr(text, a + 1, z - a)).otherwise(F.lit(""))

    def part(c: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("cuts"), k - 1)["e"])
        sign = F.when(c["first"]["kind"] == "term", shape(piece(c["s"], c["e"]))).otherwise(c["first"]["kind"])
        return F.concat(piece(begin, c["s"]), F.when(c["goes"], "").otherwise(F.concat(F.lit("<"), sign, F.lit(">"))))

    tail = piece(F.element_at("cuts", -1)["e"], F.length(text))
    cut = out.select("own", F.concat(F.array_join(F.transform("cuts", part), ""), tail).alias("new"))
    rest = own.join(some, same("s_id", "s_at"), "left_anti").select("own", text.alias("new"))
    return cut.unionByName(rest).select(*[F.col("new").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in df.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and list of ``find``'s spans, with ``at``, the text's hash."""
    of = lambda kind: F.size(F.filter("base", lambda i: i["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = lambda x: F.size(F.filter("terms", lambda i: i["x"] == x)).cast("long")
    return found.select(
        id_col, of("email"), of("ip"), of("card"), of("phone"),
        F.sha2(joined(F.col("base"), True), 256).alias("base_sha256"), joined(F.concat("base", "terms"), True).alias("spans"),
        terms("generalise").alias("n_generalised"), terms("remove").alias("n_removed"), "at",
    )
