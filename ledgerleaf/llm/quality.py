"""Document quality by an interpolated modified Kneser-Ney model of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import counted, give_back, known, reliable, text_or_empty

#: Bits of a symbol; a symbol is a code point. Three fit into a long.
BITS = 21
ORDER = 3
_ONE, _TWO = (1 << BITS) - 1, (1 << (2 * BITS)) - 1


def symbols(text: str) -> np.ndarray:
    """The code points after two zeros, which stand before a text's first character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(code) + ORDER - 1, np.int64)
    out[ORDER - 1 :] = np.maximum(code, 1)
    return out


def grams(text: str) -> np.ndarray:
    """The n-grams of ORDER symbols that end at each character, as numbers of 3 x 21 bits."""
    s = symbols(text)
    return (s[:-2] << (2 * BITS)) | (s[1:-1] << BITS) | s[2:]


def language(col: str) -> Column:
    """A null language is one of its own, ''."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def gram_counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, g, n over all texts. Each task adds up the grams of many texts before it passes them on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang", dropna=False)["text"]:
                held, size = [], 0
                for k, text in enumerate(texts):
                    held.append(grams(text))
                    size += len(text)
                    if size > 2_000_000 or k == len(texts) - 1:
                        g, n = np.unique(np.concatenate(held), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "g": g, "n": n})
                        held, size = [], 0

    text = df.select(language(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    return text.mapInPandas(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, most_langs: int = 10_000) -> dict[str, DataFrame]:
    """The model as tables, sharded by language and gram: log10 probabilities and back-off weights.

    ``p3``, ``p2``, ``p1``: lang, key (a gram of that order), p. ``w3``, ``w2``: lang, key (a context of two
    or one symbols), w: what it leaves to the order below. ``w1``: lang, w: the probability of a symbol that the language never has.

    Lower orders count distinct predecessors. Discounts D1, D2, D3+ of each order come from its counts of
    counts, by language; they are a row a language, broadcast up to ``most_langs`` languages, so that no order is
    shuffled by language alone. The lowest order is interpolated with equal shares for all symbols of
    the language and one for all others. Each order is kept, as the next one reads it again.
    """
    tri = counts.select("lang", F.col("g").alias("key"), F.col("n").alias("c"))
    bi = reliable(tri.groupBy("lang", F.col("key").bitwiseAND(_TWO).alias("key")).agg(F.count("*").alias("c")))
    uni = reliable(bi.groupBy("lang", F.col("key").bitwiseAND(_ONE).alias("key")).agg(F.count("*").alias("c")))
    sizes = reliable(uni.groupBy("lang").agg((F.count("*") + 1).alias("v")))
    few = sizes.count() <= most_langs
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)

    def discounted(level: DataFrame) -> DataFrame:
        """Adds ctx, p0 = (c - D(c)) / total(ctx) and gamma(ctx)."""
        has = lambda k: F.sum((F.col("c") == k).cast("double"))
        d = level.groupBy("lang").agg(*[has(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        nth = lambda k: F.least(F.lit(float(k)), F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0))))
        d = d.select("lang", nth(1).alias("d1"), nth(2).alias("d2"), nth(3).alias("d3"))
        x = level.join(small(d), "lang").withColumn("ctx", F.shiftright("key", BITS))
        x = x.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        x = x.withColumn("d", F.least("d", F.col("c") * 0.999))
        ctx = x.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        return x.join(ctx, ["lang", "ctx"]).select("lang", "key", "ctx", ((F.col("c") - F.col("d")) / F.col("total")).alias("p0"), (F.col("mass") / F.col("total")).alias("gamma"))

    def mixed(level: DataFrame, mask: int, lower: DataFrame) -> DataFrame:
        low = lower.select("lang", F.col("key").alias("low"), F.col("p").alias("below"))
        x = discounted(level).withColumn("low", F.col("key").bitwiseAND(mask)).join(low, ["lang", "low"])
        return reliable(x.select("lang", "key", "ctx", (F.col("p0") + F.col("gamma") * F.col("below")).alias("p"), "gamma"))

    u = reliable(discounted(uni).join(small(sizes), "lang").select("lang", "key", (F.col("p0") + F.col("gamma") / F.col("v")).alias("p"), (F.col("gamma") / F.col("v")).alias("other")))
    b = mixed(bi, _ONE, u)
    t = mixed(tri, _TWO, b)
    p = lambda x: x.select("lang", "key", F.log10("p").alias("p"))
    w = lambda x: x.groupBy("lang", F.col("ctx").alias("key")).agg(F.log10(F.first("gamma")).alias("w"))
    return {"p3": p(t), "p2": p(b), "p1": p(u), "w3": w(t), "w2": w(b), "w1": u.groupBy("lang").agg(F.log10(F.first("other")).alias("w"), F.count("*").alias("v"))}


def train(trusted: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, DataFrame]:
    """The model's tables, counted over all of ``trusted``; one model a language."""
    return {k: reliable(v) for k, v in kneser_ney(reliable(gram_counts(trusted, lang_col, text_col))).items()}


def log_probabilities(need: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """lang, g, p: log10 probability of the last symbol of each of the distinct grams ``need`` (lang, g), by joins with the shards.

    A gram that was never seen has its context's weight and the probability of the order below.
    """

    def met(x: DataFrame, table: str, key: Column, name: str) -> DataFrame:
        y = model[table].select(F.col("lang").alias("k_lang"), F.col("key").alias("k_key"), F.col("w" if table[0] == "w" else "p").alias(name))
        return x.withColumn("k", key).join(y, (F.col("lang") == F.col("k_lang")) & (F.col("k") == F.col("k_key")), "left").drop("k", "k_lang", "k_key")

    x = met(need, "p3", F.col("g"), "a3")
    seen = x.filter("a3 IS NOT NULL").select("lang", "g", F.col("a3").alias("p"))
    x = x.filter("a3 IS NULL")
    two, one = F.col("g").bitwiseAND(_TWO), F.col("g").bitwiseAND(_ONE)
    for table, key, name in (("w3", F.shiftright("g", BITS), "c3"), ("p2", two, "a2"), ("w2", F.shiftright(two, BITS), "c2"), ("p1", one, "a1")):
        x = met(x, table, key, name)
    x = x.join(model["w1"].select("lang", F.col("w").alias("other")), "lang")
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    below = F.coalesce("a2", nil("c2") + F.coalesce("a1", "other"))
    return seen.unionByName(x.select("lang", "g", (nil("c3") + below).alias("p")))


def perplexities(
    df: DataFrame, model: dict[str, DataFrame], chars_each: int = 4_000_000, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """id, row (hash of the text), lang, n_symbols, perplexity for every row: 10 to the mean of -log10 p over a text's characters.

    The texts of a language are dealt by their hashes into parts of about ``chars_each`` characters. A part's distinct grams are
    joined with the model's shards, and what they find comes back to the part, which adds up each of its
    texts. So what is looked up grows with the texts, a shard only holds its grams, and nothing of the model passes the driver
    or is copied to all tasks. The texts are shuffled once, for both steps. Rows of equal id, language and text are scored once,
    so that they do not meet in one part, and returned as often as they are.

    A language without a model of its own is scored by that of the language with most symbols; an empty
    text has no perplexity (null), and so has every text where there is no model at all.
    """
    text = text_or_empty(text_col)
    langs = model["w1"].select(F.col("lang").alias("own"))
    widest = model["w1"].agg(F.max_by("lang", F.struct("v", "lang")).alias("widest"))  # one row
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), language(lang_col).alias("lang"), text.alias("text"))
    own = ["id", "row", "lang"]
    twice = counted(rows.groupBy(F.xxhash64(*own).alias("same")).count().filter("count > 1").select("same"))
    if twice.isEmpty():
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    else:
        met = F.xxhash64(*own) == F.col("same")
        once = rows.join(twice, met, "left_semi").groupBy(*own).agg(F.first("text").alias("text"), F.count("*").alias("times"))
        rows = rows.join(twice, met, "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(once)
    rows = rows.join(counted(langs, 10_000), F.col("lang") == F.col("own"), "left").crossJoin(F.broadcast(widest))
    rows = rows.select(*own, F.coalesce("own", "widest", F.lit("")).alias("by"), "text", "times")
    sizes = counted(rows.groupBy("by").agg(F.ceil((F.sum(F.length("text")) + 1) / chars_each).alias("parts")), 10_000)
    rows = rows.join(sizes, "by").select(*own, "by", "text", "times", F.pmod(F.xxhash64("row", "id"), "parts").cast("int").alias("part"))

    used = StructType.fromDDL("part int, lang string, g long")
    used_arrow = to_arrow_schema(used)

    def distinct(table: pa.Table) -> pa.Table:
        found, held, size = np.zeros(0, np.int64), [], 0
        for text in table["text"].to_pylist():
            held.append(grams(text))
            size += len(text)
            if size > 1_000_000:
                found, held, size = np.unique(np.concatenate([found, *held])), [], 0
        found = np.unique(np.concatenate([found, *held]))
        first = [pa.array([table[c][0].as_py()] * len(found), t) for c, t in (("part", pa.int32()), ("by", pa.string()))]
        out = pa.Table.from_arrays([*first, pa.array(found, pa.int64())], schema=used_arrow)
        del found, held
        give_back()
        return out

    # dealt by gram once, for the lookup and for what goes back
    asked = rows.groupBy("by", "part").applyInArrow(distinct, used).repartition("lang", "g")
    values = asked.join(log_probabilities(asked.select("lang", "g").distinct(), model), ["lang", "g"]).select("part", "lang", "g", "p")
    schema = StructType([StructType.fromDDL("id string")["id"]] + StructType.fromDDL("row long, lang string, n_symbols long, perplexity double, times long").fields)
    schema.fields[0].dataType = df.schema[id_col].dataType
    out = to_arrow_schema(schema)

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(have := found["g"].to_numpy())
        have, p = have[order], found["p"].to_numpy()[order]
        scores = [float(10 ** -p[np.searchsorted(have, grams(t))].mean()) if t and len(have) else None for t in table["text"].to_pylist()]
        sizes = pc.utf8_length(table["text"]).to_numpy()
        del have, p, order
        give_back()
        own = [table[c].combine_chunks() for c in ("row", "lang")]
        ids, numbers = table["id"].combine_chunks().cast(out.field("id").type), [pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays([ids, *own, *numbers, table["times"].combine_chunks()], schema=out)

    scored = rows.groupBy("by", "part").cogroup(values.groupBy("lang", "part")).applyInArrow(score, schema)
    if twice.isEmpty():
        return scored.drop("times")
    each = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("again")
    return scored.select("*", each).drop("times", "again")


def classify(
    df: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, margin: float = 1.5, least_ratio: float = 1.2, folds: int = 5, least_held: int = 20,
    id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """Score and verdict of every row of ``df``: id, row (hash of the text), lang, n_symbols, perplexity, threshold, keep.

    ``trusted_ids`` has the ids of trusted documents. The model is counted over their texts but for one in ``folds`` (by the
    text's hash, so copies stay together). Those held out give each language's limits: the median of their log perplexities, and
    the ``quantile`` of how far they lie above it, times the square root of their length, as the mean over a short text varies more.
    A document is rejected where its own distance passes ``margin`` times that, and its perplexity ``least_ratio`` times
    the median. A language with fewer than ``least_held`` texts held out has the limits of all (of the texts trained on, where none is held out).

    Null or empty texts have a null perplexity and are kept, and so is everything where nothing is
    trusted. Null languages are a language of their own, ''. Repeated rows get equal verdicts; a perplexity equal to its limit stays. An empty
    table gives an empty result. Other columns of ``df`` are not read, whatever their names.
    """
    texts = df.select(id_col, lang_col, text_col)
    trusted = known(texts, trusted_ids, id_col)
    held = F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(folds)) == 0
    model = train(trusted.filter(~held), lang_col, text_col)
    scored = reliable(perplexities(df, model, id_col=id_col, lang_col=lang_col, text_col=text_col))
    ids = trusted_ids.select(F.col(id_col).alias("trusted")).distinct()
    sample = scored.join(ids, F.col("id") == F.col("trusted"), "left_semi").filter("perplexity IS NOT NULL")
    sample = reliable(sample.select("lang", F.log10("perplexity").alias("l"), F.sqrt("n_symbols").alias("root"), (F.pmod("row", F.lit(folds)) == 0).alias("held")))
    out_ = sample.filter("held")
    out_ = sample if out_.isEmpty() else out_
    n = 10_000
    mids = counted(out_.groupBy("lang").agg(F.percentile_approx("l", 0.5, n).alias("own_mid"), F.count("*").alias("n")).filter(F.col("n") >= least_held).drop("n"), 100_000)
    mid = out_.agg(F.percentile_approx("l", 0.5, n).alias("x")).first()["x"]  # one number
    mid_of = F.coalesce("own_mid", F.lit(mid).cast("double"))
    far = reliable(out_.join(mids, "lang", "left").select("lang", F.col("own_mid").isNotNull().alias("own"), ((F.col("l") - mid_of) * F.col("root")).alias("d")))
    ends = counted(far.filter("own").groupBy("lang").agg(F.percentile_approx("d", quantile, n).alias("own_end")), 100_000)
    end = far.agg(F.percentile_approx("d", quantile, n).alias("x")).first()["x"]
    limit = mid_of + F.greatest(margin * F.coalesce("own_end", F.lit(end).cast("double")) / F.sqrt("n_symbols"), F.log10(F.lit(least_ratio)))
    judged = scored.join(mids, "lang", "left").join(ends, "lang", "left").withColumn("threshold", F.when(F.col("n_symbols") > 0, F.pow(F.lit(10.0), limit)))
    return judged.select(
        F.col("id").alias(id_col), "row", F.col("lang").alias(lang_col), "n_symbols", "perplexity", "threshold",
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"),
    )


def accepted(df: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``classify``'s verdicts on it keep, with all their columns. Those rejected are counted: up to two
    million are broadcast, more are joined by shuffle."""
    bad = counted(verdicts.filter("NOT keep").select(F.col(id_col).alias("id"), "row", F.col(lang_col).alias("lang")).distinct())
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(id_col).alias("own_id"), F.xxhash64(text_or_empty(text_col)).alias("own_row"), language(lang_col).alias("own_lang"))
    return own.join(bad, F.col("own_id").eqNullSafe(bad["id"]) & (F.col("own_row") == bad["row"]) & (F.col("own_lang") == bad["lang"]), "left_anti").select("own.*")
