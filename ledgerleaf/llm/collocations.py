"""Phrases that occur more often than their parts let expect, counted by FM-indexes over word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import give_back, reliable

#: What ends a piece, and the word that stands for it in an index: no piece holds one of these characters.
ENDS, END = r"[.,;:!?\n\x0b\x0c\r]+", "."


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start to start + length, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Index:
    """FM-index of a sequence of word ids, whose suffixes are sorted by their first ``depth`` words. 0 ends a piece.

    Intervals of patterns of up to ``depth`` words are right; how suffixes that tie there are sorted makes no difference.
    """

    def __init__(self, words: np.ndarray, depth: int):
        n, size = len(words), int(words.max(initial=0)) + 1
        key, last, most = words.astype(np.int64), words, size
        for d in range(1, depth):
            last = np.where(last == 0, 0, np.append(words[d:], np.zeros(min(d, n), words.dtype))[:n])
            if most * size >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
                most = n
            key, most = key * size + last, most * size
        before = np.argsort(key, kind="stable") - 1
        self.size, self.n = size, n
        self.bwt = words[before].astype(np.int64)  # before the first word stands the last, an end
        self.places = np.sort(self.bwt * n + np.arange(n))  # by symbol, then by row
        self.first = np.searchsorted(self.places, np.arange(size + 1, dtype=np.int64) * n)  # rows that begin with smaller words

    def step(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows that begin with smaller words, and ``word``'s occurrences in the transform above ``row``."""
        return np.searchsorted(self.places, word * self.n + row)

    def extended(self, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of the patterns in [low, high) by the word before: number of the pattern, word, low, high, and low in the other
        direction's index, where ``other`` is the pattern's. An end extends nothing."""
        lengths = high - low
        at = np.repeat(np.arange(len(low)), lengths) * self.size + self.bwt[spread(low, lengths)]
        key, count = np.unique(at, return_counts=True)
        of, word = np.divmod(key, self.size)
        run = np.cumsum(count) - count  # symbols seen before, of smaller words in the same interval and of all earlier ones
        own = np.cumsum(lengths) - lengths
        start = self.step(word, low[of])
        out = of, word, start, start + count, other[of] + run - own[of]
        return tuple(x[word > 0] for x in out)


class Shard:
    """The words of some texts of one language, indexed in both directions."""

    def __init__(self, words: np.ndarray, depth: int):
        words = np.append(words[words.nonzero()[0][0] :], 0) if words.any() else words[:0]
        self.n = int(np.count_nonzero(words))
        self.ahead = Index(words, depth) if depth > 2 else None
        self.back = Index(words[::-1], depth) if self.n else None  # what stands before a word there follows it in the text

    def grams(self, longest: int, wanted=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each length up to ``longest``: grams (a row of word ids each) and counts.

        Two words are found by extending to the right; longer ones from those by extending to the left. ``wanted(grams)`` tells which of two
        words or more are to be extended further, and which longer ones are kept by their last and first part.
        """
        if not self.n:
            return
        word = np.flatnonzero(np.diff(self.back.first)[1:]) + 1
        low, high = self.back.first[word], self.back.first[word + 1]
        yield word[:, None], high - low
        if longest < 2:
            return
        of, after, back_low, back_high, ahead_low = self.back.extended(low, high, low)
        grams = np.stack([word[of], after], 1)
        yield grams, back_high - back_low
        low, high = ahead_low, ahead_low + back_high - back_low
        for _ in range(3, longest + 1):
            keep = wanted(grams)
            grams, low, high = grams[keep], low[keep], high[keep]
            of, before, low, high, _ = self.ahead.extended(low, high, low)
            grams = np.concatenate([before[:, None], grams[of]], 1)
            keep = wanted(grams[:, :-1])
            grams, low, high = grams[keep], low[keep], high[keep]
            yield grams, high - low


def word_ids(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts as ids, 0 where a piece ends, and the words by id."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    marked = pc.binary_join_element_wise(pc.replace_substring_regex(lower, pattern=ENDS, replacement=f" {END} "), f" {END} ", "")
    coded = pc.ascii_split_whitespace(marked).flatten().dictionary_encode()
    known, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    end, none = (pc.index(known, x).as_py() for x in (END, ""))
    if none >= 0:  # what stands before a first or behind a last blank
        ids = ids[ids != none]
    ids = np.where(ids == end, 0, np.where(ids == 0, end, ids))
    order = np.arange(len(known))
    order[[0, end]] = order[[end, 0]]
    return ids, known.take(pa.array(order))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of a gram's words, column by column."""
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15, np.uint64)
    for w in words:
        h = (h ^ w) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def word_hashes(words: list[str], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with up to ``most_bytes`` of text, one row at least. Texts are its last column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most_bytes, "right")))
        yield batch.slice(a, b - a)
        a = b


def shard_counts(df: DataFrame, lengths: range, maps: dict | None = None, shard_bytes: int = 5_000_000) -> DataFrame:
    """lang, gram, n of every shard: grams of ``lengths`` words, and the empty gram, whose n is the number of words, where 1 is among them.

    ``df`` has lang and text. A shard is some texts of one language, up to ``shard_bytes`` of them or one text. ``maps``: by length, bit maps of the hashes of
    grams that occur often enough; a longer gram is counted where its two parts are in them.
    """
    schema = StructType.fromDDL("lang string, gram string, n long")
    out = to_arrow_schema(schema)
    depth = lengths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: np.frombuffer(b.value, np.uint8) for k, b in (maps or {}).items()}
        for piece in (p for b in batches for p in slices(b, shard_bytes)):
            for lang in pc.unique(piece.column(0)).to_pylist():
                ids, known = word_ids(piece.column(1).filter(pc.equal(piece.column(0), lang)))
                shard = Shard(ids, depth)
                if 1 in lengths and shard.n:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([shard.n])], schema=out)
                hashes = word_hashes(known.to_pylist(), lang) if own else None
                wanted = lambda g: in_map(own[g.shape[1]], gram_hash([hashes[c] for c in g.T]))  # noqa: E731, B023
                for grams, count in shard.grams(depth, wanted):
                    if grams.shape[1] in lengths and len(grams):
                        parts = [known.take(pa.array(c)) for c in grams.T]
                        text = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(count)), text, pa.array(count)], schema=out)
            give_back()

    return df.select("lang", "text").mapInArrow(run, schema)


def bit_map(often: DataFrame, bits: int) -> np.ndarray:
    """A bit map of ``bits`` bits (a power of 2) with the hashes of all grams of ``often`` (lang, gram): always of one size, whatever their number."""
    schema = StructType.fromDDL("at long, bits long")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                words = pc.split_pattern(b.column(1).filter(pc.equal(b.column(0), lang)), " ")
                coded, k = words.flatten().dictionary_encode(), len(words[0])
                h = word_hashes(coded.dictionary.to_pylist(), lang)[coded.indices.to_numpy()].reshape(-1, k)
                at = np.unique(gram_hash(list(h.T)) & np.uint64(bits - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], schema=out)

    rows = often.select("lang", "gram").mapInArrow(run, schema).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(max(1, bits >> 6), np.int64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return words.astype("<i8").view(np.uint8)


def frequent_grams(df: DataFrame, longest: int = 3, least: int = 10, map_bits: int = 1 << 26) -> DataFrame:
    """lang, gram, n, words: all grams of up to ``longest`` words with ``least`` or more occurrences; the empty gram has the number of words, whatever it is.

    Counts of shards are added up by Spark. One and two words come first; of longer ones only those are counted whose first and last part (a word
    less) may be frequent, as tells a bit map of ``map_bits`` bits (8 MB). It never loses one, and as it does not grow with the data, all
    executors can have it; where it is full, more grams are counted in vain.
    """
    if longest < 2 or map_bits & (map_bits - 1) or map_bits < 64:
        raise ValueError("two words or more, and a power of 2 of bits from 64 on")
    sc, maps = df.sparkSession.sparkContext, {}
    add = lambda x: x.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("gram") == ""))
    words = F.when(F.col("gram") == "", 0).otherwise(F.size(F.split("gram", " ")))
    found = reliable(add(shard_counts(df, range(1, 3))).withColumn("words", words))
    for k in range(3, longest + 1):
        maps[k - 1] = sc.broadcast(bit_map(found.filter(F.col("words") == k - 1), map_bits).tobytes())
        more = add(shard_counts(df, range(k, k + 1), maps)).withColumn("words", F.lit(k))
        found = reliable(found.unionByName(more))
    return found


def collocations(
    df: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, map_bits: int = 1 << 26, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words. A phrase has 2 to ``longest``
    words and ``least`` or more occurrences within pieces (a). Cut after some of its words it has parts with l and r occurrences and the score
    floor(1000000 a a / (l r)), exact; the cut of the lowest score counts, the earliest of several. A phrase goes if a longer one, with at least
    ``covered`` percent of its occurrences, holds it. n is the language's number of words.

    Null and empty texts hold no words; a null language is ``und``. Repeated rows and null ids count each. An empty table gives no phrases. Other columns are ignored, whatever their names.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    grams = frequent_grams(docs, longest, least, map_bits)
    found = grams.filter("words > 1").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.split("gram", " ").alias("w"))
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("first"), join(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    part = lambda on, n: grams.select("lang", F.col("gram").alias(on), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(_score(), "cut", "l", "r")).alias("b"))
    size = F.size("w")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))))
    longer = found.filter(size > 2).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    nth = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= top)
    total = grams.filter("words = 0").select("lang", F.col("n"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


def _score() -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits; at most 1000000, as no part is rarer than the phrase."""
    n = lambda c: F.col(c).cast("decimal(16,0)")
    return F.call_function("div", (n("a") * n("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (n("l") * n("r")).cast("decimal(32,0)")).cast("long").alias("score")
