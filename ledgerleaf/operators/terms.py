"""Many terms found in texts at once: one pass over the words, and look-ups of the words, not of the terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .literature import term, text_predicate

#: What stands between two words: anything but letters, numbers and the underline. CUT marks where the two part; it stands for no text of its own.
BETWEEN, CUT, INSTEAD = r"([^\p{L}\p{N}_]+)", "\x00", "\x01"
#: Bytes of texts that are cut into words together: a worker's memory goes by this and by its longest text, not by a batch.
RUN = 1_000_000


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def leaves(spec) -> set[str]:
    """The terms that a predicate's data names."""
    if isinstance(spec, str):
        return {spec}
    (kind, value), *rest = spec.items()
    if rest:
        raise ValueError("one key a node")
    if kind == "tag":
        return set()
    return leaves(value) if kind == "not" else set().union(*map(leaves, value))


def shape_of(text: str) -> tuple[int, int] | None:
    """(words, length of the part to compare or 0 for the whole) of a term that begins and ends with a word's character; None for others."""
    body = text.rstrip("*")
    if not body or not _wordy(body[0]) or not _wordy(body[-1]):
        return None
    starts = [k for k, c in enumerate(body) if _wordy(c) and (k == 0 or not _wordy(body[k - 1]))]
    return len(starts), len(body) if text.endswith("*") else 0


class Finder:
    """Terms by shape, as Arrow look-up tables."""

    def __init__(self, terms: Iterable[str]):
        self.shapes: dict[tuple[int, int], list[str]] = {}
        for t in terms:
            self.shapes.setdefault(shape_of(t), []).append(t)
        self.keys = {s: pa.array([t.rstrip("*").lower() for t in ts]) for s, ts in self.shapes.items()}
        # words that a term of several begins with
        self.heads = {s: pa.array(sorted({self.head(t) for t in ts})) for s, ts in self.shapes.items() if s[0] > 1}

    @staticmethod
    def head(text: str) -> str:
        body = text.lower()
        return body[: next(k for k, c in enumerate(body) if not _wordy(c))]

    def hits(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        """(row, number of the first word, terms) of all hits, shape by shape."""
        lower = pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), CUT, INSTEAD)
        cut = pc.split_pattern(pc.replace_substring_regex(lower, pattern=BETWEEN, replacement=rf"{CUT}\1{CUT}"), CUT)
        # of each text in turn: a word (the first and last may be empty), what is between, a word ...
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        ids, known = coded.indices.to_numpy(), coded.dictionary
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        place = np.arange(len(ids)) - offsets[row]
        word = np.flatnonzero(place % 2 == 0)
        empty = pc.index(known, "").as_py()
        skipped = (ids[np.minimum(offsets[:-1], max(len(ids) - 1, 0))] == empty).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        for shape, keys in self.keys.items():
            n, part = shape
            if n == 1:
                term_of = self.index(pc.utf8_slice_codeunits(known, 0, part) if part else known, keys)
                at = word[term_of[ids[word]] >= 0]
                which = term_of[ids[at]]
            else:
                head = self.index(known, self.heads[shape]) >= 0
                at = word[head[ids[word]]]
                at = at[at + 2 * n - 2 < offsets[row[at] + 1]]
                run = pc.binary_join_element_wise(*[known.take(pa.array(ids[at + k])) for k in range(2 * n - 1)], "")
                which = self.index(pc.utf8_slice_codeunits(run, 0, part) if part else run, keys)
                at, which = at[which >= 0], which[which >= 0]
            terms = self.shapes[shape]
            yield row[at], place[at] // 2 - skipped[row[at]], which, terms

    @staticmethod
    def index(values: pa.Array, keys: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(values, value_set=keys), -1).to_numpy(zero_copy_only=False)


def runs(batch: pa.RecordBatch, most: int = RUN) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (key, text) in runs of ``most`` bytes and a text at most."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(batch)]
    for a, z in zip(edges, edges[1:]):
        yield batch.slice(a, z - a)


def _found(df: DataFrame, terms: Iterable[str], col: str, key: str, positions: bool) -> DataFrame:
    terms = sorted(set(terms))
    even = [t for t in terms if shape_of(t)]
    odd = [t for t in terms if not shape_of(t)]
    if positions and odd:
        raise ValueError(f"terms without a word's character at both ends have no positions: {odd}")
    rows = df.select(F.col(key).alias("__row"), F.col(col).cast("string").alias("__text"))
    schema = StructType([rows.schema["__row"], *StructType.fromDDL("term string, pos int" if positions else "term string").fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(even)
        for b in (part for batch in batches for part in runs(batch)):
            for row, pos, which, names in finder.hits(b.column(1)):
                if not positions:
                    one = np.unique(row * len(names) + which)
                    row, which = np.divmod(one, len(names))
                term_ = pa.array(names).take(pa.array(which))
                cols = [b.column(0).take(pa.array(row)), term_] + ([pa.array(pos, pa.int32())] if positions else [])
                yield pa.RecordBatch.from_arrays(cols, schema=out)
            pa.default_memory_pool().release_unused()

    parts = [rows.filter(F.length("__text") > 0).mapInArrow(run, schema)] if even else []
    if odd:
        hits = F.array_compact(F.array(*[F.when(term(F.col("__text"), t), F.lit(t)) for t in odd]))
        parts.append(rows.select("__row", F.explode(hits).alias("term")))
    if not parts:
        parts = [rows.limit(0).select("__row", F.lit("").alias("term"))]
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumnRenamed("__row", key)


def find_terms(df: DataFrame, terms: Iterable[str], col: str, key: str, positions: bool = False) -> DataFrame:
    """key, term (and pos, the number of its first word): the terms that a row's text holds, as ``term`` tells them; in either case.

    Each batch of texts is cut into words once, by Arrow's own functions; its different words are looked up among the terms, for each shape that a term
    has (its words; a stem's length), and runs of words where a phrase can begin. So a thousand terms of the same shapes cost what one does, and
    no text is shuffled. Terms that begin or end with another character than a word's are searched one by one.

    Null texts hold nothing; without ``positions`` a term is found once for a key. The terms are a parameter of the call.
    """
    out = _found(df, terms, col, key, positions)
    return out if positions else out.distinct()


def holds(spec, found: Column, tags: Column | None = None) -> Column:
    """``text_predicate``'s test over the array of terms that were found."""
    return text_predicate(spec, found, tags, leaf=lambda c, t: F.array_contains(c, t))


def _true_of_nothing(spec) -> bool:
    if isinstance(spec, str):
        return False
    (kind, value), = spec.items()
    return {"tag": lambda: False, "not": lambda: not _true_of_nothing(value), "any": lambda: any(map(_true_of_nothing, value)), "all": lambda: all(map(_true_of_nothing, value))}[kind]()


def topic_membership(df: DataFrame, topics: dict, col: str, key: str) -> DataFrame:
    """key, topic: every topic whose test a row's text passes. All terms of all topics are found in one pass; see ``find_terms``.

    Keys are unique and not null. Rows without any term come in only where a topic is true of nothing.
    """
    found = _found(df, set().union(set(), *map(leaves, topics.values())), col, key, False).groupBy(key).agg(F.collect_set("term").alias("__found"))
    if any(map(_true_of_nothing, topics.values())):
        found = df.select(key, col).filter(F.col(col).isNotNull()).select(key).join(found, key, "left").withColumn("__found", F.coalesce("__found", F.array().cast("array<string>")))
    hits = F.array_compact(F.array(*[F.when(holds(spec, F.col("__found")), F.lit(name)) for name, spec in topics.items()]))
    return found.select(key, F.explode(hits).alias("topic"))


def near(df: DataFrame, one: str, other: str, within: int, col: str, key: str) -> DataFrame:
    """key: rows in which ``one`` and ``other`` begin at most ``within`` words apart, in either order.

    One pass over the places of both, in order, by row: each place meets the last one of the other term before it.
    """
    if one == other:
        raise ValueError("two different terms")
    places = find_terms(df, {one, other}, col, key, positions=True)
    w = Window.partitionBy(key).orderBy("pos", "term").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda t: F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(w)
    gap = F.col("pos") - F.when(F.col("term") == one, last(other)).otherwise(last(one))
    return places.withColumn("__gap", gap).filter(F.col("__gap") <= within).select(key).distinct()
