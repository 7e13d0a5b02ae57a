"""Links between the tokens of two tokenizers over the same bytes, by products of sparse matrices."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .collocations import spread
from .common import give_back, reliable
from .packing import LONG_SPACE, IdBytes
from .tokens import byte_symbols, vocabulary


class Csr(NamedTuple):
    """A sparse matrix of ones by rows: row i has the columns indices[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    indices: np.ndarray

    @classmethod
    def runs(cls, lengths: np.ndarray) -> "Csr":
        """Row i has the next lengths[i] columns."""
        starts = np.append(0, np.cumsum(lengths))
        return cls(starts, np.arange(starts[-1]))

    @classmethod
    def ones(cls, column: np.ndarray) -> "Csr":
        """Row i has one column."""
        return cls(np.arange(len(column) + 1), column)

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def product_lengths(a: Csr, b: Csr) -> np.ndarray:
    """Terms that each row of a·b adds up: the symbolic pass, which makes no term."""
    sums = np.append(0, np.cumsum(b.lengths()[a.indices]))
    return sums[a.starts[1:]] - sums[a.starts[:-1]]


def product(a: Csr, b: Csr, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of all entries of a·b, row by row: each entry (i, k) of ``a`` adds row k of ``b`` to row i."""
    times = b.lengths()[a.indices]
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), a.lengths()), times)
    key = row * columns + b.indices[spread(b.starts[a.indices], times)]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // max(columns, 1), key[first] % max(columns, 1), np.diff(first, append=len(key))


class Vocabularies:
    """Two vocabularies: byte-level merges (A) and pieces (B), their encoders and each token's bytes."""

    def __init__(self, a: str, b: str):
        a = vocabulary(a)
        self.coder = IdBytes(a)  # its own, as it is set differently
        self.coder.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = {c: x for x, c in enumerate(byte_symbols())}
        entries = {i: t for t, i in self.coder.lib.get_vocab(with_added_tokens=True).items()}
        self.a = self.table([bytes(byte[c] for c in t) if (t := entries.get(i)) and all(c in byte for c in t) else (t or "").encode() for i in range(max(entries) + 1)])
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(b))
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b = self.table([bytes([int(t[3:-1], 16)]) if sp.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)])
        self.blank = next((i for i, t in enumerate(names) if t == "▁"), None)
        # B must not merge across a blank behind another character, nor treat a blank otherwise than by its sign
        whole = [sp.id_to_piece(i) for i in sp.encode("a  b ")]
        self.cut = self.coder.fast is not None and self.blank is not None and not any(re.search("[^▁]▁", t) for t in names) and "".join(whole) == "▁a▁▁b▁"

    @staticmethod
    def table(tokens: list[bytes]) -> tuple[np.ndarray, Csr]:
        data = np.frombuffer(b"".join(tokens), np.uint8)
        return data, Csr.runs(np.fromiter(map(len, tokens), np.int64, len(tokens)))

    def a_ids(self, text: str) -> list[int]:
        if self.coder.fast is None or len(text) >= 50_000 and LONG_SPACE.search(text):
            return self.coder.lib.encode(text, add_special_tokens=False).ids
        return self.coder.fast.encode_ordinary(text)

    def both(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that begin with the blank that B adds itself."""
        b = self.pieces.encode([c[1:] for c in chunks], num_threads=1)
        return [self.a_ids(c) for c in chunks], [x if c != " " else [self.blank] for x, c in zip(b, chunks, strict=True)]


@lru_cache(maxsize=2)
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Where both tokenizers part texts in any case: before a blank behind a character that is surely no white space or control."""
    at = np.flatnonzero(data[1:] == 0x20) + 1
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    return at[(one > 0x20) & ((one < 0x80) | ~wide)]


class Chunks:
    """Texts cut into chunks, and the different chunks aligned.

    of: the chunk of each place in the texts; starts: the first place of each text. Of each chunk: good (both
    token rows give its bytes), n_a, n_b, n_groups, n_links, n_shared. Of each link of the chunks: chunk, a, b (ids) and value (bytes shared).
    """

    def __init__(self, texts: list[bytes], vocab: Vocabularies, cut: bool):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(x for t in texts for x in (b" ", t)), np.uint8)
        begins = np.zeros(len(data), bool)
        begins[ends - sizes] = True
        if cut:
            begins[cut_points(data)] = True
        begin = np.flatnonzero(begins)
        self.starts = np.searchsorted(begin, np.append(0, ends))
        offsets = pa.array(np.append(begin, len(data)), pa.int64()).buffers()[1]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        self.of = coded.indices.to_numpy()
        own, n = coded.dictionary, len(coded.dictionary)
        at = np.frombuffer(own.buffers()[1], np.int64)[: n + 1]
        size, content = np.diff(at), np.frombuffer(own.buffers()[2], np.uint8)[: at[-1]]
        del begins, begin, offsets, coded, data
        made: tuple[list, list, list, list] = ([], [], [], [])
        for k in range(0, n, 10_000):  # lists of few chunks at a time
            for side, ids in enumerate(vocab.both(own.slice(k, 10_000).cast(pa.large_string()).to_pylist())):
                made[side].append(np.fromiter(chain.from_iterable(ids), np.int64))
                made[2 + side].append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat = [np.concatenate(x) for x in made[:2]]
        home = [np.repeat(np.arange(n), np.concatenate(x)) for x in made[2:]]
        del made
        long = [t.lengths()[f] for f, (_, t) in zip(flat, (vocab.a, vocab.b), strict=True)]
        self.good = np.ones(n, bool)
        for h, w in zip(home, long, strict=True):
            self.good &= np.bincount(h, w, n).astype(np.int64) == size
        where, good = np.repeat(np.arange(n), size), self.good.copy()
        want, where = (content, where) if good.all() else (content[good[where]], where[good[where]])
        for f, h, w, (tokens, t) in zip(flat, home, long, (vocab.a, vocab.b), strict=True):
            on = good[h]
            self.good[where[tokens[spread(t.starts[f[on]], w[on])] != want]] = False
        del where, want
        keep = [self.good[h] for h in home]
        (a, b), (a_home, b_home), (a_long, b_long) = ([x[k] for x, k in zip(xs, keep, strict=True)] for xs in (flat, home, long))
        self.align(n, a, b, a_home, b_home, a_long, b_long)

    def align(self, n: int, a, b, a_home, b_home, a_long, b_long) -> None:
        total = int(a_long.sum())
        # tokens by bytes, and bytes by tokens: the product's values are the bytes that two tokens share
        of_byte = Csr.ones(np.repeat(np.arange(len(b)), b_long))
        i, j, self.value = product(Csr.runs(a_long), of_byte, len(b))
        self.chunk, self.a, self.b = a_home[i], a[i], b[j]
        a_end, b_end = np.cumsum(a_long), np.cumsum(b_long)
        ends = np.zeros(total + 1, np.int8)
        ends[a_end] += 1
        ends[b_end] += 1
        group = np.cumsum(ends == 2)
        a_group, b_group = group[a_end - a_long], group[b_end - b_long]
        # tokens by groups, and groups by tokens: the product's entries are the pairs that share a group
        self.by_group = Csr.ones(a_group), Csr.runs(np.bincount(b_group, minlength=int(group[-1]) if total else 0))
        shared = product_lengths(*self.by_group)
        count = lambda home, w=None: np.bincount(home, w, n).astype(np.int64)
        first = np.append(True, a_group[1:] != a_group[:-1])[: len(a)]
        self.n_a, self.n_b, self.n_links, self.n_shared, self.n_groups = count(a_home), count(b_home), count(self.chunk), count(a_home, shared), count(a_home[first])
        self.tokens = a, b, a_group, b_group, a_home

    def shared_groups(self, rows: int = 100_000):
        """Positions of the A and B tokens of all shared-group links, in blocks of ``rows`` A tokens."""
        a, b = self.by_group
        for k in range(0, len(a.indices), rows):
            i, j, _ = product(Csr.ones(a.indices[k : k + rows]), b, len(self.tokens[1]))
            yield i + k, j

    def told(self) -> list[str]:
        """Of each text its groups, as ids: a1,a2|b1;a3|b2."""
        a, b, a_group, b_group, _ = self.tokens
        join = lambda at, values, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), values), by)
        ids = lambda x, g: join(np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)), pa.array(x).cast(pa.string()), ",")
        groups = pc.binary_join_element_wise(ids(a, a_group), ids(b, b_group), "|")
        chunks = join(np.append(0, np.cumsum(self.n_groups)), groups, ";")
        return join(self.starts, chunks.take(pa.array(self.of)), ";").to_pylist()

    def sums(self, of_chunk: np.ndarray) -> np.ndarray:
        """For each text the sum over its chunks."""
        run = np.append(0, np.cumsum(of_chunk[self.of]))
        return run[self.starts[1:]] - run[self.starts[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a, b of the different linked id pairs, and each link's pair."""
        width = int(self.b.max(initial=0)) + 1
        key, of = np.unique(self.a * width + self.b, return_inverse=True)
        return key // width, key % width, of

    def text_pairs(self, pair_of: np.ndarray, n_pairs: int, cells: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The matrix of texts by pairs, whose values are the links: of each text its pairs, rising, and their times.

        Runs of texts with up to ``cells`` entries, or one text, are added up at a time.
        """
        links = np.searchsorted(self.chunk, np.arange(len(self.good) + 1))  # links stand by chunk
        each, many = np.diff(links), max(1, cells // max(n_pairs, 1))
        for k in range(0, len(self.starts) - 1, many):
            starts = self.starts[k : k + many + 1]
            of = self.of[starts[0] : starts[-1]]
            text = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), each[of])
            times = np.bincount(text * n_pairs + pair_of[spread(links[of], each[of])], minlength=(len(starts) - 1) * n_pairs)
            held = np.flatnonzero(times)
            ends = np.searchsorted(held, np.arange(len(starts)) * n_pairs)
            for i, (p, q) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                yield held[p:q] - i * n_pairs, times[held[p:q]]


def aligned(texts: list[bytes], vocab: Vocabularies) -> list[tuple[np.ndarray, Chunks]]:
    """The texts that both tokenizers give back byte for byte, as (numbers of texts, their chunks).

    A text with a chunk that is not given back is tried once more as one chunk; what fails then has no tokens.
    """
    out, rest = [], np.arange(len(texts))
    for cut in (True, False) if vocab.cut else (False,):
        if not len(rest):
            break
        chunks = Chunks([texts[i] for i in rest], vocab, cut)
        bad = chunks.sums((~chunks.good).astype(np.int64)) > 0
        if bad.any() and not bad.all():
            chunks = Chunks([texts[i] for i in rest[~bad]], vocab, cut)
        if not bad.all():
            out.append((rest[~bad], chunks))
        rest = rest[bad]
    return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
KEY = ["block", "h1", "h2"]


def different_texts(df: DataFrame, block_bytes: int, text_col: str) -> DataFrame:
    """block, h1, h2, text, copies: texts that are not empty, equal ones of an Arrow batch as one row.

    The block comes from the text's hash; there are so many that one holds about ``block_bytes``.
    """
    text = F.col(text_col).cast("string")
    some = df.filter(F.length(text) > 0)
    blocks = max(1, -(-(some.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block_bytes))
    rows = some.select(F.pmod(F.xxhash64(F.lit(3), text), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(7), text).alias("h1"), F.xxhash64(text).alias("h2"), text.alias("text"))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("copies long").fields])
    out = to_arrow_schema(schema)

    def once(batches):
        for b in batches:
            h = np.rec.fromarrays([b.column(k).to_numpy() for k in (1, 2)])
            _, first, copies = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(first)).columns, pa.array(copies)], schema=out)

    return rows.mapInArrow(once, schema)


def _block(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Different texts of a block with the sum of their copies, and both hashes."""
    h = np.rec.fromarrays([t[c].to_numpy() for c in ("h1", "h2")])
    own, first, of = np.unique(h, return_index=True, return_inverse=True)
    texts = t["text"].cast(pa.large_binary()).take(pa.array(first)).to_pylist()
    return texts, np.bincount(of, t["copies"].to_numpy(), len(own)).astype(np.int64), own["f0"], own["f1"]


#: A block's row for each text: its numbers and, packed, its pairs; and one row for the block (times null): the pairs, and how many documents hold each.
PARTS = "block long, h1 long, h2 long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, times binary, pairs array<struct<a: int, b: int, n: bigint>>"


def aligned_block(t: pa.Table, a: str, b: str, out: pa.Schema) -> pa.Table:
    """The rows of ``PARTS``, here ``out``, for a block's texts."""
    own, copies, h1, h2 = _block(t)
    rows: list[tuple] = []
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    block, before = t["block"][0].as_py(), 0
    for at, chunks in aligned(own, vocabularies(a, b)):
        pa_, pb_, of = chunks.pairs()
        n, packed = np.zeros(len(pa_), np.int64), []
        for (held, times), many in zip(chunks.text_pairs(of, len(pa_)), copies[at].tolist(), strict=True):
            n[held] += many
            packed.append(zlib.compress(np.concatenate([np.diff(held + before, prepend=0), times]).astype("<u4").tobytes(), 1))
        sums = [chunks.sums(getattr(chunks, c)).tolist() for c in COUNTS]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in chunks.told()]
        rows += zip([block] * len(at), h1[at].tolist(), h2[at].tolist(), *sums, sha, packed, [None] * len(at), strict=True)
        keys.append(np.stack([pa_, pb_], 1))
        counts.append(n)
        before += len(pa_)
    give_back()
    if not rows:
        return out.empty_table()
    pairs = pa.StructArray.from_arrays([*map(pa.array, np.concatenate(keys).T.astype(np.int32)), pa.array(np.concatenate(counts))], fields=list(out.field("pairs").type.value_type))
    columns = [pa.array([*c, block if k == 0 else None], f.type) for k, (c, f) in enumerate(zip(zip(*rows, strict=True), out, strict=True)) if f.name != "pairs"]
    lists = pa.ListArray.from_arrays(pa.array([*[0] * (len(rows) + 1), len(pairs)], pa.int32()), pairs)
    return pa.Table.from_arrays([*columns, lists], schema=out)


def align(
    df: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Of every document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared.

    A text has one blank put before it and is encoded by ``a`` (byte-level merges) and ``b`` (pieces). A·Bᵀ of the tokens' byte incidences gives the links, tokens that
    share bytes; ends common to both part the tokens into groups, and the product of the group incidences gives the pairs that share a group (n_shared).
    An id pair counts the documents of the whole table that hold it linked; n_best are the links whose count is the highest of their A id, count_sum adds the links' counts up.

    Different texts are dealt into blocks by their hash and encoded once. A block keeps of each text its row of the matrix texts by pairs; its pairs are counted,
    summed over all blocks by Spark and come back by a join, and the rows are multiplied with them. So no task
    holds more of the corpus than its block and that block's pairs. Equal texts are one with their number.

    Null and empty texts and those that a tokenizer does not give back byte for byte have zeros and an empty digest. Repeated rows
    and null ids have a row each; an empty table gives none. Other columns are ignored, whatever their names. A very long text is a block's largest part; it is never cut but where both tokenizers cut.
    """
    parts = StructType.fromDDL(PARTS)
    rows = to_arrow_schema(parts)
    made = reliable(different_texts(df, block_bytes, text_col).groupBy("block").applyInArrow(lambda t: aligned_block(t, a, b, rows), parts))
    asked = made.filter("times IS NULL").select("block", F.posexplode("pairs").alias("pos", "p")).select("block", "pos", "p.*")
    counts = reliable(asked.groupBy("a", "b").agg(F.sum("n").alias("n")))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    told = counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    told = asked.drop("n").join(told, ["a", "b"]).select(F.col("block").alias("of_block"), "pos", "n", "best")
    names = [c for c in parts.names if c not in ("block", "times", "pairs")]
    schema = StructType([*[parts[c] for c in names], *StructType.fromDDL("n_best long, count_sum long").fields])
    out = to_arrow_schema(schema)

    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told["pos"].to_numpy())
        n, is_best = told["n"].to_numpy()[order], told["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        both = []
        for x in t["times"].to_pylist():
            held, times = np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64).reshape(2, -1)
            held = np.cumsum(held)
            both.append((int(times @ is_best[held]), int(times @ n[held])))
        return pa.Table.from_arrays([*[t[c] for c in names], *[pa.array([x[k] for x in both], pa.int64()) for k in (0, 1)]], schema=out)

    each = made.filter("times IS NOT NULL").drop("pairs").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(run, schema)
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).alias("id"), F.when(F.length(text) > 0, F.xxhash64(F.lit(7), text)).alias("h1"), F.when(F.length(text) > 0, F.xxhash64(text)).alias("h2"))
    numbers = [c for c in schema.names if c.startswith(("n_", "count"))]
    return docs.join(each, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
