"""Best-fit packing of token sequences by fitted length patterns."""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import per_text, reliable, with_id_type
from .tokens import byte_symbols, vocabulary

#: White space beyond the depth of the fast encoder's pattern matcher.
LONG_SPACE = re.compile(r"\s{50000}")


class IdBytes:
    """Token ids of texts as little-endian unsigned 32-bit bytes, those that the tokenizers library gives.

    A byte-level vocabulary file whose ids follow its merges, split by the public pattern, is encoded by
    tiktoken, which gives the same ids in half the time (the tests compare the characters of the first three planes and odd strings; no
    other planes). Any other file, and texts with white space of 50,000 characters, where its pattern matcher runs out of depth, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            self.fast = self.same_ids(json.load(f))

    @staticmethod
    def same_ids(spec: dict) -> tiktoken.Encoding | None:
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {k: v for k, v in model["vocab"].items() if k not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
        affixes = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        by_rank = len(ids) == 256 + len(pairs) and all(ids.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        if not plain or affixes or not by_rank or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return None
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in k): v for k, v in ids.items()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> bytes:
        if self.fast is None or len(text) >= 50_000 and LONG_SPACE.search(text):
            return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=4)
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


def pieces(
    df: DataFrame, capacity: int = 2048, vocab: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text and its end id: id, piece, start, length, ids_crc32.

    A text that fits is one piece. A longer one is cut so that every piece but the first is full.
    """
    schema = with_id_type(df, "piece int, start long, length long, ids_crc32 long", id_col)
    end = np.asarray([end_id], "<u4").tobytes()

    def rows(key, text):
        ids = id_bytes(vocabulary(vocab)).of(text) + end
        n = len(ids) // 4
        first = n % capacity or min(n, capacity)
        cuts = [0, *range(first, n + 1, capacity)]
        return [
            (key, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]

    return per_text(df, rows, schema, id_col, text_col)


def patterns(capacity: int, steps: int = 8) -> np.ndarray:
    """Length patterns of two to four documents that fill a sequence exactly, padded with 0.

    All pairs; for triples each smallest length with ``steps`` spread middle lengths; for quadruples
    each smallest length up to a quarter with ``steps`` spread pairs of middle lengths. The offset of
    the spread turns by the golden ratio from length to length, so that middle lengths of every residue occur.
    """
    c, golden = capacity, (5**0.5 - 1) / 2
    a = np.arange(1, c // 2 + 1)
    found = [np.stack([a, c - a, 0 * a, 0 * a], 1)]
    turn = lambda x, k: (k + (x * golden) % 1) / steps
    for k in range(steps):
        a = np.arange(1, c // 3 + 1)
        b = a + ((c - 3 * a) // 2 * turn(a, k)).astype(int)
        found.append(np.stack([a, b, c - a - b, 0 * a], 1))
        a = np.arange(1, c // 4 + 1)
        b = a + ((c - 4 * a) // 3 * turn(a, k)).astype(int)
        d = b + ((c - a - 3 * b) // 2 * turn(a + 7, (3 * k) % steps)).astype(int)
        found.append(np.stack([a, b, d, c - a - b - d], 1))
    p = np.concatenate(found)
    return np.unique(np.sort(p[(p >= 0).all(1)], 1)[:, ::-1], axis=0)


def fit_repeats(hist: np.ndarray, pats: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, A's columns being the patterns' length counts.

    Accelerated projected gradient (with restarts): the matrix has four entries a column, so a round is
    one gather and one scatter. Lengths are weighted by 1/sqrt(1 + count) so that rare ones count too.
    """
    w = 1 / np.sqrt(1 + hist)
    w[0] = 0
    target, n = hist * w, len(hist)
    flat = pats.ravel()

    def forward(x):
        return np.bincount(flat, np.repeat(x, pats.shape[1]) * w[flat], n)

    def back(r):
        return (r * w)[pats].sum(1)

    v = np.ones(len(pats))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (np.linalg.norm(v) * 1.05 + 1e-12)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        g = back(forward(y) - target)
        new = np.maximum(0, y - step * g)
        if g @ (new - x) > 0:
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit_groups(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram: (lengths of one sequence, how many such sequences)."""
    open_at: dict[int, list[tuple[list[int], int]]] = {}
    mask = 0  # bit r: some open sequence has r tokens left

    def put(room: int, group: tuple[list[int], int]) -> None:
        nonlocal mask
        open_at.setdefault(room, []).append(group)
        mask |= 1 << room

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            if fits := mask >> length:
                room = length + (fits & -fits).bit_length() - 1
                inside, count = open_at[room].pop()
                if not open_at[room]:
                    mask &= ~(1 << room)
                if count > n:
                    put(room, (inside, count - n))
                    count = n
                put(room - length, ([*inside, length], count))
                n -= count
            else:
                each = min(n, capacity // length)
                put(capacity - each * length, ([length] * each, n // each))
                n -= n // each * each
    return [g for groups in open_at.values() for g in groups]


def plan_groups(hist: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Sequences for a histogram of lengths 1..capacity: fitted, rounded patterns, then the residuals, packed best-fit."""
    left = hist.astype(np.int64).copy()
    pats = patterns(capacity)
    repeats = np.round(fit_repeats(hist.astype(float), pats)).astype(np.int64)
    groups: list[tuple[list[int], int]] = []
    for k in np.argsort(-repeats, kind="stable"):
        if not repeats[k]:
            break
        lengths, mult = np.unique(pats[k][pats[k] > 0], return_counts=True)
        n = int(min(repeats[k], (left[lengths] // mult).min()))
        if n:
            left[lengths] -= n * mult
            groups.append((pats[k][pats[k] > 0].tolist(), n))
    return groups + best_fit_groups(left, capacity)


def slots(groups: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """The plan by (length, rank): arrays of keys' starts (length * 2^40 + rank), first sequence, offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in groups:
        at = 0
        for length in lengths:
            rank = used.get(length, 0)
            used[length] = rank + n
            rows.append(((length << 40) + rank, base, at))
            at += length
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pack(
    df: DataFrame, capacity: int = 2048, vocab: str = "byte_bpe_50k.json", end_id: int = 0, bucket_rows: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every piece of every text with its place: id, piece, start, length, ids_crc32, sequence_id, offset.

    The plan is made on the histogram of lengths, at most ``capacity`` numbers whatever the input: fit
    repeat counts of enumerated patterns by non-negative least squares, round, pack the rest best-fit.
    A piece finds its place by its rank among pieces of its length. Ranks come from counts by (length,
    salt) and a row number inside each of these, so a length that many texts share is spread too. The
    plan that is broadcast has a few rows for each length and pattern, not for each document.

    A null or empty text is one piece, the end id alone; a long one has all its pieces. Repeated rows are packed each on its own; null
    ids are kept. Pieces of equal length are told apart by id, piece and digest; equal ones may change places. Other columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    cut = reliable(pieces(df, capacity, vocab, end_id, id_col, text_col))
    hist = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # one row a length
        hist[r["length"]] = r["count"]
    plan = spark.sparkContext.broadcast(slots(plan_groups(hist, capacity)))
    salts = int(max(64, hist.sum() // bucket_rows))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = (
        salted.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32", "start")))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("rn") - 1)
        .select(id_col, "piece", "start", "length", "ids_crc32", "rank")
    )
    schema = with_id_type(df, "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", id_col)

    def place(batches):
        keys, base, at = plan.value
        for pdf in batches:
            key = (pdf["length"].to_numpy() << 40) + pdf["rank"].to_numpy()
            k = np.searchsorted(keys, key, "right") - 1
            yield pd.DataFrame({c: pdf[c] for c in [id_col, "piece", "start", "length", "ids_crc32"]} | {"sequence_id": base[k] + key - keys[k], "offset": at[k]})

    return ranked.mapInPandas(place, schema)
