"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, reliable, with_id_type

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIM, WINDOW, LONGEST = 1 << 17, 4, 6, 40
#: Lengths of the character n-grams.
SIZES = (3, 4, 5, 6)
#: Sharpness of the soft maximum over the windows of a text.
SHARP = 4.0
#: What a clean text called toxic costs, against a toxic one missed.
CLEAN_COST = 3.0
#: Step, decay and floor of the training.
RATE, DECAY, FLOOR = 0.6, 0.001, 0.05


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of each word's subwords: itself and its character n-grams of SIZES,
    with marks at both ends. Rolling hashes over all words at once, so the work is in proportion to their length.
    """
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    whole = np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marked], np.int64)
    buckets, owners = [whole], [np.arange(len(words))]
    h = np.zeros(len(code), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(left[: len(h)] >= n)
            mixed = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(owner[at])
        if not len(h):
            break
    return np.concatenate(buckets), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    """The text's distinct words, by first occurrence: a word repeated a thousand times says no more than one."""
    return list(dict.fromkeys(WORD.findall(text.lower())))


def soft_max(z: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each run of ``z`` that begins at ``starts``, and each entry's share in it."""
    top = np.maximum.reduceat(z, starts)
    size = np.diff(np.append(starts, len(z)))
    e = np.exp(SHARP * (z - np.repeat(top, size)))
    total = np.add.reduceat(e, starts)
    return top + np.log(total) / SHARP, e / np.repeat(total, size)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 160, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weight of each subword bucket, bias and scale of the log odds.

    A text's distinct words are cut into windows of WINDOW words. A window's vector is the mean over its words of the
    mean of their subwords' embeddings; a linear softmax of two classes scores it; the text has the
    soft maximum of its windows. Embeddings and softmax are trained together by gradient descent on log
    loss, with the steps of each bucket scaled by its past gradients. A fifth of the texts is held back: the round with the least loss there is
    taken, and its best cut becomes probability one half. Scoring needs only the product of embeddings
    and class weights, one number a bucket.
    """
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    flat, win_len, win_doc = [], [], []
    for d, text in enumerate(texts):
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(text)] or [vocab.setdefault("", len(vocab))]
        flat += ids
        n = len(ids)
        sizes = [WINDOW] * (n // WINDOW) + [n % WINDOW] * bool(n % WINDOW)
        win_len += sizes
        win_doc += [d] * len(sizes)
    flat, win_len, win_doc = np.array(flat), np.array(win_len), np.array(win_doc)
    win_start = np.cumsum(win_len) - win_len
    doc_start = np.flatnonzero(np.diff(win_doc, prepend=-1))
    bag, bag_word = subwords(list(vocab))
    bag_len = np.bincount(bag_word, minlength=len(vocab))
    held = rng.random(len(texts)) < 0.2
    y = labels.astype(float)
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y)[~held].sum())))
    emb = rng.normal(0, 0.05, (BUCKETS, DIM))
    cls = rng.normal(0, 1, (DIM, 2))
    bias, seen, rate, decay, floor = -1.0, np.zeros(BUCKETS), RATE, DECAY, FLOOR
    best = (np.inf, None)
    for k in range(rounds):
        diff = cls[:, 1] - cls[:, 0]
        bucket = emb @ diff
        word = np.bincount(bag_word, bucket[bag], len(vocab)) / bag_len
        z_win = WINDOW * np.add.reduceat(word[flat], win_start) / np.maximum(win_len, WINDOW // 2) + bias
        z, share = soft_max(z_win, doc_start)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if held.any():
            loss = -np.mean(np.where(y[held] > 0, np.log(p[held] + 1e-9), np.log(1 - p[held] + 1e-9)))
            if loss < best[0]:
                best = (loss, (bucket.copy(), bias, z.copy()))
        g_win = ((p - y) * weight)[win_doc] * share
        g_word = np.bincount(flat, np.repeat(g_win * WINDOW / np.maximum(win_len, WINDOW // 2), win_len), len(vocab))
        g_bucket = np.bincount(bag, (g_word / bag_len)[bag_word], BUCKETS)
        # steps shrink with a bucket's past gradients; the floor keeps buckets of few texts nearly still
        seen += g_bucket**2
        step = rate * g_bucket / (np.sqrt(seen) + floor * np.sqrt(seen.max()) + 1e-12)
        g_diff = emb.T @ g_bucket
        emb -= step[:, None] * (diff / (diff @ diff))[None, :] + decay * emb
        cls -= 0.02 * np.stack([-g_diff, g_diff], 1) / (np.abs(g_diff).max() + 1e-12)
        bias -= 0.5 * float(g_win.sum())
    bucket, bias, z = best[1] if best[1] is not None else (emb @ (cls[:, 1] - cls[:, 0]), bias, z)
    zs, ys = z[held], y[held]
    if len(set(ys.tolist())) == 2:
        order = np.argsort(-zs)
        # cost if the first k are called toxic; of the best cuts the middle one
        wrong = CLEAN_COST * np.append(0, np.cumsum(1 - ys[order])) + ys.sum() - np.append(0, np.cumsum(ys[order]))
        ks = np.flatnonzero(wrong == wrong.min())
        edge = np.concatenate([[zs.max() + 1], zs[order], [zs.min() - 1]])
        bias -= float(np.mean([(edge[k] + edge[k + 1]) / 2 for k in ks]))
    return bucket, bias, 1.0


@lru_cache(maxsize=2)
def _weights(raw: bytes) -> tuple[np.ndarray, float]:
    a = np.frombuffer(raw, "<f4")
    return a[1:].astype(np.float64), float(a[0])


class Scorer(dict):
    """Scores texts by a trained model; remembers the number of each word, up to a million."""

    def __init__(self, raw: bytes):
        self.bucket, self.bias = _weights(raw)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Mean weight of each word's subwords."""
        got = [*map(self.get, words)]
        if new := [w for w, s in zip(words, got, strict=True) if s is None]:
            bag, owner = subwords(new)
            fresh = np.bincount(owner, self.bucket[bag], len(new)) / np.bincount(owner, minlength=len(new))
            it = iter(fresh.tolist())
            got = [next(it) if s is None else s for s in got]
            if len(self) + len(new) > 1_000_000:
                self.clear()
            self.update((w, s) for w, s in zip(new, fresh.tolist(), strict=True) if len(w) <= LONGEST)
        return np.array(got)

    def score(self, text: str) -> float:
        words = words_of(text)
        if not words:
            z = self.bias
        else:
            s = self.numbers(words)
            starts = np.arange(0, len(s), WINDOW)
            size = np.diff(np.append(starts, len(s)))
            z_win = WINDOW * np.add.reduceat(s, starts) / np.maximum(size, WINDOW // 2) + self.bias
            z = float(soft_max(z_win, np.zeros(1, int))[0][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@lru_cache(maxsize=1)
def scorer(raw: bytes) -> Scorer:
    return Scorer(raw)


def train(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """A model from labelled texts; the caller bounds the number of their ids.

    Of an id and label with several texts, or with one that is repeated, the text with the least hash is learnt from. The tasks that hold the texts cut each down to its distinct words and write them; one task then reads these alone
    and fits the model. What it reads is bounded by the number of texts and the words that one can hold. Another attempt gives the
    same model (fixed seed, rows sorted by text).
    """

    def words(batches):
        for pdf in batches:
            yield pdf.assign(t=[" ".join(words_of(t)) for t in pdf["t"]])

    def run(batches):
        pdf = pd.concat(list(batches), ignore_index=True).dropna(subset=["y"]).sort_values(["t", "y"])
        if pdf["y"].nunique() < 2:
            raw = np.concatenate([[5.0 if len(pdf) and pdf["y"].iat[0] else -5.0], np.zeros(BUCKETS)])
        else:
            bucket, bias, _ = fit(pdf["t"].tolist(), pdf["y"].to_numpy())
            raw = np.concatenate([[bias], bucket])
        yield pd.DataFrame({"model": [raw.astype("<f4").tobytes()]})

    rows = texts.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y"))
    least = F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")
    chosen = reliable(rows.mapInPandas(words, "id string, t string, y int").groupBy("id", "y").agg(least).select("t", "y"))
    # a first row without a label, so that there is a task even where no text is
    empty = rows.sparkSession.createDataFrame([("", None)], "t string, y int")
    return bytes(empty.unionByName(chosen).coalesce(1).mapInPandas(run, "model binary").first()["model"])


def toxicity(
    df: DataFrame, labels: DataFrame, most_of_each: int = 2_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """id, held_out, score, predicted for every row of ``df``.

    Learns from labels whose crc32(id as text) mod 5 is not 0, at most ``most_of_each`` of either kind
    (those whose ids have the least hashes, then the least ids); the others are held out. Only the text is an input of a
    score. Null and empty texts get the model's score of no words; a text of any length is scored whole. Labels that are null teach nothing;
    of one kind only, they give a constant. Repeated rows get equal scores, a score of exactly 0.5 counts as toxic, null ids are not held out.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.select(id_col, F.col(label_col).cast("int").alias("__y")).filter(~held & F.col(id_col).isNotNull() & F.col("__y").isin(0, 1)).distinct()
    pick = [known.filter(F.col("__y") == k).orderBy(F.xxhash64(id_col), id_col).limit(most_of_each) for k in (0, 1)]
    chosen = pick[0].unionByName(pick[1])
    raw = train(df.select(id_col, text_col).join(F.broadcast(chosen), id_col), id_col, text_col, "__y")
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def rows(key, text):
        s = scorer(shared.value).score(text)
        return [(key, s, int(s >= 0.5))]

    out = per_text(df, rows, with_id_type(df, "score double, predicted int", id_col), id_col, text_col)
    return out.select(id_col, held.alias("held_out"), "score", "predicted")
