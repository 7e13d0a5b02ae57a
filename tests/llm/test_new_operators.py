"""Mixing, collocations and alignment against plain brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import alignment, collocations, mixing, registry

SCHEMA = "doc_id long, text string, lang string, source string"
EDGES = [
    (1, None, None, "x"), (2, "", "en", None), (3, " \t\n ", "en", None), (4, "word " * 3000, "en", "a"), (5, "Twice the same. Twice THE same, twice", "en", "a"),
    (5, "Twice the same. Twice THE same, twice", "en", "a"), (None, "no id\n\n\nhere", "de", "a"), (6, "<|endoftext|> special é漢字\x1c😀 <s>", None, "b"), (7, "x" * 20_000, "en", "c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).selectExpr("*", "1 AS n", "'c' AS gram", "2 AS block", "3L AS h1", "source AS size", "4 AS __part", "lang AS start")


def rows_of(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


# ---- mixing


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = Counter()
    for _, t, _, s in rows:
        size[s] += words(t)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    goal, left, open_ = {}, share * sum(size.values()), set(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * size[s]}
        if not over:
            return size, goal | {s: level * weight[s] for s in open_}
        for s in over:
            goal[s] = most * size[s]
            left -= goal[s]
        open_ -= over
    return size, goal


def agree(rows, got):
    size, goal = targets(rows)
    source = defaultdict(list)
    for d, t, _, s in rows:
        source[d, words(t)].append(s)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        fits = [s for s in source[r["doc_id"], r["size"]] if size[s] == r["source_size"] and abs(goal[s] - r["target"]) < 1e-6 * max(1, goal[s])]
        assert fits
        taken[fits[0]] += r["taken"]
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 1, s


def test_mixing(spark, sf, edges):
    for rows, df in ((rows_of(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")), (EDGES, edges)):
        got = mixing.mix(df).collect()
        agree(rows, got)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    again = registry.op13_mixing(spark, sf).collect()
    first = [r["positions"][0] if r["positions"] else 2 for r in again]
    assert first == sorted(first) and len(again) == len(rows_of(spark, sf))
    none = mixing.mix(edges.limit(0))
    assert none.count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, "en", "a"), (1, None, "en", None)], SCHEMA)).collect()] == [0, 0]


def test_mixing_of_many_sources_with_caps(spark):
    rnd = random.Random(1)
    rows = [(k, "w " * rnd.choice([0, 1, 3, 40]), "en", rnd.choice([None, *"abcdefghijklmnopq", "é", "z" * 5])) for k in range(1500)] + [(k, "w " * 900, "en", "big") for k in range(1500, 1520)]
    agree(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())


def test_running_sums_of_a_hot_group(spark):
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 7 > 0 THEN cast(id % 5 AS string) END AS g", "id % 4 AS v", "cast(hash(id) AS long) AS o")
    total = Counter()
    for r in sorted(mixing.running_sums(df, ["g"], "v", ["o", "id"], rows_each=900).collect(), key=lambda r: (r["o"], r["id"])):
        assert r["before"] == total[r["g"]]
        total[r["g"]] += r["v"]
    assert sum(total.values()) == sum(k % 4 for k in range(20_000))


def test_schedules_are_inverted(spark):
    for knots in [*mixing.SHAPES, ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 1.0))]:
        t = np.linspace(0, 1, 200_001)
        w = np.interp(t, *zip(*knots))
        area = np.append(0, np.cumsum((w[1:] + w[:-1]) / 2))
        got = spark.range(101).select(mixing.time_of(F.col("id") / 100, knots).alias("t")).collect()
        for k, r in enumerate(got):
            assert abs(np.interp(r["t"], t, area / area[-1]) - k / 100) < 1e-6
    with pytest.raises(ValueError):
        mixing.time_of(F.lit(0.5), ((0.0, 1.0), (0.5, 1.0)))


def test_order_of_training_follows_the_schedules(spark):
    rows = [(k, "w " * (1 + k % 5), "en", "abc"[k % 3]) for k in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA), share=0.6)
    order = mixing.training_order(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and sum(r["words"] for r in order) == sum(r["taken"] for r in mixed.collect())
    early = Counter()
    for r in order:
        early["abc"[r["doc_id"] % 3], r["position"] < 0.5] += r["words"]
    share = {s: early[s, True] / (early[s, True] + early[s, False]) for s in "abc"}
    assert abs(share["a"] - 0.625) < 0.01 and abs(share["b"] - 0.5) < 0.01 and abs(share["c"] - 0.375) < 0.01


# ---- collocations


def pieces_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def brute_phrases(rows, longest=3, least=10, covered=50, top=2000):
    count, n = Counter(), Counter()
    for _, t, lang, _ in rows:
        for p in pieces_of(t):
            n[lang if lang is not None else "und"] += len(p)
            for k in range(1, longest + 1):
                count.update((lang if lang is not None else "und", tuple(p[i : i + k])) for i in range(len(p) - k + 1))
    cands = {g: a for g, a in count.items() if len(g[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), f in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(f, inside[lang, w[i : i + k]])
    out = defaultdict(list)
    for (lang, w), a in cands.items():
        if (lang, w) in inside and 100 * inside[lang, w] >= covered * a:
            continue
        score, _, left, right = min((10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, k, g.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for k, (s, a, g, x, y) in enumerate(sorted(found)[:top], 1)]


def phrases(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations(spark, sf, edges):
    rows = rows_of(spark, sf)
    assert phrases(registry.op11_collocations(spark, sf)) == sorted(brute_phrases(rows))
    assert phrases(collocations.collocations(edges)) == sorted(brute_phrases(EDGES))
    assert collocations.collocations(edges.limit(0)).count() == 0
    small = edges.union(edges).union(edges)
    for kw in ({"least": 2, "longest": 2}, {"least": 2, "longest": 5}, {"least": 3, "covered": 101, "top": 3}):
        assert phrases(collocations.collocations(small, map_bits=64, **kw)) == sorted(brute_phrases(EDGES * 3, **kw))


def test_collocations_of_odd_texts(spark):
    rnd = random.Random(7)
    alphabet = [*"aAbÄä.,;\n\r\x0b\x0c \t \x00\x1c\x85", " ", "é", "w1 ", "w2 ", "W1\t", "the ", "　", "| "]
    rows = [(k, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr", None, "und", ""]), "s") for k in range(1500)]
    got = phrases(collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), longest=4, least=4))
    assert got and got == sorted(brute_phrases(rows, 4, 4))


def test_index_counts_and_both_directions():
    rnd = random.Random(3)
    for _ in range(30):
        ids = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(0, 200))], np.int64)
        want = Counter()
        for k in range(1, 5):
            want.update(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
        got = {}
        for grams, count in collocations.Shard(ids, 4).grams(4, lambda g: np.ones(len(g), bool)):
            got |= {tuple(g): c for g, c in zip(grams.tolist(), count.tolist(), strict=True)}
        assert got == want


def test_scores_past_64_bits(spark):
    a, left, right = 3 * 10**11 + 7, 4 * 10**11 + 1, 5 * 10**11 + 3
    r = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score()).first()
    assert r["score"] == 10**6 * a * a // (left * right)


# ---- alignment


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spans(both, text):
    t, sp = both
    char = {c: b for b, c in enumerate(alignment.byte_symbols())}
    a = [(i, bytes(char[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p := sp.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    out = []
    for side in (a, b):
        at, found = 0, []
        for i, x in side:
            found.append((i, at, at + len(x)))
            at += len(x)
        out.append(found)
    return out


def brute_align(both, texts):
    each = []
    for t in texts:
        a, b = spans(both, t or "")
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 900 else slow_links(a, b)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, k, m = [], 0, 0
        for e in ends:
            k2, m2 = k, m
            while k2 < len(a) and a[k2][2] <= e:
                k2 += 1
            while m2 < len(b) and b[m2][2] <= e:
                m2 += 1
            groups.append((a[k:k2], b[m:m2]))
            k, m = k2, m2
        told = ";".join(",".join(str(x[0]) for x in g) + "|" + ",".join(str(x[0]) for x in h) for g, h in groups)
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(told.encode()).hexdigest() if a else "", sum(len(g) * len(h) for g, h in groups)))
    count = Counter(p for e in each for p in set(e[3]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, g, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha, shared) for n_a, n_b, g, links, sha, shared in each]


def slow_links(a, b):
    out, k = [], 0
    for x in a:
        while k and b[k][1] > x[1]:
            k -= 1
        while b[k][2] <= x[1]:
            k += 1
        m = k
        while m < len(b) and b[m][1] < x[2]:
            out.append((x[0], b[m][0]))
            m += 1
    return out


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def links_of(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in COLS)) for r in df.collect())


def test_alignment(spark, sf, edges, both):
    for rows, df in ((rows_of(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")), (EDGES, edges)):
        want = sorted((str(r[0]), *x) for r, x in zip(rows, brute_align(both, [r[1] for r in rows]), strict=True))
        assert links_of(alignment.align(df, block_bytes=100_000)) == want
    assert links_of(registry.op12_alignment(spark, sf)) == sorted((str(r[0]), *x) for r, x in zip(rows_of(spark, sf), brute_align(both, [r[1] for r in rows_of(spark, sf)]), strict=True))
    assert alignment.align(edges.limit(0)).count() == 0


def test_alignment_of_odd_texts(spark, both):
    rnd = random.Random(5)
    alphabet = [*"ab cd'\n\t.!<|>12é\x1c\x85\x00  　 漢̈ʼ²Ⅷ　😀▁", "<|endoftext|>", "'ll", " s", "  ", "   ", "\r\n", "</s>", "<0x41>", " x", "…", "”", "}\r"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2500)] + [" " * 30, "a ", " a", "ﬁ", "▁", "\n" * 50]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts + texts[:100])]
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute_align(both, [r[1] for r in rows]), strict=True))
    assert links_of(alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(4), block_bytes=5000)) == want
    assert sum(w[1] > 0 for w in want) > 1000 and sum(w[1] == 0 for w in want) > 300


def test_products_of_sparse_matrices():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        a, b = rnd.random((7, 9)) < 0.3, rnd.random((9, 5)) < 0.4
        of = lambda m: alignment.Csr(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1])
        i, j, v = alignment.product(of(a), of(b), 5)
        got = np.zeros((7, 5), int)
        got[i, j] = v
        assert (got == a.astype(int) @ b.astype(int)).all()
        assert (alignment.product_lengths(of(a), of(b)) == (a.astype(int) @ b.sum(1))).all()


def test_links_of_shared_groups():
    vocab = alignment.vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model")
    c = alignment.Chunks([b"unbelievable zzqx 12345", "naïveté 漢字".encode()], vocab, True)
    a, b, a_group, b_group, _ = c.tokens
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if a_group[i] == b_group[j]}
    got = {(int(x), int(y)) for i, j in c.shared_groups(rows=3) for x, y in zip(i, j, strict=True)}
    assert got == want and len(got) == c.n_shared.sum()
