"""Operators of training data against plain brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import components, decontaminate, linededup, media, packing, pii, quality, registry, secrets, simhash, tokens, toxicity

EDGES = [
    (1, None, "x"), (2, "", "clash"), (3, " ", None), (4, "word " * 3000, "a"), (5, "twice the same text, a long line that many hold in common\nshort", "a"),
    (5, "twice the same text, a long line that many hold in common\nshort", "a"), (None, "no id\n\n\nhere", "a"), (6, "<|endoftext|> special é漢字\x1c😀", "b"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "source AS row", "1 AS h", "2L AS pos")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def docs_of(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_token_counts(spark, sf, lib, edges):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in registry.op1_token_counts(spark, sf).collect()}
    for d, t in docs_of(spark, sf):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert got[d] == (len(t.encode()), n, n > 512)
    assert sorted(r["n_tokens"] for r in tokens.token_counts(edges).collect()) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in EDGES)


def test_token_counts_of_odd_strings(lib):
    rnd, count = random.Random(3), tokens.counter(tokens.vocabulary("byte_bpe_50k.json"))
    alphabet = [*"ab cd'\n\t.!<|>12é\x1c\x85 漢̈ʼ²Ⅷ　😀", "<|endoftext|>", "'ll", " s", "\r\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        assert count.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t
    assert count.count("a" * 20_000) == len(lib.encode("a" * 20_000).ids)


def test_packing(spark, sf, lib, edges):
    for rows, texts in ((registry.op3_packing(spark, sf).collect(), docs_of(spark, sf)), (packing.pack(edges).collect(), [(d, t or "") for d, t, _ in EDGES])):
        ids = {d: [*lib.encode(t, add_special_tokens=False).ids, 0] for d, t in texts}
        assert len(rows) == sum(-(-len(ids[d]) // 2048) for d, _ in texts)
        seqs = {}
        for r in rows:
            own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(own) == r["length"] <= 2048
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
            assert r["piece"] == 0 or r["length"] == 2048
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in seqs.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= 2048
        assert len(seqs) <= 1.05 * -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(edges.limit(0)).count() == 0


def test_packing_goes_by_fitted_patterns():
    rnd = np.random.default_rng(3)
    hist = np.bincount(rnd.integers(1, 2049, 20_000), minlength=2049)
    pats = packing.patterns(2048)
    known = {tuple(sorted(x[x > 0].tolist())) for x in pats}
    groups = packing.plan_groups(hist, 2048)
    by_pattern = sum(n for lengths, n in groups if tuple(sorted(lengths)) in known)
    used = np.zeros(2049, np.int64)
    for lengths, n in groups:
        assert sum(lengths) <= 2048
        np.add.at(used, lengths, n)
    assert (used == hist).all() and by_pattern >= 0.5 * sum(n for _, n in groups)
    assert sum(n for _, n in groups) <= 1.03 * -(-int((hist * np.arange(2049)).sum()) // 2048)
    assert packing.plan_groups(np.zeros(2049, np.int64), 2048) == []


def test_packed_ids_are_the_librarys_for_all_characters_and_odd_strings(lib):
    ids, rnd = packing.id_bytes(tokens.vocabulary("byte_bpe_50k.json")), random.Random(4)
    assert ids.fast is not None and packing.id_bytes(tokens.vocabulary("word_bpe_49k.json")).fast is None
    alphabet = [*"ab cd'\n\t.!<|>12é\x1c\x85 漢̈ʼ²Ⅷ　😀\0", "<|endoftext|>", "'ll", " s", "\r\n"]
    odd = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(5000)]
    odd += [f"a{c}1{c}. {c}b {c} 'sx{c}!" for c in map(chr, range(0x30000)) if not "\ud800" <= c <= "\udfff"]
    odd += ["a" * 200_000, " " * 200_000 + "a", "x" + "\n" * 60_000, "x" + " " * 49_999 + "y" + " " * 49_998]
    for k in range(0, len(odd), 10_000):
        for t, e in zip(odd[k : k + 10_000], lib.encode_batch_fast(odd[k : k + 10_000], add_special_tokens=False)):
            assert ids.of(t) == np.array(e.ids, "<u4").tobytes(), t[:50]


def test_line_dedup_streams_over_batches_and_edges():
    import pandas as pd

    rnd = random.Random(5)
    rows = sorted({(rnd.randint(0, 12), rnd.randint(0, 1), rnd.randint(0, 15), rnd.randint(0, 3)) for _ in range(700)}, key=lambda r: (r[0], r[1], -r[2], r[3]))
    held = {}
    for a, b, d, _ in rows:
        held.setdefault((a, b), set()).add(d)
    want = {(a, b, d, p) for a, b, d, p in rows if len(held[a, b]) >= 5 and d != max(held[a, b])}
    frame = lambda part: pd.DataFrame(part, columns=["h1", "h2", "doc", "pos"]).assign(row=lambda x: x["h1"] * 2 + x["h2"])
    for cuts, size in ((1, 3), (4, 7), (9, 1), (3, 1000)):
        # rows of a hash and document stay together, as range partitioning keeps them
        edges_at = sorted({next(i for i in range(k, len(rows) + 1) if i in (0, len(rows)) or rows[i][:3] != rows[i - 1][:3]) for k in range(0, len(rows) + 1, max(1, len(rows) // cuts))} | {0, len(rows)})
        parts = [rows[a:z] for a, z in zip(edges_at, edges_at[1:])]
        batches = lambda part: iter([frame(part[i : i + size]) for i in range(0, len(part), size)])
        total = {}
        for part in parts:
            for t in linededup.edge_hashes(batches(part)):
                for a, b, n, k in t.itertuples(index=False):
                    o = total.get((a, b), (0, k))
                    total[a, b] = (o[0] + n, max(o[1], k))
        got = [(int(r) // 2, int(r) % 2, d, p) for part in parts for t in linededup.dropped_lines(batches(part), total, 5) for d, r, p in t[["doc", "row", "pos"]].itertuples(index=False)]
        assert len(got) == len(set(got)) and set(got) == want


def brute_lines(texts):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in texts:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    for d, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != d)]
        yield d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_dedup(spark, sf, edges):
    rows = registry.op4_line_dedup(spark, sf).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in rows) == sorted(brute_lines(docs_of(spark, sf)))
    line = "  A line that is long enough to count, held by all of them\t"
    df = spark.createDataFrame([(d, f"{line}\n{d}\n{line.lower()}") for d in range(7)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.apply_bitmaps(linededup.dedup_lines(df)).collect()}
    assert out == {d: f"{line}\n{d}\n{line.lower()}" if d == 6 else str(d) for d in range(7)}
    assert linededup.dedup_lines(edges).count() == len(EDGES)
    assert linededup.dedup_lines(edges.limit(0)).count() == 0


def test_line_dedup_of_clashing_columns_and_text_ids(spark):
    line = "a line that is long enough to count, held by all of them"
    df = spark.createDataFrame([(f"d{d}", f"{line}\n{d}", "mine", 1) for d in range(6)] + [(None, line, "mine", 1), ("d0", f"{line}\n0", "mine", 1)], "doc_id string, text string, keep string, n_lines int")
    df = df.selectExpr("*", "'mine' AS lost", "'mine' AS doc", "'mine' AS row")
    out = linededup.apply_bitmaps(linededup.dedup_lines(df)).drop("line_dedup")
    assert out.columns == df.columns and {(r["keep"], r["n_lines"], r["lost"]) for r in out.collect()} == {("mine", 1, "mine")}
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(f"d{d}", str(d)) for d in range(5)] + [("d5", f"{line}\n5"), (None, line), ("d0", "0")])


def brute_fp(text):
    words = [w for w in re.split(r"[ \t-\r]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, sf, edges):
    rows = registry.op5_simhash(spark, sf).collect()
    fp = {d: brute_fp(t) for d, t in docs_of(spark, sf)}
    group, least = brute_groups([*fp.values()]), {}
    for d, f in fp.items():
        least[group[f]] = min(d, least.get(group[f], d))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{f:016x}", least[group[f]]) for d, f in fp.items()}
    assert simhash.near_duplicates(edges).count() == len(EDGES)
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


def test_covering_masks_and_links(spark):
    for r in (1, 2, 3):
        ms = simhash.masks(r)
        for bits in itertools.combinations(range(64), r):
            diff = sum(1 << b for b in bits)
            assert any(m & diff == 0 for m in ms)
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = {b ^ (1 << i) ^ (1 << j) for b in base for i, j in itertools.combinations(range(0, 64, 4), 2)} | {rnd.getrandbits(64) for _ in range(50)} | set(base)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r["u"] % 2**64: r["root"] % 2**64 for r in components.components(simhash.links(df).selectExpr("a AS u", "b AS v")).collect()}
    want = brute_groups([*fps])
    same = lambda g: {frozenset(x for x in fps if g(x) == k) for k in {g(x) for x in fps}}
    assert same(lambda x: roots.get(x, x)) == same(lambda x: want[x])


def test_components_of_a_chain(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    got = {r["u"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def code_spans(text, kinds):
    out = []
    for kind, rx, ok in kinds:
        out += [(kind, m.start(), m.end()) for m in re.finditer(rx, text) if ok(m)]
    return out


SECRETS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def luhn(m):
    d = [int(c) for c in m[0] if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), luhn), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
]


def odd_texts(seed, parts, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


SECRET_PARTS = ["token", "TOKEN=", "password", ": ", "=", "'", '"', " ", "abcdef1", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "api_key", "Apikey:", "secret:pass", "-", "deadbeefdeadbeefdeadbeef", "ſ"]
PII_PARTS = ["a", "b.c", "@", "x.org", "_", "1.2.3.4", ".5", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "+44 (20) 7946-0958", "+1", "é", "\n", "0001", "@y-z.co", "12345678901234567890"]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_secrets(spark, sf, edges):
    order = [k for k, *_ in SECRETS]
    texts = docs_of(spark, sf) + [(10**6 + i, t) for i, t in enumerate(odd_texts(1, SECRET_PARTS))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in secrets.digest(secrets.scan(df, repo=F.col("source"), owner=F.col("source"))).collect():
        base = sorted(code_spans(dict(texts)[r["doc_id"]], SECRETS), key=lambda s: (s[1], order.index(s[0])))
        assert r["base_sha256"] == digest(base), (r["doc_id"], base, r["spans"])
        assert [r[f"n_{k}"] for k in order] == [sum(s[0] == k for s in base) for k in order]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(",")) | {""}
    got = secrets.digest(secrets.scan(edges, repo=F.col("source"), owner=F.col("source")))
    assert got.count() == len(EDGES)
    assert secrets.scan(edges.limit(0), repo=F.col("source"), owner=F.col("source")).count() == 0


def test_secrets_by_owner(spark):
    mine, copied = "Zk3vX9qLw2Rt8Yb5Nc7Md1", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7"
    rows = [(1, "o1", f"use {mine} and {copied}"), (2, "o2", f"see {copied}"), (3, "o3", copied), (4, "o1", "x" * 30)]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, source string, text string"), repo=F.col("source"), owner=F.col("source"))).collect()}
    assert got[1]["spans"] == "owned:4:26" and got[1]["n_copied"] == 1 and got[2]["spans"] == "" and got[4]["spans"] == ""


def test_many_matches_in_one_text(spark):
    n = 200_000
    df = spark.createDataFrame([(1, "é ab12 " * n), (2, "")], "id long, t string")
    from ledgerleaf.llm.spans import with_matches

    got = with_matches(
        df, "t", "m", "b([0-9])[0-9]", group=1
    ).selectExpr("id", "size(m) AS n", "get(m, size(m) - 1) AS z", "aggregate(m, 0L, (a, i) -> a + i.s) AS total").orderBy("id").collect()
    assert (got[0]["n"], got[0]["z"]["s"], got[0]["z"]["e"], got[0]["z"]["x"]) == (n, 7 * (n - 1) + 3, 7 * n - 1, "1")
    assert got[0]["total"] == sum(7 * k + 3 for k in range(n)) and got[1]["n"] == 0


def test_owners_by_brute_force(spark):
    rnd = random.Random(12)
    values = ["".join(rnd.choices("ABCDEFGHabcdefgh0123456789", k=rnd.choice((8, 22, 30)))) + "1a" for _ in range(25)]
    rows = []
    for d in range(200):
        found = rnd.sample(values, 3)
        rows.append((d, f"o{rnd.randint(0, 5) if rnd.random() < 0.3 else d % 3}", f"r{d % 7}", f"x password={found[0]} y {found[1]} z token: '{found[2]}' \n"))
    df = spark.createDataFrame(rows, "doc_id long, owner string, repo string, text string")
    out = {r["doc_id"]: r for r in secrets.scan(df, repo=F.col("repo"), owner=F.col("owner")).collect()}
    held = {}
    spans = {d: [(m[2], m.start(), m.end()) for m in SECRETS[0][1].finditer(t)] + [(m[0], m.start(), m.end()) for m in re.finditer(r"(?<= )\w{20,}(?= )", t)] for d, _, _, t in rows}
    for d, o, r, _ in rows:
        for v, *_ in spans[d]:
            held.setdefault(v, (set(), set()))
            held[v][0].add(o)
            held[v][1].add(r)
    for d, found in spans.items():
        got = {(j["s"], j["e"]): (j["n_owners"], j["n_repos"], j["verdict"] == "copied") for j in out[d]["judged"]}
        assert got == {(a, z): (len(held[v][0]), len(held[v][1]), len(held[v][0]) > 1 or len(held[v][1]) > 2) for v, a, z in found}


def test_pii(spark, sf, edges):
    order = [k for k, *_ in PII]
    texts = docs_of(spark, sf) + [(10**6 + i, t) for i, t in enumerate(odd_texts(2, PII_PARTS))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in pii.digest(pii.find(df)).collect():
        base = sorted(code_spans(dict(texts)[r["doc_id"]], PII), key=lambda s: (order.index(s[0]), s[1]))
        assert r["base_sha256"] == digest(base), (r["doc_id"], dict(texts)[r["doc_id"]], base, r["spans"])
        assert [r[f"n_{k}"] for k in order] == [sum(s[0] == k for s in base) for k in order]
    assert pii.find(edges).count() == len(EDGES)
    assert pii.find(edges.limit(0)).count() == 0


def test_pii_terms(spark):
    filler = ["alpha beta gamma delta epsilon zeta eta theta iota kappa"] * 3
    rows = [(i, f"{filler[0]} number{i} Snowfield jane.roe@corp.example word{i} more") for i in range(4)] + [(10 + i, f"{filler[0]} other words {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    terms = {rows[0][1][t["s"] : t["e"]] for t in found[0]["terms"]}
    assert "Snowfield" in terms and "alpha" not in terms
    text = {r["doc_id"]: r["text"] for r in pii.sanitised(df, pii.find(df)).collect()}
    assert text[0] == f"{filler[0]} number0  <email> word0 " and text[10] == rows[4][1]


def test_pii_recall_of_planted_terms_and_edges(spark, edges):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(3, 6)))
    rows, planted = [], {}
    for k in range(20):  # an entity and a name that stands beside it in five texts, and alone in a line of another
        who, mail = f"Zed{chr(97 + k)}mark", f"p{k}@mail.example"
        for d in range(6):
            body = " ".join(word() for _ in range(30))
            rows.append((10 * k + d, f"{body}\n{who} {mail} {word()}" if d < 5 else f"{who} {body}\n{body} {mail}"))
            planted[10 * k + d] = who
    rows += [(1000 + d, " ".join(word() for _ in range(40))) for d in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS base", "'x' AS terms", "'x' AS at")
    found = pii.find(df)
    marks = {r["doc_id"]: {dict(rows)[r["doc_id"]][t["s"] : t["e"]] for t in r["terms"]} for r in found.collect()}
    caught = sum(w in marks[d] for d, w in planted.items())
    assert caught >= 0.95 * len(planted) and not any(marks[d] for d in marks if d >= 1000)
    clean = {r["doc_id"]: r for r in pii.sanitised(df, found).collect()}
    assert not any("mail.example" in r["text"] for r in clean.values()) and {r["base"] for r in clean.values()} == {"x"}
    out = {(r["doc_id"], r["text"]) for r in pii.sanitised(edges, pii.find(edges)).collect()}
    assert out == {(d, t) for d, t, _ in EDGES} and pii.sanitised(edges.limit(0), pii.find(edges.limit(0))).count() == 0


def test_sanitised_places(spark):
    df = spark.createDataFrame([(1, "a +1 10.20.30.40 b é x@y.org"), (2, None)], "doc_id long, text string")  # an address inside a number
    assert {r["doc_id"]: r["text"] for r in pii.sanitised(df, pii.find(df)).collect()} == {1: "a <phone> b é <email>", 2: None}


def sample_box(kind, *parts):
    return media.box(kind, *parts)


def test_media_of_other_files():
    n32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    head = sample_box(b"ftyp", b"isom", n32(512))
    track = lambda number, kind, entry, tables: sample_box(
        b"trak", media.full(b"tkhd", n32(0, 0, number, 0, 0)),
        sample_box(b"mdia", media.full(b"mdhd", n32(0, 0, 1000, 0, 0)), media.full(b"hdlr", n32(0), kind, bytes(13)), sample_box(b"minf", sample_box(b"stbl", media.full(b"stsd", n32(1), entry), *tables))),
    )
    empty = [media.full(b"stts", n32(0)), media.full(b"stsc", n32(0)), media.full(b"stsz", n32(0, 0)), media.full(b"stco", n32(0))]
    sound = sample_box(b"mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16))
    (t,) = media.read_tracks(head + sample_box(b"moov", track(1, b"soun", sound, empty)))
    assert (t.kind, t.codec, t.width, t.height) == ("soun", "mp4a", 0, 0)
    # a fragment: sizes and flags by run, data behind the fragment's box
    picture = sample_box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 640, 360), bytes(50))
    movie = sample_box(b"moov", track(7, b"vide", picture, empty), sample_box(b"mvex", media.full(b"trex", n32(7, 1, 40, 5, 0x10000))))
    body = lambda at: sample_box(b"moof", sample_box(b"traf", sample_box(b"tfhd", n32(0x20000, 7)), sample_box(b"trun", n32(0x1 | 0x4 | 0x200, 3, at, 0, 10, 20, 30))))
    size = len(body(0))
    data = head + movie + body(size + 8) + sample_box(b"mdat", bytes(range(60)))
    (t,) = media.read_tracks(data)
    assert (t.codec, t.width, t.sizes.tolist(), t.keys.tolist(), t.ticks) == ("avc1", 640, [10, 20, 30], [0], 120)
    assert media.stored_samples(data, t) == bytes(range(60))
    # compact sizes of 4 bits
    compact = [media.full(b"stts", n32(1, 3, 40)), media.full(b"stsc", n32(1, 1, 3, 1)), media.full(b"stz2", n32(4, 3), bytes([0x12, 0x30])), media.full(b"stco", n32(1, 0))]
    (t,) = media.read_tracks(sample_box(b"moov", track(1, b"vide", picture, compact)))
    assert t.sizes.tolist() == [1, 2, 3] and t.offsets.tolist() == [0, 1, 3]
    # what can't be is an error, quickly
    deep = b""
    for _ in range(1500):
        deep = sample_box(b"moov", deep)
    huge = [media.full(b"stsz", n32(1, 2**32 - 1)), *empty[:2], empty[3]]
    for bad in (deep, sample_box(b"moov", track(1, b"vide", picture, huge)), head + sample_box(b"moof", sample_box(b"traf", sample_box(b"tfhd", n32(0, 9))))):
        with pytest.raises(ValueError):
            media.read_tracks(bad)


def test_media(spark, sf, edges):
    texts = dict(docs_of(spark, sf))
    stored = {r["doc_id"]: r for r in registry.op7_media(spark, sf).collect()}
    assert stored.keys() == texts.keys()
    for d, r in stored.items():
        raw = texts[d].encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        file, n = media.write_container(pad), len(pad) // 64
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and file.count(pad) >= 1
        assert r["feature"].startswith(f"raw:8x8:{n * 0.04:.3f}:{n}:{-(-n // 16)}:{64 * -(-n // 16)}:")
    for n in (1, 7, 8, 9, 17, 100):
        payload = random.Random(n).randbytes(64 * n)
        data = media.write_container(payload)
        (t,) = media.read_tracks(data)
        assert media.stored_samples(data, t) == payload
        assert (t.codec, t.width, t.height, t.duration, t.timescale, len(t.keys)) == ("raw", 8, 8, 40 * n, 1000, -(-n // 16))
        assert data[t.key_ranges()[-1][0] :][:64] == payload[64 * int(t.keys[-1]) :][:64]
    good = media.write_container(bytes(64))
    big = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8)
    rows = [(1, good), (2, good[:-5]), (3, b""), (4, None), (5, b"\0\0\0\x04free"), (6, big + good), (7, good + struct.pack(">I4s", 0, b"free") + b"xx"), (None, good)]
    got = {r["media_id"]: (r["codec"], r["error"] is None) for r in media.media_columns(spark.createDataFrame(rows, "media_id long, content binary")).collect()}
    assert got == {1: ("raw", True), 2: (None, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: ("raw", True), 7: ("raw", True), None: ("raw", True)}
    assert media.stored_texts(edges).count() == len(EDGES)


ITEM = "A train leaves Paris at 9 and covers 120 km in 2 hours. How far does the train from Paris go in 5 hours at that same steady speed over the line?"


def test_decontamination(spark, edges):
    other = ITEM.replace("120", "300").replace("Paris", "Lyon").replace(" 9 ", " 7 ")
    mixed = ITEM.replace("Paris", "Lyon", 1)
    rows = [(1, f"Some words before. {ITEM} And after."), (2, f"x y z. {other} tail"), (3, f"x y z. {mixed} tail"), (4, "nothing of the kind " * 10), (5, ITEM[:60]), (6, None), (7, ""), (1, f"Some words before. {ITEM} And after.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, ITEM), (10, "too short"), (11, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 9, "exact"), (2, 9, "template")}
    kept = decontaminate.without_leaks(df, decontaminate.leaks(df, bench))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.leaks(edges, bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0
    assert {(r["doc_id"], r["kind"]) for r in decontaminate.leaks(df, bench, most_windows=0).collect()} == {(1, "exact"), (2, "template")}


def test_decontamination_wherever_names_stand(spark):
    item = "Alice has 3 apples. Alice buys 4 more apples at the market. How many apples does Alice hold in the end, if Bob eats 2 of them today?"
    other = item.replace("Alice", "Zoë").replace("Bob", "Ivan").replace(" 3 ", " 8 ").replace(" 4 ", " 5 ").replace(" 2 ", " 6 ")
    rows = [
        (1, item.replace(". ", ".\n")), (2, f'they said "{other}"'), (3, "İstanbul İİ " * 3 + item), (4, "İİ " + item.replace("Alice", "Dan", 1)), (5, "1 2 3 4 5 6 7 8 9 " * 50),
        (6, "so it goes: red, green tea"), (7, "7 8 9 10 11 12"), (8, "word " * 60_000 + item), (None, item), (9, "Red green tea"),
    ]
    bench = spark.createDataFrame([(1, item), (2, "Green tea"), (3, "3 4 5 6 7 8"), (None, item), (4, ""), (5, "...")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS row")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1, "exact"), (2, 1, "template"), (3, 1, "exact"), (8, 1, "exact"), (None, 1, "exact"), (5, 3, "exact"), (6, 2, "exact"), (9, 2, "exact")}
    kept = decontaminate.without_leaks(df, decontaminate.leaks(df, bench))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {4, 7}


def test_words_of_templates_and_texts_are_equally_many(spark):
    df = spark.createDataFrame(
        [(c, f"Ab {chr(c)}x{chr(c)} cd {chr(c)} 12kg 3.5 {chr(c)}{chr(c)}") for c in range(0x20, 0x3000)], "id int, t string"
    )
    assert decontaminate.with_words(df, F.col("t")).filter("size(tw) <> size(rw)").count() == 0


def test_recall_of_questions_with_other_names_and_numbers(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    name = lambda: rnd.choice("ABCDEFGH") + word()
    items, docs = [], []
    for k in range(60):
        names, numbers = [name(), name()], [str(x) for x in rnd.sample(range(2, 90), 3)]
        body = [word() for _ in range(25)]
        build = lambda ns, xs, body=body: " ".join([ns[0], *body[:6], xs[0], *body[6:12], ns[1], *body[12:18], xs[1], "km", *body[18:], ns[0], xs[2]]) + "."
        items.append((k, build(names, numbers)))
        docs.append((k, " ".join(word() for _ in range(50)) + "\n" + build([name(), name()], [str(x) for x in rnd.sample(range(100, 900), 3)]) + " " + " ".join(word() for _ in range(50))))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(60)} and {r["kind"] for r in got} == {"template"}


def test_decontamination_of_planted_items(spark, sf):
    docs, bench = docs_of(spark, sf), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, b in bench if b in t}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op9_decontamination(spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 2


def brute_kneser_ney(texts):
    """log10 p of the last of three symbols, from plain counts; symbols are code points, zeros before the first."""
    tri = Counter(tuple(x[i : i + 3]) for t in texts for x in [[0, 0, *map(ord, t)]] for i in range(len(t)))
    levels = {3: tri, 2: Counter(g[1:] for g in tri)}
    levels[1] = Counter(g[1:] for g in levels[2])
    table, size = {}, len(levels[1]) + 1
    for k, counts in levels.items():
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        cut = [min(i, max(0.1, i - (i + 1) * y * n[i + 1] / max(1, n[i]))) for i in (1, 2, 3)]
        d = {g: min(cut[min(c, 3) - 1], 0.999 * c) for g, c in counts.items()}
        total, mass = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[g]
        table[k] = (counts, d, total, mass)

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / size
        counts, d, total, mass = table[len(g)]
        if not total[g[:-1]]:
            return below
        return (counts[g] - d[g]) / total[g[:-1]] * (g in counts) + mass[g[:-1]] / total[g[:-1]] * below if g in counts else mass[g[:-1]] / total[g[:-1]] * below

    return p


def test_kneser_ney(spark, edges):
    rnd = random.Random(8)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "banana bandana", "", "été 漢字 ", *["".join(rnd.choices("abcd ", k=rnd.randint(1, 40))) for _ in range(30)]]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    p, model = brute_kneser_ney(texts), quality.train(df)
    assert sum(p((ord("t"), ord("h"), c)) for c in {ord(c) for t in texts for c in t} | {7}) == pytest.approx(1)  # 7 stands for all others
    others = spark.createDataFrame([(100, "en", "zebra théâtre 漢"), (101, "xx", "the cat"), (102, None, "the dog"), (103, "en", None), (104, "en", "the cat sat " * 20_000)], "doc_id long, lang string, text string")
    got = {r["id"]: r["perplexity"] for r in quality.perplexities(df.unionByName(others), model, chars_each=200).collect()}
    for r in [*df.collect(), *others.collect()]:
        t = r["text"]
        if not t:
            assert got[r["doc_id"]] is None
            continue
        x = [0, 0, *map(ord, t)]
        want = 10 ** -np.mean([np.log10(p(tuple(x[i : i + 3]))) for i in range(len(t))])
        assert got[r["doc_id"]] == pytest.approx(want), t[:50]


def test_quality_of_edges(spark, edges):
    clash = edges.selectExpr("*", "'mine' AS keep", "'mine' AS own", "'mine' AS perplexity", "'mine' AS threshold", "'mine' AS id")
    said = quality.classify(clash, edges.filter("doc_id in (4, 5)").select("doc_id"))
    assert said.count() == len(EDGES)
    by = {r["doc_id"]: (r["perplexity"], r["keep"]) for r in said.collect()}
    assert by[1] == by[2] == (None, True) and by[3][0] is not None
    kept = quality.accepted(clash, said)
    assert kept.columns == clash.columns and {r["keep"] for r in kept.collect()} == {"mine"} and kept.filter("doc_id = 5").count() == 2
    nothing = quality.classify(edges, edges.select("doc_id").limit(0))
    assert nothing.filter("keep").count() == len(EDGES) and nothing.filter("perplexity IS NOT NULL").count() == 0
    assert quality.classify(edges.limit(0), edges.select("doc_id")).count() == 0 and quality.accepted(edges.limit(0), said).count() == 0


def test_quality_scores_equal_rows_once_and_returns_all(spark):
    many = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'en' AS lang", "'the same words again' AS text")
    other = spark.createDataFrame([(1, "en", "the cat sat on the mat"), (1, "en", "the cat sat on the mat"), (2, "fr", "le chat")], "doc_id long, lang string, text string")
    model = quality.train(other)
    got = quality.perplexities(many.unionByName(other), model, chars_each=1_000).groupBy("id", "lang", "n_symbols").agg(F.count("*").alias("n"), F.count_distinct("perplexity").alias("d"))
    assert {(r["id"], r["lang"], r["n_symbols"], r["n"], r["d"]) for r in got.collect()} == {(None, "en", 20, 100_000, 1), (1, "en", 22, 2, 1), (2, "fr", 7, 1, 1)}
    alone = quality.perplexities(many.limit(1), model).first()["perplexity"]
    assert alone == pytest.approx(quality.perplexities(many.unionByName(other), model).filter("id IS NULL").first()["perplexity"])


def test_toxicity_learns_a_repeated_id_once(spark):
    # ids whose crc32 mod 5 is not 0 are learnt from
    few = spark.createDataFrame([(i, ("vile rotten scum " if i % 2 else "kind gentle words ") + f"w{i}", i % 2) for i in range(60)], "doc_id long, text string, toxic int")
    many = few.unionByName(few.filter("doc_id in (1, 2, 3)").crossJoin(spark.range(5_000)).drop("id"))
    once, again = (toxicity.train(x) for x in (few, many))
    assert once == again


def test_quality_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.35


def test_toxicity_scores_by_plain_loops():
    rnd = random.Random(2)
    weights = rnd.choices([0.0, 0.5, -0.3, 1.2], k=toxicity.BUCKETS)
    raw = np.array([-0.7, *weights], "<f4").tobytes()
    for t in ("", "One two THREE four five six seven", "a b c " * 50, "é漢字 word", "x" * 300):
        words = list(dict.fromkeys(re.findall(r"[^\W\d_]+", t.lower())))
        of = []
        for w in words:
            bag, owner = toxicity.subwords([w])
            assert len(bag) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.SIZES) and set(owner.tolist()) == {0}
            of.append(sum(float(np.float32(weights[b])) for b in bag.tolist()) / len(bag))
        z = [toxicity.WINDOW * sum(of[i : i + toxicity.WINDOW]) / max(len(of[i : i + toxicity.WINDOW]), toxicity.WINDOW // 2) - float(np.float32(0.7)) for i in range(0, len(of), toxicity.WINDOW)]
        want = np.log(sum(np.exp(toxicity.SHARP * x) for x in z)) / toxicity.SHARP if z else -float(np.float32(0.7))
        assert toxicity.Scorer(raw).score(t) == pytest.approx(1 / (1 + np.exp(-want)))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    # about 400 toxic texts to learn from; with five times as many the check's tables have 0.99
    assert n.get((1, 1), 0) >= 0.65 * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity(spark, edges):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ta", "re", "on", "the", "ing", "er"]) for _ in range(rnd.randint(1, 4)))
    text = lambda bad: " ".join(w for k in range(80) for w in ([rnd.choice(["scumbag", "idiot"])] if bad and k % 30 == 7 else []) + [word()])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)] + [(9000, "so you are an idiott and a scumbagg, tare onthe", 1), (9001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, df.select("doc_id", "toxic")).collect()}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    held = [(got[d]["predicted"], y) for d, _, y in rows[:600] if got[d]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert got[9000]["score"] > got[9001]["score"]
    assert toxicity.toxicity(edges, edges.select("doc_id", F.lit(1).alias("toxic"))).count() == len(EDGES)
    assert toxicity.toxicity(edges.limit(0), edges.select("doc_id", F.lit(1).alias("toxic"))).count() == 0
