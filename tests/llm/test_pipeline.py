"""The pipeline's stages, each against its own input."""

import random

import corpus_pipeline as P


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == cols, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
        docs = out
    assert 0 < docs.count() < before
    assert P.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    rows, pairs = [], 0
    for d in range(150):  # a text, and a copy with some words changed, spread over it
        words = [word() for _ in range(rnd.randint(60, 400))]
        other = list(words)
        for at in rnd.sample(range(len(words)), max(1, len(words) // 60)):
            other[at] = word()
        a, b = " ".join(words), " ".join(other)
        s = len(five_words(a) & five_words(b)) / len(five_words(a) | five_words(b))
        rows += [(2 * d, a), (2 * d + 1, b)]
        pairs += s >= 0.8
    assert pairs > 100
    base = [word() for _ in range(200)]
    for d in range(1000, 1060):  # more copies of a text than all pairs are checked of
        rows.append((d, " ".join([*base[:100], word(), *base[101:]])))
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one two"), (2004, "one  TWO"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()}
    sim = lambda a, b: len(a & b) / len(a | b)
    of = {d: five_words(t) for d, t in rows if d is not None and d < 300}
    near = [d for d in range(0, 300, 2) if sim(of[d], of[d + 1]) >= 0.8]
    assert all(d in kept for d in range(0, 300, 2))
    assert sum(d + 1 not in kept for d in near) >= 0.97 * len(near)
    assert all(d + 1 in kept for d in range(0, 300, 2) if d not in near)
    assert {d for d in kept if d is not None and d >= 1000} == {1000, 2000, 2003}
    assert None not in kept


ROWS = [
    (1, None, "en"), (2, "", "en"), (3, "", None), (4, "some words that stand here alone", "en"), (4, "some words that stand here alone", "en"), (4, "another text under the same id, not to be lost", "en"),
    (None, "no id but a text of its own", "en"), (None, "some words that stand here alone", "en"), (5, "x " * 30_000, "en"),
]


def test_stages_on_edges(spark, sf):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns; then no rows at all."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "cast(length(text) AS long) AS n_chars", *[f"'mine' AS {c}" for c in ("keep", "own", "row", "id", "root", "line_dedup", "n_lines", "item", "perplexity")])
    want = {
        "line_dedup": sorted(map(repr, ROWS)), "decontamination": sorted(map(repr, ROWS)),
        # blank texts are copies; of the equal texts that of the smallest id stays, once
        "near_dedup": sorted(map(repr, [ROWS[0], ROWS[3], ROWS[5], ROWS[6], ROWS[8]])),
    }
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        got = sorted(repr((r["doc_id"], r["text"], r["lang"])) for r in rows)
        if name == "quality_classifier":  # a model of few texts may reject the others, but never those without text; equal rows fare alike
            assert set(map(repr, ROWS[:3])) <= set(got) <= set(map(repr, ROWS)) and got.count(repr(ROWS[3])) in (0, 2)
        else:
            assert got == want[name], name
        assert all({r[c] for c in docs.columns[5:]} == {"mine"} for r in rows)
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert packed.filter("piece = 0").count() == len(ROWS) and P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_run_chains_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    of = lambda df: sorted(tuple(r[k] for k in keys) for r in df.collect())
    assert of(P.run(spark, sf)) == of(P.STAGES[-1][1](spark, docs, sf))
