"""Benchmark items in lower case, in capitals and re-parameterised, against an independent matcher of templates."""

import random
from collections import defaultdict

import pytest
import regex

from ledgerleaf.llm import decontaminate as D

TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:(?<=[0-9])[.,](?=[0-9])[\p{L}\p{M}\p{N}]+)*")
LETTERS = regex.compile(r"[\p{Lu}\p{Lt}][\p{L}\p{M}]*")
NUMBER = regex.compile("[0-9][0-9.,]*")


def tokens(text):
    """(template word, value) pairs; units behind a number of the same or the word before are set off."""
    out = []
    for w in TOKEN.findall(text):
        glued = regex.fullmatch(r"(.*[0-9])([A-Za-z]+)", w)
        out += [glued[1], glued[2]] if glued and glued[2].lower() in D.UNITS else [w]
    pairs = []
    for w in out:
        if LETTERS.fullmatch(w):
            pairs.append(("<name>", w.lower()))
        elif NUMBER.fullmatch(w):
            pairs.append(("<number>", w))
        elif pairs and pairs[-1][0] == "<number>" and w in D.UNITS:
            pairs.append(("<unit>", w))
        else:
            pairs.append((w.lower(), w.lower()))
    return pairs


def windows(pairs, size):
    """Position and what counts of each window: its template, or its values where it is nothing but placeholders."""
    for i in range(len(pairs) - size + 1):
        run = pairs[i : i + size]
        yield i, tuple(v for _, v in run) + ("values",) if all(t[0] == "<" for t, _ in run) else tuple(t for t, _ in run)


def finds(doc, item, size=5, coverage=0.8):
    d, own = tokens(doc), tokens(item)
    literal = [(t if t in ("<number>", "<unit>") else v, v) for t, v in own]
    found = defaultdict(list)
    for i, w in windows(d, size):
        found[w].append(i)
    for view in (own, literal):
        want = [*windows(view, size)]
        if view is literal and [t for t, _ in literal] == [t for t, _ in own]:
            continue
        lines = defaultdict(set)
        for q, w in want:
            for p in found.get(w, ()):
                lines[p - q].add((q, w))
        hit = set()
        for k, ws in lines.items():
            values = defaultdict(set)
            for q, w in ws:
                for j in range(size):
                    if view[q + j][0][0] == "<":
                        values[view[q + j]].add(d[q + j + k][1])
            if all(len(v) == 1 for v in values.values()):
                hit |= {w for _, w in ws}
        if len(hit) >= coverage * len({w for _, w in want}):
            return True
    want = {(*(v for _, v in own[i : i + size]), "values") for i in range(len(own) - size + 1)}
    return bool(want) and len(want & found.keys()) >= coverage * len(want)


def made(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    name = lambda: word().title()
    items, docs = [], []
    for k in range(40):
        parts = [rnd.choice([word, word, word, name, lambda: str(rnd.randint(1, 99)), lambda: f"{rnd.randint(1, 9)}.{rnd.randint(1, 9)} km", lambda: f"{rnd.randint(2, 9)}kg"])() for _ in range(rnd.randint(5, 24))]
        item = " ".join(parts) + rnd.choice([".", "?", ""])
        items.append((k, item))
        other = " ".join(name() if p[0].isupper() and rnd.random() < 0.9 else str(rnd.randint(100, 999)) if p.isdigit() else p for p in parts)
        cut = " ".join(p if rnd.random() < 0.93 else word() for p in parts)
        for text in (item, item.lower(), item.upper(), other, cut, item.replace(" ", "\n", 3)):
            docs.append((len(docs), " ".join(word() for _ in range(8)) + rnd.choice([" ", ". ", "\n"]) + text + " " + " ".join(word() for _ in range(8))))
    return items, docs


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_are_those_of_an_independent_matcher(spark, seed):
    items, docs = made(seed)
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    long_ = [(i, t) for i, t in items if len(tokens(t)) >= 5]
    want = {(d, i) for d, t in docs for i, x in long_ if finds(t, x)}
    assert {g for g in got if g[1] in dict(long_)} == want
    for kind, at in (("copies", 0), ("lower case", 1), ("capitals", 2)):
        found = sum((6 * i + at, i) in got for i, _ in long_)
        assert found >= 0.97 * len(long_), (kind, found, len(long_))


def test_copies_without_capitals_and_in_capitals(spark):
    item = "Alice Brown has 3 red apples and buys 4 more from Bob at the market in Paris. How many apples does she hold now?"
    rows = [(1, f"so: {item.lower()} yes"), (2, f"SO: {item.upper()} YES"), (3, item), (4, item.lower().replace("alice", "dora")), (5, item.replace("Alice", "Dora").replace("3", "7")), (6, "nothing of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["kind"]) for r in D.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(1, "exact"), (2, "exact"), (3, "exact"), (4, "exact"), (5, "template")}
