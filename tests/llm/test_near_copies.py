"""Groups of near copies against brute force, near the limit of similarity and far above it."""

import random

import numpy as np
import pytest

from ledgerleaf.llm import simhash


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def roots_by_hand(texts, least=0.8):
    sets = [five_words(t) for t in texts]
    root = [*range(len(texts))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if met >= least * (len(sets[i]) + len(sets[j]) - met) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("sizes, changed", [((8, 9, 60), 4), ((250,), 5), ((250,), 4), ((8, 9, 60, 120), 2)])
def test_no_candidate_is_dropped_by_the_size_of_its_group(spark, sizes, changed):
    rnd = random.Random(sum(sizes) * changed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    texts = []
    for size in sizes:
        base = [word() for _ in range(300)]
        for _ in range(size):
            own = list(base)
            for at in rnd.sample(range(300), changed):
                own[at] = word()
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(80)) for _ in range(50)]
    want = roots_by_hand(texts)
    kept = {r["doc_id"] for r in simhash.without_copies(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    true = set(want)
    assert true <= kept  # no text is taken for a copy that is none
    merges = len(texts) - len(true)
    assert merges == 0 or len(texts) - len(kept) >= 0.9 * merges, (len(texts), len(kept), len(true))


def test_bits_are_signs_of_sums_over_all_shingles():
    rnd = np.random.default_rng(5)
    base = np.sort(rnd.integers(0, 1 << 64, 400, np.uint64))
    fps = lambda x: np.unpackbits(np.array(simhash.search_fingerprint(x)[0], "<u4").view(np.uint8))
    own = fps(base)
    # one shingle that is the least by any hash decides nothing: taking any one away moves few bits
    moved = [int((own != fps(np.delete(base, k))).sum()) for k in range(0, 400, 7)]
    assert max(moved) < 0.12 * len(own)
    apart = [int((own != fps(np.sort(np.concatenate([base[:360], rnd.integers(0, 1 << 64, 40, np.uint64)])))).sum()) / len(own) for _ in range(20)]
    assert 0.08 < np.mean(apart) < 0.2  # angle of a cosine of 0.9: 0.144
    other = fps(np.sort(rnd.integers(0, 1 << 64, 400, np.uint64)))
    assert 0.42 < (own != other).mean() < 0.58


def test_masks_of_parts_cover_the_radius():
    tables = simhash.part_masks(simhash.NEAR, simhash.WIDE)
    assert all(any(not m >> i & 1 for m in tables) for i in range(simhash.WIDE)) and all(0 < m < 1 << simhash.WIDE for m in tables)


def test_other_texts_share_no_key_by_chance_and_near_ones_do():
    rnd = np.random.default_rng(8)
    tables = simhash.part_masks(simhash.NEAR, simhash.WIDE)
    assert all(m.bit_count() >= 26 for m in tables)  # pairs that agree by chance: one in 2 ** 26
    size, met = 64 * (len(simhash._TIMES) - 1), 0
    words = lambda bits: np.packbits(bits, bitorder="little").view("<u4").tolist()
    for _ in range(200):
        one = rnd.integers(0, 2, size, np.uint8)
        two = one ^ (rnd.random(size) < 0.095)
        a, b = simhash.parts_of(words(one)), simhash.parts_of(words(two))
        assert sum(x << simhash.WIDE * k for k, x in enumerate(a)) == int.from_bytes(np.packbits(one, bitorder="little").tobytes(), "little") % (1 << simhash.WIDE * simhash.PARTS)
        met += any((x ^ y) & m == 0 for x, y in zip(a, b, strict=True) for m in tables)
    assert met >= 190
