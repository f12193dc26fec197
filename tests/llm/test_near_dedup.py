"""SimHash groups of several words, and the pipeline's near-dedup stage, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from kinetra.llm import components, simhash  # noqa: E402

from .test_llm import DOCS, _odd  # noqa: E402

WORDS, WITHIN = 8, 77


def near_classes(texts: dict) -> dict:
    """Smallest id reachable by links: at most 77 of 512 bits differ, and a word agrees under one of the masks."""
    masks = np.array(simhash.covering_masks(4), np.uint64)
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[i], 5, WORDS, False) for i in ids])
    forest = components.Forest()
    for i, a in enumerate(ids):
        x = fps[i + 1 :] ^ fps[i]
        near = np.bitwise_count(x).sum(1, dtype=int) <= WITHIN
        for j in np.flatnonzero(near):
            if ((x[j][:, None] & masks) == 0).any():
                forest.join(a, ids[i + 1 + j])
    return {i: forest.find(i) for i in ids}


def test_fingerprint_of_several_words():
    """Bit by bit: over half of the distinct shingles' hashes."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    import xxhash

    rnd = random.Random(5)
    for n in (0, 3, 5, 300, 9000):
        words = [rnd.choice("abcdef") for _ in range(n)]
        shingles = {" ".join(words[i : i + 5]) for i in range(max(1, n - 4))} if words else set()
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        got = simhash.fingerprint(" ".join(words), 5, 3, False).tolist()
        hashes = [h, *([mixed((x + i * 0x9E3779B97F4A7C15) & mask) for x in h] for i in (1, 2))]
        assert got == [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs)) for hs in hashes]


def test_near_copies_of_every_similarity(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for n in range(60):
        base = [word() for _ in range(rnd.choice([20, 60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(2):
            near = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                near[rnd.randrange(len(near))] = word()
            texts.append("  ".join(near).upper() if n % 3 else "\n".join(near))
    base = [word() for _ in range(100)]  # a chain: neighbours are alike, its ends are not
    for _ in range(20):
        texts.append(" ".join(base))
        base = [*base[4:], *(word() for _ in range(4))]
    shared = " ".join(word() for _ in range(12))
    texts += [f"{shared} {' '.join(word() for _ in range(5))}" for _ in range(20)]  # a common line, not alike
    texts += ["", " \n", "two words", "Two  words", "two wordz"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    docs = {i: texts[j] for i, j in enumerate(order)}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], DOCS)
    classes = near_classes(docs)
    got = {r["doc_id"]: r["component"] for r in simhash.simhash_groups(df, radius=4, size=5, words=WORDS, within=WITHIN, repeats=False).collect()}
    assert got == classes
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert {r["doc_id"] for r in out.collect()} == set(classes.values()) and out.columns == df.columns


def test_share_of_pairs_that_is_found():
    """By similarity: the recall that README states."""
    rnd = random.Random(12)
    masks = np.array(simhash.covering_masks(4), np.uint64)
    for changed, low in ((0, 1.0), (2, 0.98), (5, 0.5), (12, 0.3)):  # of 300 words: Jaccard 1, 0.93, 0.84, 0.66
        found = 0
        for _ in range(60):
            base = [str(rnd.random()) for _ in range(300)]
            near = list(base)
            for i in rnd.sample(range(5, 295), changed):
                near[i] = str(rnd.random())
            x = simhash.fingerprint(" ".join(base), 5, WORDS, False) ^ simhash.fingerprint(" ".join(near), 5, WORDS, False)
            found += bool(((x[:, None] & masks) == 0).any() and np.bitwise_count(x).sum() <= WITHIN)
        assert found / 60 >= low or changed == 12 and found / 60 < 0.3


def test_odd_rows(spark):
    odd = _odd(spark)
    out = simhash.near_dedup(odd)
    assert out.columns == odd.columns and 0 < len(out.collect()) < odd.count()
    assert simhash.near_dedup(odd.where("false")).count() == 0
