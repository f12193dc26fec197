"""Phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from kinetra.llm import collocations


def brute(rows: list[tuple], min_count: int, covered: int, top: int) -> list[tuple]:
    f: dict[str, Counter] = {}
    for text, lang in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            counts.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        frequent = {g: a for g, a in counts.items() if len(g) > 1 and a >= min_count}
        rows = []
        for g, a in frequent.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in frequent.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "ñandú", "state", "art", "😀", "x" * 900, "end.", "so,so", "\tq", "l'été"]
    rows = [(" ".join(rng.choices([*words, "state of the art", "a\nb", ""], k=rng.randint(0, 60))), rng.choice(["en", "en", "fr", None])) for _ in range(80)]
    return [*rows, (None, "en"), ("", None), (" \t\n", "fr"), ("again " * 500, "de"), *rows[:5]]


@pytest.mark.parametrize("head", [1 << 16, 4, 0])
def test_against_brute_force(spark, head):
    rows = texts(1)
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, rank int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=4, top=60, head=head).collect())
    want = brute(rows, 4, 80, 60)
    assert got == want and {len(r[2].split(" ")) for r in want} == {2, 3, 4}


def test_nothing_frequent(spark):
    none = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(none.limit(0)).collect() == []


def test_tiles_count_dense_and_sparse_ones():
    rng = np.random.default_rng(2)
    left = np.concatenate([rng.integers(0, 300, 200_000), rng.integers(0, 60_000, 50_000), -rng.integers(1, 1 << 62, 500), np.full(9, -5)])
    right = np.concatenate([rng.integers(0, 300, 200_000), rng.integers(0, 60_000, 50_000), rng.integers(0, 9, 500), np.full(9, 3)])
    tiles = collocations.Tiles()
    for part in np.array_split(np.arange(len(left)), 7):
        tiles.add(left[part], right[part])
    assert {(a, b): n for a, b, n in zip(*map(np.ndarray.tolist, tiles.counted()), strict=True)} == Counter(zip(left.tolist(), right.tolist(), strict=True))
    assert [len(x) for x in tiles.counted()] == [0, 0, 0]


def test_hashes_tell_words_and_languages_apart():
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(50_000)} | {"ab" * 600, "ba" * 600})
    both = collocations.tokens([" ".join(words).encode(), " ".join(words).encode(), b" ".join(w.encode() for w in words)], ["en", "fr", "en"])
    one, two, three = np.split(both.keys, 3)
    assert len(set(one.tolist()) | set(two.tolist())) == 2 * len(words) and (one == three).all() and (one >> np.uint64(63) == 1).all()
