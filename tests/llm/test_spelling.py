"""Spelling variants against brute force."""

from __future__ import annotations

import random
import zlib

import pytest

from kinetra.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(words: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= ratio * words[w] else None for w, f in form.items()}

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def found(df) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("cell_points", [1 << 18, 40])
def test_near_words_of_few_letters(spark, monkeypatch, cell_points):
    rng = random.Random(5)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.choice([1, 2, 30, 400, 5000]) for _ in range(400)}
    k = 1500 if cell_points > 1000 else 20
    words |= {"x" * 2 * k: 7, "x" * (2 * k + 1): 90, "x" * k + "y" + "x" * k: 8, "😀a": 3, "😀b": 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    near = spelling.near_words(df, cell_points).collect()
    want = sorted((a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b))
    assert sorted(map(tuple, near)) == want  # each pair both ways, and once


def test_groups_and_chains(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefg1": 9, "other": 4, "othen": 39}
    df = spark.createDataFrame([*words.items(), (None, 4), ("", 9)], "word string, n long")
    got = found(spelling.group_variants(df.withColumn("form", df.n)))
    assert got == groups(words) and got["abcdefg"][:2] == ("abcdefgh", "abcdefghij")


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    stems = ["zusammen", "événement", "Continuation", "STRASSEN", "kurz"]
    texts = [" ".join(rng.choices(stems, weights=[50, 20, 9, 5, 5], k=rng.randint(0, 90))) for _ in range(60)]
    texts += [None, "", "…", "zusammen,zusammen", "zusamen " * 3, "x" * 70_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "zusammenx zusammenx", None)]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    import re

    counts: dict[str, int] = {}
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    got = found(spelling.op12_spelling(spark, str(tmp_path)))
    assert got == groups({w: n for w, n in counts.items() if n >= 2})
    assert any(v[0] for v in got.values())


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
