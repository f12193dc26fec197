"""The byte-level network: chunks, slopes, and accuracy on labels that it never learnt from."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from kinetra.llm import classifier


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_chunks_hold_every_window(n):
    data = bytes(i % 251 for i in range(n))
    rows = classifier.chunked(data)
    seen = set()
    for k, row in enumerate(rows):
        at = k * (classifier.CHUNK - classifier.LAP)
        for i in range(classifier.CHUNK - classifier.WIDTH + 1):
            if at + i + classifier.WIDTH <= n:
                assert bytes(row[i : i + classifier.WIDTH].astype(np.uint8)) == data[at + i : at + i + classifier.WIDTH]
                seen.add(at + i)
    assert seen == set(range(max(0, n - classifier.WIDTH + 1)))


def some_weights():
    rng = np.random.default_rng(1)
    w = classifier.fit([classifier.chunked(b"")], np.ones(1, np.float32), epochs=0)
    return {k: (v + rng.normal(0, 0.05, v.shape)).astype(np.float64) for k, v in w.items()}


def test_slopes_are_those_of_the_loss():
    w = some_weights()
    texts, y = [classifier.chunked(t) for t in (b"a clean text of words " * 60, b"#$% !! " * 9, b"")], np.array([1.0, 0.0, 1.0])
    whole = [b"a clean text of words " * 60, b"#$% !! " * 9, b""]
    loss = lambda v: -np.mean(y * np.log(p := classifier.scores(v, whole)) + (1 - y) * np.log(1 - p))
    slopes = classifier._gradients(w, texts, y)
    for name, at in (("bytes", (97, 2)), ("filters", (5, 3)), ("bias", (4,)), ("dense", (2, 5)), ("dense_bias", (1,)), ("out", (3,)), ("out", (20,)), ("out_bias", (0,))):
        ends = []
        for step in (1e-2, -1e-2):
            v = {k: x.copy() for k, x in w.items()}
            v[name][at] += step
            ends.append(loss(v))
        assert slopes[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.15, abs=2e-5), name


def test_long_texts_are_scored_in_parts_and_whole():
    w = some_weights()
    long = bytes(range(32, 127)) * 9000
    direct = classifier.chunked(long)
    h = classifier._hidden(w, np.concatenate([classifier._found(w, classifier._windows(w, direct[k : k + 100]))[0] for k in range(0, len(direct), 100)]))
    want = 1 / (1 + np.exp(-classifier._logit(w, h.mean(0, keepdims=True), h.max(0, keepdims=True))))
    together = classifier.scores(w, [b"", long, b"short"])
    assert together[1] == pytest.approx(want[0], abs=1e-5)
    assert [classifier.scores(w, [t])[0] for t in (b"", long, b"short")] == pytest.approx(together, abs=1e-5)


def test_accuracy_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = classifier.op11_classifier(spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "a b", 2.0), (2, "", 3.0), (2, "", 3.0), (3, "word " * 100_000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    got = classifier.classify(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and {r.doc_id: r.held_out for r in got}[None]
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(0.9 < r.score < 1 for r in classifier.classify(docs, ones).collect())
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    assert classifier.classify(docs, both, per_class=2).count() == 5
    assert classifier.classify(docs.limit(0), both).count() == 0
