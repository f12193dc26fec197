"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes, each LAP bytes into the one before, so that every run of WIDTH bytes of
the whole text lies in a chunk. Bytes are embedded; learned filters run over each chunk and are max-pooled in it; a hidden layer
takes what the filters found in a chunk; its mean and its maximum over all chunks of the text give one probability. All chunks
of a text count, however long it is; they are scored CHUNKS at a time.

train() fits the network on a bounded sample: at most per_class labelled texts of each label, those of the smallest hashes of
their id, and of each at most `chunks` chunks, evenly spread. The sample is balanced where there are enough; the
prior of all labels to learn from is put back into the last constant. Rows for which crc32(key as text) mod folds is 0 are never
learnt from. The weights go to the tasks with the function; they have a fixed size.

Edge cases: a null or empty text is a chunk of padding; a null key counts as empty text in crc32; labels that are null or not 0
or 1 are not learnt from; a key labelled twice is taken once for each of its labels; with one label only, or none, the score is
the prior of the labels with one added to each; repeated rows are scored each; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read

CHUNK, LAP, WIDTH, CHUNKS = 512, 64, 8, 256
DIM, FILTERS, HIDDEN = 6, 24, 16
_PAD = 256

Weights = dict[str, np.ndarray]


def chunked(data: bytes, most: int = 0) -> np.ndarray:
    """Rows of CHUNK byte values, padded; at most so many, evenly spread, if most is given."""
    n = max(1, -(-(len(data) - LAP) // (CHUNK - LAP)))
    at = np.arange(n) if not most or n <= most else np.unique(np.linspace(0, n - 1, most).round().astype(np.int64))
    rows = np.full((len(at), CHUNK), _PAD, np.int16)
    for row, k in zip(rows, at.tolist(), strict=True):
        piece = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - k * (CHUNK - LAP)), k * (CHUNK - LAP)) if data else []
        row[: len(piece)] = piece
    return rows


def _windows(w: Weights, rows: np.ndarray) -> np.ndarray:
    """The embedded bytes of each place of a filter: (rows, places, WIDTH * DIM)."""
    x = w["bytes"][rows].reshape(len(rows), CHUNK * DIM)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM, axis=1)[:, ::DIM])


def _found(w: Weights, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each filter finds at best in each row, and where."""
    a = windows @ w["filters"]
    at = a.argmax(axis=1)
    return np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + w["bias"], 0), at


def _hidden(w: Weights, found: np.ndarray) -> np.ndarray:
    return np.maximum(found @ w["dense"] + w["dense_bias"], 0)


def _logit(w: Weights, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.concatenate([mean, most], axis=1) @ w["out"] + w["out_bias"]


def scores(w: Weights, texts: list[bytes]) -> np.ndarray:
    """A probability for each text."""
    total, most, n = np.zeros((len(texts), HIDDEN), np.float32), np.zeros((len(texts), HIDDEN), np.float32), np.zeros(len(texts))
    rows, of, held = [], [], 0

    def add() -> None:
        every, owner = np.concatenate(rows), np.concatenate(of)
        for k in range(0, len(every), CHUNKS):
            h, o = _hidden(w, _found(w, _windows(w, every[k : k + CHUNKS]))[0]), owner[k : k + CHUNKS]
            np.add.at(total, o, h)
            np.maximum.at(most, o, h)
            np.add.at(n, o, 1)
        rows.clear()
        of.clear()

    step = CHUNKS * (CHUNK - LAP)
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - LAP), step):  # a bounded part of a long text
            rows.append(chunked(t[k : k + step + LAP]))
            of.append(np.full(len(rows[-1]), i))
            held += len(rows[-1])
            if held >= CHUNKS:
                add()
                held = 0
    if rows:
        add()
    return 1 / (1 + np.exp(-_logit(w, total / n[:, None], most).astype(np.float64)))


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Weights:
    """Weights that tell the labels apart; each text is its rows of chunked(). Adam on the log loss."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    w = {"bytes": normal(_PAD + 1, DIM, scale=0.5), "filters": normal(WIDTH * DIM, FILTERS, scale=0.2), "bias": np.zeros(FILTERS, np.float32), "dense": normal(FILTERS, HIDDEN, scale=0.3), "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=0.2), "out_bias": np.zeros(1, np.float32)}
    moved, spread, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            g = _gradients(w, [texts[i] for i in some], labels[some])
            t += 1
            for name, d in g.items():
                moved[name] += 0.1 * (d - moved[name])
                spread[name] += 0.01 * (d * d - spread[name])
                now = rate * (1 - epoch / epochs)
                w[name] -= now * (moved[name] / (1 - 0.9**t)) / (np.sqrt(spread[name] / (1 - 0.99**t)) + 1e-7)
    return w


def _gradients(w: Weights, texts: list[np.ndarray], labels: np.ndarray) -> Weights:
    """Of the mean log loss. Only the places where a filter found most take part in its slope."""
    rows, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    of, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    windows = _windows(w, rows)
    found, at = _found(w, windows)
    h = _hidden(w, found)
    mean, most = np.add.reduceat(h, starts) / sizes[:, None], np.maximum.reduceat(h, starts)
    p = 1 / (1 + np.exp(-_logit(w, mean, most)))
    dz = ((p - labels) / len(labels)).astype(np.float32)
    ends = dz[:, None] * w["out"]
    top = h == most[of]
    dh = (ends[:, :HIDDEN] / sizes[:, None])[of] + ends[of, HIDDEN:] * top / np.add.reduceat(top, starts, dtype=np.float32)[of]
    dh = dh.astype(np.float32) * (h > 0)
    df = (dh @ w["dense"].T) * (found > 0)
    best = np.take_along_axis(windows, at[:, :, None], 1)  # (rows, FILTERS, WIDTH * DIM)
    dx = (df[:, :, None] * w["filters"].T).reshape(-1, DIM)
    values = rows[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)].ravel()
    slope = np.stack([np.bincount(values, dx[:, i], _PAD + 1) for i in range(DIM)], 1).astype(np.float32)
    return {"bytes": slope, "filters": np.einsum("cf,cfw->wf", df, best), "bias": df.sum(0), "dense": found.T @ dh, "dense_bias": dh.sum(0), "out": np.concatenate([mean, most], 1).T.astype(np.float32) @ dz, "out_bias": dz.sum(keepdims=True)}


def _fold(key: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, per_class: int = 1000, chunks: int = 4) -> Weights:
    """The network, fitted on a bounded sample of the labelled rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (_fold(key, folds) != 0)).select(F.col(key).alias("_kx_key"), F.col(label).cast("int").alias("_kx_label")).distinct()
    counts = {r["_kx_label"]: r["count"] for r in known.groupBy("_kx_label").count().collect()}
    order = F.xxhash64("_kx_key")
    some = [known.where(F.col("_kx_label") == v).orderBy(order, "_kx_key").limit(per_class) for v in (0, 1)]
    rows = df.select(F.col(key).alias("_kx_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(some[0].union(some[1])), "_kx_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [chunked((t.as_py() or "").encode(), chunks).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["place", "label", "rows"])

    sample = rows.select(order.alias("place"), F.col("_kx_label").alias("label"), "text").transform(map_arrow, cut, "place long, label int, rows binary")
    found = sorted(map(tuple, sample.orderBy("place", "label", "rows").limit(4 * per_class).collect()))  # ids repeat at most a bounded number of times
    y = np.array([r[1] for r in found], np.float32)
    prior = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    if len(set(y.tolist())) < 2:
        w = fit([chunked(b"")], np.ones(1, np.float32), epochs=0)
        return w | {"out": np.zeros_like(w["out"]), "out_bias": np.array([prior], np.float32)}
    w = fit([np.frombuffer(r[2], np.int16).reshape(-1, CHUNK) for r in found], y)
    w["out_bias"] += np.float32(prior - np.log(y.sum() / (1 - y).sum()))
    return w


def score(df: DataFrame, w: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNKS):
                part = b.slice(at, CHUNKS)
                found = scores(w, [(t.as_py() or "").encode() for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.round(6))], names=["key", "score"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).transform(map_arrow, run, f"key {kind}, score double").withColumnRenamed("key", key)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, per_class: int = 1000, limit: float = 0.3) -> DataFrame:
    """key, held_out (never learnt from), score and predicted (1 if the score is at least limit) of every row."""
    found = score(df, train(df, labels, key, text, label, folds, per_class), key, text)
    return found.select(key, (_fold(key, folds) == 0).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op11_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
