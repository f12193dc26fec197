"""Substring dedup by sliding sentence spans.

A text is cut into sentences (up to a run of . ! ? or their like in other scripts or a line break, with the white space behind); a sentence of more than 25
words is cut behind words at which the hash of the last three words is the least among those of the four words on either side, so
that copies of a passage are cut at the same words wherever it stands, but for the few words at its ends. What is still longer
than 25 words (mostly where words repeat) is cut at its least hashes. Every run of `span` consecutive sentences that has at
least min_words words is hashed, over its words in lower case, and the hashes are joined
over all documents by 128 bits. The first run of a hash stays (smallest doc_id, then the earliest in its text); the sentences of all
others are removed, and the rest of the text stays as it was.

Hashes are counted with partial sums before the shuffle; only those that occur twice or more are joined back, by a join that
adaptive execution can split, so a passage that a third of all documents share is no task of its own.

Edge cases: null and empty texts have no sentences and stay as they are; fewer than `span` sentences make no run; rows that
repeat doc_id and text are one document and change alike; a null doc_id sorts first; an empty table gives an empty result;
all columns of df come back, the text changed, with n_sentences, n_removed and copied_from added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, read, text_key

_ENDS = ".!?\n\u2026\u3002\uff01\uff0e\uff1f\u0964\u061f\u06d4"
_SENTENCE = re.compile(rf"[^{_ENDS}]*[{_ENDS}]+\s*|[^{_ENDS}]+")
_WORDS = re.compile(r"\S+\s*")
LONGEST = 25
#: Words on either side that a cut looks at; a part of a cut sentence has more words than that, its last one as many at least.
REACH = 4


def _cuts(words: list[str]) -> list[int]:
    """Places in a long sentence to cut at, by what the words are, not by where they stand."""
    low = [w.strip().lower() for w in words]
    h = [xxhash.xxh3_64_intdigest(" ".join(low[max(0, i - 2) : i + 1]).encode("utf-8", "surrogatepass")) for i in range(len(low))]
    out = []
    for i in range(REACH, len(h) - REACH):
        x = h[i]
        if x == min(h[i - REACH : i + REACH + 1]) and x not in h[i - REACH : i]:
            out.append(i + 1)
    every, at = [], 0
    for cut in [*out, len(h)]:
        while cut - at > LONGEST:
            upto = min(at + LONGEST, cut - REACH)
            at = min(range(at + REACH, upto), key=h.__getitem__) + 1
            every.append(at)
        every.append(cut)
        at = cut
    return every


def sentences(text: str | None) -> list[str]:
    """Consecutive parts that make up the whole text."""
    out = []
    for s in _SENTENCE.findall(text or ""):
        if len(s) > 2 * LONGEST and len(words := _WORDS.findall(s)) > LONGEST:
            words[0] = s[: len(s) - len(s.lstrip())] + words[0]
            cuts = _cuts(words)
            out += ["".join(words[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)]
        else:
            out.append(s)
    return out


def spans(text: str | None, span: int = 2, min_words: int = 10) -> list[tuple[int, bytes]]:
    """(first sentence, 128 bits of hash) of the runs of a text; sentences without words are passed over."""
    kept = [(i, w) for i, s in enumerate(sentences(text)) if (w := s.lower().split())]
    out = []
    for j in range(len(kept) - span + 1):
        run = kept[j : j + span]
        if sum(len(w) for _, w in run) >= min_words:
            out.append((j, xxhash.xxh3_128_digest("\n".join(" ".join(w) for _, w in run).encode("utf-8", "surrogatepass"))))
    return out


def _without(text: str, gone: set[int], span: int) -> tuple[str, int, int]:
    """The text without the runs that start at the given places; sentences with words, and how many of them went."""
    parts = sentences(text)
    worded = [i for i, s in enumerate(parts) if s.strip()]
    drop = {worded[k] for j in gone for k in range(j, j + span)}
    return "".join(s for i, s in enumerate(parts) if i not in drop), len(worded), len(drop)


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 2, min_words: int = 10) -> DataFrame:
    """(key, tk, at, source): runs that occurred before, with the key of the first document that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                rows, at, hashes = [], [], []
                for i, t in enumerate(part.column(2)):
                    for j, h in spans(t.as_py(), span, min_words):
                        rows.append(i)
                        at.append(j)
                        hashes.append(h)
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(at, pa.int32()), *(pa.array(x) for x in np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2).T.copy())], names=["key", "tk", "at", "h", "h2"])

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).alias("key"), text_key(F.col(text)).alias("tk"), F.col(text).cast("string").alias("text"))
    runs = materialize(slim.transform(map_arrow, run, f"key {kind}, tk long, at int, h long, h2 long"))
    # Repeats first, from the hashes alone; then their first places.
    again = runs.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h", "h2")
    some = materialize(runs.join(again, ["h", "h2"]))
    discard(runs)
    first = materialize(some.groupBy("h", "h2").agg(F.min(F.struct("key", "tk", "at")).alias("first")))  # so that the join deals both sides out by itself
    later = some.join(first, ["h", "h2"]).where(~F.struct("key", "tk", "at").eqNullSafe(F.col("first")))
    later = materialize(later.select("key", "tk", "at", F.col("first.key").alias("source")))
    discard(some, first)
    return later


def dedup_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 2, min_words: int = 10) -> DataFrame:
    """Every row of df without the sentences of non-first runs; copied_from: the keys of the documents with the first copies."""
    df = df.drop(*({"n_sentences", "n_removed", "copied_from"} - {key, text}))  # the columns made here take their place
    gone = repeated_spans(df, key, text, span, min_words).groupBy("key", "tk").agg(F.collect_set("at").alias("_kx_gone"), F.array_sort(F.collect_set("source")).alias("copied_from"))
    rows = df.withColumn("_kx_tk", text_key(F.col(text)))
    rows = rows.join(gone, F.col(key).eqNullSafe(gone["key"]) & (F.col("_kx_tk") == gone["tk"]), "left").select(df["*"], "_kx_gone", "copied_from")
    at = rows.columns.index(text)
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, n, removed = [], [], []
            for t, g in zip(b.column(at), b.column(len(kinds)), strict=True):
                t, g = t.as_py(), g.as_py()
                kept, all_, cut = _without(t or "", set(g or ()), span)
                new.append(kept if g else t)
                n.append(all_)
                removed.append(cut)
            columns = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), b.column(len(kinds) + 1)], names=[*kinds, "n_sentences", "n_removed", "copied_from"])

    return rows.transform(map_arrow, run, f"{fields}, n_sentences long, n_removed long, copied_from array<{kinds[key]}>")


def op5_substring(spark, sf_dir: str) -> DataFrame:
    """Every document without the sentences that earlier documents have."""
    return dedup_spans(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed", "copied_from")
