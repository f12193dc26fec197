"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of `window` consecutive words of the benchmark items (a shorter item is one window). A table
gives for each block of words how far a search may shift: the block's least distance from the end of any pattern. Where it
is 0, the block picks a bucket of patterns by their suffix, and a direct comparison of all words confirms. Long windows
share one table; shorter items have one for each length.

The patterns go to every task. They are small by a check, not by hope: the benchmark's words are counted first, and beyond
`max_words` they are searched in parts of that size, each in a pass of its own over the documents, whose result is written
before the next part is read; the passes are then merged by document and text, with the same result. An item that is longer
than a part is cut into pieces that share their windows' words. Items are the stated query set; no document is compared with
another.

Edge cases: null and empty texts have no words and no hits; equal windows of several items count for each item; items
without words match nothing; items of null id are searched like others, are left out of items and count as one in n_items;
repeated document rows come back repeated; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, read, text_key

#: Bytes that are no part of a word become blanks, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: The same words by characters.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Patterns of one length m over words; block: words whose shift is looked up."""

    def __init__(self, m: int, block: int = 3) -> None:
        self.m, self.b = m, min(block, m)
        self.rest = m - self.b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[int]]] = defaultdict(dict)

    def add(self, pattern: tuple, item: int) -> None:
        for end in range(self.b, self.m + 1):
            key = pattern[end - self.b : end]
            self.shift[key] = min(self.shift.get(key, self.rest), self.m - end)
        self.buckets[pattern[-self.b :]].setdefault(pattern, []).append(item)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of every occurrence, in order."""
        m, b, rest, shift, n = self.m, self.b, self.rest, self.shift.get, len(words)
        end = m
        while end <= n:
            key = tuple(words[end - b : end])
            if step := shift(key, rest):
                end += step
                continue
            if (bucket := self.buckets.get(key)) and (items := bucket.get(tuple(words[end - m : end]))):
                yield end - m, items
            end += 1


def compile_items(items: list[tuple[str | None, str]], window: int = 10) -> list[WuManber]:
    """One searcher for each length of window; items are (id, text)."""
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = search_words(text)
        if m := min(window, len(words)):
            s = by_length.setdefault(m, WuManber(m))
            for w in {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}:
                s.add(w, item)
    return list(by_length.values())


def hits(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Disjoint sorted spans [start, end) of the hit words, and the items found."""
    spans, found = [], set()
    for s in searchers:
        for start, items in s.find(words):
            spans.append((start, start + s.m))
            found.update(items)
    return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint sorted spans of the same places; spans that touch are one."""
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(x) for x in merged]


def _parts(bench: DataFrame, item: str, text: str, window: int, max_words: int) -> Iterator[tuple[list[tuple[str | None, str]], bool]]:
    """The distinct items in parts, read part by part if there are several, and whether this is the only part.

    A part has at most twice max_words characters, and so max_words words, or is one piece of a longer item: max_words + window - 1 words.
    """
    rows = bench.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    most = 2 * max_words  # a word and its separator take two characters at least
    words = F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(max_words))
    pieces = F.transform(starts, lambda k: F.array_join(F.slice("w", k + 1, max_words + window - 1), " "))
    long = rows.where(F.length("t") > most).select("i", words.alias("w")).select("i", F.explode(pieces).alias("t"))
    rows = rows.where(F.length("t") <= most).union(long)
    rows = materialize(rows.distinct())
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size <= most:
        part = [tuple(r) for r in rows.collect()]
        discard(rows)
        yield part, True
        return
    # The driver sees a partition at a time, and no part is empty.
    part, held = [], 0
    for r in rows.repartition(2 * int(size // most) + 1, F.xxhash64("i", "t")).toLocalIterator():
        if part and held + len(r.t) > most:
            yield part, False
            part, held = [], 0
        part.append(tuple(r))
        held += len(r.t)
    discard(rows)
    yield part, False


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, kind: str, shared) -> DataFrame:
    """key, tk, n_words, n_hit, spans, items and nameless (an item of null id is found) of every row of (key, tk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, spans, items, nameless = [], [], [], [], []
            for t in b.column(2):
                words = search_words(t.as_py())
                s, found = hits(words, shared.value)
                n_words.append(len(words))
                n_hit.append(sum(e - a for a, e in s))
                spans.append([{"start": a, "end": e} for a, e in s])
                items.append(sorted(found - {None}))
                nameless.append(None in found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(nameless, pa.bool_())],
                names=["key", "tk", "n_words", "n_hit", "spans", "items", "nameless"],
            )

    return docs.transform(map_arrow, run, f"key {kind}, tk long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, nameless boolean")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_words, spans of all passes, items, nameless) with the spans merged, and n_hit."""
    for b in batches:
        spans = [merge([(s["start"], s["end"]) for s in x]) for x in b.column(2).to_pylist()]
        n_hit = pa.array([sum(e - a for a, e in x) for x in spans], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n_hit, pa.array([[{"start": a, "end": e} for a, e in x] for x in spans], _SPANS), b.column(3), b.column(4)], names=["key", "n_words", "n_hit", "spans", "items", "nameless"])


def find_contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 300_000) -> DataFrame:
    """key, n_words, n_hit, spans (word positions), items (sorted ids as strings) and n_items of every document row."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    slim = docs.select(F.col(key).alias("key"), text_key(F.col(text).cast("string")).alias("tk"), F.col(text).cast("string").alias("text"))
    passes = []
    for part, only in _parts(bench, item, item_text, window, max_words):
        shared = spark.sparkContext.broadcast(compile_items(part, window))
        passes.append(_pass(slim, kind, shared))
        if not only:
            passes[-1] = materialize(passes[-1])
            shared.destroy()
    n_items = (F.size("items") + F.col("nameless").cast("int")).cast("long").alias("n_items")
    if len(passes) == 1:
        return passes[0].select(F.col("key").alias(key), "n_words", "n_hit", "spans", "items", n_items)
    # Several parts: equal rows of key and text are merged over the passes, and come back as often as the first pass has them.
    every = passes[0].withColumn("first", F.lit(1))
    for p in passes[1:]:
        every = every.union(p.withColumn("first", F.lit(0)))
    one = every.groupBy("key", "tk", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("nameless").alias("nameless"), F.sum("first").alias("n"))
    rows = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("key", "n_words", "spans", "items", "nameless")
    rows = rows.transform(map_arrow, _merged, f"key {kind}, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, nameless boolean")
    return rows.select(F.col("key").alias(key), "n_words", "n_hit", "spans", "items", n_items)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 300_000) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns; no document is shuffled."""
    at = docs.columns.index(text)

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not any(next(s.find(w), None) for s in shared.value) for w in (search_words(t.as_py()) for t in b.column(at))], pa.bool_()))

        return run

    last = None
    for part, only in _parts(bench, item, item_text, window, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(compile_items(part, window))
        docs = docs.transform(map_arrow, clean(shared), docs.schema)
        if not only:
            docs = materialize(docs)
            shared.destroy()
            if last is not None:
                discard(last)
            last = docs
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS win FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, sizes WHERE len(ws) >= m)),
f AS (SELECT DISTINCT doc_id, m, i, item_id FROM dw JOIN bw USING (m, win)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) FROM f) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM f) GROUP BY 1)
SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
