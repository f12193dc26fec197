"""Phrase collocation mining: frequent phrases of two to four words, counted pair by pair in tiles.

A text is split into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words at blanks and tabs, after A-Z are lower-cased. Words
are counted for each language. Those that occur min_count times get ids by falling frequency: the first HEAD of them their
rank, the others 64 bits of their hash. Neighbouring words make a pair, a pair of ids. In each task, pairs of ranks fall into
tiles of 1024 x 1024 ids: a tile with many pairs is counted in a dense array addressed by the two ids (bincount), the pairs
of sparse tiles, and those of hashed ids, are sorted and counted as coordinates. Spark adds the tasks' counts up. Frequent
pairs are ranked and get ids the same way, and pairs of pairs are counted by the same tiles: two pairs that overlap in a word
make a phrase of three words, two that touch one of four.

What is broadcast has a fixed bound: HEAD keys and a bitmap of at most 2^BITS bits that tells which keys can be frequent; where
it errs by keeping a key, the counts still decide. 64 bits stand for a word, or a pair, in its language.

A phrase of min_count occurrences a is cut behind its first k words; with l and r the occurrences of the two parts the score is
floor(2000000 * a / (l + r)). The cut of the lowest score counts, then the smallest k. A phrase goes if a longer frequent one
holds it and has at least `covered` hundredths of its occurrences; as a phrase is no rarer than any that holds it, looking at
those with one word more is enough. The first `top` phrases of each language stay, by score, occurrences, and phrase.

Edge cases: null and empty texts have no words; a null language is `und`; rows that are repeated count each; no phrase crosses
the end of a text; phrases that tie in score and occurrences go by the bytes of their text; a table without frequent words
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, read

#: Ids that are ranks; bits of the largest bitmap; ids of a tile's side, as a power of two; pairs from which a tile is dense.
HEAD, BITS, SIDE, DENSE = 1 << 16, 26, 10, 1 << 16
#: Bytes of texts that are split together, and pairs or words that a task gathers before it counts them.
PART, GATHERED = 1 << 21, 1 << 21

_u64 = np.uint64
_TOP = _u64(1 << 63)
_BASE, _INVERSE = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64)
_KIND = np.zeros(256, np.uint8)  # 0 of a word, 1 blank, 2 ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = np.frombuffer(hashlib.shake_256(b"values of bytes").digest(2048), "<u8")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit keys; the top bit is set, which no rank has."""
    x = (x ^ (x >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u64(27))) * _u64(0x94D049BB133111EB)
    return (x ^ (x >> _u64(31))) | _TOP


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(_mix(left.astype(_u64)) * _u64(_BASE) + right.astype(_u64))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, _u64)
    x[:1] = 1
    return np.cumprod(x)


@dataclass
class Tokens:
    """The words of some texts in a row: keys, and whether a word begins a piece; data, start and end say where they are."""

    keys: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(texts: list[bytes], langs: list[str]) -> Tokens:
    """Splits and hashes all words of the texts at once: a word's hash is a polynomial of its bytes."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    kind = _KIND[data]
    word = np.r_[False, kind == 0, False]
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    value = _VALUE[data] * _powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, _u64)
    np.cumsum(value, out=sums[1:])
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], _u64)
    keys = _mix((sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start] + (end - start).astype(_u64)) ^ lang[doc] | _TOP
    pieces = np.cumsum(kind == 2, dtype=np.int32)[start]
    return Tokens(keys, np.r_[True, pieces[1:] != pieces[:-1]][: len(start)], doc, data, start, end)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and their languages, about PART bytes at a time."""
    for b in batches:
        texts, langs, size = [], [], 0
        for t, lang in zip(b.column(0), b.column(1), strict=True):
            texts.append((t.as_py() or "").encode())
            langs.append(lang.as_py())
            size += len(texts[-1])
            if size >= PART:
                yield texts, langs
                texts, langs, size = [], [], 0
        if texts:
            yield texts, langs


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each key, and the sums of n."""
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    sums = np.zeros(len(at), np.int64)
    np.add.at(sums, back, n)
    return at, sums


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n); rows without a word have all words of a language."""
    keys, counts, words, langs_of, total = [], [], [], [], {}

    def counted() -> pa.RecordBatch:
        at, n = _summed(np.concatenate([*keys, np.empty(0, _u64)]), np.concatenate([*counts, np.empty(0, np.int64)]))
        key = np.concatenate([*keys, np.empty(0, _u64)])[at].view(np.int64)
        out = [pa.array([langs_of[i] for i in at.tolist()], pa.string()), pa.array([words[i].decode() for i in at.tolist()], pa.string()), pa.array(key), pa.array(n)]
        for held in (keys, counts, words, langs_of):
            held.clear()
        return pa.RecordBatch.from_arrays(out, names=["lang", "word", "key", "n"])

    for texts, langs in _parts(batches):
        t = tokens(texts, langs)
        key, at, n = np.unique(t.keys, return_index=True, return_counts=True)
        data = t.data.tobytes()
        keys.append(key)
        counts.append(n.astype(np.int64))
        words += [data[a:b] for a, b in zip(t.start[at].tolist(), t.end[at].tolist(), strict=True)]
        langs_of += [langs[d] for d in t.doc[at].tolist()]
        for d, n in zip(*np.unique(t.doc, return_counts=True), strict=True):
            total[langs[d]] = total.get(langs[d], 0) + int(n)
        if len(words) >= GATHERED // 2:
            yield counted()
    yield counted()
    none = pa.nulls(len(total))
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(total.values(), pa.int64())], names=["lang", "word", "key", "n"])


@dataclass
class Known:
    """Which keys are frequent: those of the head with their ranks, and a bitmap that holds all of them and few others."""

    keys: np.ndarray
    ranks: np.ndarray
    bitmap: np.ndarray
    bits: int

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each key, a rank or the key itself, and whether it can be frequent."""
        at = np.searchsorted(self.keys, keys)
        ranked = np.r_[self.keys, _u64(0)][at] == keys
        ids = np.where(ranked, np.r_[self.ranks, 0][at], keys.view(np.int64))
        bit = keys << _u64(1) >> _u64(64 - self.bits)
        return ids, ranked | (self.bitmap[bit >> _u64(3)] >> (bit & _u64(7)).astype(np.uint8) & 1).astype(bool)


class Tiles:
    """Counts pairs of ids."""

    def __init__(self) -> None:
        self.codes, self.pairs, self.held = [], [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        ranked = (left >= 0) & (right >= 0)
        side, inside = HEAD >> SIDE, (1 << SIDE) - 1
        a, b = left[ranked], right[ranked]
        self.codes.append(((a >> SIDE) * side + (b >> SIDE)) << 2 * SIDE | (a & inside) << SIDE | b & inside)
        self.pairs.append((left[~ranked], right[~ranked]))
        self.held += len(left)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """left, right and count of all that was added since."""
        code = np.concatenate([*self.codes, np.empty(0, np.int64)])
        left, right = (np.concatenate([*(p[i] for p in self.pairs), np.empty(0, np.int64)]) for i in range(2))
        self.codes, self.pairs, self.held = [], [], 0
        tile = code >> 2 * SIDE
        size = np.bincount(tile, minlength=1)
        found, counts = [], []
        for t in np.flatnonzero(size >= DENSE).tolist():
            n = np.bincount(code[tile == t] & (1 << 2 * SIDE) - 1, minlength=1 << 2 * SIDE)
            at = np.flatnonzero(n)
            found.append(at | t << 2 * SIDE)
            counts.append(n[at])
        sparse, n = np.unique(code[size[tile] < DENSE], return_counts=True)
        code = np.concatenate([*found, sparse])
        side, inside = HEAD >> SIDE, (1 << SIDE) - 1
        tile = code >> 2 * SIDE
        a, b = tile // side << SIDE | code >> SIDE & inside, tile % side << SIDE | code & inside
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])][: len(left)])
        return np.concatenate([a, left[new]]), np.concatenate([b, right[new]]), np.concatenate([*counts, n, np.diff(np.r_[new, len(left)])]).astype(np.int64)


def _runs(first: np.ndarray, known: np.ndarray, words: int) -> np.ndarray:
    """Places from which so many known words follow in one piece."""
    n = len(first) - words + 1
    if n <= 0:
        return np.empty(0, np.int64)
    good = reduce(np.logical_and, (known[i : i + n] for i in range(words)))
    return np.flatnonzero(good & ~reduce(np.logical_or, (first[i : i + n] for i in range(1, words)), np.zeros(n, bool)))


def _counter(words, pairs=None):
    """Counts pairs of words, or where pairs are known pairs of these: (size, l, r, n), size in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = {size: Tiles() for size in ((3, 4) if pairs else (2,))}

        def counted(size: int) -> pa.RecordBatch:
            left, right, n = tiles[size].counted()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), pa.array(left), pa.array(right), pa.array(n)], names=["size", "l", "r", "n"])

        for texts, langs in _parts(batches):
            t = tokens(texts, langs)
            ids, known = words.value.ids(t.keys)
            if pairs is None:
                at = _runs(t.first, known, 2)
                tiles[2].add(ids[at], ids[at + 1])
            elif len(ids) > 1:
                two, frequent = pairs.value.ids(_pair_keys(ids[:-1], ids[1:]))
                both = known[:-1] & known[1:] & frequent & ~t.first[1:]
                at = np.flatnonzero(both[:-1] & both[1:])
                tiles[3].add(two[at], two[at + 1])
                at = np.flatnonzero(both[:-2] & both[1:-1] & both[2:])
                tiles[4].add(two[at], two[at + 2])
            for size in tiles:
                if tiles[size].held >= GATHERED:
                    yield counted(size)
        for size in tiles:
            yield counted(size)

    return run


def _slices(bits: int):
    """(slice, bitmap) of the keys, 2^15 bits a slice; a slice's keys come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column(0).to_numpy().view(_u64) << _u64(1) >> _u64(64 - bits)
            for s in np.unique(bit >> _u64(15)).tolist():
                here = (bit[bit >> _u64(15) == s] & _u64((1 << 15) - 1)).astype(np.int64)
                made.setdefault(s, np.zeros(1 << 15, bool))[here] = True
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], names=["slice", "bitmap"])

    return run


def _ranked(table: DataFrame, head: int) -> tuple[DataFrame, Known]:
    """table (key, n, ...) with the column id, and what tasks must know of its keys."""
    spark = table.sparkSession
    head = table.orderBy(F.desc("n"), "key").limit(min(head, HEAD)).select("key").toArrow().column(0).to_numpy()
    bits = min(BITS, max(16, int(table.count() * 64).bit_length()))
    dealt = table.select("key").repartition(1 << max(0, bits - 21), F.shiftrightunsigned(F.shiftleft("key", 1), 64 - bits + 15))
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for row in dealt.transform(map_arrow, _slices(bits), "slice long, bitmap binary").toLocalIterator():
        bitmap[row.slice << 12 : row.slice + 1 << 12] |= np.frombuffer(row.bitmap, np.uint8)
    order = np.argsort(head.view(_u64))
    ranks = spark.createDataFrame(pa.table({"key": pa.array(head, pa.int64()), "rank": pa.array(np.arange(len(head)), pa.int64())}))
    return materialize(table.join(ranks, "key", "left").withColumn("id", F.coalesce("rank", "key")).drop("rank")), Known(head.view(_u64)[order], order.astype(np.int64), bitmap, bits)


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_pair_keys(b.column(0).to_numpy(), b.column(1).to_numpy()).view(np.int64))], names=["l", "r", "n", "key"])


def _named(table: DataFrame, parts: DataFrame, left: str, right: str) -> DataFrame:
    """table joined with parts for its columns l and r; the parts' columns get the prefixes left and right."""
    for end, prefix in (("l", left), ("r", right)):
        table = materialize(table.join(parts.select(*[F.col(c).alias(f"{prefix}{c}") for c in parts.columns]), F.col(end) == F.col(f"{prefix}id")).drop(f"{prefix}id"))
    return table


def _cut(k: int, left: str, right: str) -> Column:
    score = F.expr(f"(cast(a as decimal(20, 0)) * 2000000) div cast({left} + {right} as decimal(21, 0))")
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, covered: int = 80, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of all phrases that stay, and (lang, n), the words of each language."""
    sc = df.sparkSession.sparkContext
    docs = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    counts = docs.transform(map_arrow, _count_words, "lang string, word string, key long, n long").groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n"))
    counts = materialize(counts.where(F.col("word").isNull() | (F.col("n") >= min_count)))
    totals = counts.where("word is null").select("lang", "n")

    words, known = _ranked(counts.where("word is not null"), head)
    known_words = sc.broadcast(known)
    frequent = lambda counter: docs.transform(map_arrow, counter, "size int, l long, r long, n long").groupBy("size", "l", "r").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counted = materialize(frequent(_counter(known_words)).select("l", "r", "n").transform(map_arrow, _with_keys, "l long, r long, n long, key long"))
    pairs, known = _ranked(counted, head)
    known_pairs = sc.broadcast(known)
    longer = materialize(frequent(_counter(known_words, known_pairs)))
    known_words.destroy()
    known_pairs.destroy()
    discard(counted)

    # Pairs: lw and rw are the words, ln and rn their counts.
    two = _named(pairs.select("id", "l", "r", F.col("n").alias("a")), words.select("id", "lang", "word", "n"), "l", "r").drop("rlang")
    ends = two.select("id", "l", "r", F.col("llang").alias("lang"), F.concat_ws(" ", "lword", "rword").alias("phrase"), F.col("lword").alias("first"), F.col("rword").alias("last"), F.col("ln").alias("first_n"), F.col("rn").alias("last_n"), "a")
    of = lambda size: _named(longer.where(F.col("size") == size).select("l", "r", "n").withColumnRenamed("n", "a"), ends.withColumnRenamed("a", "n"), "x", "y")
    three, four = of(3), of(4)
    # The pair in the middle of four words, and the two phrases of three words that it makes.
    middle = ends.select(F.col("id").alias("mid"), F.col("l").alias("xr"), F.col("r").alias("yl"))
    four = materialize(four.join(middle, ["xr", "yl"]))
    triple = three.select("l", "r", F.col("a").alias("n"))
    four = four.join(triple.select("l", F.col("r").alias("mid"), F.col("n").alias("front")), ["l", "mid"]).join(triple.select(F.col("l").alias("mid"), "r", F.col("n").alias("back")), ["mid", "r"])
    four = materialize(four)

    over = lambda table, *names: reduce(DataFrame.union, [table.select(*[F.col(c) for c in cols], "a") for cols in names])
    over_two = over(three, ["l"], ["r"]).groupBy(F.col("l").alias("id")).agg(F.max("a").alias("most"))
    over_three = over(four, ["l", "mid"], ["mid", "r"]).groupBy("l", F.col("mid").alias("r")).agg(F.max("a").alias("most"))
    stays = F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))
    two = two.join(over_two, "id", "left").where(stays).select(F.col("llang").alias("lang"), F.concat_ws(" ", "lword", "rword").alias("phrase"), "a", _cut(1, "ln", "rn").alias("cut"))
    three = three.join(over_three, ["l", "r"], "left").where(stays).select(F.col("xlang").alias("lang"), F.concat_ws(" ", "xphrase", "ylast").alias("phrase"), "a", F.least(_cut(1, "xfirst_n", "yn"), _cut(2, "xn", "ylast_n")).alias("cut"))
    four = four.select(F.col("xlang").alias("lang"), F.concat_ws(" ", "xphrase", "yphrase").alias("phrase"), "a", F.least(_cut(1, "xfirst_n", "back"), _cut(2, "xn", "yn"), _cut(3, "front", "ylast_n")).alias("cut"))
    return two.union(three).union(four).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), totals


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, covered: int = 80, top: int = 2000, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language) and score of the first phrases of each language."""
    found, totals = phrases(df, text, lang, min_count, covered, head)
    first = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):  # the first of each of 64 parts of a language, then the first of those
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of the documents."""
    return collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws[i : i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
cuts AS (SELECT c.lang, c.k, c.g, c.a, j, x.a AS l, y.a AS r, ((2000000 * c.a::HUGEINT) // (x.a + y.a))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN f x ON c.lang = x.lang AND x.g = c.g[1 : j] JOIN f y ON c.lang = y.lang AND y.g = c.g[j + 1 :]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
subs AS (SELECT lang, a, g[i : i + m - 1] AS g FROM (SELECT lang, a, g, k, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
most AS (SELECT lang, g, max(a) AS most FROM subs GROUP BY ALL),
kept AS (SELECT low.lang, array_to_string(low.g, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN most ON low.lang = most.lang AND low.g = most.g WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
