"""Spelling variant grouping: words one edit apart, found by dynamic programming over sorted word lists.

Words that differ by exactly one inserted, deleted or replaced code point share their first or their last half: with m the
shorter length, the first m // 2 code points, or the last m - m // 2. So every word goes to a few cells, one for each half and
length that it can share; in cells of last halves words are reversed. A cell is a sorted list. It is scanned for all its words
of length m at once: a stretch of the list whose words share their first d code points (by the longest common prefixes of
neighbours) has one row of the edit matrix for each searched word, a band of the three places around the diagonal. The row is
made once for the stretch and serves all stretches it falls into one code point further; where no place of the band is at most
one, the stretch is skipped. Half words that too many words share are salted: a cell holds two salts' words, so its size is
bounded, and every pair of words still meets in one cell.

group_variants() takes (word, n) and finds for each word its near words, its form (the near word of largest n, if that is at
least `ratio` times the word's n; ties go to the smallest in code-point order) and its root (the last form of a chain).

Edge cases: null and empty words are dropped, and words given twice count together; words of one code point are near each
other; a table without words gives an empty result; ids that are null count as empty in noisy_words(); null texts have no
words; only the named columns are read, so further ones may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a salt's words in a cell; a chunk of cells that are scanned together holds about as many.
CELL = 1 << 18
_FAR = 2


def noisy_words(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): the words of all texts, of which one in `every` loses a code point; which, the crc32 of key and word says."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    runs = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _scan(words: list[str], cell: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (shorter or equal, other) one edit apart in the same cell; rows are sorted by cell and word."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    width = int(size.max()) + 2
    table = np.zeros((n, width), np.uint32)
    table[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    shared = np.full(n, -1, np.int64)  # longest common prefix with the row before, -1 at the start of a cell
    shared[1:] = np.argmin(table[1:] == table[:-1], axis=1)
    shared[starts] = -1
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    q = np.flatnonzero(size == m)
    lo, hi = starts[of[q]], np.r_[starts[1:], n][of[q]]
    # The band: edits from the searched word's first d - 1, d and d + 1 code points to the stretch's first d.
    left, middle, right = (np.full(len(q), v, np.int8) for v in (_FAR, 0, 1))
    found_q, found_e = [q[:0]], [q[:0]]
    for d in range(width - 1):
        if not len(q):
            break
        whole = size[lo] == d  # the stretch begins with a word that ends here
        edits = np.choose(np.clip(size[q] - d + 1, -1, 3) % 4, [left, middle, right, np.int8(_FAR)])
        near = whole & (edits == 1)
        found_q.append(q[near])
        found_e.append(lo[near])
        ends = np.flatnonzero(shared <= d)
        first, last = np.searchsorted(ends, lo) + whole, np.searchsorted(ends, hi)
        many = last - first
        row = np.repeat(np.arange(len(q)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
        q, left, middle, right = q[row], left[row], middle[row], right[row]
        lo, hi = ends[at], np.r_[ends, n][at + 1]
        c = table[lo, d]
        new_left = np.minimum(left + (c != table[q, d - 1]) if d else np.int8(_FAR), middle + 1)
        new_middle = np.minimum(np.minimum(middle + (c != table[q, d]), right + 1), new_left + 1)
        new_right = np.minimum(right + (c != table[q, d + 1]), new_middle + 1)
        keep = np.minimum(np.minimum(new_left, new_middle), new_right) <= 1
        q, lo, hi = q[keep], lo[keep], hi[keep]
        left, middle, right = (np.minimum(x[keep], _FAR).astype(np.int8) for x in (new_left, new_middle, new_right))
    return np.concatenate(found_q), np.concatenate(found_e)


_PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The near words, both ways, of whole cells."""
    words, cell, m, side, salt, mixed, n = (rows.column(c) for c in ("word", "cell", "m", "side", "salt", "mixed", "n"))
    words, (cell, m, side, salt, mixed, n) = words.to_pylist(), (x.to_numpy() for x in (cell, m, side, salt, mixed, n))
    u, v = _scan(words, cell, m)
    # Each pair once: of two searched words the first, of a cell of two salts only what is in no other cell.
    good = ((m[v] != np.fromiter((len(words[i]) for i in v), np.int64, len(v))) | (u < v)) & (~mixed[u] | (salt[u] != salt[v]))
    u, v = u[good], v[good]
    out: dict[str, list] = {c: [] for c in _PAIRS.names}
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        a, b = words[i], words[j]
        if side[i]:
            a, b = a[::-1], b[::-1]
            if a[: m[i] // 2] == b[: m[i] // 2]:
                continue  # the cell of their first half has them
        for x, xn, y, yn in ((a, n[i], b, n[j]), (b, n[j], a, n[i])):
            for c, value in zip(out, (x, xn, y, yn), strict=True):
                out[c].append(value)
    yield pa.RecordBatch.from_pydict(out, schema=_PAIRS)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows of a partition between cells, at about CELL code points."""
    held, points = [], 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        cell = rows.column("cell").to_numpy()
        starts = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)] if len(cell) else np.zeros(1, int)
        done = np.cumsum(rows.column("m").to_numpy() + 2)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            new = not (held and a == 0 and held[-1].column("cell")[-1].as_py() == cell[0])
            if new and points >= CELL:
                yield from _pairs(pa.concat_tables(held))
                held, points = [], 0
            held.append(rows.slice(a, b - a))
            points += int(done[b - 1] - (done[a - 1] if a else 0))
    if held:
        yield from _pairs(pa.concat_tables(held))


def near_words(words: DataFrame, cell_points: int = CELL) -> DataFrame:
    """(word, n, near, near_n): all pairs of words one edit apart, both ways; words is (word, n) with distinct words."""
    size = F.length("word")
    shares = F.explode(F.array(*[F.struct((size - less).alias("m"), F.lit(side).alias("side")) for less in (0, 1) for side in (0, 1)]))
    half = F.floor(F.col("m") / 2).cast("int")
    rows = words.select("word", "n", shares.alias("s")).select("word", "n", "s.*").where("m > 0")
    part = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(F.expr("right(word, m - m div 2)"))
    rows = rows.select(F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"), "n", "m", "side", part.alias("half"))
    name = ["m", "side", "half"]
    large = rows.groupBy(*name).agg(F.count("*").alias("c")).select(*name, F.ceil(F.col("c") * (F.col("m") + 2) / cell_points).cast("int").alias("salts")).where("salts > 1")
    rows = rows.join(materialize(large), name, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    low, high = F.least("salt", "other"), F.greatest("salt", "other")
    # Words of a salt go to the cell of that salt alone and to those with each other salt.
    rows = rows.select("word", "n", "m", "side", "salt", (low != high).alias("mixed"), F.xxhash64("m", "side", "half", low, high).alias("cell"))
    rows = rows.repartition("cell").sortWithinPartitions("m", "cell", "word")
    return rows.transform(map_arrow, _near, "word string, n long, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed in steps of twice the length until none goes further."""
    links = materialize(forms.select("word", F.col("form").alias("to")))
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = materialize(links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        discard(links)
        links = longer
        if not links.where("moved").take(1):
            return links.select("word", F.col("to").alias("root"))


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of (word, n)."""
    words = words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words)
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    rows = words.join(near, "word", "left").withColumn("best_n", -F.col("best.n"))
    has = F.col("best_n") >= ratio * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    rows = rows.join(_roots(rows.where("form is not null")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return group_variants(noisy_words(read(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE raw AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT id, run, count(*) AS times FROM raw WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i::INT - 1, 2))::BIGINT)), lambda c, x:
        list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS h FROM runs),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
holes AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
one AS (SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, w.word FROM holes a JOIN w ON a.rest = w.word UNION SELECT w.word, a.word FROM holes a JOIN w ON a.rest = w.word),
best AS (SELECT one.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS form, max(w.n) AS form_n FROM one JOIN w ON one.near = w.word GROUP BY 1),
linked AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM linked UNION ALL SELECT walk.word, l.form FROM walk JOIN linked l ON walk.root = l.word WHERE l.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN linked l ON walk.root = l.word WHERE l.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN ends USING (word)
"""
