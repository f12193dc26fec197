"""Line dedup with a suffix array over line sequences, built by distributed prefix doubling.

The lines with a word (ends trimmed) of a document are a sequence. A line is deleted if it lies in a run of lines of at least
min_words words that occurs earlier: in a document before this one (by doc_id), or further up in the same one. The first copy
of a run stays.

Round k gives every suffix the rank of its first 2^k lines: the number of suffixes whose first 2^k lines sort before, by the
lines' hashes. Suffixes of one rank are an interval of the suffix array whose longest common prefix is at least 2^k lines;
suffixes alone in their interval repeat nothing and leave. A rank is refined by the rank of the suffix 2^k lines further: the
pairs are counted, and a running sum inside each rank gives the new ones: over 64 stretches of the second rank, over the 64
ranges of a stretch and inside each range; so neither suffixes nor pairs are gathered by rank.

A run of m lines, 2^k <= m < 2^(k+1), is named by the ranks (round k) at its start and 2^k lines before its end. It is enough
to look at the shortest runs of min_words words that start, and that end, at each line: every line of a longer repeated run
is in one of them that repeats with it. They have min_words lines at most, so log2(min_words) rounds do. DataFrame functions
only; every round is written to the shared folder.

Edge cases: null and empty texts have no lines and stay as they are; lines without words are no part of a sequence and are never
deleted; what is not deleted stays as it is; rows that repeat doc_id and text are one document and change alike; a null doc_id sorts first; an empty table gives an empty result; extra columns pass through dedup_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, discard, materialize, read, text_key

_WORD = r"[^\x20\x09-\x0D]"
_SIDE = 64
_RANGES = _SIDE**2


def _worded(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(_WORD))


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _running(table: DataFrame, within: list[str], part: str, order: list[str]) -> DataFrame:
    """table with before: the sum of n over the rows of the same `within` that come earlier, by part, then order.

    A task holds _SIDE stretches of parts of one group, the _SIDE parts of one stretch, or one part, never a whole group.
    """
    upto = lambda *cols: Window.partitionBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, over: F.coalesce(F.sum(n).over(over), F.lit(0))
    table = table.withColumn("stretch", F.floor(F.col(part) / _SIDE))
    stretches = table.groupBy(*within, "stretch").agg(F.sum("n").alias("all"))
    stretches = stretches.select(*within, "stretch", before("all", upto(*within).orderBy("stretch")).alias("s"))
    parts = table.groupBy(*within, "stretch", part).agg(F.sum("n").alias("all"))
    parts = parts.select(*within, "stretch", part, before("all", upto(*within, "stretch").orderBy(part)).alias("p"))
    starts = materialize(parts.join(stretches, [*within, "stretch"]).select(*within, part, (F.col("s") + F.col("p")).alias("start")))
    inside = table.withColumn("inside", before("n", upto(*within, part).orderBy(*order)))
    out = materialize(inside.join(starts, [*within, part]).select(*within, *order, (F.col("start") + F.col("inside")).alias("before")))
    discard(starts)
    return out


def _first_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """(h1, h2, before): ranks of the lines that occur more than once, and a bound of the ranks."""
    seen = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("bucket", F.shiftright("h1", 52)))
    total = seen.agg(F.sum("n")).first()[0] or 0
    ranks = _running(seen.withColumn("one", F.lit(0)), ["one"], "bucket", ["h1", "h2"])
    discard(seen)
    return ranks, total


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """(key, tk, seq): the lines to delete; seq counts the lines with words of a document from 0."""
    line = F.posexplode(F.transform(_worded(F.col(text)), _trim)).alias("seq", "line")
    lines = df.select(F.col(key).alias("key"), text_key(F.col(text)).alias("tk"), line)
    lines = lines.select("key", "tk", "seq", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.size(F.split("line", BLANKS)).alias("w"))
    table = lines = materialize(lines)

    # Shortest runs of min_words words: from each line on, and up to each line.
    doc = Window.partitionBy("key", "tk")
    lines = lines.dropDuplicates(["key", "tk", "seq"])  # rows repeated in full
    upto = F.sum("w").over(doc.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("w"))
    rows = rows.withColumn("words", F.sum("w").over(doc)).withColumn("n", F.count("*").over(doc))
    after = F.first("seq").over(doc.orderBy("start").rangeBetween(min_words, Window.unboundedFollowing))
    before = F.last("seq").over(doc.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    rows = rows.withColumn("to", F.coalesce(after, F.when(F.col("words") - F.col("start") >= min_words, F.col("n"))).cast("int"))
    rows = rows.withColumn("from", F.coalesce(before + 1, F.when(F.col("upto") >= min_words, F.lit(0))).cast("int"))
    ranks, total = _first_ranks(lines)
    rows = materialize(rows.join(ranks, ["h1", "h2"]).select("key", "tk", F.col("seq").cast("long").alias("seq"), "from", "to", F.col("before").alias("r0")))
    discard(table, ranks)

    k = 0
    while 1 << k + 1 <= min_words:
        ahead = doc.orderBy("seq").rangeBetween(1 << k, 1 << k)
        old, rows = rows, rows.withColumn("next", F.first(f"r{k}").over(ahead))
        pairs = rows.where(f"r{k} is not null and next is not null").groupBy(f"r{k}", "next").agg(F.count("*").alias("n"))
        pairs = materialize(pairs.where("n > 1").withColumn("range", F.floor(F.col("next") / (total // _RANGES + 1))))
        ranks = _running(pairs, [f"r{k}"], "range", ["next"])
        rows = materialize(rows.join(ranks, [f"r{k}", "next"], "left").withColumn(f"r{k + 1}", F.col(f"r{k}") + F.col("before")).drop("next", "before"))
        discard(old, pairs, ranks)
        k += 1

    # Names of the runs, all of whose lines repeat.
    run = F.explode(F.array(F.struct(F.col("seq").alias("a"), F.col("to").cast("long").alias("b")), F.struct(F.col("from").cast("long").alias("a"), (F.col("seq") + 1).alias("b")))).alias("run")
    runs = rows.select("key", "tk", run).select("key", "tk", "run.*").where("a is not null and b is not null").distinct()
    m = F.col("b") - F.col("a")
    level = sum((F.when(m >= 1 << i, 1).otherwise(0) for i in range(1, k + 1)), F.lit(0))
    runs = runs.withColumn("level", level).withColumn("c", F.expr("b - shiftleft(1L, level)"))
    at = lambda name: F.coalesce(*[F.when(F.col("level") == i, F.col(f"{name}{i}")) for i in range(k + 1)])
    ranked = rows.select("key", "tk", "seq", *[f"r{i}" for i in range(k + 1)])
    for end in ("a", "c"):
        there = ranked.select(F.col("key").alias("k2"), F.col("tk").alias("t2"), F.col("seq").alias(end), *[F.col(f"r{i}").alias(f"{end}r{i}") for i in range(k + 1)])
        runs = runs.join(there, (runs["key"].eqNullSafe(there["k2"])) & (runs["tk"] == there["t2"]) & (runs[end] == there[end])).drop("k2", "t2").drop(there[end])
        runs = runs.withColumn(f"{end}_rank", at(f"{end}r")).drop(*[f"{end}r{i}" for i in range(k + 1)]).where(F.col(f"{end}_rank").isNotNull())
    table, runs = rows, materialize(runs.select("key", "tk", "a", "b", F.xxhash64((F.col("b") - F.col("a")), "a_rank", "c_rank").alias("name"), (F.col("b") - F.col("a")).alias("m"), "a_rank", "c_rank"))
    name = ["name", "m", "a_rank", "c_rank"]
    # Written, so that the join below deals both sides out by itself and can split a common run.
    first = materialize(runs.groupBy(*name).agg(F.min(F.struct("key", "tk", "a")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = runs.join(first, name).where(~F.struct("key", "tk", "a").eqNullSafe(F.col("first")))
    gone = materialize(later.select("key", "tk", F.explode(F.sequence(F.col("a").cast("int"), (F.col("b") - 1).cast("int"))).alias("seq")).distinct())
    discard(table, runs, first)
    return gone


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_words: int = 20) -> DataFrame:
    """All rows and columns of df without the repeated lines, with n_lines (lines with words) and n_deleted; n_chars anew where lines went."""
    df = df.drop(*({"n_lines", "n_deleted"} - {key, text}))  # the columns made here take their place
    gone = repeated_lines(df, key, text, min_words).groupBy("key", "tk").agg(F.collect_set("seq").alias("_kx_gone"))
    gone = gone.select("key", "tk", F.size("_kx_gone").alias("_kx_dropped"), F.sort_array("_kx_gone").alias("_kx_gone"))
    rows = df.withColumn("_kx_tk", text_key(F.col(text)))
    rows = rows.join(gone, F.col(key).eqNullSafe(gone["key"]) & (F.col("_kx_tk") == gone["tk"]), "left")
    # Where the deleted lines stand among all lines, and a flag for each line up to the last of them: looking one up takes no search.
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORD), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_kx_worded", F.when(F.col("_kx_dropped").isNotNull(), worded)).withColumn("_kx_gone", F.transform("_kx_gone", lambda s: F.get("_kx_worded", s)))
    rows = rows.withColumn("_kx_keep", F.expr("flatten(transform(_kx_gone, (x, i) -> concat(array_repeat(true, x - if(i = 0, 0, _kx_gone[i - 1] + 1)), array(false))))"))
    left = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get("_kx_keep", i), F.lit(True))), "\n")
    changed = F.col("_kx_dropped").isNotNull()
    rows = rows.withColumn("_kx_left", F.when(changed, left).otherwise(F.col(text)))
    kinds = dict(df.dtypes)
    out = [F.col("_kx_left").alias(c) if c == text else F.when(changed, F.length("_kx_left").cast(kinds[c])).otherwise(df[c]).alias(c) if c == n_chars else df[c] for c in df.columns]
    return rows.select(*out, F.size(_worded(df[text])).cast("long").alias("n_lines"), F.coalesce("_kx_dropped", F.lit(0)).cast("long").alias("n_deleted"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs."""
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


OP3_SQL = r"""
WITH RECURSIVE raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS every, list_filter(every, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
al AS (SELECT doc_id, l, pos, CASE WHEN regexp_matches(l, '[^\x20\x09-\x0D]') THEN count(*) FILTER (regexp_matches(l, '[^\x20\x09-\x0D]')) OVER (PARTITION BY doc_id ORDER BY pos) - 1 END AS seq FROM (SELECT doc_id, unnest(every) AS l, unnest(range(len(every))) AS pos FROM raw)),
l0 AS (SELECT doc_id, l, seq FROM al WHERE seq IS NOT NULL),
l1 AS (SELECT doc_id, seq, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM l0),
l2 AS (SELECT doc_id, seq, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w FROM l1),
l3 AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM l2),
fw AS (SELECT x.doc_id, x.seq AS a, min(y.seq) AS z FROM l3 x JOIN l3 y ON x.doc_id = y.doc_id AND y.seq BETWEEN x.seq AND x.seq + 19 AND y.upto - x.upto + x.w >= 20 GROUP BY ALL),
bw AS (SELECT y.doc_id, max(x.seq) AS a, y.seq AS z FROM l3 x JOIN l3 y ON x.doc_id = y.doc_id AND x.seq BETWEEN y.seq - 19 AND y.seq AND y.upto - x.upto + x.w >= 20 GROUP BY ALL),
runs AS (SELECT doc_id, a, z FROM fw UNION SELECT doc_id, a, z FROM bw),
named AS (SELECT r.doc_id, r.a, r.z, string_agg(l, chr(10) ORDER BY seq) AS name FROM runs r JOIN l3 ON r.doc_id = l3.doc_id AND seq BETWEEN a AND z GROUP BY ALL),
later AS (SELECT doc_id, a, z FROM named QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS seq FROM later),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS t FROM al ANTI JOIN gone USING (doc_id, seq) GROUP BY 1),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT raw.doc_id, CASE WHEN cut.n IS NULL THEN raw.text ELSE coalesce(kept.t, '') END AS text, len(ls) AS n_lines, coalesce(cut.n, 0) AS n_deleted
FROM raw LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
