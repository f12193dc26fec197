"""Quality rules: a base verdict from each text alone, and cross-document line frequency per host.

A line is normalised (lower case, runs of white space to one blank, ends trimmed) and hashed. A line is boilerplate in a host
if more than min_docs and more than min_share of the host's distinct documents hold it; documents of equal texts are no
distinct ones, so copies of an article don't make its lines boilerplate. Boilerplate lines are removed from all documents of
the host. A document is depleted, and rejected, if less than min_left of its words is left. The limits are 5 documents or a
thousandth of the host, whichever is more, and four fifths of the words. DataFrame functions only.

Distinct texts are told apart by (host, line, text) before they are counted by (host, line), with partial counts, and what is
above the limits is written before it is joined, so that a line or a host with a third of all rows is no task of its own.

Edge cases: a null text has no words and fails the base rule; a null host counts as the empty one; lines without words are
never boilerplate; rows that repeat doc_id, text and host are one document and share a verdict, and rows of one doc_id and
text under several hosts are judged each by its own host; an empty table gives an empty result; only key, text and host are
read from other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, discard, materialize, read, text_key, words

#: A text whose distinct repeated windows exceed this many is sorted instead of searched; both give the same windows.
SORT_ABOVE = 512


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _normal(line: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(line, BLANKS, " ")))


def _line_id(line: Column) -> Column:
    """96 bits that stand for a normalised line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def base_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, _text_key, _host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(_lines(F.col(text)), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.select(
        F.col(key), text_key(F.col(text)).alias("_text_key"), _host(df, host).alias("_host"), words(F.col(text)).alias("w"), with_word.alias("l"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).alias("n_symbols"),
    )
    n = F.size("w")
    rows = rows.select(
        key, "_text_key", "_host", n.alias("n"), F.length(F.array_join("w", "")).alias("word_chars"), "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))).alias("three"),
    )
    rows = rows.withColumn("sorted", F.sort_array("three"))
    rows = rows.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (x == F.get(F.col("sorted"), i - 1))))).drop("sorted")
    rows = rows.withColumn("placed", F.when(F.size("twice") > SORT_ABOVE, F.array_sort(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn(
        "starts",
        F.when(F.size("twice") == 0, F.array().cast("array<int>"))
        .when(
            F.size("twice") > SORT_ABOVE,
            F.transform(F.filter("placed", lambda x, j: ((j > 0) & (x["h"] == F.get(F.col("placed"), j - 1)["h"])) | F.coalesce(x["h"] == F.get(F.col("placed"), j + 1)["h"], F.lit(False))), lambda x: x["i"]),
        )
        .otherwise(F.filter(F.transform("three", lambda h, i: F.when(F.array_contains("twice", h), i)), lambda i: i.isNotNull())),
    )
    covered = F.size(F.array_union(F.array_union("starts", F.transform("starts", lambda i: i + 1)), F.transform("starts", lambda i: i + 2)))
    rows = rows.select(key, "_text_key", "_host", F.col("n").cast("long").alias("n_words"), *[F.col(c).cast("long") for c in ("word_chars", "n_symbols", "n_dup_lines")], covered.cast("long").alias("n_repeat_words"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # A generator of one row each: a later filter stays above it, and doesn't copy the expressions below into its condition.
    facts = F.explode(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))).alias("facts")
    return rows.select(key, "_text_key", "_host", facts).select(key, "_text_key", "_host", "facts.*")


def _host(df: DataFrame, host: str) -> Column:
    return F.coalesce(df[host].cast("string"), F.lit(""))


def boilerplate(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 5, min_share: float = 0.001) -> DataFrame:
    """(_key, _text_key, _host, h1, h2, at, n: words): the lines to remove and their places, each as often as its document has it."""
    one = F.posexplode(F.transform(_lines(F.col(text)), _normal)).alias("at", "line")
    rows = df.select(F.col(key).alias("_key"), text_key(F.col(text)).alias("_text_key"), _host(df, host).alias("_host"), one).where("line <> ''")
    rows = rows.select("_key", "_text_key", "_host", _line_id(F.col("line")).alias("id"), "at", F.size(F.split("line", " ")).alias("n")).select("_key", "_text_key", "_host", "id.*", "at", "n")
    lines = materialize(rows)
    # Distinct texts are dealt out by all four columns, and combined before they are shuffled by line.
    parts = lines.select("_host", "h1", "h2", "_text_key").distinct().groupBy("_host", "h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    hosts = df.select(_host(df, host).alias("_host"), text_key(F.col(text)).alias("t")).distinct().groupBy("_host").agg(F.count("*").alias("all_docs"))
    above = materialize(parts.join(hosts, "_host").where(F.col("docs") > min_share * F.col("all_docs")).select("_host", "h1", "h2"))
    gone = materialize(lines.join(above, ["_host", "h1", "h2"]))
    discard(lines, above)
    return gone


def _by_document(left: DataFrame, right: DataFrame, host: Column, key: str, tk: str) -> DataFrame:
    """Left join on key, text key and host; nulls equal nulls."""
    right = right.select(F.col("_key").alias("_kx_key"), F.col("_text_key").alias("_kx_right"), F.col("_host").alias("_kx_host"), *[c for c in right.columns if c not in ("_key", "_text_key", "_host")])
    on = F.col(key).eqNullSafe(F.col("_kx_key")) & F.col(tk).eqNullSafe(F.col("_kx_right")) & (host == F.col("_kx_host"))
    return left.join(right, on, "left").drop("_kx_key", "_kx_right", "_kx_host")


def _times(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(_key, _text_key, _host, times) of the documents whose row is repeated."""
    rows = df.select(F.col(key).alias("_key"), text_key(F.col(text)).alias("_text_key"), _host(df, host).alias("_host"))
    return rows.groupBy("_key", "_text_key", "_host").agg(F.count("*").alias("times")).where("times > 1")


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 5, min_share: float = 0.001, min_left: float = 0.8) -> DataFrame:
    """The columns of base_rules without _text_key and _host, n_removed_words and kept, for every row."""
    gone = boilerplate(df, key, text, host, min_docs, min_share)
    lost = gone.groupBy("_key", "_text_key", "_host").agg(F.sum("n").alias("lost"))
    # Repeated rows put the lines of one document in the sum several times.
    lost = _by_document(lost, _times(df, key, text, host), F.col("_host"), "_key", "_text_key").select("_key", "_text_key", "_host", (F.col("lost") / F.coalesce("times", F.lit(1))).cast("long").alias("lost"))
    rows = _by_document(base_rules(df, key, text, host), lost, F.col("_host"), key, "_text_key")
    rows = rows.withColumn("n_removed_words", F.coalesce("lost", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words")
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))).drop("lost", "_text_key", "_host")


def apply_quality(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", min_docs: int = 5, min_share: float = 0.001, min_left: float = 0.8) -> DataFrame:
    """The documents that pass, without their boilerplate lines; all columns of df, n_chars anew where lines went.

    The base rule judges the text as it came.
    """
    sets = boilerplate(df, key, text, host, min_docs, min_share).groupBy("_key", "_text_key", "_host").agg(F.sort_array(F.collect_set("at")).alias("_kx_gone"))
    # A flag for each line up to the last removed one, so that looking one up takes no search.
    sets = sets.withColumn("_kx_keep", F.expr("flatten(transform(_kx_gone, (x, i) -> concat(array_repeat(true, x - if(i = 0, 0, _kx_gone[i - 1] + 1)), array(false))))"))
    good = base_rules(df, key, text, host).where(~F.col("base_failed")).select(F.col(key).alias("_key"), "_text_key", "_host").distinct()
    marked = _by_document(good, sets, F.col("_host"), "_key", "_text_key").withColumn("_kx_good", F.lit(True))
    rows = df.withColumn("_kx_text_key", text_key(F.col(text)))
    rows = _by_document(rows, marked, _host(df, host), key, "_kx_text_key").where("_kx_good")
    left = F.array_join(F.filter(_lines(F.col(text)), lambda x, i: F.coalesce(F.get("_kx_keep", i), F.lit(True))), "\n")
    rows = rows.withColumn("_kx_left", F.when(F.col("_kx_gone").isNull(), F.col(text)).otherwise(left))
    rows = rows.where(F.col("_kx_gone").isNull() | (F.size(words(F.col("_kx_left"))) >= min_left * F.size(words(F.col(text)))))
    length = [F.when(F.col("_kx_gone").isNull(), F.col(c)).otherwise(F.length("_kx_left").cast(kind)).alias(c) if c == n_chars else F.col("_kx_left").alias(c) if c == text else F.col(c) for c, kind in df.dtypes]
    return rows.select(*length)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """The verdict on every document; the host is the source."""
    return quality_rules(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
ex AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM ex),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, source, t, unnest(ls) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
nl AS (SELECT doc_id, source, t, trim(lower(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l FROM ln),
hosts AS (SELECT source, count(DISTINCT t) AS all_docs FROM d GROUP BY 1),
hot AS (SELECT source, l, count(DISTINCT t) AS n FROM nl WHERE l <> '' GROUP BY 1, 2),
above AS (SELECT source, l FROM hot JOIN hosts USING (source) WHERE n > 5 AND n > 0.001 * all_docs),
lost AS (SELECT doc_id, sum(len(string_split(l, ' ')))::BIGINT AS n FROM nl JOIN above USING (source, l) GROUP BY 1),
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.8 * n_words AS kept FROM b
"""
