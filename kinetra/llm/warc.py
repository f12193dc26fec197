"""WARC archives: a writer, and a reader that trusts no magic bytes.

The reader splits files at every occurrence of the version line, also inside payloads. Each occurrence is a candidate record
with an offset, which tasks sum up in the order of the file; its Content-Length gives the offset of its successor. Candidates
of a file that follow each other without a gap are one stretch, with one successor; starting from the stretch at offset 0,
pointer jumping (each round doubles the length of the jumps) marks the stretches on the chain, and in each the candidates from
where the chain enters it. All others lie inside payloads and are put back into the record that holds them.

The writer puts one record a row with Spark's text writer, so files are committed whole and tasks can be retried. Of records
of equal payload the one of the smallest id is a response, an HTTP head and the payload; the others are revisits that name its
record and carry the head only.

Edge cases: a null payload is written as an empty one; a row of null id is named NAMELESS, is never the first of its payload,
and is a response if no row with an id has its payload; if rows repeat the smallest id of a payload, they are all responses;
an empty table gives no archives and no records; a file that doesn't begin with a record gives none, and one whose chain breaks
gives the records up to there; a record that its file's end cuts off is left out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, discard, map_arrow, materialize, read, scratch, settled

MAGIC = "WARC/1.1\r\n"
RECORDS_PER_FILE = 4096
#: Names a record whose row has no id; those of ids, also of empty ones, have a colon more.
NAMELESS = "<urn:page>"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four base32 ones."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record for each row to gzipped archives under path, dated now."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumn("digest", base32_sha1(F.col("body"))).withColumn("size", F.octet_length("body"))
    # Only payloads that occur twice or more; written first, so that its real size decides how it is joined.
    copies = materialize(rows.groupBy("digest", "size").agg(F.min("key").cast("string").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(copies, ["digest", "size"], "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")))
    carried = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda i: F.coalesce(F.concat(F.lit("<urn:page:"), i, F.lit(">")), F.lit(NAMELESS))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", now),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(carried)).cast("string")),
        F.lit("\r\n"),
        http,
        carried,
    )
    writer = rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(path)
    discard(copies)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's offset inside its file block: rows come in the order of the file. Columns f, block, size come first."""
    here, upto = None, 0
    for b in batches:
        f, block, size = (np.asarray(b.column(i)) for i in range(3))
        inside = np.empty(len(size), np.int64)
        cuts = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(size)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if here != (f[i], block[i]):
                here, upto = (f[i], block[i]), 0
            ends = upto + np.cumsum(size[i:j])
            inside[i:j] = ends - size[i:j]
            upto = int(ends[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside)], names=[*b.schema.names, "inside"])


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """f (hash of the file's name), block, size and chunk: what stands between two version lines."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"), (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"), F.col("value").alias("chunk"))


def _head(chunk: Column) -> Column:
    return F.substring_index(chunk, "\r\n\r\n", 1)


def _length(chunk: Column) -> Column:
    """Content-Length, null if there is none."""
    return F.nullif(F.regexp_extract(_head(chunk), r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,18})", 1), F.lit("")).cast("bigint")


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(f, at, end, next): each stretch's offset, its end, and the offset of the record after it; and (f, block, start): where blocks begin.

    The payloads stay where they are: only sizes leave the scan.
    """
    slim = _stretches(spark, path).select("f", "block", "size", (len(MAGIC) + F.octet_length(_head(F.col("chunk"))) + 4 + _length(F.col("chunk")) + 4).cast("long").alias("reach"))
    slim = materialize(slim.transform(map_arrow, _placed, "f long, block long, size long, reach long, inside long"))
    blocks = slim.groupBy("f", "block").agg(F.sum("size").alias("size"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = materialize(blocks.select("f", "block", start.alias("start")))
    # A stretch begins behind a version line; the first of a file begins at 0 and is empty if the file starts with one.
    at = (F.col("start") + F.col("inside") - len(MAGIC)).alias("at")
    rows = slim.join(blocks, ["f", "block"]).select("f", at, "size", "reach")
    found = materialize(rows.select("f", "at", (F.col("at") + F.col("size")).alias("end"), (F.col("at") + F.col("reach")).alias("next")))
    discard(slim)
    return found, blocks


def _chain(found: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(f, at) of the candidates reachable from offset 0 that their file holds whole."""
    whole = Window.partitionBy("f")
    fits = found.withColumn("all", F.max("end").over(whole)).where("at >= 0 and next <= all")
    order = whole.orderBy("at")
    gap = (~F.col("at").eqNullSafe(F.lag("next").over(order))).cast("int")
    nodes = materialize(fits.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order)).select("f", "at", "next", "run"))
    exits = nodes.groupBy("f", "run").agg(F.max_by("next", "at").alias("at"))
    # Where a stretch leads: to a stretch, at an offset that may lie inside it.
    jump = materialize(exits.join(nodes.select("f", "at", F.col("run").alias("to")), ["f", "at"]).select("f", "run", "to", "at"))
    reached = materialize(nodes.where("at = 0").select("f", "run", "at"))
    for _ in range(max_rounds):
        if not jump.take(1):
            break
        ahead = reached.select("f", "run").join(jump, ["f", "run"]).select("f", F.col("to").alias("run"), "at")
        twice = jump.select("f", F.col("run").alias("from"), F.col("to").alias("run")).join(jump, ["f", "run"]).select("f", F.col("from").alias("run"), "to", "at")
        # The jumps of a round are 2^k stretches long; those that leave the file go. No stretch is entered twice: offsets grow.
        after_jump, after = materialize(twice), materialize(reached.union(ahead))
        discard(jump, reached)
        jump, reached = after_jump, after
    else:
        raise RuntimeError("a chain of records is longer than 2^64")
    chain = materialize(nodes.join(reached.select("f", "run", F.col("at").alias("entry")), ["f", "run"]).where("at >= entry").select("f", "at"))
    discard(nodes, jump, reached)
    return chain


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(f, at, headers: map of lower-case names, payload: binary) of the records on each file's chain.

    The archives are read twice, for the candidates and for the payloads. What isn't a record by itself (strays inside
    payloads, and the records that hold them) is written first, so that it is joined by its real size: usually it is small,
    and no payload is shuffled. The payload of an HTTP response is what follows its head.
    """
    found, blocks = candidates(spark, path)
    known = _chain(found)
    stray = materialize(found.where("at >= 0").select("f", "at").join(known, ["f", "at"], "left_anti"))
    # Files with strays: each stray, and each record before one, with the record that it belongs to.
    marked = stray.withColumn("stray", F.lit(True))
    some = known.join(stray.select("f").distinct(), "f", "left_semi").withColumn("stray", F.lit(False)).union(marked)
    last = Window.partitionBy("f").orderBy("at")
    some = some.withColumn("record", F.last(F.when(~F.col("stray"), F.col("at")), ignorenulls=True).over(last.rowsBetween(Window.unboundedPreceding, 0)))
    some = some.withColumn("held", F.coalesce(F.lead("stray").over(last), F.lit(False)))
    parts = materialize(some.where("stray or held").select("f", "at", "record"))
    discard(found, known, stray)

    scan = _stretches(spark, path).transform(map_arrow, _placed, "f long, block long, size long, chunk string, inside long")
    at = (F.col("start") + F.col("inside") - len(MAGIC)).alias("at")
    scan = scan.join(blocks, ["f", "block"]).select("f", at, "chunk").where("at >= 0")
    single = scan.join(parts, ["f", "at"], "left_anti").select("f", "at", "chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk"))), lambda x: x["chunk"]), MAGIC)
    several = scan.join(parts, ["f", "at"]).where("record is not null").groupBy("f", "record").agg(joined.alias("chunk")).select("f", F.col("record").alias("at"), "chunk")
    records = single.union(several)
    head = _head(F.col("chunk"))
    lines = F.transform(F.split(head, "\r\n"), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    # A repeated header keeps its first value.
    names = F.filter(lines, lambda x: x["k"] != "")
    headers = F.map_from_entries(F.filter(names, lambda x, i: F.array_position(F.transform(names, lambda y: y["k"]), x["k"]) == i + 1))
    block = F.substring(F.col("chunk").cast("binary"), F.octet_length(head) + 5, _length(F.col("chunk")).cast("int"))
    rows = records.select("f", "at", headers.alias("headers"), block.alias("block"))
    is_http = F.coalesce(F.lower(F.col("headers")["content-type"]).startswith("application/http"), F.lit(False))
    after = F.octet_length(_head(F.col("block").cast("string"))) + 5
    payload = F.when(is_http, F.substring(F.col("block"), after, F.octet_length("block"))).otherwise(F.col("block"))
    return rows.select("f", "at", "headers", payload.alias("payload"))


def archive_and_read(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write df as archives under path and return the records as they are read back."""
    write_archives(df, path, key, url, payload)
    return read_archives(df.sparkSession, path)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = scratch(spark)
    page = lambda name: F.expr(f"try_cast(nullif(regexp_extract(headers['{name}'], '<urn:page:(-?[0-9]+)>', 1), '') as bigint)")

    def facts() -> DataFrame:
        return archive_and_read(read(spark, sf_dir, "pages"), path).select(
            page("warc-record-id").alias("page_id"), F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"),
            F.col("headers")["warc-type"].alias("record_type"), page("warc-refers-to").alias("refers_to"),
        )

    rows = settled(spark, facts)
    delete(spark, path)
    responses, revisits = rows.where("refers_to is null"), rows.where("refers_to is not null").select("page_id", "record_type", "refers_to")
    # A revisit has the payload of the record that it refers to; of those that revisits name there is one row each.
    named = revisits.select("refers_to").distinct().join(responses.select(F.col("page_id").alias("refers_to"), "size", "digest").dropDuplicates(["refers_to"]), "refers_to")
    told = revisits.join(materialize(named), "refers_to")
    both = responses.select("page_id", "size", "digest", "record_type", "refers_to").union(told.select("page_id", "size", "digest", "record_type", "refers_to"))
    return both.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
       translate(string_agg(lpad(upper(to_base(('0x' || substr(x, i, 5))::BIGINT, 32)), 4, '0'), '' ORDER BY i), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d, range(1, 41, 5) t(i) GROUP BY page_id, h, first
"""
