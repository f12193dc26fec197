"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet under the shared folder and reads
it again for the next one. All stages but the last return the columns of documents.

In every stage an empty table gives an empty one, further columns pass through whatever their names are, and a null or empty text,
which has no words, is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetra.llm import bpe, decontam, line_dedup, quality, simhash
from kinetra.llm.common import delete, read, scratch, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; boilerplate lines of a host go from the others.

    A null source is a host of its own; repeated rows share a verdict and all stay.
    """
    return quality.apply_quality(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them the documents of which nothing is left.

    Rows that repeat doc_id and text are one document and change alike; a null doc_id comes first.
    """
    rows = line_dedup.dedup_lines(docs)
    return rows.where((rows.n_deleted == 0) | (rows.n_deleted < rows.n_lines)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; linked are texts alike by 0.8 in five-word shingles, by their fingerprints.

    The fingerprints tell similarity to within some hundredths, and not all pairs near the limit meet; README has the shares found.
    Of repeated rows one stays; a null doc_id goes by its text, and stays only if its group has no row with an id.
    """
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go; items of null id count too, those without words don't."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each."""
    return bpe.encode_digests(docs, *bpe.default_vocabulary())


STAGES = [("quality_rules", quality_rules), ("dedup_lines", dedup_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL has neither XXH64 nor byte-level BPE; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        last, folder = folder, scratch(spark)
        with temporary(spark):  # what the stage's operators wrote for themselves
            out = stage(spark, docs, sf_dir)
            out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if last:
            delete(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
