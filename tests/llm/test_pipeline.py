"""The pipeline's stages, each against a brute-force version of itself on what it is given."""

from __future__ import annotations

import hashlib

import duckdb
import pandas as pd
import pytest

pytest.importorskip("kinetra.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from kinetra.llm import bpe, queries  # noqa: E402
from kinetra.llm.common import materialize, read  # noqa: E402

from .test_llm import _contaminated  # noqa: E402
from .test_near_dedup import near_classes  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, FOLDER, "documents")
    columns = docs.columns
    bench = [tuple(r) for r in read(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, FOLDER))
        if name != "encode":
            assert docs.columns == columns
            after = {r["doc_id"]: r for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "quality_rules":
            kept = {r["doc_id"] for r in queries.QUERIES["op8_quality"](spark, FOLDER).collect() if r["kept"]}
            assert set(after) == kept
        elif name == "dedup_lines":
            c = duckdb.connect()
            c.register("documents", pd.DataFrame(sorted(before.items()), columns=["doc_id", "text"]))
            want = {r["doc_id"]: r["text"] for r in c.sql(queries.SQL["op3_line_dedup"]).df().to_dict("records")}
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, t in want.items() if t.strip() or t == before[i]}
        elif name == "near_dedup":
            assert set(after) == set(near_classes(before).values())
        elif name == "decontaminate":
            assert set(after) == {i for i, t in before.items() if not _contaminated(t, bench)[1]}
        else:
            path, pattern, ascii = bpe.default_vocabulary()
            codec = bpe.Codec(bpe.load_ranks(path), pattern, ascii)
            got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in docs.collect()}
            assert got == {i: (len(codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in before.items()}
            run = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
            assert run == got


def test_odd_documents_through_all_stages(spark, tmp_path):
    """Nulls in every column, repeated rows, a benchmark passage, clashing column names and an empty table."""
    good = [" ".join(f"w{i}x{(i * k) % 89}" for i in range(70)) for k in (3, 5, 7)]
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, good[0], "en", "s"), (1, good[0], "en", "s"), (2, good[0], None, None), (None, good[1], "en", None), (3, None, None, None), (4, "", "en", "s"), (5, "few words", "en", "s"), (6, f"{good[2]} {passage}", "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long")
    bench = spark.createDataFrame([(None, passage), (1, None), (1, "")], "item_id long, text string")
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    left = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left) == [(False, 1), (True, None)]
    assert {r["decoded_sha256"] for r in left} == {hashlib.sha256(t.encode()).hexdigest() for t in good[:2]}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
