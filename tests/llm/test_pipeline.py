"""The pipeline's stages against brute force, on the small tables and on odd input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobtide.llm import line_crf, quality_rules
from jobtide.llm.common import read_table
from tests_support import DOCS, slow_components, slow_fingerprint, slow_passages

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the small tables")
def test_stages_match_brute_force(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    labels, items = read_table(spark, SF, "labels"), [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id for r in line_crf.judge_quality(docs, labels).collect() if r.score >= 0.3}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if n == 0:
            want = quality
        elif n == 1:
            want = {i for i in want if not any(r.rejects(quality_rules.Measures(rows[i])) for r in quality_rules.RULES)}
        elif n == 2:
            fps = {i: slow_fingerprint(rows[i]) for i in want}
            root, low = slow_components(set(fps.values())), {}
            for i in sorted(want, reverse=True):
                low[root[fps[i]]] = i
            want = set(low.values())
        elif n == 3:
            want -= {d for d, _ in slow_passages([(i, rows[i]) for i in want], items)}
        if n < 4:
            assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(want), name
    pieces = docs.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: len(rows[i].encode().split()) for i in want}


def test_stages_take_odd_tables(spark, tmp_path):
    text = "\n".join(f"A plain line number {i} with some more words in it." for i in range(12))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, "en", "a", 1), (None, text + " x", "en", "a", 1),
            (3, None, None, None, None), (4, "", "", "", 0), (None, None, None, None, None), (5, "Words " * 3000, "en", "b", 1)]
    odd = spark.createDataFrame(rows, DOCS).withColumns(
        {c: F.lit("clash") for c in ("score", "__kept", "__score", "__tag", "__bad_id", "__times", "count", "fp", "row", "words")})
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, str(tmp_path))
            found = out.collect()
            if name != "best_fit_packing":
                assert out.columns == table.columns and len(found) <= len(rows)
                assert {r["__kept"] for r in found} | {r["__tag"] for r in found} | {r["__score"] for r in found} <= {"clash"}
            if name == "simhash_near_dedup" and found:
                kept = [r.doc_id for r in found if r.text == text]
                assert kept == [1]
