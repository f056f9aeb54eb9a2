"""The queries of this package and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import (
    chat_repair, collocations, decontaminate, line_crf, line_dedup, packing, quality_rules, resampling, sharding, simhash_dedup, token_counts, toxicity, url_filter,
)
from jobtide.llm import sql
from jobtide.llm.common import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

ALLOW = ["com/", "www.example.com/en/"]
BLOCK = ["example.com/en/", "net/es/", "net/fr/"]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(fn=None, *, said: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if said is not None:
            SQL[f.__name__] = said
        return f

    return add(fn) if fn else add


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.judge_toxicity(docs, labels, threshold=0.3, folds=4, out=2)


@query(said=sql.url_filter(ALLOW, BLOCK))
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), ALLOW, BLOCK)


@query(said=sql.QUALITY_RULES)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_rules(read_table(spark, sf_dir, "documents"))


@query(said=sql.DECONTAMINATE)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.find_passages(docs, items).drop("tag")


@query(said=sql.SHARDING)
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.format_chats(read_table(spark, sf_dir, "conversations"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return line_crf.judge_quality(docs, labels, threshold=0.3, folds=5, out=0)


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, clusters=packing.near_clusters(docs))


@query(said=sql.COLLOCATIONS)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=10, longest=3, share=50, first=2000)


@query(said=sql.RESAMPLING)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resampling.resample(docs, target, share=5, least_words=20, longest=3, buckets=10_000, seed=42)


@query(said=sql.LINE_DEDUP)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(read_table(spark, sf_dir, "documents"), threshold=10, least_chars=1)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
