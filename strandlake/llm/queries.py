"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm._work import on_workers


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.tokens import encode_decode

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.tokens import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.simhash import simhash_groups

    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.langid import identify

    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.neighbours import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.pfor import token_files

    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("word_bpe_49k.json"))


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.lm_score import cross_parse

    return cross_parse(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.secrets import labelled_findings, scan, train

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_findings(spark)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from strandlake.llm._work import scratch
    from strandlake.llm.shards import ingest

    store = ingest(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "shards"))
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "shard_run", "shard_file", "shard_tier", "shard_version")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.llm.decontaminate import matches

    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_simhash, op2_bpe, op3_token_counts, op4_language, op5_secrets, op6_sharding, op7_neighbours, op8_token_files, op9_decontamination, op10_cross_parsing, pipeline)


def _ready(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _ready(f) for f in _ALL}
#: SQL is too slow or can't express these on whole tables; tests hold them against brute force.
ORACLES: dict[str, str] = {}
