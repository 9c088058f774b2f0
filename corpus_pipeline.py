"""Training-corpus preparation in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, langid, secrets, simhash, tokens
from strandlake.llm._work import discard, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found (`und`: null, or without letters)."""
    return langid.predicted(docs, langid.learn(docs), lang_out="__lang", score_out="__score").where("`__lang` <> 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash group, that of the least id (rows without an id come last). Rows count one by one: of
    rows with one id only those go whose own text is a copy."""
    return simhash.first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark items, as they are or re-parameterised."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark; no document goes. ``n_chars`` follows the text."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark))).withColumn("n_chars", F.length("text").cast("long"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with digests of ids and decoded text."""
    import public_tokenizers

    return tokens.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("secret scans", secret_scan), ("BPE encoding and decoding", tokenise)]

#: SQL expresses neither learned languages, nor the forest, nor BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            discard(spark, docs)  # what the stage before wrote; nothing reads it any more
        docs = spark.read.parquet(path)
    return docs
