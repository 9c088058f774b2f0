"""Reads that keep arriving: each micro-batch is classified against the static table, and its counts are appended.

Classification looks at one read at a time, so batches are independent. What accumulates is kept as partial results that
merge: sums of reads and k-mers, and sketches of distinct k-mers. A batch that is run again overwrites its own folder,
so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators import classify, report


def start(reads: DataFrame, table: DataFrame, tree: DataFrame, k: int, out: str, **trigger) -> StreamingQuery:
    """Classify a stream of (read_id, seq) into ``out``/calls, ``out``/counts and ``out``/sketches, a folder per batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        hits = classify.lookup(rows, table, k).persist()
        calls = classify.vote(rows, classify.hit_counts(hits), tree)
        for name, df in (("calls", calls), ("counts", report.taxon_counts(calls, hits)), ("sketches", report.taxon_sketches(hits))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        hits.unpersist()
        rows.unpersist()

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(taxid, n_reads, n_kmers, unique_estimate) over all batches so far."""
    counts = spark.read.parquet(f"{out}/counts").groupBy("taxid").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_kmers").alias("n_kmers"))
    unique = spark.read.parquet(f"{out}/sketches").groupBy("taxid").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_estimate"))
    return counts.join(unique, "taxid", "left")
