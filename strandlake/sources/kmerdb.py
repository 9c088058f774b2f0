"""Importing binary k-mer databases: a header, then fixed-width (key, value) rows in little-endian order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, ROWS = b"JFLISTDN", 4_000_000


def header(data: bytes) -> tuple[int, int, int]:
    """(key bits, number of rows, header size)."""
    if data[:8] != MAGIC:
        raise ValueError("not a k-mer database")
    bits, width, count = struct.unpack_from("<Q", data, 8)[0], struct.unpack_from("<Q", data, 16)[0], struct.unpack_from("<Q", data, 48)[0]
    if width != 4:
        raise ValueError("values must have four bytes")
    return bits, count, 72 + 2 * (4 + 8 * bits)


def rows(data: bytes, key_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(data, np.uint8).reshape(-1, key_bytes + 4)
    key = np.zeros((len(table), 8), np.uint8)
    key[:, :key_bytes] = table[:, :key_bytes]
    return key.view("<i8").ravel(), np.ascontiguousarray(table[:, key_bytes:]).view("<u4").ravel().astype(np.int64)


def read_kmer_database(spark: SparkSession, uri: str) -> DataFrame:
    """(code BIGINT, taxon BIGINT): tasks read ranges of rows, so no task or row holds the file. The store must be one that
    pyarrow reads and that all executors share."""
    from strandlake.plans.workers import on_workers

    on_workers(spark)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        bits, count, start = header(f.read(72))
    key_bytes = -(-bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                n = min(ROWS, count - k * ROWS)
                with fs.open_input_file(path) as f:
                    f.seek(start + k * ROWS * (key_bytes + 4))
                    code, taxon = rows(f.read(n * (key_bytes + 4)), key_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(taxon)], names=["code", "taxon"])

    pieces = -(-count // ROWS)
    return spark.range(0, pieces, 1, max(1, pieces)).mapInArrow(run, "code bigint, taxon bigint")


def read_uid_map(spark: SparkSession, uri: str) -> DataFrame:
    """(uid, taxid, parent_uid): row number from 1 of pairs of unsigned 32-bit integers; a parent of 0 ends a chain. Tasks read
    ranges of rows."""
    from strandlake.plans.workers import on_workers

    on_workers(spark)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    count = fs.get_file_info(path).size // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                n = min(ROWS, count - k * ROWS)
                with fs.open_input_file(path) as f:
                    f.seek(8 * k * ROWS)
                    pairs = np.frombuffer(f.read(8 * n), "<u4").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + k * ROWS + 1), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["uid", "taxid", "parent_uid"])

    pieces = -(-count // ROWS)
    return spark.range(0, pieces, 1, max(1, pieces)).mapInArrow(run, "uid bigint, taxid bigint, parent_uid bigint")


def uid_taxa(uids: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(uid, taxids): the taxa of a uid's chain, its own first; of all uids or those wanted."""
    from strandlake.operators.tree import chains

    paths = chains(uids.select(F.col("uid").alias("node"), F.col("parent_uid").alias("up")))
    steps = paths if wanted is None else paths.where(F.col("node").isin(wanted))
    each = steps.select(F.col("node").alias("chain"), F.posexplode(F.reverse("path")).alias("at", "uid")).join(uids.select("uid", "taxid"), "uid")
    return each.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "taxid"))), lambda x: x["taxid"]).alias("taxids")).withColumnRenamed("chain", "uid")


def as_table(imported: DataFrame, k: int) -> DataFrame:
    from strandlake.functions.dna import decode

    return imported.select(decode(F.col("code"), k).alias("kmer"), "taxon")
