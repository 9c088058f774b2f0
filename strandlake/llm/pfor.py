"""Token ids in a binary file format: patched frame of reference, with an index of block starts.

A file is, in little-endian order: the magic, numbers of ids, documents and blocks; documents' ids (int64), whether each
is null (uint8) and sizes in tokens (uint32); block starts in bytes (uint64, one more than blocks); the blocks. A block
holds ``BLOCK`` ids: their minimum (uint32), a width in bits (uint8) chosen so that ``PERCENTILE`` of the differences to the
minimum fit, the number of exceptions (uint16), all differences' low bits packed at that width, and for each exception its
position (uint8) and whole difference (uint32). The last block is filled up with its own minimum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import bpe
from strandlake.llm._work import materialise, scratch
from strandlake.llm.tokens import slices

MAGIC, HEAD, BLOCK, PERCENTILE = b"SLPFOR1\n", struct.Struct("<8sQQQ"), 256, 0.95
#: Ids after which a file is closed, at the next end of a document.
FILE_IDS = 1_000_000
_BLOCK_HEAD = struct.Struct("<IBH")


def _packed(d: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) values -> (rows, BLOCK * width / 8) bytes."""
    if not width:
        return np.zeros((len(d), 0), np.uint8)
    out = [np.packbits((d[k : k + 256, :, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8).reshape(-1, BLOCK * width), axis=1, bitorder="little") for k in range(0, len(d), 256)]
    return np.concatenate(out)


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(raw), BLOCK), np.uint32)
    power = (1 << np.arange(width, dtype=np.uint32)).astype(np.uint32)
    out = [np.unpackbits(raw[k : k + 256], axis=1, bitorder="little").reshape(-1, BLOCK, width) @ power for k in range(0, len(raw), 256)]
    return np.concatenate(out).astype(np.uint32)


def pack(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Blocks' bytes and their starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return [], np.zeros(1, np.uint64)
    d = np.empty(n * BLOCK, np.uint32)
    d[: len(ids)] = ids
    d[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    d = d.reshape(n, BLOCK)
    low = d.min(1)
    d -= low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.ceil(np.log2(np.partition(d, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(int)
    blocks: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _packed(d[rows], int(w))
        over = d[rows] >> np.uint32(w) != 0 if w < 32 else np.zeros((len(rows), BLOCK), bool)
        for k, r in enumerate(rows):
            at = np.flatnonzero(over[k])
            blocks[r] = b"".join((_BLOCK_HEAD.pack(int(low[r]), int(w), len(at)), packed[k].tobytes(), at.astype(np.uint8).tobytes(), d[r, at].astype("<u4").tobytes()))
    return blocks, np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")


def unpack(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the blocks."""
    count = len(starts) - 1
    d, low, width = np.empty((count, BLOCK), np.uint32), np.empty(count, np.uint32), np.empty(count, int)
    extra = []
    for r in range(count):
        low[r], width[r], k = _BLOCK_HEAD.unpack_from(data, int(starts[r]))
        extra.append(k)
    for w in np.unique(width):
        rows, size = np.flatnonzero(width == w), int(w) * BLOCK // 8
        raw = np.frombuffer(b"".join(data[int(starts[r]) + 7 : int(starts[r]) + 7 + size] for r in rows), np.uint8).reshape(len(rows), size)
        d[rows] = _unpacked(raw, int(w))
    for r in np.flatnonzero(extra):
        at = int(starts[r]) + 7 + int(width[r]) * BLOCK // 8
        d[r, np.frombuffer(data, np.uint8, extra[r], at)] = np.frombuffer(data, "<u4", extra[r], at + extra[r])
    d += low[:, None]
    return d.reshape(-1)[:n]


def write_bytes(docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One whole file."""
    blocks, starts = pack(ids)
    known = np.array([0 if x is None else x for x in docs], "<i8")
    return b"".join((HEAD.pack(MAGIC, len(ids), len(docs), len(blocks)), known.tobytes(), np.array([x is None for x in docs], np.uint8).tobytes(), np.array(sizes, "<u4").tobytes(), starts.tobytes(), *blocks))


def read_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their sizes, all token ids."""
    magic, n, docs, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    at = HEAD.size
    known = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at := at + docs)
    starts = np.frombuffer(data, "<u8", blocks + 1, at := at + 4 * docs)
    ids = unpack(data[at + 8 * (blocks + 1) :], starts, n)
    return [None if x else int(k) for k, x in zip(known, null, strict=True)], sizes, ids


def read_ids(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a file; only the blocks that hold them are unpacked."""
    _, n, docs, blocks = HEAD.unpack_from(data)
    stop = min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at = HEAD.size + 13 * docs
    starts = np.frombuffer(data, "<u8", blocks + 1, at)
    a, b = start // BLOCK, -(-stop // BLOCK)
    part = unpack(data[at + 8 * (blocks + 1) :], starts[a : b + 1], (b - a) * BLOCK)
    return part[start - a * BLOCK : stop - a * BLOCK]


def write_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files in ascending id order below ``folder`` (a fresh one of the shared folder) and return their manifest:
    (part, seq, before, n_tokens, name). ``before`` is the tokens of earlier files of the same part.

    Files carry the attempt's number in their names and the manifest is a table that Spark commits, so a task that runs
    twice or on a lost executor adds no file to it; what such a task left is never read. The folder must be in a store
    that pyarrow opens (local and shared disks, HDFS, S3, GCS).
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        coder, part, seq, before = bpe.load(path), context.partitionId(), 0, 0
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        docs, sizes, data, held = [], [], [], 0

        def close():
            nonlocal docs, sizes, data, held, seq, before
            name = f"tokens-{part:06d}-{seq:06d}-{context.taskAttemptId()}.pfor"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(write_bytes(docs, sizes, np.concatenate(data)))
            row = [part, seq, before, held, name]
            docs, sizes, data, seq, before, held = [], [], [], seq + 1, before + held, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["part", "seq", "before", "n_tokens", "name"])

        for batch in batches:
            for few in slices(batch, 1):
                ids, count = coder.encode_column(few.column(1))
                ends, known = np.cumsum(count), few.column(0).to_pylist()
                if end_id is not None:
                    ids, count = np.insert(ids, ends, end_id), count + 1
                    ends += np.arange(1, len(ends) + 1)
                # Cut after each document with which a file is full.
                start = 0
                while start < len(known):
                    at = int(ends[start - 1]) if start else 0
                    stop = min(len(known), int(np.searchsorted(ends, at + max(1, FILE_IDS - held))) + 1)
                    docs += known[start:stop]
                    sizes += count[start:stop].tolist()
                    data.append(ids[at : int(ends[stop - 1])].astype(np.uint32))
                    held += len(data[-1])
                    start = stop
                    if held >= FILE_IDS:
                        yield close()
        if docs:
            yield close()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"))  # the hash divides what one id or null holds
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ordered.mapInArrow(run, "part int, seq int, before long, n_tokens long, name string"), "manifest").withColumn("folder", F.lit(folder))


def read_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the bytes of the manifest's files."""
    at, starts = 0, {}
    for part, n in sorted(manifest.groupBy("part").agg(F.sum("n_tokens")).collect()):  # one row for each write task
        starts[part], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, name, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, root = pa.fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{root}/{name}") as f:
                    docs, sizes, ids = read_bytes(f.read())
                ends = np.cumsum(sizes, dtype=np.int64)
                raw, begin = memoryview(ids.astype("<u4").tobytes()), ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begin + (starts[part] + before)), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    # Names are short, so the manifest is few splits; its rows are dealt out so that files are read in parallel.
    rows = manifest.select("part", "before", "name", "folder")
    dealt = rows.repartition(min(max(1, rows.count()), manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode all texts, write them as files and read the files back: one row per input row, in ascending id order of
    ``start`` (nulls first; repeated ids in an order fixed by their texts).

    A null or empty text has just the end id. An empty table writes and returns nothing. Other columns aren't read; ids
    are integers.
    """
    return read_files(write_files(docs, path, folder, end_id, id_col, text_col), id_col)
