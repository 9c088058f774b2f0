"""Token-level operators on whole texts: encode and decode, and counting without ids."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import bpe

#: Bytes of text handled at a time within an Arrow batch, so that Python strings of one batch don't pile up, and where ids and decoded texts are laid out besides.
SLICE_BYTES, LAID_OUT_BYTES = 4_000_000, 1_000_000


def give_back() -> None:
    """Return freed memory to the system: a worker stays when its tasks are over, and what it holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of the column at that place; a longer text is a part of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(at)), 0).cast(pa.int64())).to_numpy()
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _mapped(docs: DataFrame, id_col: str, text_col: str, fields: str, rows_of, size: int = SLICE_BYTES) -> DataFrame:
    """id and what ``rows_of`` makes of the texts, streamed over Arrow batches in slices of ``size`` bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, size):
                columns = list(zip(*rows_of(part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=["id", *names])
            batch = part = columns = None
            give_back()

    return out.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode whole texts and decode them again, with digests of both.

    One row per input row (repeated rows repeat): id, ``n_tokens``, ``ids_sha256`` of the ids as little-endian uint32,
    ``decoded_sha256`` of the decoded UTF-8; on request ``ids`` and ``decoded``. A null or empty text has no tokens and
    decodes to the empty text. A null id stays null. Other columns aren't read. An empty table gives an empty one.
    """

    def rows_of(texts):
        coder = bpe.load(path)
        ids, count = coder.encode_column(texts)
        ends, raw = np.cumsum(count).tolist(), memoryview(ids.tobytes())
        for a, b, back in zip([0, *ends], ends, coder.decode_all(ids, count), strict=False):
            out = [b - a, bpe.sha256(raw[4 * a : 4 * b]), bpe.sha256(back)]
            if keep_ids:
                out.append(ids[a:b].astype("int32"))
            if keep_text:
                out.append(back.decode("utf-8", "replace"))
            yield out

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return _mapped(docs, id_col, text_col, fields, rows_of, LAID_OUT_BYTES)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "text") -> DataFrame:
    """All columns, with ``out_col`` holding the text that decoding a document's ids gives (null stays null)."""
    schema = docs.schema if out_col in docs.columns else docs.withColumn(out_col, F.lit("")).schema
    at = docs.columns.index(text_col)

    def run(batches):
        coder = bpe.load(path)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at)
                back = [t.decode("utf-8", "replace") if t_is else None for t, t_is in zip(coder.decode_all(*coder.encode_column(texts)), texts.is_valid().to_pylist(), strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {out_col: pa.array(back, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of whole texts, from pieces per distinct pre-token; ids are never laid out.

    Each document becomes frequencies of its distinct pre-tokens, which are joined to the table pre-token -> pieces and
    summed. The join is on the map side: the table is filled as pre-tokens first appear in a worker process, so no
    (document, pre-token) row is shuffled and a pre-token that a third of the rows share is no hot key.

    One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit). Null and empty
    texts have 0 and 0. A null id stays null. Strings of special tokens count as one token each.
    """

    def rows_of(texts):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for size, n in zip(sizes, bpe.load(path).count_all(texts.to_pylist()), strict=True):
            yield size, n, n > limit

    return _mapped(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", rows_of)
