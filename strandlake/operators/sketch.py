"""HyperLogLog registers as rows: mergeable by maximum, estimated from the histogram of ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finalizer(keys: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finalizer of key + 1."""
    h = keys.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def ranhash(keys: np.ndarray) -> np.ndarray:
    """The hash of integers in Numerical Recipes."""
    u = lambda x: np.uint64(x)
    v = keys.astype(np.uint64) * u(3935559000370003845) + u(2691343689449507681)
    v ^= v >> u(21)
    v ^= v << u(37)
    v ^= v >> u(4)
    v *= u(4768777513237032717)
    v ^= v << u(20)
    v ^= v >> u(41)
    return v ^ (v << u(5))


def wang(keys: np.ndarray) -> np.ndarray:
    """Thomas Wang's 64-bit mixer."""
    u, k = lambda x: np.uint64(x), keys.astype(np.uint64)
    k = ~k + (k << u(21))
    k ^= k >> u(24)
    k *= u(265)
    k ^= k >> u(14)
    k *= u(21)
    k ^= k >> u(28)
    return k + (k << u(31))


MIXERS = {"murmur": finalizer, "ranhash": ranhash, "wang": wang}


def _rank(rest: np.ndarray, width: int) -> np.ndarray:
    """Leading zeros of the low ``width`` bits, plus one."""
    high = np.zeros(rest.shape, np.int64)
    left = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >> np.uint64(step) != 0
        high[big] += step
        left[big] >>= np.uint64(step)
    return np.where(rest == 0, width + 1, width - high)


def registers(kmers: DataFrame, precision: int = 12, mixer: str = "murmur") -> DataFrame:
    """(taxon, idx, rank) from (taxon, kmer BIGINT). Hashing wraps at 64 bits, which SQL arithmetic refuses, so it runs on Arrow batches."""
    from strandlake.plans.workers import on_workers

    on_workers(kmers.sparkSession)
    width = 64 - precision

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = MIXERS[mixer](batch.column(1).to_numpy())
            rank = _rank(h & np.uint64((1 << width) - 1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((h >> np.uint64(width)).astype(np.int32)), pa.array(rank.astype(np.int32))], names=["taxon", "idx", "rank"])

    hashed = kmers.select(F.col("taxon").cast("bigint").alias("taxon"), F.col("kmer").cast("bigint").alias("kmer")).mapInArrow(run, "taxon bigint, idx int, rank int")
    return hashed.groupBy("taxon", "idx").agg(F.max("rank").alias("rank"))


def merge(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("taxon", "idx").agg(F.max("rank").alias("rank"))


def ertl(histogram: list[int], precision: int) -> float:
    """Improved raw estimate from the numbers of registers by rank (index 0: empty)."""
    m, q = 1 << precision, 64 - precision

    def sigma(x: float) -> float:
        if x == 1:
            return math.inf
        y, z = 1.0, x
        while True:
            x *= x
            last, z = z, z + x * y
            y += y
            if z == last:
                return z

    def tau(x: float) -> float:
        if x in (0, 1):
            return 0.0
        y, z = 1.0, 1 - x
        while True:
            x = math.sqrt(x)
            last, y = z, y * 0.5
            z -= (1 - x) ** 2 * y
            if z == last:
                return z / 3

    z = m * tau(1 - histogram[q + 1] / m)
    for k in range(q, 0, -1):
        z = (z + histogram[k]) / 2
    return m * m / (2 * math.log(2)) / (z + m * sigma(histogram[0] / m))


def linear(histogram: list[int]) -> float:
    m = sum(histogram)
    return m * math.log(m / histogram[0]) if histogram[0] else math.inf


def raw(histogram: list[int]) -> float:
    m = sum(histogram)
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    return alpha * m * m / sum(n * 2.0**-k for k, n in enumerate(histogram))


def flajolet(histogram: list[int]) -> float:
    """The first estimator: raw, or linear counting while it is small and registers are empty."""
    e, m = raw(histogram), sum(histogram)
    return linear(histogram) if e <= 2.5 * m and histogram[0] else e


def estimate(rows: DataFrame, precision: int = 12, method: str = "ertl") -> DataFrame:
    """(taxon, estimate) of register rows; per taxon one small histogram is evaluated."""
    from strandlake.plans.workers import on_workers

    on_workers(rows.sparkSession)
    m, q = 1 << precision, 64 - precision
    counts = rows.groupBy("taxon", "rank").agg(F.count("*").alias("n")).groupBy("taxon").agg(F.collect_list(F.struct("rank", "n")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs in batch.column(1).to_pylist():
                histogram = [0] * (q + 2)
                for p in pairs:
                    histogram[p["rank"]] = p["n"]
                histogram[0] = m - sum(histogram)
                out.append(round({"ertl": lambda h: ertl(h, precision), "flajolet": flajolet, "linear": linear}[method](histogram)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["taxon", "estimate"])

    return counts.mapInArrow(run, "taxon bigint, estimate bigint")
