"""SimHash near-duplicates: exact Hamming pairs through vantage-point shards and trees.

Fingerprints at distance up to ``r`` = 4 are found as follows.

1. Equal fingerprints are one point, so thousands of exact copies cost one.
2. The 64 bits form r + 1 blocks. The Hamming distance within a block is a metric whose sum over the blocks is the
   whole distance, so a pair within r has distance 0 in some block. Each block thus has its shards: the vantage points
   are the block's values, and since the radius left for that block is 0, the triangle bound leaves a point exactly
   one shard of each block to visit. (Vantage points over all 64 bits prune nothing useful at radius 4: distances of
   unrelated fingerprints to any vantage point lie within 32 +- 8, so almost every shard boundary overlaps almost every
   query ball. ``overlap_share`` measures it.)
3. A shard with more than ``SPLIT`` points is divided in the same way over the bits that its points may differ in,
   level by level; this is exact again, as the pairs within it differ in at most r of those bits.
4. Within a shard, small ones compare all pairs in memory; larger ones build a vantage-point tree over the whole
   distance: a query ball goes left if d - r <= median and right if d + r > median, into both where it overlaps.
5. Shards emit a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._work import materialise
from strandlake.llm.components import connected_components

#: Points of a shard beyond which it is divided further, and how often at most.
SPLIT, LEVELS = 1024, 5
#: Points up to which a shard or a tree's leaf compares all pairs.
LEAF = 128


def fingerprint(data: bytes, words_per_shingle: int = 4) -> int:
    """64-bit fingerprint of a UTF-8 text, signed."""
    words = data.lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], 42) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed fingerprint of each row's whole text; null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    return [(j * bits // n, (j + 1) * bits // n) for j in range(n)]


def _dealt(points: DataFrame, bits: int, radius: int) -> DataFrame:
    """Each point once for each block of its remaining bits: (shard, rest, fp, node); rest lacks the block."""
    ways = []
    for j, (lo, hi) in enumerate(_blocks(bits, radius + 1)):
        value = F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << lo) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", hi), lo) if hi < 64 else F.lit(0).cast("long")
        ways.append(F.struct(F.xxhash64(F.col("shard"), F.lit(j), value).alias("shard"), low.bitwiseOR(high).alias("rest")))
    return points.select("fp", "node", F.explode(F.array(*ways)).alias("way")).select("way.shard", "way.rest", "fp", "node")


class Forest:
    """Union-find over positions, with vectorised skipping of what is joined already."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = flat


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _compare(start: np.ndarray, stop: np.ndarray, fp: np.ndarray, radius: int, forest: Forest) -> None:
    """All pairs within each run [start, stop) of positions, by their offset."""
    last = np.repeat(stop, stop - start)
    i = np.concatenate([np.arange(a, b) for a, b in zip(start, stop, strict=True)]) if len(start) else np.zeros(0, int)
    d = 1
    while len(i):
        keep = i + d < last
        i, last = i[keep], last[keep]
        hit = _near(fp[i], fp[i + d]) <= radius
        forest.join(i[hit], i[hit] + d)
        d += 1


def tree_join(fp: np.ndarray, at: np.ndarray, radius: int, forest: Forest) -> None:
    """Join what lies within ``radius`` among positions ``at``: vantage-point tree, balls of all points at once.

    Each step takes a node's members and the points whose balls reach it. The vantage point is the member that a hash
    of the members picks; members within the median distance go left. A ball goes wherever the triangle bound allows.
    """
    todo = [(at, at)]
    while todo:
        members, asking = todo.pop()
        if len(members) <= LEAF:
            for m in members:
                hit = asking[_near(fp[asking], fp[m]) <= radius]
                forest.join(hit, np.full(len(hit), m))
            continue
        vantage = fp[members[int(fp[members[0]]) % len(members)]]
        d, q = _near(fp[members], vantage).astype(int), _near(fp[asking], vantage).astype(int)
        middle = int(np.median(d))
        if not (d > middle).any():
            middle -= 1
        if not (d <= middle).any():  # all at one distance: nothing to divide by
            for k in range(0, len(members), LEAF):
                todo.append((members[k : k + LEAF], asking))
            continue
        todo.append((members[d <= middle], asking[q - radius <= middle]))
        todo.append((members[d > middle], asking[q + radius > middle]))


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(shard, fp, node):
            cuts = np.flatnonzero(np.diff(shard)) + 1
            start, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]])
            size, forest = stop - start, Forest(len(shard))
            small = (size > 1) & (size <= LEAF)
            _compare(start[small], stop[small], fp, radius, forest)
            for k in np.flatnonzero(size > LEAF):
                tree_join(fp, np.arange(start[k], stop[k]), radius, forest)
            i = np.flatnonzero(forest.root != np.arange(len(shard)))
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[forest.root[i]])], names=["a", "b"])

        for batch in batches:
            shard, fp, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(shard):
                continue
            held.append((shard, fp.view(np.uint64), node))
            if shard[0] == shard[-1] and all(h[0][0] == shard[0] for h in held):
                continue  # one shard so far
            shard, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = np.searchsorted(shard, shard[-1])  # the last shard may go on in the next batch
            yield solve(shard[:whole], fp[:whole], node[:whole])
            held = [(shard[whole:], fp[whole:], node[whole:])]
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def hamming_links(points: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the links among ``points`` (fp long, node long; fp distinct)."""
    bits, level = 64, points.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp", "node")
    done = None
    for k in range(LEVELS):
        level = _dealt(level, bits, radius)
        bits -= bits // (radius + 1)
        if k == LEVELS - 1 or bits <= 2 * (radius + 1):
            done = level if done is None else done.unionByName(level)
            break
        level = materialise(level, "shards")
        large = materialise(level.groupBy("shard").count().where(F.col("count") > SPLIT).select("shard"), "large-shards")
        light = level.join(large, "shard", "left_anti")
        done = light if done is None else done.unionByName(light)
        if large.isEmpty():
            break
        level = level.join(large, "shard", "left_semi")
    return done.select("shard", "fp", "node").repartition("shard").sortWithinPartitions("shard").mapInArrow(_linked(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable by links).

    Links join fingerprints at ``radius`` or fewer differing bits; equal ones always. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows without an id link nothing; they carry the component of an equal
    fingerprint, or null. Rows that repeat an id are one document. Other columns aren't read; an empty table gives an
    empty one. Ids are integers.
    """
    found = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    points = materialise(found.where("id is not null").groupBy("fp").agg(F.min("id").cast("long").alias("node")), "points")
    nodes = connected_components(hamming_links(points, radius))
    classes = points.join(nodes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(docs.schema[id_col].dataType).alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, columns as they are: the row of the least id, rows without an id last.

    It goes by rows: rows that repeat an id are kept or dropped by their own texts, exact repeats leave one row, and rows
    without an id count as documents. Rows tied on the id are told apart by their hash; whole equal rows leave one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = materialise(docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("n", F.monotonically_increasing_id()), "rows")
    found = materialise(fingerprints(marked, "n", "text"), "fingerprints")
    points = materialise(found.groupBy("fp").agg(F.min("id").alias("node")), "points")
    nodes = connected_components(hamming_links(points, radius))
    classes = points.join(nodes, "node", "left").select("fp", F.coalesce("component", "node").alias("class"))
    ranked = materialise(found.select(F.col("id").alias("n"), "fp").join(classes, "fp").join(marked.select("n", "id", F.xxhash64("row").alias("hash")), "n").select("n", "class", F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "n").alias("place")), "places")
    best = ranked.groupBy("class").agg(F.min("place").alias("best"))
    copies = ranked.join(best, "class").where(F.col("place.n") != F.col("best.n")).select("n")
    return marked.join(materialise(copies, "copies"), "n", "left_anti").select("row.*")


def overlap_share(fp: np.ndarray, radius: int = 4) -> float:
    """Share of points whose ball crosses the median shell of a vantage point over all 64 bits."""
    d = _near(fp, fp[0]).astype(int)
    return float((np.abs(d - np.median(d)) <= radius).mean())
