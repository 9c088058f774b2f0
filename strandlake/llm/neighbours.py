"""Near-duplicate embeddings by NN-descent.

1. Equal vectors are one point. Points without a direction (null, empty, zero, null or non-finite components) are set
   aside: they link with nothing.
2. First lists: random hyperplanes deal the points to cells of about ``CELL``, in several independent ways; within a
   cell all are compared and each point keeps its ``LIST`` nearest.
3. Rounds: around each point its neighbours, in either direction, meet and are compared (neighbours of neighbours), and
   lists are improved, until few change.
4. The links found so far give components. A full list whose last entry still is a link is saturated: it is enlarged to
   the whole component of its point, where all members are compared with all others, in blocks. So are components of at
   most a block. Elsewhere every list holds all that was found, and its links are counted.
5. The audit compares a fixed number of points, and as many of those that have links, with all others, and repeats 2 to 4
   with further hyperplanes while the mean share of a point's links that are found is less than ``RECALL``. Less than
   ``LEAST_RECALL`` in the end is an error.

Lengths of vectors that few points have are compared all with all, many lengths in one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._work import materialise
from strandlake.llm.components import connected_components
from strandlake.llm.simhash import Forest

CELL, WAYS, LIST, ROUNDS, BLOCK = 256, 6, 10, 4, 512
#: Neighbours of neighbours are followed along edges of at least this cosine less than the threshold.
SLACK = 0.2
#: Points of the audit, what it asks for, and how often lists may be extended for it.
AUDIT, RECALL, LEAST_RECALL, EXTENSIONS = 200, 0.97, 0.9, 3
#: Points up to which all of one length are compared in one task.
FEW = 1024


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns -> tables that hold whole groups."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = [table.column(i)[table.num_rows - 1] for i in range(keys)]
        same = np.ones(table.num_rows, bool)
        for i, v in enumerate(last):
            same &= np.asarray(table.column(i)) == v.as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def points_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(v, node, copies): distinct vectors with a direction."""
    v = F.col(vec_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(sound & F.col(id_col).isNotNull()).groupBy(v.alias("v")).agg(F.min(id_col).cast("long").alias("node"), F.count("*").alias("copies"))


def _cells(points: DataFrame, n: int, width: int, ways: range) -> DataFrame:
    """(cell, node, v), each point once a way; cells beyond four times ``CELL`` are dealt into random parts of it."""
    bits = max(0, math.ceil(math.log2(max(1, n / CELL))))

    def deal(batches):
        for batch in batches:
            x = _rows(batch.column(1), width)
            cells = [np.zeros(len(x), np.int64) + (w << 48) for w in ways]
            for cell, w in zip(cells, ways, strict=True):
                if bits:
                    planes = np.random.default_rng([11, w]).standard_normal((width, bits))
                    cell += (x @ planes > 0) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.concat_arrays([batch.column(0)] * len(ways)), pa.concat_arrays([batch.column(1)] * len(ways))], names=["cell", "node", "v"])

    kind = points.schema["v"].dataType.simpleString()
    dealt = points.select("node", "v").mapInArrow(deal, f"cell long, node long, v {kind}")
    sizes = materialise(dealt.groupBy("cell").count().where(F.col("count") > 4 * CELL), "cell-sizes")
    parts = F.coalesce(F.ceil(F.col("count") / CELL), F.lit(1)).cast("long")
    return dealt.join(sizes, "cell", "left").select(F.xxhash64("cell", F.pmod(F.xxhash64("node", "cell"), parts)).alias("cell"), "node", "v")


def _best(node: np.ndarray, other: np.ndarray, cos: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` largest of each node, repeated pairs once."""
    order = np.lexsort((other, -cos, node))
    node, other, cos = node[order], other[order], cos[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])]) if len(node) else np.zeros(0, bool)
    node, other, cos = node[new], other[new], cos[new]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    keep = rank < most
    return node[keep], other[keep], cos[keep]


def _compare_cells(floor: float, width: int):
    def run(batches):
        for table in _groups(batches, 1):
            cell, node, v = np.asarray(table.column(0)), np.asarray(table.column(1)), _rows(table.column(2).combine_chunks(), width)
            for a, b in _runs(cell):
                if b - a < 2:
                    continue
                cos = v[a:b] @ v[a:b].T
                np.fill_diagonal(cos, -2)
                k = min(LIST, b - a - 1)
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(cos, near, 1).ravel()
                use = value >= floor
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[a:b], k)[use]), pa.array(node[a:b][near].ravel()[use]), pa.array(value[use])], names=["node", "other", "cos"])

    return run


def _bridges(threshold: float, width: int):
    """(a, b): a spanning forest of each cell's links, as lists full of closer neighbours may hold none between two dense parts."""

    def run(batches):
        for table in _groups(batches, 1):
            cell, node, v = np.asarray(table.column(0)), np.asarray(table.column(1)), _rows(table.column(2).combine_chunks(), width)
            for a, b in _runs(cell):
                i, j = np.nonzero(np.triu(v[a:b] @ v[a:b].T >= threshold, 1))
                if len(i):
                    forest = Forest(b - a)
                    forest.join(i, j)
                    i = np.flatnonzero(forest.root != np.arange(b - a))
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:b][i]), pa.array(node[a:b][forest.root[i]])], names=["node", "other"])

    return run


def _merge(batches):
    """(node, other, cos) sorted by node -> each node's best; hence lists that several sources feed."""
    for table in _groups(batches, 1):
        n, o, c = _best(*(np.asarray(table.column(i)) for i in range(3)), LIST)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(o), pa.array(c)], names=["node", "other", "cos"])


_EDGE = "node long, other long, cos double"


def _lists(candidates: DataFrame, name: str) -> DataFrame:
    return materialise(candidates.repartition("node").sortWithinPartitions("node").mapInArrow(_merge, _EDGE), name)


def _meet(floor: float, width: int):
    """Around each hub, all its neighbours are compared with each other."""

    def run(batches):
        for table in _groups(batches, 2):
            hub, part, node = (np.asarray(table.column(i)) for i in range(3))
            v = _rows(table.column(3).combine_chunks(), width)
            out = []
            for a, b in _runs(hub, part):
                if b - a > 1:
                    cos = v[a:b] @ v[a:b].T
                    np.fill_diagonal(cos, -2)
                    i, j = np.nonzero(cos >= floor)
                    out.append((node[a + i], node[a + j], cos[i, j]))
            if out:
                n, o, c = _best(*(np.concatenate(x) for x in zip(*out, strict=True)), LIST)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(o), pa.array(c)], names=["node", "other", "cos"])

    return run


def _round(lists: DataFrame, points: DataFrame, floor: float, width: int, name: str) -> DataFrame:
    """Neighbours of neighbours. A hub with many reverse neighbours is met in random parts of 64, each of which goes on as a list's source."""
    both = lists.select(F.col("node").alias("hub"), "other").union(lists.select(F.col("other").alias("hub"), F.col("node").alias("other"))).distinct()
    degree = materialise(both.groupBy("hub").count().where(F.col("count") > 64), f"{name}-hubs")
    parts = F.coalesce(F.ceil(F.col("count") / 64), F.lit(1)).cast("long")
    kind = points.schema["v"].dataType.simpleString()
    met = both.join(degree, "hub", "left").select("hub", F.pmod(F.xxhash64("other", "hub"), parts).alias("part"), F.col("other").alias("node")).join(points.select("node", "v"), "node")
    found = met.select("hub", "part", "node", "v").repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_meet(floor, width), _EDGE)
    return _lists(lists.union(found), name)


def _count_links(threshold: float, width: int):
    """Blocks of one component meet: (node, links) and the least node linked, in parts that add up."""

    def run(batches):
        for table in _groups(batches, 3):
            keys = [np.asarray(table.column(i)) for i in range(3)]
            side, node, copies = (np.asarray(table.column(i)) for i in (3, 4, 5))
            v = _rows(table.column(6).combine_chunks(), width)
            for a, b in _runs(*keys):
                left = np.arange(a, b)[side[a:b] == 0]
                right = np.arange(a, b)[side[a:b] == 1]
                same = keys[1][a] == keys[2][a]
                right = left if same else right
                n = np.zeros(len(left), np.int64)
                m = np.zeros(len(right), np.int64)
                for k in range(0, len(left), BLOCK):
                    hit = v[left[k : k + BLOCK]] @ v[right].T >= threshold
                    if same:
                        hit[np.arange(len(hit)), np.arange(k, k + len(hit))] = True  # a point's own copies
                    n[k : k + BLOCK] = hit @ copies[right]
                    m += copies[left[k : k + BLOCK]] @ hit
                yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(n)], names=["node", "links"])
                if not same:
                    yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array(m)], names=["node", "links"])

    return run


def _counted(points: DataFrame, lists: DataFrame, members: DataFrame, threshold: float, width: int) -> DataFrame:
    """(node, links): copies linked to each member of a component, itself and its own copies included."""
    near = lists.where(F.col("cos") >= threshold)
    full = near.groupBy("node").count().where(F.col("count") >= LIST).select("node")
    sized = members.join(full.withColumn("full", F.lit(1)), "node", "left").groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.max("full").alias("saturated"))
    sized = materialise(sized, "component-sizes")
    dense = members.join(sized.where("saturated = 1 or blocks = 1").select("component", "blocks"), "component")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    a = dense.withColumn("own", own).join(points, "node")
    other = a.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = other.select("component", F.least("own", "i").alias("i"), F.greatest("own", "i").alias("j"), F.when(F.col("own") <= F.col("i"), 0).otherwise(1).cast("int").alias("side"), "node", "copies", "v")
    met = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    enlarged = met.mapInArrow(_count_links(threshold, width), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    loose = members.join(sized.where("saturated is null and blocks > 1").select("component"), "component", "left_semi").select("node")
    both = near.select("node", "other").union(near.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    copies = points.select("node", "copies")
    seen = both.join(loose, "node", "left_semi").join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("links"))
    plain = loose.join(copies, "node").join(seen, "node", "left").select("node", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("links"))
    return enlarged.unionByName(plain)


def _few(threshold: float):
    """Points sorted by their length, few of each -> (node, links, component), all compared with all of their length."""

    def run(batches):
        for table in _groups(batches, 1):
            width, node, copies = (np.asarray(table.column(i)) for i in range(3))
            vectors = table.column(3).combine_chunks()
            for a, b in _runs(width):
                v = _rows(vectors[a:b], int(width[a]))
                hit = v @ v.T >= threshold
                np.fill_diagonal(hit, True)
                i, j = np.nonzero(np.triu(hit, 1))
                order = np.argsort(node[a:b])  # so that the root is the least id
                rank = np.argsort(order)
                forest = Forest(b - a)
                forest.join(rank[i], rank[j])
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b]), pa.array(hit @ copies[a:b]), pa.array(node[a:b][order][forest.root[rank]])], names=["node", "links", "component"])

    return run


def _truth(points: DataFrame, asked: DataFrame, width: int, threshold: float) -> dict[int, int]:
    """True numbers of links of some points, from a scan of all; at most twice ``AUDIT`` are asked for."""
    asked = asked.limit(2 * AUDIT).toArrow()
    if not asked.num_rows:
        return {}
    nodes, q = asked.column(0).to_pylist(), _rows(asked.column(1).combine_chunks(), width)

    def scan(batches):
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            total += (_rows(batch.column(1), width) @ q.T >= threshold).T @ np.asarray(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), pa.array(total)], names=["k", "n"])

    found = points.select("copies", "v").mapInArrow(scan, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {nodes[r.k]: r.n for r in found}


def _drawn(points: DataFrame, n: int) -> DataFrame:
    """About ``AUDIT`` of n points by hash."""
    return points.where(F.xxhash64("node").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53) < min(1.0, AUDIT / max(1, n))).select("node", "v")


def _recall(links: DataFrame, true: dict[int, int]) -> float:
    """Mean share of links found of the audited points that have any; 1 where none has."""
    linked = {k: n for k, n in true.items() if n > 1}
    have = {r.node: r.links for r in links.where(F.col("node").isin(list(linked))).collect()} if linked else {}
    return float(np.mean([min(have.get(k, 1), n) / n for k, n in linked.items()])) if linked else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: id, ``n_links`` (other rows linked directly), ``component_id`` (least id reachable), ``kept``.

    Links are pairs of cosine >= threshold in double precision; none below it is ever counted. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing and are their own component, as are rows with
    a null id (component and kept null). Vectors of different lengths link only within their length. Repeated rows are
    linked copies of one another. An empty table gives an empty one. Labels and other columns aren't read.
    """
    kind = vectors.schema[id_col].dataType
    parts = []
    slim = vectors.select(F.col(id_col), F.col(vec_col).cast("array<double>").alias("v0")) if vectors.schema[vec_col].dataType.simpleString() not in ("array<float>", "array<double>") else vectors.select(F.col(id_col), F.col(vec_col).alias("v0"))
    everything = materialise(points_of(slim, id_col, "v0"), "points")
    sizes = materialise(everything.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")), "widths")
    few = everything.withColumn("w", F.size("v")).join(sizes.where(F.col("n") <= FEW).select("w"), "w", "left_semi").select("w", "node", "copies", "v")
    small = few.repartition("w").sortWithinPartitions("w").mapInArrow(_few(threshold), "node long, links long, component long")
    parts.append(everything.select("v", "node").join(materialise(small, "few"), "node").select("v", "links", "component"))
    # Lengths with more points; each goes through the rounds on its own.
    for width, n in sizes.where(F.col("n") > FEW).orderBy("w").collect():
        points = everything.where(F.size("v") == width)
        floor = threshold - SLACK
        true = _truth(points, _drawn(points, n), width, threshold)
        lists = bridges = None
        for k in range(1 + EXTENSIONS):
            cells = _cells(points, n, width, range(k * WAYS, (k + 1) * WAYS))
            dealt = cells.select("cell", "node", "v").repartition("cell").sortWithinPartitions("cell")
            first = dealt.mapInArrow(_compare_cells(floor, width), _EDGE)
            bridge = materialise(dealt.mapInArrow(_bridges(threshold, width), "node long, other long").distinct(), "bridges")
            bridges = bridge if bridges is None else bridges.union(bridge)
            lists = _lists(first if lists is None else lists.union(first), "lists")
            total = lists.agg(F.sum("cos")).first()[0] or 0.0
            for r in range(ROUNDS):
                lists = _round(lists, points, floor, width, f"lists-{r}")
                now = lists.agg(F.sum("cos")).first()[0] or 0.0
                if now - total <= 0.001 * abs(now):
                    break
                total = now
            members = materialise(connected_components(lists.where(F.col("cos") >= threshold).select("node", "other").union(bridges), "node", "other"), "members")
            links = materialise(_counted(points, lists, members, threshold, width), "links")
            if k == 0:  # a uniform choice may hit no linked point at all
                linked = points.join(links, "node", "left_semi")
                true |= _truth(points, _drawn(linked, links.count()), width, threshold)
            recall = _recall(links, true)
            if recall >= RECALL:
                break
        if recall < LEAST_RECALL:
            raise RuntimeError(f"only {recall:.2f} of the audited links of vectors of length {width} were found")
        parts.append(points.select("v", "node", "copies").join(links.join(members, "node"), "node", "left").select("v", F.coalesce("links", "copies").alias("links"), F.coalesce("component", "node").alias("component")))
    rows = slim.withColumnRenamed(id_col, "id")
    table = parts[0]
    for p in parts[1:]:
        table = table.union(p)
    table = materialise(table.select(F.col("v").alias("v0"), "links", "component", F.lit(True).alias("in")), "classes")
    found = rows.join(table, "v0", "left").withColumn("in", F.col("in") & F.col("id").isNotNull())
    found = found.select("id", F.when(F.col("in"), F.col("links")).otherwise(1).cast("long").alias("links"), F.when(F.col("in"), F.col("component")).otherwise(F.col("id").cast("long")).alias("component"))
    return found.select(F.col("id").cast(kind).alias(id_col), (F.col("links") - 1).alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
