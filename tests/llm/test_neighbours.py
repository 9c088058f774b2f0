import numpy as np
import pytest
from strandlake.llm import neighbours


def brute(vectors, threshold=0.9):
    ids = list(vectors)
    sound = [i for i in ids if vectors[i] and all(x is not None and np.isfinite(x) for x in vectors[i]) and any(vectors[i])]
    x = np.array([np.array(vectors[i], float) / np.linalg.norm(vectors[i]) for i in sound])
    hit = x @ x.T >= threshold
    root = {i: i for i in ids}
    change = True
    while change:
        change = False
        for a, i in enumerate(sound):
            least = min(root[sound[b]] for b in np.flatnonzero(hit[a]))
            if least < root[i]:
                root[i] = least
                change = True
    links = dict.fromkeys(ids, 0) | {i: int(hit[a].sum()) - 1 for a, i in enumerate(sound)}
    return {i: (links[i], root[i]) for i in ids}


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(2)
    out, n = {}, 0
    for size, spread in ((1, 0), (700, 0.05), (60, 0.1), (300, 0.02), (12, 0.15), (2, 0.1), (90, 0.3)):
        center = rng.standard_normal(24)
        for _ in range(size):
            out[n] = (center / np.linalg.norm(center) + spread * rng.standard_normal(24) / 2).astype("float32").tolist()
            n += 1
    for _ in range(500):
        out[n] = rng.standard_normal(24).astype("float32").tolist()
        n += 1
    for _ in range(40):
        out[n] = out[5]
        n += 1
    return out


def test_against_all_pairs(spark, clusters):
    df = spark.createDataFrame([(i, v, 0) for i, v in clusters.items()], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    want = brute(clusters)
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98
    kept = {r.vec_id for r in neighbours.near_duplicates(df).where("kept").collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 5, "x"), (2, [2.0, 0.0], 5, "x"), (3, None, None, "x"), (4, [], 1, None), (5, [0.0, 0.0], 1, "x"), (6, [nan, 1.0], 1, "x"), (7, [inf, 1.0], 1, "x"), (8, [None, 1.0], 1, "x"), (9, [0.0, 1.0], 1, "x"), (9, [0.0, 1.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (10, [1.0, 0.0, 0.0], 1, "x"), (11, [1e-30, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, links string")
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect())
    assert got == [(-1, 0, None, None), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (9, 1, 9, True), (10, 0, 10, True), (11, 2, 1, False)]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_a_low_recall_is_an_error(spark, clusters, monkeypatch):
    monkeypatch.setattr(neighbours, "_recall", lambda *_: 0.5)
    monkeypatch.setattr(neighbours, "EXTENSIONS", 0)
    df = spark.createDataFrame([(i, v) for i, v in clusters.items()], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="0.50"):
        neighbours.near_duplicates(df)


def test_more_lengths_than_a_thousand(spark):
    rng = np.random.default_rng(3)
    rows = []
    for w in range(1, 1102):
        x = rng.standard_normal(w)
        rows += [(3 * w, x.tolist()), (3 * w + 1, (2 * x).tolist()), (3 * w + 2, (-x).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert got == {i: (0, i) if i % 3 == 2 else (1, 3 * (i // 3)) for i, _ in rows}


def test_unsaturated_lists_count_as_saturated_ones_do(spark, monkeypatch):
    """Rings whose points link to the next ones only: components larger than a block without a full list."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "FEW", 0)
    rings = {}
    for r in range(6):
        for k in range(18):
            v = [0.0] * 12
            v[2 * r], v[2 * r + 1] = float(np.cos(np.pi * k / 9)), float(np.sin(np.pi * k / 9))
            rings[len(rings)] = v
    df = spark.createDataFrame(list(rings.items()), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert got == brute(rings) and {n for n, _ in got.values()} == {2}
