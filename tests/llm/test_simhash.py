import random
import re

import numpy as np
import pytest
import xxhash
from strandlake.llm import simhash
from strandlake.llm import simhash as S
from strandlake.llm.components import connected_components

from .conftest import AWKWARD


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=4):
    """{fp: least node} by all pairs."""
    nodes = list(points)
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for f in nodes:
        least[find(f)] = min(least.get(find(f), points[f]), points[f])
    return {f: least[find(f)] for f in nodes}


def test_awkward(spark, awkward, nothing):
    got = simhash.simhash_groups(awkward).collect()
    fps = {t: brute_fingerprint(t) for _, t, *_ in AWKWARD}
    points = {}
    for i, t, *_ in AWKWARD:
        if i is not None:
            points[fps[t]] = min(points.get(fps[t], i), i)
    classes = brute_components(points)
    want = sorted((str(i), f"{fps[t]:016x}", str(classes.get(fps[t]))) for i, t, *_ in AWKWARD)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert fps[None] == fps[""] == 0
    assert simhash.simhash_groups(nothing).count() == 0


def clustered(n, seed, tight):
    rng = random.Random(seed)
    out = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(n // 12):
            x = center
            for _ in range(rng.randint(0, tight)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return {f: i for i, f in enumerate(sorted(out))}


@pytest.mark.parametrize(("split", "leaf"), [(1024, 128), (16, 4)])
def test_links_against_all_pairs(spark, monkeypatch, split, leaf):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    points = clustered(600, split, 9)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for f, i in points.items()]
    links = simhash.hamming_links(spark.createDataFrame(signed, "fp long, node long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: got.get(i, i) for i in points.values()} == {points[f]: c for f, c in brute_components(points).items()}


def test_tree_prunes_and_loses_nothing():
    fp = np.array(list(clustered(1500, 5, 6)), np.uint64)
    forest, brute = simhash.Forest(len(fp)), simhash.Forest(len(fp))
    simhash.tree_join(fp, np.arange(len(fp)), 4, forest)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    brute.join(i, j)
    assert (forest.root == brute.root).all()


def test_overlap_of_whole_vantage_shards_is_almost_total():
    fp = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert simhash.overlap_share(fp) > 0.6


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (3, 4), (None, 5), (900, 900)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                change = True
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_groups_goes_by_rows(spark, nothing):
    far = "entirely other words about the sea and ships that pass by night under stars"
    texts = [(7, "a b c d e f g"), (7, "a b c d e f g"), (3, "a b c d e f g"), (7, far), (None, "a b c d e f g"), (None, "no id and no copy of anything in this table at all"), (9, None), (8, ""), (2, far + " x" * 0)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id long, text string, n string")
    out = S.first_of_groups(docs)
    assert out.columns == docs.columns
    got = sorted(map(str, ((r.doc_id, r.text) for r in out.collect())))
    assert got == sorted(map(str, [(3, "a b c d e f g"), (2, far), (None, texts[5][1]), (8, "")]))
    only = spark.createDataFrame([(7, "a b c d e f g", "n"), (3, "a b c d e f g", "n"), (7, far, "n")], docs.schema)
    assert sorted(r.text for r in S.first_of_groups(only).collect()) == sorted(["a b c d e f g", far])
    assert S.first_of_groups(nothing).count() == 0
