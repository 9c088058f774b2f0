import pytest
from strandlake.llm import shards

from .conftest import AWKWARD


def test_every_row_once_and_sizes_grow(spark, awkward, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), fanout=3, base_bytes=6000, target_bytes=20_000)
    df = spark.range(4000).selectExpr("id as doc_id", "repeat(md5(string(id)), 4) as text").repartition(1)
    for k in range(20):
        store.append(df.where(f"doc_id >= {200 * k} and doc_id < {200 * k + 200}"))
        now = store.compact()
        tiers = [r["tier"] for r in now["runs"] if r["bytes"] < shards.LARGEST * 20_000]
        assert all(tiers.count(t) < 3 for t in tiers)
    out = store.read()
    assert out.count() == 4000 and out.select("doc_id").distinct().count() == 4000 and sorted(out.select("doc_id", "text").collect()) == sorted(df.collect())
    assert len(store.manifest()["runs"]) < 10 and max(r["tier"] for r in store.manifest()["runs"]) >= 2
    assert {r.shard_run for r in out.select("shard_run").distinct().collect()} == {r["run"].split("/")[1] for r in store.manifest()["runs"]}


def test_commits_cannot_overwrite_one_another(spark, tmp_path):
    a, b = shards.ShardStore(spark, str(tmp_path / "s")), shards.ShardStore(spark, str(tmp_path / "s"))
    before = a.manifest()
    b.append(spark.range(5).toDF("doc_id"))
    with pytest.raises(shards.CommitConflict):
        a._commit(before, spark.range(1).toDF("doc_id").schema.json(), [])
    assert a.read().count() == 5 and a.version() == 1


def test_awkward(spark, awkward, nothing, tmp_path):
    out = shards.ingest(awkward, str(tmp_path / "a"), 4).read()
    assert sorted(map(str, out.select(awkward.columns).collect())) == sorted(map(str, awkward.collect())) and out.count() == len(AWKWARD)
    assert shards.ingest(nothing, str(tmp_path / "n")).read().count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        shards.ShardStore(spark, str(tmp_path / "a")).append(spark.range(3))


def test_old_versions_stay_readable_until_vacuum(spark, tmp_path):
    store, reads = shards.ShardStore(spark, str(tmp_path / "s"), fanout=2, base_bytes=1 << 20), {}
    for k in range(5):
        store.append(spark.range(10 * k, 10 * k + 10).toDF("doc_id").repartition(1))
        reads[store.version()] = store.read()  # opened before the compaction
        store.compact()
    for v, df in reads.items():
        assert df.count() == store.read(v).count() == 10 * len([w for w in reads if w <= v])
    newest = store.version()
    assert store.vacuum(1) > 0 and store.read().count() == 50 and store.version() == newest
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND"):
        store.read(1).count()


def test_conflicting_appends_are_tried_again(spark, tmp_path, monkeypatch):
    a, b = shards.ShardStore(spark, str(tmp_path / "s"), fanout=2), shards.ShardStore(spark, str(tmp_path / "s"), fanout=2)
    commit, met = a._commit, []

    def late(*args):
        if len(met) < 2:
            met.append(b.append(spark.range(3).toDF("doc_id")))
        return commit(*args)

    monkeypatch.setattr(a, "_commit", late)
    a.append(spark.range(5).toDF("doc_id"))
    assert len(met) == 2 and a.read().count() == 11
    met.clear()
    a.compact()
    assert a.read().count() == 11 + 3 * len(met) and len(list((tmp_path / "s" / "runs").iterdir())) >= len(a.manifest()["runs"])


def test_clashing_names(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(1, "mine")], "doc_id long, shard_run string"))
    assert store.read().columns == ["doc_id", "shard_run", "_shard_run", "_shard_file", "_shard_tier", "_shard_version"] and store.read().first().shard_run == "mine"


def test_large_runs_are_merged_as_small_ones_are(spark, tmp_path):
    df = spark.range(600).selectExpr("id as doc_id", "repeat(md5(string(id)), 4) as text")
    shapes = []
    for target in (1 << 20, 100):  # to the second, every run is larger than 16 targets
        store = shards.ShardStore(spark, str(tmp_path / str(target)), fanout=3, base_bytes=1 << 20, target_bytes=target)
        for k in range(6):
            store.append(df.where(f"doc_id >= {100 * k} and doc_id < {100 * k + 100}").coalesce(1))
            store.compact()
        assert sorted(store.read().select("doc_id", "text").collect()) == sorted(df.collect())
        shapes.append((store.version(), [r["tier"] for r in store.manifest()["runs"]]))
    assert shapes[0] == shapes[1] and shapes[0][1] == [1, 1]
