"""Cases that only larger tables have, and results held against SQL or brute force on them."""

import pytest


@pytest.fixture(scope="module")
def made(spark, tables, tmp_path_factory):
    """A folder of tables with a few suppliers and orders whose keys a function of theirs gives."""

    def make(supplier: str = "s_suppkey", suppliers: str = "true"):
        folder = str(tmp_path_factory.mktemp("tables"))
        for t in ("region", "nation", "orders"):
            spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        spark.read.parquet(f"{tables}/supplier.parquet").where(suppliers).selectExpr(f"cast({supplier} as bigint) as s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.parquet(f"{folder}/supplier.parquet")
        return folder

    return make


def same_as_sql(spark, folder, name):
    import duckdb
    from strandlake.plans import catalogue

    db = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders"):
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, folder)
    cursor = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", ["assembly_map", "assembly_taxids"])
def test_suppliers_numbered_as_human_and_mouse(spark, made, name):
    same_as_sql(spark, made("case when s_suppkey < 5 then 8603 + s_suppkey else 9085 + s_suppkey end"), name)


def tasks_of(df):
    """Partitions that the rows come in, without adaptive merging."""
    return df.rdd.getNumPartitions()


def test_genomes_and_reads_come_in_many_parts(spark, tables):
    from strandlake.plans.fixtures import Fixtures

    f = Fixtures(spark, tables)
    assert tasks_of(f.genomes) >= 4 and tasks_of(f.windows) >= 4


def test_window_counts_explode_nothing(spark):
    from strandlake.functions import dna

    texts = ["", None, "ACG", "ACGT", "acgtn\r\nACGTA", "Straße ACGTACGT", "N" * 9, "ACGTNACG" * 3, "A" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    counts = dna.window_counts(df, 4, keep=("id",))
    assert "explode" not in counts._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.id, r.n, r.a) for r in dna.with_kmers(df, 4, keep=("id",)).groupBy("id").agg({"*": "count", "ambig": "count_if"}).toDF("id", "n", "a").collect()}
    assert {tuple(r) for r in counts.collect()} == want


def test_codes_tell_long_kmers_apart(spark):
    import random

    from pyspark.sql import functions as F
    from strandlake.functions import dna

    rng = random.Random(4)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGTACGTACGTN") for _ in range(80))) for i in range(20)] + [(90, "T" * 40 + "0123 +-" * 9)], "read_id int, seq string")
    for k in (5, 18, 19, 31, 40):
        first = F.col(dna.code_columns(k)[0])
        got = {(r.read_id, r.pos, r.canon) for r in dna.with_codes(df, k).select("read_id", "pos", F.when(first >= 0, dna.letters(k)).alias("canon")).collect()}
        assert got == {(r.read_id, r.pos, None if r.ambig else r.canon) for r in dna.with_kmers(df, k).collect()}


@pytest.mark.parametrize("name, most", [("classify_chunked", 1), ("confidence_lines", 2)])
def test_reads_are_exploded_once(spark, tables, name, most):
    """Not once for each chunk of the table, or each use of the rows; the filter reads them again for their ids and lengths."""
    from strandlake.plans import catalogue

    plan = catalogue.QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == most


def test_set_votes_by_counting(spark):
    """Sets of all kinds, clades or not, nested or not, against votes counted taxon by taxon."""
    import random
    from collections import Counter

    from strandlake.operators import classify as C
    from strandlake.operators import tree as T

    rng = random.Random(11)
    parent = {1: 0} | {i: 1 for i in range(10, 13)} | {i: 10 + i % 3 for i in range(100, 112)}
    tree = T.with_paths(spark.createDataFrame([(t, p, f"n{t}", "no rank") for t, p in parent.items()], "taxid long, parent long, name string, rank string"))
    path = lambda t: [*path(parent[t]), t] if t else []
    kmers = ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(60)]
    kmers = sorted({min(k, k[::-1].translate(str.maketrans("ACGT", "TGCA"))) for k in kmers})
    nest = sorted(rng.sample(range(100, 112), 8))
    kinds = [list(range(100, 112)), [t for t in range(100, 112) if t % 3 == 1], nest, nest[::2], nest[:1], nest[::4], [101], [107], [999], [103, 999]]
    sets = {k: sorted(rng.choice(kinds) if i % 4 else rng.sample(range(100, 112), rng.randint(1, 6))) for i, k in enumerate(kmers)}
    reads = {i: [rng.choice(kmers) for _ in range(rng.randint(1, 5))] for i in range(400)}
    # N between k-mers, so that a read has these and no others.
    table = spark.createDataFrame(list(sets.items()), "kmer string, taxids array<long>")
    got = {r.read_id: r.taxid for r in C.set_votes(spark.createDataFrame([(i, "N".join(ks)) for i, ks in reads.items()], "read_id long, seq string"), table, tree, 9).collect()}
    for i, ks in reads.items():
        n, w = Counter(), Counter()
        for k in ks:
            for t in sets[k]:
                if t in parent:
                    n[t] += 1
                    w[t] += 1 / len(sets[k])
        best = max(((n[t], round(w[t], 6)) for t in n), default=None)
        tied = [path(t) for t in n if (n[t], round(w[t], 6)) == best]
        assert got[i] == (max((a for a in tied[0] if all(a in p for p in tied)), key=lambda a: tied[0].index(a)) if tied else 0), (i, ks)


@pytest.mark.parametrize("name", ["report_ranks", "report_rank_lines", "report_from_counts"])
def test_calls_are_made_once_for_a_rank_report(spark, tables, name):
    """Its several uses of the counts read them from one table in memory."""
    from strandlake.plans import catalogue

    df = catalogue.QUERIES[name](spark, tables)
    plan = df._jdf.queryExecution().withCachedData().toString()
    assert "Relation [o_orderkey" not in plan and "InMemoryRelation [taxid" in plan
