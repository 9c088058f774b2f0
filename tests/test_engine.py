"""Hand-checked cases, invariances, and the catalogue's SQL counterparts on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.functions import dna
from strandlake.operators import classify as C
from strandlake.operators import database as D
from strandlake.operators import sketch
from strandlake.operators import tree as T

TREE = [(1, 0, "root", "no rank"), (2, 1, "Bacteria", "superkingdom"), (10, 2, "G a", "genus"), (11, 2, "G|b", "genus"), (100, 10, "s1", "species"), (101, 10, "s2", "species"), (110, 11, "s3", "species"), (9, 100, "strain", "no rank")]


@pytest.fixture(scope="module")
def tree(spark):
    return T.with_paths(spark.createDataFrame(TREE, "taxid long, parent long, name string, rank string")).persist()


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_windows_by_hand(spark, monkeypatch):
    monkeypatch.setattr(dna, "SLICE", 7)
    rng = random.Random(1)
    seqs = ["", None, "AC", "ACG", "ACGT", "NNNN", "acgtn", "AC\r\nGT", "ACGé", "".join(rng.choice("ACGTN") for _ in range(100))]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id int, seq string")
    got = sorted((r.read_id, r.pos, r.kmer, r.canon, r.ambig) for r in dna.with_kmers(df, 3).collect())
    want = []
    for i, s in enumerate(seqs):
        s = (s or "").replace("\r", "").replace("\n", "").upper().replace("É", "N")
        for p in range(len(s) - 2):
            w = s[p : p + 3]
            want.append((i, p, w, min(w, rc(w)), not set(w) <= set("ACGT")))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want)]
    assert [g[3] for g in got if not g[4]] == [w[3] for w in sorted(want) if not w[4]]


def test_codes_and_minimizers(spark):
    rng = random.Random(2)
    kmers = ["".join(rng.choice("ACGT") for _ in range(15)) for _ in range(50)] + ["T" * 15, "A" * 15]
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    mask = dna.SCRAMBLE & (4**7 - 1)
    rows = spark.createDataFrame([(k,) for k in kmers], "kmer string").select("kmer", dna.encode(F.col("kmer")).alias("c"), dna.decode(dna.encode(F.col("kmer")), 15).alias("d"), dna.minimizer(F.col("kmer"), 15, 7).alias("m")).collect()
    for r in rows:
        parts = [r.kmer[i : i + 7] for i in range(9)]
        assert r.c == code(r.kmer) and r.d == r.kmer and r.m == min(mask ^ code(min(p, rc(p))) for p in parts)
    assert spark.sql("SELECT 1").select(dna.encode(F.lit("T" * 31)).alias("c")).first().c == 4611686018427387903


def test_small_functions(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [x(dna.general_format(F.lit(v), 4)) for v in (100.0, 1.5, 12.345678, 0.0)] == ["100", "1.5", "12.35", "0"]
    assert x(dna.prefixed_taxid(F.lit("tool:taxid|77|x"))) == 77 and x(dna.prefixed_taxid(F.lit("x|77"))) is None
    assert x(dna.strip_mate(F.lit("a_1"))) == "a_1" and x(dna.strip_mate(F.lit("a_1"), True)) == "a" and x(dna.strip_version(F.lit("NC_1.12"))) == "NC_1"
    assert dna.parse_size("8G") == 8 << 30 and dna.parse_size("3x") == 0 and dna.parse_size("12") == 12


def test_lca_of_random_sets(spark, tree):
    parent = {t: p for t, p, *_ in TREE}

    def path(t):
        out = [t]
        while parent[out[-1]]:
            out.append(parent[out[-1]])
        return out[::-1]

    rng = random.Random(3)
    sets = {i: [rng.choice(TREE)[0] for _ in range(rng.randint(1, 4))] for i in range(200)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "k int, taxid long")
    got = {r.k: r.taxon for r in T.lca_by(rows, ["k"], tree).collect()}
    for i, s in sets.items():
        common = [a for a in path(s[0]) if all(a in path(t) for t in s)]
        assert got[i] == common[-1]


def test_vote(spark, tree):
    hits = {1: {100: 3, 10: 5, 110: 7}, 2: {100: 2, 101: 2}, 3: {100: 2, 110: 2}, 4: {2: 9}, 5: {9: 1, 100: 1, 10: 1, 11: 2}, 6: {777: 4}}
    counts = spark.createDataFrame([(r, t, n) for r, h in hits.items() for t, n in h.items()], "read_id int, taxon long, n long")
    reads = spark.createDataFrame([(i,) for i in range(1, 8)], "read_id int")
    assert {r.read_id: r.taxid for r in C.vote(reads, counts, tree).collect()} == {1: 100, 2: 10, 3: 2, 4: 2, 5: 9, 6: 0, 7: 0}


def test_calls_do_not_depend_on_strand_order_or_chunks(spark, tree):
    rng = random.Random(5)
    seq = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genomes = [("g1", 100, 0, 0, (a := seq(300))), ("g2", 101, 0, 1, a[:100] + seq(200)), ("g3", 110, 1, 2, seq(300))]
    g = spark.createDataFrame(genomes, "seq_id string, taxid long, tier long, ord long, seq string")
    table = D.build_lca(D.genome_kmers(g, 11), tree).persist()
    reads = [(i, x[4][p : p + 60]) for i, (x, p) in enumerate((rng.choice(genomes), rng.randint(0, 240)) for _ in range(60))] + [(900, "ACG"), (901, ""), (902, "N" * 40)]
    fwd, back = (spark.createDataFrame([(i, f(s)) for i, s in reads], "read_id int, seq string") for f in (str, rc))
    call = lambda df: {r.read_id: r.taxid for r in C.classify(df, [table], tree, 11).collect()}
    want = call(fwd)
    assert want == call(back) == call(fwd.orderBy(F.desc("read_id"))) and want[900] == want[901] == want[902] == 0 and len(want) == len(reads)
    bounds = [(r.lo, r.hi) for r in D.chunk_bounds(D.bin_index(table, 11, 5), 3).collect()]
    assert sorted(C.lookup_in_chunks(fwd, table, bounds, 11, 5).collect()) == sorted(C.lookup(fwd, table, 11).collect())
    lists = {r.read_id: r.hitlist for r in C.hitlists(fwd, C.lookup(fwd, table, 11)).collect()}
    rows = C.classify(fwd, [table], tree, 11).collect()
    assert {r.read_id: r.hitlist for r in rows} == lists and lists[900] == "0:0" and lists[902] == "A:30"


def test_sketch_estimates(spark):
    for n in (0, 10, 1000, 50_000):
        df = spark.range(n).select(F.lit(1).alias("taxon"), (F.col("id") * 7919).alias("kmer"))
        for method in ("ertl", "flajolet"):
            got = sketch.estimate(sketch.registers(df, 12), 12, method).collect()
            assert not n and not got or abs(got[0].estimate - n) <= max(2, 0.06 * n)
    halves = [sketch.registers(spark.range(a, a + 6000).select(F.lit(1).alias("taxon"), F.col("id").alias("kmer")), 12) for a in (0, 3000)]
    assert abs(sketch.estimate(sketch.merge(*halves), 12).first().estimate - 9000) < 540
    assert sketch.finalizer(np.array([0], np.int64))[0] == 0xB456BCFC34C2CB2C and math.isinf(sketch.linear([0, 5]))


def test_sources_and_sinks(spark, tree, tmp_path):
    from strandlake.sources import kmerdb, sequences, tables

    (tmp_path / "x.fa").write_text(">a one\nAC\nGT\r\n>b\n>c three\nTTT")
    got = sorted(map(tuple, sequences.read_fasta(spark, str(tmp_path / "x.fa")).select("id", "header_line", "seq").collect()))
    assert got == [("a", "a one", "ACGT"), ("b", "b", ""), ("c", "c three", "TTT")]
    (tmp_path / "x.fq").write_text("@r1 d\nACGT\n+\nIIII\n@r2\nGG\n+\nII\nbroken\nAC\n+\nII\n@r4\nA\n+\nI\n")
    assert [tuple(r) for r in sequences.read_fastq(spark, str(tmp_path / "x.fq")).orderBy("rec_no").collect()] == [(0, "r1", "r1 d", "ACGT", "IIII"), (1, "r2", "r2", "GG", "II")]
    assert sequences.sniff(spark, str(tmp_path / "x.fq")) == "fastq" and sequences.sniff(spark, str(tmp_path / "x.fa")) == "fasta"
    sequences.write_fasta(sequences.read_fasta(spark, str(tmp_path / "x.fa")), str(tmp_path / "out.fa.gz"))
    taxonomy = tree.select("taxid", "parent", "name", "rank")
    tables.write_dumps(taxonomy, str(tmp_path / "nodes"), str(tmp_path / "names"))
    assert sorted(tables.read_taxonomy_dumps(spark, str(tmp_path / "nodes"), str(tmp_path / "names")).collect()) == sorted(taxonomy.collect())
    tables.write_taxdb(taxonomy, str(tmp_path / "taxdb"))
    assert sorted(tables.read_taxdb(spark, str(tmp_path / "taxdb")).collect()) == sorted(taxonomy.collect())
    (tmp_path / "m.map").write_text("s1\t5\nlate\t6\tname\ns1\t7\n")
    assert sorted(map(tuple, D.first_mapping(tables.read_seqmap(spark, str(tmp_path / "m.map"))).collect())) == [("late", 6, "name"), ("s1", 5, None)]
    rows = np.array([(5, 100), (9, 11)], np.int64)
    data = bytearray(72 + 2 * (4 + 8 * 22))
    data[:8], data[8], data[16], data[48] = b"JFLISTDN", 22, 4, 2
    (tmp_path / "db.kdb").write_bytes(bytes(data) + b"".join(int(k).to_bytes(3, "little") + int(v).to_bytes(4, "little") for k, v in rows))
    assert sorted(map(tuple, kmerdb.read_kmer_database(spark, str(tmp_path / "db.kdb")).collect())) == [(5, 100), (9, 11)]
    (tmp_path / "e.dat").write_text("ID   X\nAC   J01;\nDE   a vector\nDE   of sorts\nSQ   Sequence 8 BP;\n     acgt acgt        8\n//\n")
    assert [tuple(r) for r in sequences.read_embl(spark, str(tmp_path / "e.dat")).collect()] == [("J01", "J01 a vector of sorts", "ACGTACGT")]


def test_stream_adds_up(spark, tree, tmp_path):
    from strandlake.streaming import continuous

    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    g = spark.createDataFrame([("g", 100, 0, 0, genome)], "seq_id string, taxid long, tier long, ord long, seq string")
    table = D.build_lca(D.genome_kmers(g, 11), tree).persist()
    reads = spark.createDataFrame([(i, genome[i * 3 : i * 3 + 50] if i % 4 else "A" * 30) for i in range(80)], "read_id int, seq string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    continuous.start(stream, table, tree, 11, str(tmp_path / "out")).awaitTermination()
    got = {r.taxid: r.n_reads for r in continuous.totals(spark, str(tmp_path / "out")).collect()}
    assert got == {100: 60, 0: 20}


COMPARED = ["kmer_ambiguous_flags", "minimizer_bins", "lca_distance", "lineage_ranked", "descendants_pruned", "build_lca_contaminant", "build_lca_tiers", "seqid_resolve", "classify_calls", "classify_rows", "classify_quick", "classify_taxid_sets", "taxon_counts", "report_main", "confidence_filter", "grade_summary"]


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows_as_sql(spark, tables, name):
    import duckdb
    from strandlake.plans import catalogue

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "documents"):
        db.execute(f"create view {t} as select * from read_parquet('{tables}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, tables)
    cursor = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cursor.fetchall()))


def test_every_query_is_listed():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "taxon_counts" in entry.queries()


def test_records_with_one_id_are_classified_one_by_one(spark, tree):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    g = spark.createDataFrame([("g", 100, 0, 0, genome)], "seq_id string, taxid long, tier long, ord long, seq string")
    table = D.build_lca(D.genome_kmers(g, 11), tree)
    reads = spark.createDataFrame([("r", genome[:60]), ("r", genome[100:160]), ("r", "A" * 30), ("r", "ACG")], "read_id string, seq string")
    rows = C.classify(reads, [table], tree, 11, print_sequence=True).collect()
    assert sorted((r.taxid, r.length, r.hitlist, r.seq) for r in rows) == sorted([(100, 60, "100:50", genome[:60]), (100, 60, "100:50", genome[100:160]), (0, 30, "0:20", "A" * 30), (0, 3, "0:0", "ACG")])
    quick = C.classify(reads, [table], tree, 11, quick=True, min_hits=2).collect()
    assert sorted((r.taxid, r.hitlist) for r in quick) == [(0, "Q:0"), (0, "Q:0"), (100, "Q:2"), (100, "Q:2")]


def test_cycles_end(spark):
    broken = spark.createDataFrame([(1, 0, "root", "no rank"), (5, 6, "a", "genus"), (6, 5, "b", "genus"), (7, 7, "self", "genus")], "taxid long, parent long, name string, rank string")
    with pytest.raises(ValueError, match="own ancestors"):
        T.with_paths(broken)
    assert T.with_paths(broken.where("taxid in (1, 7)")).count() == 2


def brute_dust(s, window=64, level=20):
    """Perfect intervals by their definition."""
    t = [s[i : i + 3] for i in range(len(s) - 2)]
    score = {}
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + window - 2)):
            part = t[i : j + 1]
            score[i, j] = sum(part.count(x) * (part.count(x) - 1) / 2 for x in set(part)) / (j - i)
    masked = set()
    for (i, j), x in score.items():
        if 10 * x > level and all(x >= score[a, b] for a in range(i, j) for b in range(a + 1, j + 1)):
            masked.update(range(i, j + 3))
    return "".join(c.lower() if k in masked else c for k, c in enumerate(s))


def test_dust_by_definition():
    from strandlake.functions.dust import _mask

    rng = random.Random(8)
    cases = ["", "A", "ACG", "ACGTTGCATC" + "A" * 16, "A" * 30, "ACACACACACACACAC" + "GATTACAGT", "".join(rng.choice("ACGT") for _ in range(40)) + "AT" * 9 + "".join(rng.choice("ACGT") for _ in range(10))]
    cases += ["".join(rng.choice("AAAC") for _ in range(35)) for _ in range(4)]
    for s in cases:
        assert _mask(s) == brute_dust(s)
    assert _mask("ACGTTGCATC" + "A" * 16) == "ACGTTGCATC" + "a" * 16


def test_mixers():
    m = (1 << 64) - 1

    def ran(u):
        v = (u * 3935559000370003845 + 2691343689449507681) & m
        v ^= v >> 21
        v ^= v << 37 & m
        v ^= v >> 4
        v = v * 4768777513237032717 & m
        v ^= v << 20 & m
        v ^= v >> 41
        return v ^ (v << 5 & m)

    def wang(k):
        k = ((~k & m) + (k << 21)) & m
        k ^= k >> 24
        k = (k + (k << 3) + (k << 8)) & m
        k ^= k >> 14
        k = (k + (k << 2) + (k << 4)) & m
        k ^= k >> 28
        return (k + (k << 31)) & m

    keys = [0, 1, 12345678901234567, 2**62 + 7]
    assert sketch.ranhash(np.array(keys)).tolist() == [ran(k) for k in keys] and sketch.wang(np.array(keys)).tolist() == [wang(k) for k in keys]


def test_all_mixers_estimate(spark):
    df = spark.range(20_000).select(F.lit(1).alias("taxon"), F.col("id").alias("kmer"))
    for mixer in sketch.MIXERS:
        assert abs(sketch.estimate(sketch.registers(df, 12, mixer), 12).first().estimate - 20_000) < 1200


def test_uid_map(spark, tmp_path):
    from strandlake.sources import kmerdb

    pairs = np.array([(5, 0), (7, 1), (9, 2), (3, 0)], "<u4")
    (tmp_path / "uid.map").write_bytes(pairs.tobytes())
    uids = kmerdb.read_uid_map(spark, str(tmp_path / "uid.map"))
    assert sorted(map(tuple, uids.collect())) == [(1, 5, 0), (2, 7, 1), (3, 9, 2), (4, 3, 0)]
    assert {r.uid: r.taxids for r in kmerdb.uid_taxa(uids).collect()} == {1: [5], 2: [7, 5], 3: [9, 7, 5], 4: [3]}
    assert [tuple(r) for r in kmerdb.uid_taxa(uids, [3]).collect()] == [(3, [9, 7, 5])]


def test_database_upkeep(spark, tmp_path):
    path = str(tmp_path / "db")
    table = spark.createDataFrame([("AAC", 5), ("ACC", 6), ("GGA", 7)], "kmer string, taxon long")
    table.write.parquet(path)
    D.rewrite(spark.read.parquet(path).where("taxon <> 6"), path)
    assert sorted(r.kmer for r in spark.read.parquet(path).collect()) == ["AAC", "GGA"] and [f.name for f in tmp_path.iterdir()] == ["db"]
    asked = spark.createDataFrame([("AAC",), ("TTT",)], "kmer string")
    assert D.require_covered(table, asked, allow=True) == 1
    with pytest.raises(ValueError, match="1 k-mers"):
        D.require_covered(table, asked)
    many = spark.range(20_000).select(F.col("id").cast("string").alias("kmer"))
    part = D.sample(many, 0.3, 5)
    assert abs(part.count() - 6000) < 300 and sorted(part.collect()) == sorted(D.sample(many.repartition(7), 0.3, 5).collect())


def test_shrink_and_index_on_skewed_prefixes(spark):
    rng = random.Random(9)
    kmers = sorted({"".join(rng.choice("AAAAC" if i % 3 else "ACGT") for _ in range(9)) for i in range(700)})
    table = spark.createDataFrame([(k, i) for i, k in enumerate(kmers)], "kmer string, taxon long")
    for blocks, offset in ((50, 1), (50, 2), (7, 3), (len(kmers), 1), (2 * len(kmers), 1)):
        n, start, want = len(kmers), 0, []
        for b in range(blocks):
            size = n // blocks + (b < n % blocks)
            want += [kmers[start + size - offset]] if size >= offset else []
            start += size
        assert sorted(r.kmer for r in D.shrink(table, blocks, offset).collect()) == want
    index = sorted(map(tuple, D.bin_index(table, 9, 4).collect()))
    assert [o for *_, o in index] == list(np.cumsum([0] + [n for _, n, _ in index[:-1]]))


def test_inserting_and_looking_up(spark):
    taxonomy = spark.createDataFrame(TREE, "taxid long, parent long, name string, rank string")
    assert T.insert(taxonomy, 55, 10, "species", "new").count() == len(TREE) + 1
    assert T.insert(taxonomy, 100, 10, "species", "taken").count() == T.insert(taxonomy, 56, 999, "species", "orphan").count() == len(TREE)
    assert [r.taxid for r in T.by_name(taxonomy, "s2").collect()] == [101]


def test_human_sequences_get_no_nodes(spark):
    taxonomy = spark.createDataFrame([*TREE, (9606, 2, "human", "species")], "taxid long, parent long, name string, rank string")
    lines = spark.createDataFrame([("a", 100, "asm", 0), ("h", 9606, "asm h", 1), ("a", 101, "late", 2), ("b", 101, "asm", 3), ("c", 110, None, 4)], "seq_id string, taxid long, name string, ord long")
    headers = spark.createDataFrame([("a", "a full header")], "seq_id string, header_line string")
    nodes, ids = T.add_assembly_taxids(taxonomy, lines, headers=headers)
    base = 1_000_000_000
    assert sorted(map(tuple, ids.collect())) == [("a", base + 2), ("b", base + 4), ("c", base + 5), ("h", base + 3)]
    got = sorted(tuple(r) for r in nodes.where(f"taxid > {base}").collect())
    assert got == [(base + 1, 100, "asm", "assembly"), (base + 2, base + 1, "a full header", "sequence"), (base + 3, 9606, "asm h", "assembly"), (base + 4, base + 1, "b", "sequence"), (base + 5, 110, "c", "sequence")]


def test_text_forms(spark):
    from strandlake.operators import report as R

    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [x(dna.fixed_format(F.lit(v), 3)) for v in (0.0625, 0.1875, 0.5, 2 / 3, 0.0005)] == ["0.062", "0.188", "0.500", "0.667", "0.001"]
    assert x(dna.fixed_format(F.lit(3.125), 2, 6)) == "  3.12"
    table = spark.createDataFrame([("d__A", 3, 0)], "lineage string, s1 long, s2 long")
    assert [r.line for r in R.sample_lines(table, ["s1", "s2"], header=True).orderBy("ord").collect()] == ["#Sample\ts1\ts2", "d__A\t3\t0"]
    with pytest.raises(ValueError, match="no such"):
        R.select_columns(table, ["nonsense"])
    stats = C.with_rates(spark.createDataFrame([(6000, 3_000_000)], "sequences long, bases long"), 30).first()
    assert (stats.kseq_per_min, stats.mbp_per_min) == (12.0, 6.0)


def test_pairs_of_fasta_files_and_compressed_reads(spark, tmp_path):
    import bz2
    import gzip

    from strandlake.sources import sequences, tables

    (tmp_path / "a.fa").write_text(">x/1 d\nAC\nGT\n>y/1\nTT\n>z/1\nGG\n")
    (tmp_path / "b.fa").write_text(">x/2\nCC\n>y/2\nAA\n")
    read = lambda n: sequences.read_fasta(spark, str(tmp_path / n), number=True).withColumnRenamed("id", "read_id")
    got = [(r.rec_no, r.read_id, r.seq) for r in C.merge_pairs(read("a.fa"), read("b.fa"), check_names=True).orderBy("rec_no").collect()]
    assert got == [(0, "x", "ACGTNCC"), (1, "y", "TTNAA"), (2, "z", "GG")]
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(b"@r\nACG\n+\nIII\n"))
    (tmp_path / "c.fa.bz2").write_bytes(bz2.compress(b">r\nACG\n"))
    assert sequences.read_fastq(spark, str(tmp_path / "c.fq.gz")).first().seq == sequences.read_fasta(spark, str(tmp_path / "c.fa.bz2")).first().seq == "ACG"
    rows = spark.createDataFrame([("C", "r", 5, 3, "5:1", "ACG")], "status string, read_id string, taxid long, length long, hitlist string, seq string")
    for _ in range(2):
        tables.write_classification(rows, str(tmp_path / "out.gz"), append=True)
    assert [r.seq for r in tables.read_classification(spark, str(tmp_path / "out.gz"), sequence=True).collect()] == ["ACG", "ACG"]
    order = C.in_read_order(rows.select("read_id", "taxid"), spark.createDataFrame([("r", 3)], "read_id string, rec_no long"))
    assert order.columns == ["read_id", "taxid"] and order.count() == 1


MORE = ["lca_pairs", "db_shrink", "bin_index_offsets", "pseudo_taxids", "report_full_columns", "report_reduced_columns", "report_other_columns", "report_rank_lines", "report_from_counts", "confidence_lines", "classify_repeated_ids", "classify_calls_k31", "minimizer_bins_k31", "nt_subset", "lineage_above_species", "assembly_taxids", "assembly_map", "skipped_sequences", "grade_reads", "classify_chunked"]


@pytest.mark.parametrize("name", MORE)
def test_same_rows_as_sql_in_further_queries(spark, tables, name):
    test_same_rows_as_sql(spark, tables, name)
