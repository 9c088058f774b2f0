"""The k-mer table: building it from genomes, its variants, its upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import tree as T
from strandlake.operators.ranges import intervals, placed, running

#: Leading bases of a k-mer that deal a table into ranges.
PREFIX = 6

#: Synthetic vector sequence and plasmid: a k-mer of these always means contamination.
CONTAMINANTS = (32630, 81077)


def genome_kmers(genomes: DataFrame, k: int, min_length: int = 0) -> DataFrame:
    """(kmer, taxid, tier, ord) of unambiguous canonical k-mers, with repeats."""
    long = genomes.where(F.length("seq") >= min_length)
    return dna.with_kmers(long, k, keep=("taxid", "tier", "ord")).where("not ambig").select(F.col("canon").alias("kmer"), "taxid", "tier", "ord")


def build_lca(kmers: DataFrame, tree: DataFrame) -> DataFrame:
    """(kmer, taxon): LCA of the taxa that have the k-mer; taxa outside the taxonomy are left out."""
    return T.lca_by(kmers, ["kmer"], tree)


def build_lca_contaminant(kmers: DataFrame, tree: DataFrame, contaminants: tuple[int, ...] = CONTAMINANTS) -> DataFrame:
    """As ``build_lca``, but a k-mer of a contaminant gets the first contaminant in library order."""
    dirty = F.col("taxid").isin(*contaminants)
    ends = kmers.join(tree.select("taxid", "pre"), "taxid").groupBy("kmer").agg(F.min_by(F.when(dirty, F.col("taxid")), F.when(dirty, F.col("ord"))).alias("c"), F.min("pre").alias("__lo"), F.max("pre").alias("__hi"))
    return T.lca_of_ends(ends, tree, "l").select("kmer", F.coalesce("c", "l").alias("taxon"))


def build_lca_tiers(kmers: DataFrame, tree: DataFrame) -> DataFrame:
    """LCA over the lowest tier that has the k-mer."""
    ends = kmers.join(tree.select("taxid", "pre"), "taxid").groupBy("kmer", "tier").agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    first = ends.groupBy("kmer").agg(F.min_by(F.struct("lo", "hi"), "tier").alias("x")).select("kmer", F.col("x.lo").alias("__lo"), F.col("x.hi").alias("__hi"))
    return T.lca_of_ends(first, tree, "taxon")


def build_sets(kmers: DataFrame) -> DataFrame:
    """(kmer, taxids): all taxa with the k-mer, ascending."""
    return kmers.groupBy("kmer").agg(F.array_sort(F.collect_set("taxid")).alias("taxids"))


def reset_taxa(table: DataFrame, kmers: DataFrame) -> DataFrame:
    """k-mers of the given sequences get taxon 0."""
    hit = kmers.select("kmer").distinct().withColumn("hit", F.lit(True))
    return table.join(hit, "kmer", "left").select("kmer", F.when(F.col("hit"), F.lit(0)).otherwise(F.col("taxon")).cast("bigint").alias("taxon"))


def check_covered(table: DataFrame, kmers: DataFrame) -> DataFrame:
    """k-mers that the table lacks; an error for the caller unless it allows them."""
    return kmers.select("kmer").distinct().join(table, "kmer", "left_anti")


def require_covered(table: DataFrame, kmers: DataFrame, allow: bool = False) -> int:
    """The number of distinct k-mers that the table lacks; any is an error unless allowed."""
    missing = check_covered(table, kmers).count()
    if missing and not allow:
        raise ValueError(f"{missing} k-mers are not in the database")
    return missing


def rewrite(table: DataFrame, path: str) -> None:
    """Replace the database at ``path``, from which the table may be read itself: the new one is written whole beside it first."""
    spark = table.sparkSession
    draft, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    table.write.parquet(draft)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    if not fs.rename(hadoop(draft), hadoop(path)):
        raise OSError(f"can't move the new database to {path}")
    fs.delete(hadoop(old), True)
    spark.catalog.refreshByPath(path)


def sample(table: DataFrame, share: float, seed: int = 0, key: str = "kmer") -> DataFrame:
    """Each row with probability ``share``, decided by a hash of its key, so it is the same in every run and layout."""
    return table.where(F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53) < share)


def taxon_sizes(table: DataFrame) -> DataFrame:
    return table.groupBy("taxon").agg(F.count("*").alias("n_kmers"))


def clade_sizes(sizes: DataFrame, tree: DataFrame) -> DataFrame:
    """(taxid, genome_size, size_of_children) over the tree."""
    up = sizes.join(tree.select(F.col("taxid").alias("taxon"), "path"), "taxon").select("taxon", "n_kmers", F.explode("path").alias("taxid"))
    own = F.sum(F.when(F.col("taxid") == F.col("taxon"), F.col("n_kmers")).otherwise(0))
    return up.groupBy("taxid").agg(own.alias("genome_size"), (F.sum("n_kmers") - own).alias("size_of_children"))


def with_bins(table: DataFrame, k: int, m: int) -> DataFrame:
    return table.withColumn("bin", dna.minimizer(F.col("kmer"), k, m))


def sorted_by_bin(table: DataFrame, k: int, m: int) -> DataFrame:
    """Range partitions of bins, sorted inside: files whose statistics prune by bin."""
    return with_bins(table, k, m).repartitionByRange("bin", "kmer").sortWithinPartitions("bin", "kmer")


def bin_index(table: DataFrame, k: int, m: int) -> DataFrame:
    """(bin, n, offset): rows of each bin and rows before it."""
    counts = with_bins(table, k, m).groupBy("bin").agg(F.count("*").alias("n")).persist()  # a row a bin; the running total reads it twice
    return running(counts, intervals("bin", 0, 4**m - 1), ["bin"], F.col("n"), "offset").select("bin", "n", "offset")


def shrink(table: DataFrame, rows: int, offset: int = 1) -> DataFrame:
    """A systematic sample: the table in k-mer order in ``rows`` blocks, the ``offset``-th last row of each."""
    total = table.agg(F.count("*").alias("total"))  # one row
    at = placed(table, F.left("kmer", F.lit(PREFIX)), ["kmer"], "at").crossJoin(F.broadcast(total))
    small, longer = F.floor(F.col("total") / rows), F.pmod("total", F.lit(rows))
    # The first ``longer`` blocks have a row more.
    head = longer * (small + 1)
    end = F.when(F.col("at") < head, (F.floor(F.col("at") / (small + 1)) + 1) * (small + 1)).otherwise(head + (F.floor((F.col("at") - head) / F.greatest(small, F.lit(1))) + 1) * small)
    size = F.when(F.col("at") < head, small + 1).otherwise(small)
    return at.where((F.col("at") == end - offset) & (size >= offset)).select("kmer", "taxon")


def chunk_bounds(index: DataFrame, chunks: int) -> DataFrame:
    """(chunk, lo, hi): bin ranges of about equal numbers of k-mers."""
    whole = index.agg(F.max(F.col("offset") + F.col("n")).alias("all"))
    through = F.col("offset") + F.col("n") - 1
    dealt = index.crossJoin(F.broadcast(whole)).withColumn("chunk", F.least(F.floor(through * chunks / F.col("all")), F.lit(chunks - 1)).cast("bigint"))  # whole is one row
    return dealt.groupBy("chunk").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))


def rows_for_size(size_bytes: int, k: int, index_bytes: int = 0) -> int:
    """Rows that fit a size: ceil(2k/8) bytes of key and 4 of value each."""
    return max(0, (size_bytes - index_bytes) // ((2 * k + 7) // 8 + 4))


def resolve_sequence_ids(sequences: DataFrame, seqmap: DataFrame) -> DataFrame:
    """(seq_id, taxid): by the id, else by the id without its version, else from a taxid in the id itself; else null."""
    first = first_mapping(seqmap).select(F.col("seq_id").alias("key"), F.col("taxid").alias("t"))
    one = sequences.join(first.withColumnRenamed("t", "t1"), F.col("seq_id") == F.col("key"), "left").drop("key")
    two = one.join(first.withColumnRenamed("t", "t2"), dna.strip_version(F.col("seq_id")) == F.col("key"), "left").drop("key")
    return two.select("seq_id", F.coalesce("t1", "t2", dna.prefixed_taxid(F.col("seq_id"))).alias("taxid"))


def first_mapping(seqmap: DataFrame) -> DataFrame:
    """(seq_id, taxid, name): the first line of each id wins."""
    return seqmap.groupBy("seq_id").agg(F.min_by(F.struct("taxid", "name"), "line_no").alias("x")).select("seq_id", "x.taxid", "x.name")


def usable_sequences(sequences: DataFrame, tree: DataFrame, min_length: int = 0) -> DataFrame:
    """Sequences that aren't empty, have a taxid in the taxonomy, and are long enough."""
    return sequences.where((F.length("seq") > 0) & F.col("taxid").isNotNull() & (F.length("seq") >= min_length)).join(tree.select("taxid"), "taxid", "left_semi")


def skipped_sequences(sequences: DataFrame, tree: DataFrame, min_length: int = 0) -> DataFrame:
    """(reason, n): why sequences aren't used; the first reason that holds counts."""
    known = sequences.join(tree.select("taxid", F.lit(True).alias("known")), "taxid", "left")
    length = F.coalesce(F.length("seq"), F.lit(0))
    reason = F.when(length == 0, "empty").when(F.col("taxid").isNull(), "no taxid").when(F.col("known").isNull(), "taxid not in taxonomy").when(length < min_length, "too short")
    return known.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def accession_subset(sequences: DataFrame, accessions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(accession_version, taxid, and the sequences' other columns): sequences named by an accession with its version that the
    map gives an accepted taxon. Sequences have ``id``; a version mapped twice to one taxon counts once."""
    wanted = accessions.where("taxid is not null").join(accepted.select("taxid"), "taxid", "left_semi").select(F.col("accession_version").alias("id"), "taxid").distinct()
    return sequences.join(wanted, "id").withColumnRenamed("id", "accession_version")


def filter_assemblies(summary: DataFrame, level: str | None = None, category: str | None = None, **equal: str) -> DataFrame:
    """Latest assemblies by level, category and any column's value; the first line of an accession."""
    rows = summary.where(F.col("version_status") == "latest")
    for column, value in {"assembly_level": level, "refseq_category": category, **equal}.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rest = [c for c in rows.columns if c != "assembly_accession"]
    return rows.groupBy("assembly_accession").agg(F.min_by(F.struct(*rest), "line_no").alias("x")).select("assembly_accession", *[f"x.{c}" for c in rest])
