"""Counts per taxon and clade, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.dna import code_columns, fixed_format, letters, lineage_name, rank_code
from strandlake.operators.tree import closure, paths_of

#: What a text report's columns show; several names mean the same.
COLUMNS = {
    name: column
    for column, names in {
        "name": "name", "name_indented": "indentedName taxName", "taxid": "taxID taxId", "rank": "taxRank rank", "depth": "depth", "pct": "cladePerc percReadsClade percent % percentage",
        "tax_reads": "numReadsTaxon taxReads reads_stay", "reads": "numReadsClade reads cladeReads reads_clade", "tax_kmers_total": "numKmersTaxon taxKmers", "kmers_total": "numKmersClade cladeKmers",
        "tax_kmers": "numUniqueKmersTaxon specificTaxKmers", "kmers": "numUniqueKmersClade kmers specificCladeKmers", "tax_kmers_db": "numKmersInDatabaseTaxon taxKmersDB taxKmersInDB",
        "kmers_db": "numKmersInDatabaseClade kmersDB cladeKmersInDB", "dup": "kmerDup dup", "cov": "kmerCov cov", None: "genomeSize totalHitLen totalScore abundance abundance_len",
    }.items()
    for name in names.split()
}
#: The columns of the usual report, of that with all k-mer counts, and of that without distinct k-mers.
USUAL = ["%", "reads", "taxReads", "kmers", "dup", "cov", "taxID", "rank", "taxName"]
FULL = ["%", "reads", "taxReads", "kmers", "taxKmers", "kmersDB", "taxKmersDB", "dup", "cov", "taxID", "rank", "taxName"]
REDUCED = ["%", "reads", "taxReads", "taxID", "rank", "taxName"]


def _codes(hits: DataFrame) -> list[str]:
    """The columns that tell k-mers apart. Hits of a lookup have integers, and lie by them, so counting by these moves nothing."""
    return [c for c in hits.columns if c.startswith("code")] or ["canon"]


def taxon_counts(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """(taxid, n_reads, n_kmers, n_unique): reads by call, k-mers by their own taxon, 0 for those without."""
    reads = calls.groupBy("taxid").agg(F.count("*").alias("n_reads"))
    # Each k-mer has one taxon, so distinct pairs give the unique counts and their sum the totals.
    pairs = hits.where("not ambig").groupBy(F.col("taxon").alias("taxid"), *_codes(hits)).agg(F.count("*").alias("n"))
    kmers = pairs.groupBy("taxid").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_unique"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return reads.join(kmers, "taxid", "full").select("taxid", zero("n_reads"), zero("n_kmers"), zero("n_unique"))


def taxon_sketches(hits: DataFrame, precision: int = 12, k: int | None = None) -> DataFrame:
    """(taxid, sketch) of distinct k-mers, mergeable. With ``k``, hits of a lookup are first made distinct by their integers, so
    that each k-mer is written as text, and sketched, once; the sketches are the same."""
    seen = hits.where("not ambig")
    if k is not None:
        seen = seen.select("taxon", *code_columns(k)).distinct().select("taxon", letters(k).alias("canon"))
    return seen.groupBy(F.col("taxon").alias("taxid")).agg(F.hll_sketch_agg("canon", precision).alias("sketch"))


def clade_sketches(sketches: DataFrame, tree: DataFrame) -> DataFrame:
    """(taxid, estimate): distinct k-mers of each clade, from the union of its sketches."""
    up = sketches.join(tree.select("taxid", "path"), "taxid", "left").select(F.explode(F.coalesce("path", F.array("taxid"))).alias("taxid"), "sketch")
    return up.groupBy("taxid").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def clade_counts(counts: DataFrame, tree: DataFrame, *sums: str) -> DataFrame:
    """Sums over each taxon's clade; taxid 0 has only itself. Unique k-mers may be summed as every k-mer has one taxon."""
    sums = sums or ("n_reads", "n_kmers", "n_unique")
    up = counts.join(tree.select("taxid", "path"), "taxid", "left").withColumn("up", F.explode(F.coalesce("path", F.array("taxid"))))
    return up.groupBy(F.col("up").alias("taxid")).agg(*[F.sum(c).alias(c) for c in sums])


def clade_unique_exact(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """(taxid, n_unique) by counting distinct k-mers of the union, for tables where a k-mer may have several taxa."""
    codes = _codes(hits)
    pairs = hits.where("not ambig").select(F.col("taxon").alias("taxid"), *codes).distinct()
    up = pairs.join(paths_of(tree, "taxid"), "taxid", "left").select(F.explode(F.coalesce("path", F.array("taxid"))).alias("taxid"), *codes).distinct()
    return up.groupBy("taxid").agg(F.count("*").alias("n_unique"))


def display_order(clades: DataFrame, tree: DataFrame, *by: str) -> DataFrame:
    """(taxid, ord): depth-first order with children by descending ``by``, then taxid; unclassified first."""
    node = clades.join(tree.select("taxid", "parent", "path"), "taxid", "left").withColumn("up", F.when(F.col("taxid") <= 1, -1).otherwise(F.col("parent")))
    rank = node.withColumn("r", F.row_number().over(Window.partitionBy("up").orderBy(*[F.desc(c) for c in by], "taxid"))).withColumn("r", F.when(F.col("taxid") == 0, 0).when(F.col("taxid") == 1, 1).otherwise(F.col("r")).cast("bigint"))
    steps = rank.select("taxid", F.posexplode(F.coalesce("path", F.array("taxid"))).alias("d", "ancestor")).join(rank.select(F.col("taxid").alias("ancestor"), "r"), "ancestor")
    sorts = steps.groupBy("taxid").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "r"))), lambda x: x["r"]).alias("sort"))
    return sorts.select("taxid", "sort", F.row_number().over(Window.orderBy("sort")).cast("bigint").alias("ord"))


def main_report(counts: DataFrame, tree: DataFrame, table_sizes: DataFrame, show_zeros: bool = False, all_columns: bool = False) -> DataFrame:
    """One row a taxon: pct, reads, tax_reads, kmers, dup, cov (clade values), taxid, rank, name, depth, ord; with
    ``all_columns`` also kmers_total, tax_kmers, tax_kmers_total, kmers_db and tax_kmers_db, which ``select_columns`` needs.

    pct is of all reads; dup is null without unique k-mers and cov is null where the table has none of the clade.
    """
    counts = counts.persist()  # a row a taxon, read five times below
    clades = clade_counts(counts, tree).persist()
    sizes = clade_counts(table_sizes.select(F.col("taxon").alias("taxid"), F.col("n_kmers").alias("kmers_db")), tree, "kmers_db")
    own = counts.select("taxid", F.col("n_reads").alias("tax_reads"), F.col("n_unique").alias("tax_kmers"), F.col("n_kmers").alias("tax_kmers_total"))
    total = clades.agg(F.sum(F.when(F.col("taxid").isin(0, 1), F.col("n_reads"))).alias("total"))
    rows = clades if show_zeros else clades.where("n_reads > 0")
    order = display_order(rows, tree, "n_reads", "n_kmers")
    full = rows.join(own, "taxid", "left").join(sizes, "taxid", "left").join(tree.select("taxid", "rank", "name", "depth"), "taxid", "left").join(order, "taxid").crossJoin(F.broadcast(total))  # total is one row
    if all_columns:
        full = full.join(table_sizes.select(F.col("taxon").alias("taxid"), F.col("n_kmers").alias("own_db")), "taxid", "left")
    return full.select(
        (F.lit(100.0) * F.col("n_reads") / F.col("total")).alias("pct"), F.col("n_reads").alias("reads"), F.coalesce("tax_reads", F.lit(0)).cast("bigint").alias("tax_reads"), F.col("n_unique").alias("kmers"),
        (F.col("n_kmers") / F.expr("nullif(n_unique, 0)")).alias("dup"), (F.col("n_unique") / F.expr("nullif(kmers_db, 0)")).alias("cov"), "taxid",
        F.coalesce("rank", F.lit("no rank")).alias("rank"), F.coalesce("name", F.lit("unclassified")).alias("name"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "ord",
        *([F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in (("n_kmers", "kmers_total"), ("tax_kmers", "tax_kmers"), ("tax_kmers_total", "tax_kmers_total"), ("kmers_db", "kmers_db"), ("own_db", "tax_kmers_db"))] if all_columns else []),
    )


def rank_report(calls: DataFrame, tree: DataFrame, show_zeros: bool = False) -> DataFrame:
    """Clade report from calls alone: pct, clade_reads, taxon_reads, rank_code, taxid, name (indented), ord."""
    return _ranked(calls.groupBy("taxid").agg(F.count("*").alias("taxon_reads")), tree, show_zeros)


def _ranked(own: DataFrame, tree: DataFrame, show_zeros: bool) -> DataFrame:
    own = own.persist()  # a row a taxon, read several times below
    if show_zeros:
        own = tree.select("taxid").join(own, "taxid", "full").select("taxid", F.coalesce("taxon_reads", F.lit(0)).alias("taxon_reads"))
    clades = clade_counts(own.withColumnRenamed("taxon_reads", "clade_reads"), tree, "clade_reads")
    total = own.agg(F.sum("taxon_reads").alias("total"))
    order = display_order(clades, tree, "clade_reads")
    full = clades.join(own, "taxid", "left").join(tree.select("taxid", "rank", "name", "depth"), "taxid", "left").join(order, "taxid").crossJoin(F.broadcast(total))  # total is one row
    name = F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0)).cast("int")), F.coalesce("name", F.lit("unclassified")))
    code = F.when(F.col("taxid") == 0, "U").otherwise(rank_code(F.coalesce("rank", F.lit(""))))
    return full.select((F.lit(100.0) * F.col("clade_reads") / F.col("total")).alias("pct"), "clade_reads", F.coalesce("taxon_reads", F.lit(0)).cast("bigint").alias("taxon_reads"), code.alias("rank_code"), "taxid", name.alias("name"), "ord")


def sample_report(calls: DataFrame, tree: DataFrame, samples: list[str], intermediate: bool = False, show_zeros: bool = False) -> DataFrame:
    """Clade reads by sample: lineage of rank-coded names, one column a sample."""
    up = calls.where("taxid <> 0").groupBy("sample", "taxid").agg(F.count("*").alias("n")).join(tree.select("taxid", "path"), "taxid").select("sample", "n", F.explode("path").alias("taxid"))
    table = up.groupBy("taxid").pivot("sample", samples).agg(F.sum("n"))
    if show_zeros:
        table = tree.select("taxid").join(table, "taxid", "left")
    names = tree.select(F.col("taxid").alias("ancestor"), rank_code(F.col("rank")).alias("code"), lineage_name(F.col("name")).alias("n")).where(F.col("ancestor") != 1)
    steps = closure(tree).join(names, "ancestor").where(F.lit(intermediate) | (F.col("code") != "-"))
    parts = steps.groupBy("taxid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), F.concat(F.lower("code"), F.lit("__"), F.col("n")).alias("t")))), lambda x: x["t"]), "|").alias("lineage"))
    shown = tree.where((F.col("taxid") != 1) & (F.lit(intermediate) | (rank_code(F.col("rank")) != "-"))).select("taxid")
    return table.join(shown, "taxid", "left_semi").join(parts, "taxid").select("lineage", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("bigint").alias(s) for s in samples])


def select_columns(report: DataFrame, names: list[str]) -> DataFrame:
    """Columns of a report with ``all_columns`` by the names that the text report uses; those that it knows but never fills are null."""
    unknown = [n for n in names if n not in COLUMNS]
    if unknown:
        raise ValueError(f"no such report columns: {', '.join(unknown)}")
    indented = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("name"))
    column = lambda c: F.lit(None).cast("double") if c is None else indented if c == "name_indented" else F.col(c)
    return report.select(*[column(COLUMNS[n]).alias(n) for n in names])


def counts_report(counts: DataFrame, tree: DataFrame, show_zeros: bool = False) -> DataFrame:
    """The clade report from (taxid, n_reads), as files of counts give them."""
    return _ranked(counts.groupBy("taxid").agg(F.sum("n_reads").alias("taxon_reads")), tree, show_zeros)


def rank_lines(report: DataFrame) -> DataFrame:
    """(ord, line): the clade report as text, percentages with two decimals."""
    return report.select("ord", F.concat_ws("\t", fixed_format(F.col("pct"), 2, 6), F.col("clade_reads").cast("string"), F.col("taxon_reads").cast("string"), "rank_code", F.col("taxid").cast("string"), "name").alias("line"))


def sample_lines(table: DataFrame, samples: list[str], header: bool = False) -> DataFrame:
    """(ord, line): the sample report as text, by lineage; with ``header`` a first line names the samples."""
    rows = table.select(F.lit(1).alias("ord"), F.concat_ws("\t", "lineage", *[F.col(f"`{s}`").cast("string") for s in samples]).alias("line"))
    if not header:
        return rows
    return table.sparkSession.createDataFrame([(0, "\t".join(["#Sample", *samples]))], "ord int, line string").unionByName(rows)
