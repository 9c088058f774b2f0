"""Taxonomy dumps, id maps, counts, classification rows and their writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSEMBLY_COLUMNS = ["assembly_accession", "bioproject", "biosample", "wgs_master", "refseq_category", "taxid", "species_taxid", "organism_name", "infraspecific_name", "isolate", "version_status", "assembly_level", "release_type", "genome_rep", "seq_rel_date", "asm_name", "submitter", "gbrs_paired_asm", "paired_asm_comp", "ftp_path", "excluded_from_refseq", "relation_to_type_material"]
CLASSIFICATION = "status string, read_id string, taxid bigint, length bigint, hitlist string"


def _dump(spark: SparkSession, path: str):
    return spark.read.text(path).select(F.split(F.regexp_replace("value", "\\t\\|$", ""), "\\t\\|\\t").alias("f"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _dump(spark, path).select(f[0].cast("bigint").alias("taxid"), f[1].cast("bigint").alias("parent"), f[2].alias("rank"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _dump(spark, path).where(f[3] == "scientific name").select(f[0].cast("bigint").alias("taxid"), f[1].alias("name"))


def read_taxonomy_dumps(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(taxid, parent, name, rank); the root's parent is 0."""
    both = read_nodes(spark, nodes).join(read_names(spark, names), "taxid", "left")
    return both.select("taxid", F.when(F.col("taxid") == 1, F.lit(0)).otherwise(F.col("parent")).cast("bigint").alias("parent"), F.coalesce("name", F.lit("")).alias("name"), "rank")


def read_taxdb(spark: SparkSession, path: str, unclassified: bool = False) -> DataFrame:
    """(taxid, parent, name, rank[, genome_size, genome_size_children]): columns in this order; fails on a node that is its own parent.

    With ``unclassified`` a row of taxid 0 is added where there is none.
    """
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path)
    names = ["taxid", "parent", "name", "rank", "genome_size", "genome_size_children"][: len(raw.columns)]
    t = raw.toDF(*names)
    for c in names:
        if c not in ("name", "rank"):
            t = t.withColumn(c, F.col(c).cast("bigint"))
    t = t.withColumn("parent", F.when(F.col("taxid") == 1, F.lit(0).cast("bigint")).otherwise(F.col("parent")))
    if unclassified and t.where("taxid = 0").isEmpty():
        text = {"name": "unclassified", "rank": "no rank"}
        t = t.unionByName(spark.range(1).select(*[(F.lit(text[c]) if c in text else F.lit(0).cast("bigint")).alias(c) for c in names]))
    return t.where(F.coalesce(F.assert_true((F.col("taxid") <= 1) | (F.col("taxid") != F.col("parent")), "a taxon is its own parent").isNull(), F.lit(True)))


def read_seqmap(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(seq_id, taxid, name, line_no) of one map, or of all *.map below a folder."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.map")
    f = F.split("value", "\t")
    return reader.text(paths).withColumn("line_no", F.monotonically_increasing_id()).select(f[0].alias("seq_id"), F.get(f, F.lit(1)).cast("bigint").alias("taxid"), F.get(f, F.lit(2)).alias("name"), "line_no").where("seq_id <> ''")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("taxon bigint, n_kmers bigint").option("sep", "\t").csv(path)


def read_classification(spark: SparkSession, path: str, sequence: bool = False) -> DataFrame:
    """Classification rows, with ``sequence`` those that have a sixth column with it."""
    return spark.read.schema(CLASSIFICATION + ", seq string" * sequence).option("sep", "\t").option("quote", "").csv(path)


def read_assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    return lines.select(*[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(ASSEMBLY_COLUMNS)], "line_no").withColumn("taxid", F.col("taxid").cast("bigint"))


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """accession2taxid, with its header line."""
    return spark.read.schema("accession string, accession_version string, taxid bigint, gi bigint").option("sep", "\t").option("header", "true").csv(path)


def read_taxon_counts(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, n_reads) from lines of taxid and count, or of taxids alone."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(f[0].cast("bigint").alias("taxid"), F.coalesce(F.get(f, F.lit(1)).cast("bigint"), F.lit(1)).alias("n")).groupBy("taxid").agg(F.sum("n").alias("n_reads"))


def find_database(name: str, environ: dict[str, str] | None = None, default: str = "STRANDLAKE_DEFAULT_DB", search: str = "STRANDLAKE_DB_PATH") -> str:
    """A database folder by name: as a path, else in the search path; without a name the default."""
    env = os.environ if environ is None else environ
    name = name or env.get(default, "")
    if not name:
        raise ValueError("no database given and no default set")
    for folder in ["", *env.get(search, ".").split(":")] if "/" not in name else [""]:
        if os.path.isdir(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(name)


def _write(df: DataFrame, path: str, header: bool = False, append: bool = False) -> None:
    gz = {"compression": "gzip"} if path.endswith(".gz") else {}
    df.write.mode("append" if append else "overwrite").options(sep="\t", header=str(header).lower(), quote="", emptyValue="", **gz).csv(path)


def write_classification(rows: DataFrame, path: str, append: bool = False) -> None:
    """Nothing is written where the path is 'off'; with ``append`` files are added to those there."""
    if path != "off":
        _write(rows, path, append=append)


def write_taxdb(taxonomy: DataFrame, path: str) -> None:
    """Sorted by taxid; the root is written as its own parent."""
    cols = ["taxid", "parent", "name", "rank", *[c for c in ("genome_size", "genome_size_children") if c in taxonomy.columns]]
    _write(taxonomy.withColumn("parent", F.when(F.col("taxid") == 1, F.lit(1).cast("bigint")).otherwise(F.col("parent"))).select(cols).orderBy("taxid"), path)


def write_dumps(taxonomy: DataFrame, nodes: str, names: str) -> None:
    end = F.lit("\t|")
    parent = F.when(F.col("taxid") == 1, F.lit(1)).otherwise(F.col("parent"))
    taxonomy.orderBy("taxid").select(F.concat(F.concat_ws("\t|\t", F.col("taxid").cast("string"), parent.cast("string"), "rank"), end)).write.mode("overwrite").text(nodes)
    taxonomy.orderBy("taxid").select(F.concat(F.concat_ws("\t|\t", F.col("taxid").cast("string"), "name", F.lit(""), F.lit("scientific name")), end)).write.mode("overwrite").text(names)


def write_counts(sizes: DataFrame, path: str) -> None:
    _write(sizes.select("taxon", "n_kmers").orderBy("taxon"), path)


def write_seqmap(seqmap: DataFrame, path: str) -> None:
    _write(seqmap.select("seq_id", "taxid", "name"), path)


def write_kmers(table: DataFrame, path: str, k: int) -> None:
    """k-mers as decimal codes, one a line."""
    from strandlake.functions.dna import encode

    table.select(encode(F.col("kmer")).cast("string")).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str, preamble: list[str] | None = None) -> None:
    """The report as text, in display order, after comment lines; one file, as a report has one row a taxon."""
    from strandlake.functions.dna import general_format

    name = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), "name")
    text = lambda c: F.coalesce(c, F.lit("NA"))
    line = F.concat_ws("\t", general_format(F.col("pct"), 4), "reads", "tax_reads", "kmers", text(general_format(F.col("dup"), 3)), text(general_format(F.col("cov"), 4)), "taxid", "rank", name)
    spark = report.sparkSession
    head = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(reversed([*[f"# {p}" for p in preamble or []], "\t".join(["%", "reads", "taxReads", "kmers", "dup", "cov", "taxID", "rank", "taxName"])]))], "ord bigint, value string")
    head.unionByName(report.select("ord", line.alias("value"))).repartition(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)
