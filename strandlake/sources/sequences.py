"""FASTA and FASTQ; .gz and .bz2 are read by their extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENOME_FILES = "*.{fna,fa,ffn,fasta,fsa,FNA,FA,FFN,FASTA,FSA}"


def _id(header: Column) -> Column:
    return F.regexp_extract(header, "^(\\S*)", 1)


def numbered(df: DataFrame, out: str = "rec_no") -> DataFrame:
    """Rows numbered from 0 in file order, without a global sort: partition sizes first, then offsets.

    Right for one file, whose splits are in order; the number of sizes is that of partitions.
    """
    marked = df.withColumn("__m", F.monotonically_increasing_id())
    part, at = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__p")).count()
    starts = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("__s"))  # a row a partition
    return marked.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn(out, (F.col("__s") + at).cast("bigint")).drop("__m", "__p", "__s")


def read_fasta(spark: SparkSession, path: str | list[str], recursive: bool = False, number: bool = False) -> DataFrame:
    """(file, id, header_line, seq): records split at line-start '>', so large files are read in parallel.

    Lines of a sequence are joined; empty sequences stay. With ``number`` records of one file also get ``rec_no`` in its order,
    by which files of mates are put together.
    """
    reader = spark.read.option("lineSep", "\n>")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", GENOME_FILES)
    raw = reader.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("t"))
    header = F.regexp_replace(F.substring_index("t", "\n", 1), "\r$", "")
    body = F.when(F.instr("t", "\n") > 0, F.expr("substring(t, instr(t, '\\n') + 1)")).otherwise("")
    rows = raw.where("t <> ''").select("file", _id(header).alias("id"), header.alias("header_line"), F.translate(body, "\r\n \t", "").alias("seq"))
    return numbered(rows) if number else rows


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, id, header_line, seq, quals) of one file of strict four-line records; it ends at the first that isn't one."""
    lines = numbered(spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")), "n")
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    records = lines.groupBy(F.floor(F.col("n") / 4).alias("rec_no")).agg(line(0).alias("h"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("quals"))
    sound = F.coalesce(F.col("h").startswith("@") & (F.col("seq") != "") & F.col("plus").startswith("+") & (F.col("quals") != ""), F.lit(False))
    stop = records.agg(F.min(F.when(~sound, F.col("rec_no"))).alias("stop"))
    header = F.substring(F.col("h"), 2, 1 << 30)
    return records.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("rec_no") < F.col("stop"))).select("rec_no", _id(header).alias("id"), header.alias("header_line"), "seq", "quals")  # stop is one row


def sniff(spark: SparkSession, path: str) -> str:
    """'fastq' if the file's first character is @, else 'fasta'."""
    first = spark.read.text(path).limit(1).collect()
    return "fastq" if first and first[0].value.startswith("@") else "fasta"


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(id, header_line, seq, quals) of either format."""
    if sniff(spark, path) == "fastq":
        return read_fastq(spark, path).select("id", "header_line", "seq", "quals")
    return read_fasta(spark, path).select("id", "header_line", "seq", F.lit(None).cast("string").alias("quals"))


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """(id, header_line, seq) of EMBL flat files: accession, description and sequence lines."""
    entries = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").contains("\nSQ "))
    description = F.array_join(F.regexp_extract_all("value", F.lit("(?m)^DE   (.*)$"), F.lit(1)), " ")
    accession = F.regexp_extract("value", "(?m)^AC   ([^;\\s]+)", 1)
    body = F.regexp_extract("value", "(?s)\\nSQ [^\\n]*\\n(.*)$", 1)
    return entries.select(accession.alias("id"), F.concat_ws(" ", accession, description).alias("header_line"), F.upper(F.regexp_replace(body, "[^A-Za-z]", "")).alias("seq"))


def _lines(df: DataFrame, text: Column, path: str, append: bool = False) -> None:
    options = {"compression": "gzip"} if path.endswith(".gz") else {}
    df.select(text.alias("value")).write.mode("append" if append else "overwrite").options(**options).text(path)


def write_fasta(df: DataFrame, path: str, append: bool = False) -> None:
    _lines(df, F.concat(F.lit(">"), F.coalesce("header_line", F.lit("")), F.lit("\n"), F.coalesce("seq", F.lit(""))), path, append)


def write_fastq(df: DataFrame, path: str, append: bool = False) -> None:
    _lines(df, F.concat(F.lit("@"), "header_line", F.lit("\n"), "seq", F.lit("\n+\n"), "quals"), path, append)


def write_sequences(df: DataFrame, path: str, fmt: str, append: bool = False) -> None:
    (write_fastq if fmt == "fastq" else write_fasta)(df, path, append)
