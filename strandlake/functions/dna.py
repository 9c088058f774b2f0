"""DNA and k-mer columns, from built-in functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: XOR mask that scrambles the order of minimizers.
SCRAMBLE = 0xE37E28C4271B5A2D
#: Bases of a slice of a long sequence; a task never holds more k-mers of one row than this.
SLICE = 2048


def tidy(seq: Column) -> Column:
    """Upper case, without line ends; letters beyond ASCII become N, so that bytes are letters."""
    plain = F.when(F.length(seq) == F.octet_length(seq), seq).otherwise(F.regexp_replace(seq, "[^\\x00-\\x7F]", "N"))
    return F.upper(F.translate(plain, "\r\n", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; letters sort as their codes do."""
    return F.least(kmer, reverse_complement(kmer))


def is_ambiguous(kmer: Column) -> Column:
    return F.length(F.translate(kmer, "ACGT", "")) > 0


def encode(kmer: Column) -> Column:
    """Two bits a base, A C G T = 0 1 2 3, first base highest; up to 31 bases stay positive."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def minimizer(kmer: Column, k: int, m: int, scrambled: bool = True) -> Column:
    """Least scrambled code of the canonical m-mers; the bin of a k-mer.

    Both strands are encoded once, and m-mers cut from the codes: the i-th of one strand is the complement of the i-th last
    of the other.
    """
    mask = F.lit(SCRAMBLE & (4**m - 1) if scrambled else 0).cast("bigint")
    low = F.lit(4**m - 1).cast("bigint")
    least = lambda codes: F.least(*[c.bitwiseXOR(mask) for c in codes]) if k > m else codes[0].bitwiseXOR(mask)
    if k > 31:  # beyond a bigint
        return least([encode(canonical(F.substring(kmer, i + 1, m))) for i in range(k - m + 1)])
    either = lambda x, i: F.least(F.shiftright(x["a"], 2 * (k - m - i)).bitwiseAND(low), F.shiftright(x["b"], 2 * i).bitwiseAND(low))
    strands = F.struct(encode(kmer).alias("a"), encode(reverse_complement(kmer)).alias("b"))
    # Of an array of one, as the codes would be computed for each m-mer otherwise.
    return F.get(F.transform(F.array(strands), lambda x: least([either(x, i) for i in range(k - m + 1)])), F.lit(0))


def hard_mask(seq: Column) -> Column:
    """Everything but A, C, G, T, lower case included, becomes N."""
    return F.regexp_replace(seq, "[^AGCT]", "N")


def _slices(df: DataFrame, k: int, seq: str, keep: tuple[str, ...]) -> DataFrame:
    """keep, ``__at``, ``__f``: long sequences cut, by byte offset, into slices that overlap by k - 1, so that no row carries a
    chromosome into the explosion; sequences shorter than k have none."""
    n = F.octet_length("__s")
    return (
        df.select(*keep, F.encode(tidy(F.col(seq)), "UTF-8").alias("__s")).where(n >= k)
        .withColumn("__at", F.explode(F.sequence(F.lit(0), n - k, F.lit(SLICE))))
        .select(*keep, "__at", F.decode(F.substring(F.col("__s"), F.col("__at") + 1, F.lit(SLICE + k - 1)), "UTF-8").alias("__f"))
    )


def with_kmers(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """keep, ``pos`` (from 0), ``kmer``, ``canon``, ``ambig`` for every window; sequences shorter than k have none.

    What can be done for a slice isn't done for its windows: the reverse complement, and marking other letters.
    """
    length = F.col("__l")
    windows = _slices(df, k, seq, keep).withColumn("__l", F.length("__f")).withColumn("__r", reverse_complement(F.col("__f"))).withColumn("__n", F.regexp_replace("__f", "[^ACGT]", "N")).withColumn("__i", F.explode(F.sequence(F.lit(0), length - k)))
    cut = lambda c: F.substring(F.col(c), F.col("__i") + 1, F.lit(k))
    mirror = F.substring(F.col("__r"), length - F.col("__i") - k + 1, F.lit(k))
    return windows.select(*keep, (F.col("__at") + F.col("__i")).cast("bigint").alias("pos"), cut("__f").alias("kmer"), F.least(cut("__f"), mirror).alias("canon"), cut("__n").contains("N").alias("ambig"))


#: Letters in one column of a k-mer's code; a digit each, read as a decimal number, they stay below 2^63.
PART = 18


def code_columns(k: int) -> list[str]:
    return [f"code{i}" for i in range(-(-k // PART))]


def codes(kmer: Column, k: int, digits: bool = False) -> list[Column]:
    """A k-mer as integers, by ``code_columns``: its letters as digits 0 to 3, read as decimal numbers, which is cheaper than
    changing their base. They sort as the letters do; null where a part has other letters. ``digits``: it is translated already."""
    d = kmer if digits else F.translate(F.regexp_replace(kmer, "[^ACGT]", "N"), "ACGT", "0123")
    return [(d if k <= PART else F.substring(d, PART * i + 1, min(PART, k - PART * i))).try_cast("bigint") for i in range(len(code_columns(k)))]


def letters(k: int) -> Column:
    """The k-mer of ``code_columns``."""
    return F.translate(F.concat(*[F.lpad(F.col(c).cast("string"), min(PART, k - PART * i), "0") for i, c in enumerate(code_columns(k))]), "0123", "ACGT")


def with_codes(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """keep, ``pos`` and the codes of the canonical k-mer for every window. Ambiguous windows have one of 8,192 negative numbers
    that no k-mer has as first code: a null or one number for all would send them to one partition of a shuffled join."""
    length, names = F.col("__l"), code_columns(k)
    digits = F.translate(F.regexp_replace("__f", "[^ACGT]", "N"), "ACGT", "0123")
    windows = _slices(df, k, seq, keep).select(*keep, "__at", digits.alias("__d"), F.length("__f").alias("__l")).withColumn("__r", F.reverse(F.translate("__d", "0123", "3210"))).withColumn("__i", F.explode(F.sequence(F.lit(0), length - k)))
    canon = F.least(F.substring(F.col("__d"), F.col("__i") + 1, F.lit(k)), F.substring(F.col("__r"), length - F.col("__i") - k + 1, F.lit(k)))
    none = -1 - F.pmod(F.xxhash64(*keep, (F.col("__at") + F.col("__i")).cast("bigint")), F.lit(8192))
    each = windows.select(*keep, (F.col("__at") + F.col("__i")).cast("bigint").alias("pos"), *[c.alias(n) for c, n in zip(codes(canon, k, digits=True), names)], none.alias("__x"))
    if len(names) == 1:
        return each.select(*keep, "pos", F.coalesce(names[0], "__x").alias(names[0]))
    whole = reduce(Column.__and__, [F.col(n).isNotNull() for n in names])
    return each.select(*keep, "pos", F.when(whole, F.col(names[0])).otherwise(F.col("__x")).alias(names[0]), *[F.when(whole, F.col(n)).otherwise(F.lit(0)).alias(n) for n in names[1:]])


def window_counts(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """keep, ``windows``, ``ambiguous``: numbers of windows of each sequence that has any. Nothing is exploded: a run of n
    letters A, C, G, T has n - k + 1 of the windows that aren't ambiguous."""
    runs = F.regexp_extract_all("__s", F.lit(f"([ACGT]{{{k},}})"), F.lit(1))
    clear = F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, r: s + F.octet_length(r) - (k - 1))
    sized = df.select(*keep, tidy(F.col(seq)).alias("__s")).where(F.octet_length("__s") >= k)
    whole = (F.octet_length("__s") - (k - 1)).cast("bigint")
    return sized.select(*keep, whole.alias("windows"), (whole - clear).alias("ambiguous"))


def parse_size(text: str) -> int:
    """'8G' -> bytes; k, m, g in either case; 0 if it is no size."""
    found = re.fullmatch(r"(\d+)([kKmMgG]?)", text.strip())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2].lower()] if found else 0


def strip_mate(name: Column, underscore: bool = False) -> Column:
    """Read name without its mate suffix; only merging also takes ``_1`` and ``_2``."""
    return F.regexp_replace(name, "[/_.][12]$" if underscore else "[/.][12]$", "")


def strip_version(name: Column) -> Column:
    return F.regexp_replace(name, "\\.\\d*$", "")


def prefixed_taxid(name: Column) -> Column:
    """N of ids such as ``tool:taxid|N|...``; null for others."""
    found = F.regexp_extract(name, "^\\w+:taxid\\|(\\d+)", 1)
    return F.when(found != "", found.cast("bigint"))


def file_name(name: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "_+", "_"), F.lit(100))


def lineage_name(name: Column) -> Column:
    """Names inside lineages: no separators, no blanks."""
    return F.translate(F.translate(name, "|.", ""), " ", "_")


def rank_code(rank: Column) -> Column:
    codes = {"superkingdom": "D", "kingdom": "K", "phylum": "P", "class": "C", "order": "O", "family": "F", "genus": "G", "species": "S"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[rank], F.lit("-"))


def fixed_format(x: Column, decimals: int, width: int = 0) -> Column:
    """A double with that many decimals, as C prints it: exact halves go to the even digit."""
    scaled = x * float(1 << (decimals + 1))
    half = (scaled == F.floor(scaled)) & (F.pmod(scaled, F.lit(2.0)) == 1)
    return F.format_string(f"%{width or ''}.{decimals}f", F.when(half, F.bround(x, decimals)).otherwise(x))


def general_format(x: Column, digits: int) -> Column:
    """A double with that many significant digits and no trailing zeros, for text output."""
    plain = F.format_string(f"%.{digits}g", x)
    return F.when(plain.contains("e") | ~plain.contains("."), plain).otherwise(F.regexp_replace(plain, "\\.?0+$", ""))
