"""What follows classification: confidence filter, lineages of reads, extraction, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import fixed_format, strip_mate
from strandlake.operators.classify import let
from strandlake.operators.tree import RANKS, at_rank, closure, descendants, lca_pairs, lineages, paths_of


def at_ranks(tree: DataFrame, ranks: list[str]) -> DataFrame:
    """(taxid, at): for each rank the nearest self or ancestor of it, root excluded; else 0. One table of a row a taxon."""
    ranked = tree.where(F.col("rank").isin(ranks) & (F.col("taxid") != 1)).select(F.col("taxid").alias("ancestor"), F.col("rank").alias("r"))
    best = closure(tree).join(ranked, "ancestor").groupBy("taxid").agg(*[F.min_by(F.when(F.col("r") == r, F.col("ancestor")), F.when(F.col("r") == r, F.col("dist"))).alias(f"a{i}") for i, r in enumerate(ranks)])
    return tree.select("taxid").join(best, "taxid", "left").select("taxid", F.array(*[F.coalesce(f"a{i}", F.lit(0)).cast("bigint") for i in range(len(ranks))]).alias("at"))


def confidence_filter(classified: DataFrame, tree: DataFrame, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(read_id, taxid, p) and the rows' columns ``carry``: each call climbs until the share of unambiguous k-mers at or below it
    reaches the threshold.

    The climb ends at the root, with the share of the node below it; root and unclassified calls stay, with p = 0. Each row is
    filtered by its own hit list, in one pass; rows that lie by a column ``record`` (see ``classify``) aren't moved for it.
    """
    key = "record" if "record" in classified.columns else "__r"
    rows = classified if key == "record" else classified.withColumn(key, F.monotonically_increasing_id())
    kept = [c for c in dict.fromkeys(("read_id", "taxid", *carry)) if c != key]
    parts = F.transform(F.filter(F.split("hitlist", " "), lambda x: ~x.startswith("A:")), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("bigint").alias("code"), F.split_part(x, F.lit(":"), F.lit(2)).cast("bigint").alias("n")))
    codes = rows.select(key, *kept, F.explode_outer(parts).alias("x")).select(key, *kept, "x.code", "x.n")
    paths = codes.join(F.broadcast(tree.select(F.col("taxid").alias("code"), F.col("path").alias("p"))), "code", "left")  # as paths_of
    per_read = paths.groupBy(key).agg(*[F.first(c).alias(c) for c in kept], F.sum("n").alias("total"), F.collect_list(F.when(F.col("p").isNotNull(), F.struct("n", "p"))).alias("h"))
    called = per_read.join(paths_of(tree, "taxid"), "taxid", "left")
    below = lambda t: F.aggregate("h", F.lit(0).cast("bigint"), lambda s, u: s + F.when(F.array_contains(u["p"], t), u["n"]).otherwise(0))
    climb = F.transform(F.reverse(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))), lambda t: F.struct(t.alias("t"), (below(t) / F.col("total")).alias("p")))

    def found(steps):
        passed = F.try_element_at(F.filter(steps, lambda x: x["p"] >= threshold - 1e-5), F.lit(1))
        return F.struct(F.coalesce(passed["t"], F.lit(1)).cast("bigint").alias("taxid"), F.coalesce(passed["p"], F.try_element_at(steps, F.lit(-1))["p"], F.lit(0.0)).alias("p"))

    end = called.withColumn("end", F.when((F.col("taxid") > 1) & F.col("path").isNotNull(), let(climb, found)))
    return end.select("read_id", F.coalesce("end.taxid", "taxid").cast("bigint").alias("taxid"), F.coalesce("end.p", F.lit(0.0)).alias("p"), *carry)


def filter_lines(filtered: DataFrame) -> DataFrame:
    """(read_id, line) of filtered rows with ``length`` and ``hitlist``: the filter's output as text, the share with three decimals
    before the hit list."""
    return filtered.select("read_id", F.concat_ws("\t", F.when(F.col("taxid") > 0, "C").otherwise("U"), F.col("read_id").cast("string"), F.col("taxid").cast("string"), F.col("length").cast("string"), F.concat(F.lit("P="), fixed_format(F.col("p"), 3)), "hitlist").alias("line"))


def translate(classified: DataFrame, tree: DataFrame, style: str = "names") -> DataFrame:
    """(read_id, lineage) of classified reads; the root's lineage is empty, ``root`` where ranks are coded."""
    text = lineages(tree, style)
    empty = F.lit("root" if style == "ranked" else "")
    shown = F.when(F.col("taxid") == 1, empty).otherwise(F.ltrim(F.col("lineage"), F.lit("|")) if style == "ranked" else F.replace("lineage", F.lit("; "), F.lit(";")))
    return classified.where("taxid <> 0").join(text, "taxid").select("read_id", shown.alias("lineage"))


def extract_reads(reads: DataFrame, calls: DataFrame, tree: DataFrame, taxa: list[int], clades: bool = True, invert: bool = False) -> DataFrame:
    """Reads called to the taxa, or to all below them; -1 among them takes every other taxon too; ``invert`` takes the rest."""
    wanted = calls.where("taxid <> 0") if -1 in taxa else calls.join(descendants(tree, taxa), "taxid", "left_semi") if clades else calls.where(F.col("taxid").isin(taxa))
    name = strip_mate(F.col("read_id").cast("string"))
    return reads.withColumn("__n", name).join(wanted.select(name.alias("__n")).distinct(), "__n", "left_anti" if invert else "left_semi").drop("__n")


def truth(calls: DataFrame, seqmap: DataFrame, pattern: str) -> DataFrame:
    """Adds ``true_taxid`` by the sequence id that ``pattern`` finds in the read name."""
    key = calls.withColumn("__k", F.regexp_extract(F.col("read_id").cast("string"), pattern, 1))
    return key.join(seqmap.select(F.col("seq_id").alias("__k"), F.col("taxid").alias("true_taxid")), "__k", "left").drop("__k")


def grade(truths: DataFrame, tree: DataFrame, ranks: list[str]) -> DataFrame:
    """(read_id, rank, verdict) for reads with a true taxon in the tree: correct, incorrect, higher_rank or unidentified.

    A call as specific as the rank, or without rank, is correct where both share the ancestor of that rank. A call of 0 has
    no rank, so it is incorrect at each.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(RANKS) for x in (r, i)])
    at = at_ranks(tree, ranks)
    called = at.join(tree.select("taxid", F.coalesce(F.try_element_at(order, F.coalesce("rank", F.lit("no rank"))), F.lit(0)).alias("o")), "taxid").select("taxid", "o", F.col("at").alias("c"))
    both = truths.join(at.select(F.col("taxid").alias("true_taxid"), F.col("at").alias("t")), "true_taxid").join(called, "taxid", "left")
    unranked = RANKS.index("no rank")
    verdict = lambda i, r: F.when(F.coalesce("o", F.lit(unranked)) > RANKS.index(r), "higher_rank").when(F.col("t")[i] == F.coalesce(F.col("c")[i], F.lit(0)), "correct").otherwise("incorrect")
    each = both.select("read_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), verdict(i, r).alias("verdict")) for i, r in enumerate(ranks)])).alias("x"))
    return each.select("read_id", "x.rank", "x.verdict")


def grade_summary(graded: DataFrame, n_reads: DataFrame) -> DataFrame:
    """(rank, total_reads, correct, incorrect, higher_rank, unidentified, sensitivity, precision); total counts skipped reads too."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("bigint"))
    by = graded.groupBy("rank").agg(n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("higher_rank").alias("higher_rank"), F.count("*").alias("seen")).crossJoin(F.broadcast(n_reads.select("total_reads")))  # one row
    return by.select("rank", "total_reads", "correct", "incorrect", "higher_rank", (F.col("total_reads") - F.col("seen")).alias("unidentified"), (F.lit(100.0) * F.col("correct") / F.col("total_reads")).alias("sensitivity"), (F.lit(100.0) * F.col("correct") / F.expr("nullif(correct + incorrect, 0)")).alias("precision"))


def grade_taxa(truths: DataFrame, tree: DataFrame, rank: str) -> DataFrame:
    """(rank, true_count, correct, incorrect, recall, precision) over the sets of true and called taxa at a rank."""
    at = at_rank(tree, rank).where("at_rank <> 0")
    true = truths.select(F.col("true_taxid").alias("taxid")).distinct().join(at, "taxid").select("at_rank").distinct()
    called = truths.select("taxid").distinct().join(at, "taxid").select("at_rank").distinct()
    both = true.withColumn("t", F.lit(1)).join(called.withColumn("c", F.lit(1)), "at_rank", "full")
    n = both.agg(F.count("t").alias("true_count"), F.count(F.when(F.col("t").isNotNull(), F.col("c"))).alias("correct"), F.count(F.when(F.col("t").isNull(), F.col("c"))).alias("incorrect"))
    return n.select(F.lit(rank).alias("rank"), "true_count", "correct", "incorrect", (F.lit(100.0) * F.col("correct") / F.expr("nullif(true_count, 0)")).alias("recall"), (F.lit(100.0) * F.col("correct") / F.expr("nullif(correct + incorrect, 0)")).alias("precision"))


def lca_ranks(truths: DataFrame, tree: DataFrame) -> DataFrame:
    """(lca_rank, n): rank of the LCA of true and called taxon; 0's is the other's."""
    pairs = lca_pairs(truths.select(F.col("true_taxid").alias("a"), F.col("taxid").alias("b")), tree)
    return pairs.join(tree.select(F.col("taxid").alias("lca"), "rank"), "lca", "left").groupBy(F.coalesce("rank", F.lit("no rank")).alias("lca_rank")).agg(F.count("*").alias("n"))
