"""Taxonomy: paths, lowest common ancestors, ranks, lineages, descendants.

A taxonomy is (taxid, parent, name, rank) with the root's parent 0. ``with_paths`` adds ``path`` (root first), ``depth`` and
``pre``, the place in preorder; operators below take that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.dna import lineage_name, rank_code
from strandlake.operators.ranges import intervals, placed

RANKS = ["unknown", "no rank", "sequence", "assembly", "subspecies", "species", "species subgroup", "species group", "subgenus", "genus", "tribe", "subfamily", "family", "superfamily", "parvorder", "infraorder", "suborder", "order", "superorder", "subclass", "class", "superclass", "subphylum", "phylum", "superphylum", "kingdom", "superkingdom", "root"]


def parent_map(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("taxid", F.when(F.col("taxid") == 1, 0).otherwise(F.col("parent")).cast("bigint").alias("parent")).where("taxid <> 0")


def with_paths(taxonomy: DataFrame) -> DataFrame:
    """Pointer doubling: the part of the path known doubles with every join, so depth d takes log2(d) of them.

    A node whose chain meets no known parent ends there; a parent of itself counts as the root. Longer cycles are an error.
    """
    nodes = taxonomy.withColumn("up", F.when((F.col("taxid") == 1) | (F.col("parent") == F.col("taxid")), 0).otherwise(F.col("parent")))
    step = chains(nodes.select(F.col("taxid").alias("node"), "up")).select(F.col("node").alias("taxid"), "path")
    pre = F.row_number().over(Window.orderBy("path")).cast("bigint")  # one row a taxon; taxonomies are small beside reads
    return taxonomy.join(step.select("taxid", "path"), "taxid").withColumn("depth", (F.size("path") - 1).cast("bigint")).withColumn("pre", pre)


def chains(nodes: DataFrame) -> DataFrame:
    """(node, path): from the last known ancestor down to each node of (node, up), where an ``up`` of 0 or unknown ends the chain."""
    step = nodes.select("node", F.col("up").cast("bigint").alias("up"), F.array("node").alias("path")).persist()
    while True:
        upper = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        longer = step.join(upper, "up", "left").select("node", F.coalesce("next", F.lit(0)).cast("bigint").alias("up"), F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path")).persist()
        left, cyclic = longer.agg(F.count_if(F.col("up") != 0), F.count_if(F.size(F.array_distinct("path")) < F.size("path"))).first()
        step.unpersist()
        step = longer
        if cyclic:
            step.unpersist()
            raise ValueError(f"{cyclic} nodes are their own ancestors")
        if not left:
            return step.select("node", "path")


def closure(tree: DataFrame) -> DataFrame:
    """(taxid, ancestor, dist), each node its own ancestor at 0."""
    return tree.select("taxid", "depth", F.posexplode("path").alias("d", "ancestor")).select("taxid", "ancestor", (F.col("depth") - F.col("d")).alias("dist"))


def paths_of(tree: DataFrame, key: str) -> DataFrame:
    """(key, path), for a join that leaves the other side where it lies: sent to all, as taxonomies are small beside what is
    joined with them, and a taxon that much of the data has would be one partition of a shuffled join."""
    return F.broadcast(tree.select(F.col("taxid").alias(key), "path"))


def common_prefix_end(a: Column, b: Column) -> Column:
    """Last common element of two paths: their nodes' lowest common ancestor; 1 if there is none."""
    same = F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(same, F.lit(-1)), F.lit(1).cast("bigint"))


def lca_pairs(pairs: DataFrame, tree: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``lca`` (0 is the identity) and ``dist``, the edges between the two (-1 if either is 0)."""
    one = lambda c: tree.select(F.col("taxid").alias(c), F.col("path").alias(f"__{c}"))
    both = pairs.join(one(a), a, "left").join(one(b), b, "left")
    found = F.when(F.col(a) == 0, F.col(b)).when(F.col(b) == 0, F.col(a)).otherwise(common_prefix_end(F.col(f"__{a}"), F.col(f"__{b}")))
    depth = F.array_position(f"__{a}", found)
    dist = F.when((F.col(a) == 0) | (F.col(b) == 0), F.lit(-1)).otherwise(F.size(f"__{a}") + F.size(f"__{b}") - 2 * depth)
    return both.select(*pairs.columns, found.alias("lca"), dist.cast("bigint").alias("dist"))


def lca_by(rows: DataFrame, keys: list[str], tree: DataFrame, taxid: str = "taxid", out: str = "taxon") -> DataFrame:
    """LCA of each group's taxa: of the first and last in preorder. Two integers a group, so it aggregates before the shuffle."""
    pre = tree.select(F.col("taxid").alias(taxid), "pre")
    ends = rows.join(pre, taxid).groupBy(*keys).agg(F.min("pre").alias("__lo"), F.max("pre").alias("__hi"))
    return lca_of_ends(ends, tree, out)


def lca_of_ends(ends: DataFrame, tree: DataFrame, out: str) -> DataFrame:
    at = lambda c: tree.select(F.col("pre").alias(c), F.col("path").alias(f"{c}p"))
    return ends.join(at("__lo"), "__lo").join(at("__hi"), "__hi").withColumn(out, common_prefix_end(F.col("__lop"), F.col("__hip"))).drop("__lo", "__hi", "__lop", "__hip")


def at_rank(tree: DataFrame, rank: str) -> DataFrame:
    """(taxid, at_rank): nearest self or ancestor of that rank, root excluded; else 0."""
    ranked = tree.where((F.col("rank") == rank) & (F.col("taxid") != 1)).select(F.col("taxid").alias("ancestor"))
    best = closure(tree).join(ranked, "ancestor").groupBy("taxid").agg(F.min_by("ancestor", "dist").alias("at_rank"))
    return tree.select("taxid").join(best, "taxid", "left").select("taxid", F.coalesce("at_rank", F.lit(0)).cast("bigint").alias("at_rank"))


def next_proper_rank(tree: DataFrame) -> DataFrame:
    """(taxid, next_taxid, next_rank): nearest self or ancestor with a real rank; root where there is none."""
    proper = tree.where((F.col("rank") != "no rank") & (F.col("taxid") != 1)).select(F.col("taxid").alias("ancestor"), F.col("rank").alias("r"))
    best = closure(tree).join(proper, "ancestor").groupBy("taxid").agg(F.min_by(F.struct("ancestor", "r"), "dist").alias("x"))
    return tree.select("taxid").join(best, "taxid", "left").select("taxid", F.coalesce("x.ancestor", F.lit(1)).cast("bigint").alias("next_taxid"), F.coalesce("x.r", F.lit("root")).alias("next_rank"))


def lineages(tree: DataFrame, style: str = "names") -> DataFrame:
    """(taxid, lineage): ``names`` joins by '; ' without the root; ``ranked`` is |d__A|p__B with '-' for other ranks; ``above``
    joins what lies above species, the root included but not 131567, and ends in a full stop."""
    if style == "above":
        ranks = tree.select(F.col("taxid").alias("ancestor"), F.col("name").alias("n"), (F.col("rank") == "species").alias("species"))
        each = closure(tree).join(ranks, "ancestor").groupBy("taxid").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("o"), F.col("ancestor").alias("a"), "n", "species"))).alias("x"))
        first = F.array_position(F.transform("x", lambda p: F.coalesce(p["species"], F.lit(False))), True)
        shown = F.filter(F.when(first > 0, F.slice("x", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("x")), lambda p: p["a"] != 131567)
        return each.select("taxid", F.when(F.size(shown) > 0, F.concat(F.array_join(F.transform(shown, lambda p: p["n"]), "; "), F.lit("."))).otherwise("").alias("lineage"))
    names = tree.select(F.col("taxid").alias("ancestor"), F.col("name").alias("n"), F.col("rank").alias("r"))
    steps = closure(tree).join(names, "ancestor").where("ancestor <> 1")
    text = F.col("n") if style == "names" else F.concat(F.lower(rank_code(F.col("r"))), F.lit("__"), lineage_name(F.col("n")))
    parts = steps.groupBy("taxid").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("o"), text.alias("t")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda p: p["t"]), "; ") if style == "names" else F.concat(F.lit("|"), F.array_join(F.transform("x", lambda p: p["t"]), "|"))
    return tree.select("taxid").join(parts, "taxid", "left").select("taxid", F.coalesce(F.when(F.size("x") > 0, joined), F.lit("")).alias("lineage"))


def descendants(tree: DataFrame, roots: list[int], pruned: DataFrame | None = None) -> DataFrame:
    """(taxid) at or below the roots; nothing at or below a taxid in ``pruned``."""
    below = tree.where(F.arrays_overlap("path", F.array(*[F.lit(r).cast("bigint") for r in roots]))).select("taxid", "path")
    if pruned is None:
        return below.select("taxid")
    cut = pruned.select(F.col("taxid").alias("cut"))
    return below.join(below.select("taxid", F.explode("path").alias("cut")).join(cut, "cut", "left_semi").select("taxid").distinct(), "taxid", "left_anti").select("taxid")


#: Groups of top taxa by name, ascending.
DIVISIONS = {
    "archaea": (2157,), "bacteria": (2,), "fungi": (4751,), "parasitic_worms": (6178, 6199, 6231, 10232, 37945), "viral": (10239, 12884),
    "protozoa": (2763, 2830, 3027, 3041, 5719, 5752, 28009, 33630, 33634, 33682, 38254, 66288, 136087, 137418, 190322, 193537, 207245, 339960, 419944, 543769, 554296, 554915, 556282, 589438, 759891, 1084709, 1401294),
}


def accepted_taxa(tree: DataFrame, group: str) -> DataFrame:
    """(taxid) of a division, or of ``taxID<n>``, without environmental samples and what is below them."""
    roots = [int(group[5:])] if group[:5].lower() == "taxid" and group[5:].isdigit() else DIVISIONS.get(group)
    if roots is None:
        raise ValueError(f"{group} is neither one of {', '.join(sorted(DIVISIONS))} nor taxID<n>")
    return descendants(tree, list(roots), tree.where(F.lower("name").contains("environmental samples")))


def is_below(tree: DataFrame, taxid: int) -> Column:
    return F.array_contains("path", F.lit(taxid).cast("bigint"))


#: Their sequences get no nodes of their own.
HUMAN, MOUSE = 9606, 10090


def insert(taxonomy: DataFrame, taxid: int, parent: int, rank: str, name: str) -> DataFrame:
    """The taxonomy with one node more; unchanged where the taxid is taken or the parent unknown."""
    new = taxonomy.sparkSession.createDataFrame([(taxid, parent, name, rank)], "taxid bigint, parent bigint, name string, rank string")
    fits = new.join(taxonomy.select(F.col("taxid")), "taxid", "left_anti").join(taxonomy.select(F.col("taxid").alias("parent")), "parent", "left_semi")
    return taxonomy.select("taxid", "parent", "name", "rank").unionByName(fits.select("taxid", "parent", "name", "rank"))


def by_name(taxonomy: DataFrame, name: str) -> DataFrame:
    """The entries of a scientific name."""
    return taxonomy.where(F.col("name") == name)


def last_pseudo_taxid(taxonomy: DataFrame) -> DataFrame:
    """(base): the number after which new taxids start; one row."""
    return taxonomy.agg(F.coalesce(F.max(F.when(F.col("taxid") >= 1_000_000_000, F.col("taxid"))) + 99, F.lit(1_000_000_000)).cast("bigint").alias("base"))


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    low, high = rows.agg(F.min("ord"), F.max("ord")).first()
    return placed(rows, intervals("ord", low or 0, high or 0), ["ord"], out)


def add_pseudo_taxids(taxonomy: DataFrame, sequences: DataFrame, rank: str = "sequence") -> DataFrame:
    """Taxonomy with one new node for each (seq_id, taxid, name, ord): numbered in ``ord`` after the last pseudo-taxid."""
    new = _numbered(sequences, "at").crossJoin(F.broadcast(last_pseudo_taxid(taxonomy))).select((F.col("base") + F.col("at") + 1).alias("taxid"), F.col("taxid").alias("parent"), F.col("name"), F.lit(rank).alias("rank"))  # base is one row
    return taxonomy.select("taxid", "parent", "name", "rank").unionByName(new)


def add_assembly_taxids(taxonomy: DataFrame, seqmap: DataFrame, sequences: bool = True, headers: DataFrame | None = None, without: tuple[int, ...] = (HUMAN, MOUSE)) -> tuple[DataFrame, DataFrame]:
    """(taxonomy, map): nodes for assemblies and, below them, for sequences.

    ``seqmap`` is (seq_id, taxid, name, ord); of repeated ids the first line counts. Lines with one name share an assembly
    node below the taxon of the first of them; every sequence but those of the taxa ``without`` gets a node below its assembly,
    or below its taxon where the name is null or empty, named by its header in ``headers`` (seq_id, header_line) or else by
    its id. Numbers follow the lines, an assembly's before its sequence's. The map is (seq_id, taxid) with the new taxids.
    The default ``without`` means NCBI's numbers; taxids of one's own making may be the same by chance.
    """
    first = seqmap.groupBy("seq_id").agg(F.min_by(F.struct("taxid", "name", "ord"), "ord").alias("x")).select("seq_id", "x.*")
    named = first.where("name <> ''")
    assemblies = named.groupBy("name").agg(F.min(F.struct("ord", "taxid")).alias("x")).select("name", F.col("x.taxid").alias("parent"), (F.col("x.ord") * 2).alias("ord"), F.lit("assembly").alias("rank"))
    own = first.where(~F.col("taxid").isin(*without)).select("seq_id", (F.col("ord") * 2 + 1).alias("ord")) if sequences else first.limit(0).select("seq_id", "ord")
    every = assemblies.select(F.lit(None).cast("string").alias("seq_id"), F.col("name").alias("assembly"), "ord").unionByName(own.select("seq_id", F.lit(None).cast("string").alias("assembly"), "ord"))
    ids = _numbered(every, "at").crossJoin(F.broadcast(last_pseudo_taxid(taxonomy))).withColumn("id", F.col("base") + F.col("at") + 1)  # base is one row
    of_name = ids.where("assembly is not null").select(F.col("assembly").alias("name"), F.col("id").alias("assembly_id"))
    of_seq = ids.where("seq_id is not null").select("seq_id", F.col("id").alias("own_id"))
    lines = first.join(of_name, "name", "left").join(of_seq, "seq_id", "left")
    shown = lines if headers is None else lines.join(headers.select("seq_id", "header_line"), "seq_id", "left")
    title = F.col("seq_id") if headers is None else F.coalesce("header_line", "seq_id")
    new = assemblies.join(of_name, "name").select(F.col("assembly_id").alias("taxid"), "parent", "name", "rank").unionByName(
        shown.where("own_id is not null").select(F.col("own_id").alias("taxid"), F.coalesce("assembly_id", "taxid").alias("parent"), title.alias("name"), F.lit("sequence").alias("rank"))
    )
    return taxonomy.select("taxid", "parent", "name", "rank").unionByName(new), lines.select("seq_id", F.coalesce("own_id", "assembly_id", "taxid").alias("taxid"))
