"""Classifying reads: k-mer lookup, hit counts, tree vote, hit lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators.tree import common_prefix_end, paths_of


def merge_databases(tables: list[DataFrame]) -> DataFrame:
    """One table in which the first database that has a k-mer decides."""
    if len(tables) == 1:
        return tables[0]
    every = reduce(DataFrame.unionByName, [t.select("kmer", "taxon", F.lit(i).alias("prio")) for i, t in enumerate(tables)])
    return every.groupBy("kmer").agg(F.min_by("taxon", "prio").alias("taxon"))


def with_records(reads: DataFrame, out: str = "record") -> DataFrame:
    """Reads with a key of their own, for sources whose ids repeat; the source must give its rows in a fixed order, as files do."""
    return reads.withColumn(out, F.monotonically_increasing_id())


def lookup(reads: DataFrame, table: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(key, pos, codes, canon, ambig, taxon) for every window; taxon 0 where the table lacks the k-mer or it is ambiguous, canon
    null where it is ambiguous.

    The join is on integers (``dna.codes``), which are short to shuffle and sorted by their bits; k-mers as text are made of
    them only where they are asked for. How the table is joined is the planner's choice by its size; no hint is given.
    ``key`` names the column that tells reads apart.
    """
    names = dna.code_columns(k)
    coded = table.select(*[c.alias(n) for c, n in zip(dna.codes(F.col("kmer"), k), names)], "taxon")
    ambig = F.col(names[0]) < 0
    return dna.with_codes(reads, k, keep=(key,)).join(coded, names, "left").select(key, "pos", *names, F.when(~ambig, dna.letters(k)).alias("canon"), ambig.alias("ambig"), F.coalesce("taxon", F.lit(0)).cast("bigint").alias("taxon"))


def lookup_in_chunks(reads: DataFrame, table: DataFrame, bounds: list[tuple[int, int]], k: int, m: int) -> DataFrame:
    """As ``lookup`` with the table taken in ranges of bins; k-mers of other bins aren't found.

    A k-mer is in at most one range, so the ranges are told apart on the table's side, once for each of its k-mers, and one
    join takes them all; the windows, of which there are many more, are neither binned nor made once for each range.
    """
    bin_ = dna.minimizer(F.col("kmer"), k, m)
    inside = reduce(Column.__or__, [F.col("bin").between(lo, hi) for lo, hi in bounds], F.lit(False))
    return lookup(reads, table.select("kmer", "taxon", bin_.alias("bin")).where(inside), k)


def stop_at_hits(hits: DataFrame, min_hits: int, key: str = "read_id") -> DataFrame:
    """Quick mode: windows up to the one with the ``min_hits``-th hit, with ``hits`` so far."""
    so_far = F.sum((F.col("taxon") > 0).cast("bigint")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    counted = hits.withColumn("hits", so_far)
    return counted.where((F.col("hits") < min_hits) | ((F.col("hits") == min_hits) & (F.col("taxon") > 0)))


def quick_calls(reads: DataFrame, hits: DataFrame, min_hits: int, key: str = "read_id") -> DataFrame:
    """(key, taxid, hits): the taxon of the deciding hit, else 0."""
    kept = stop_at_hits(hits.where("taxon > 0").select(key, "pos", "taxon"), min_hits, key).groupBy(key).agg(F.max("hits").alias("hits"), F.max(F.when(F.col("hits") == min_hits, F.col("taxon"))).alias("call"))
    return reads.select(key).join(kept, key, "left").select(key, F.coalesce("call", F.lit(0)).cast("bigint").alias("taxid"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def hit_counts(hits: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, taxon, n) of taxa hit.

    After the lookup a read's hits lie in many partitions, so counting them there would keep nearly a row each and move as
    many; they are dealt by read first, which ``vote`` then needs no more.
    """
    return hits.where("taxon <> 0").select(key, "taxon").repartition(key).groupBy(key, "taxon").agg(F.count("*").alias("n"))


def _top_end(tied):
    """LCA of tied paths: of the first and last in path order."""
    return common_prefix_end(F.array_min(tied), F.array_max(tied))


def vote(reads: DataFrame, counts: DataFrame, tree: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, taxid, score): each taxon scores the hits on it and its ancestors; the best wins, ties go to their LCA.

    A read hits few taxa, so its vote is an expression over one array; nothing is shuffled beyond gathering it.
    """
    paths = counts.join(paths_of(tree, "taxon"), "taxon")
    per_read = paths.groupBy(key).agg(F.collect_list(F.struct("taxon", "n", "path")).alias("h"))
    total = lambda t: F.aggregate("h", F.lit(0).cast("bigint"), lambda s, u: s + F.when(F.array_contains(t["path"], u["taxon"]), u["n"]).otherwise(0))
    scored = per_read.withColumn("s", F.transform("h", lambda t: F.struct(total(t).alias("score"), t["path"].alias("path")))).withColumn("best", F.array_max(F.transform("s", lambda x: x["score"])))
    tied = F.transform(F.filter("s", lambda x: x["score"] == F.col("best")), lambda x: x["path"])
    calls = scored.select(key, _top_end(tied).alias("call"), "best")
    return reads.select(key).join(calls, key, "left").select(key, F.coalesce("call", F.lit(0)).cast("bigint").alias("taxid"), F.coalesce("best", F.lit(0)).cast("bigint").alias("score"))


def _spans(sets: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kmer, span, odd) of (kmer, taxids), and (name, stretches) of the odd ones: sets as stretches of places. Most are clades,
    one stretch, which ``span`` has (first place in the high half, length less one in the low). Of others it has the first and
    last place, and ``odd`` a name, the least of the k-mers with that set, and the size."""
    each = sets.select("kmer", F.size("taxids").cast("bigint").alias("size"), F.explode("taxids").alias("taxid")).join(F.broadcast(places.select("taxid", "place")), "taxid")  # places: a row a taxon
    run = F.col("place") - F.row_number().over(Window.partitionBy("kmer").orderBy("place"))
    stretches = each.select("kmer", "size", "place", run.alias("run")).groupBy("kmer", "size", "run").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    all_ = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    lo, hi = F.min("lo"), F.max("hi")
    whole = stretches.groupBy("kmer", "size").agg((F.shiftleft(lo, 32) + (hi - lo)).alias("span"), F.when((F.count("*") > 1) | (hi - lo + 1 != F.col("size")), all_).alias("stretches")).persist()
    named = whole.where("stretches is not null").groupBy("size", "stretches").agg(F.min("kmer").alias("name"), F.collect_list("kmer").alias("kmers")).persist()
    names = named.select(F.explode("kmers").alias("kmer"), F.struct("name", "size").alias("odd"))
    return whole.select("kmer", "span").join(names, "kmer", "left"), named.select("name", "stretches")


def _contained(cases: DataFrame, odd: DataFrame) -> DataFrame:
    """Of (lo, hi, name, other), sets by their ends, or by name if that isn't empty, and odd sets' names: those in which the other
    set has all of the first one's places."""
    members = odd.select("name", F.explode("stretches").alias("s")).select("name", F.explode(F.sequence("s.lo", "s.hi")).alias("place"))
    plain = cases.where("name = ''").withColumn("place", F.explode(F.sequence("lo", "hi")))
    each = plain.unionByName(cases.where("name <> ''").join(members, "name"))
    both = each.join(members.select(F.col("name").alias("other"), "place", F.lit(1).alias("in")), ["other", "place"], "left")
    return both.groupBy("lo", "hi", "name", "other").agg(F.count("*").alias("n"), F.count("in").alias("inside")).where("n = inside").drop("n", "inside")


def _best_stretches(h: Column) -> Column:
    """The stretches that most of ``n`` of an array of (lo, hi, n, w) covers: a walk over the places where stretches begin and end."""
    steps = F.array_sort(F.concat(F.transform(h, lambda x: F.struct(x["lo"].alias("at"), x["n"].alias("d"))), F.transform(h, lambda x: F.struct((x["hi"] + 1).alias("at"), (-x["n"]).alias("d")))))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("best"), F.lit(None).cast("bigint").alias("at"), none.alias("top"))

    def step(s, x):
        # What has been summed holds from the last place to this one, if this is another.
        here = F.array(F.struct(s["at"].alias("lo"), (x["at"] - 1).alias("hi")))
        top = F.when((s["at"] == x["at"]) | (s["now"] == 0) | (s["now"] < s["best"]), s["top"]).when(s["now"] > s["best"], here).otherwise(F.concat(s["top"], here))
        best = F.when(s["at"] == x["at"], s["best"]).otherwise(F.greatest(s["best"], s["now"]))
        return F.struct((s["now"] + x["d"]).alias("now"), best.alias("best"), x["at"].alias("at"), F.coalesce(top, none).alias("top"))

    return F.aggregate(steps, start, step, lambda s: s["top"])


def _smallest(sets: Column) -> Column:
    """Of an array of (span, odd, n): the ends and the name (empty for a clade) of the smallest set; ``others``, the odd sets beside
    it; ``outside``, whether a clade doesn't hold it; ``sure``, whether its places win whatever the odd sets hold."""
    low = F.lit((1 << 32) - 1)
    form = lambda x: F.struct(F.coalesce(x["odd"]["size"], x["span"].bitwiseAND(low) + 1).alias("size"), F.shiftright(x["span"], 32).alias("lo"), (F.shiftright(x["span"], 32) + x["span"].bitwiseAND(low)).alias("hi"), F.coalesce(x["odd"]["name"], F.lit("")).alias("name"), x["n"].alias("n"))

    def judge(all_, m):
        others = F.filter(all_, lambda y: (y["name"] != "") & (y["name"] != m["name"]))
        away = F.filter(all_, lambda y: (y["name"] == "") & ((y["lo"] > m["lo"]) | (y["hi"] < m["hi"])))
        count = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, y: s + y["n"])
        # A place elsewhere lacks this set's k-mers, and this place at most those of sets that may not hold it.
        sure = ((F.size(others) == 0) & (F.size(away) == 0)) | ((m["size"] == 1) & (m["n"] > count(others) + count(away)))
        return F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), m["name"].alias("name"), F.transform(others, lambda y: y["name"]).alias("others"), (F.size(away) > 0).alias("outside"), sure.alias("sure"))

    return let(F.transform(sets, form), lambda a: let(F.array_min(a), lambda m: judge(a, m)))


def _ends_of_best(sets: Column) -> Column:
    """(lo, hi): the first and last place that most k-mers and then most weight are at, of an array of (span, more, n)."""
    stretch = lambda lo, hi, n, size: F.struct(lo.alias("lo"), hi.alias("hi"), n.alias("n"), (n / size).alias("w"))
    low = F.lit((1 << 32) - 1)
    plain = lambda x: stretch(F.shiftright(x["span"], 32), F.shiftright(x["span"], 32) + x["span"].bitwiseAND(low), x["n"], x["span"].bitwiseAND(low) + 1)
    spread = lambda x: F.when(x["span"].isNotNull(), F.array(plain(x))).otherwise(F.transform(x["more"]["stretches"], lambda y: stretch(y["lo"], y["hi"], x["n"], x["more"]["size"])))
    weight = lambda h, t: F.round(F.aggregate(F.array_sort(F.filter(h, lambda x: (x["lo"] <= t["lo"]) & (x["hi"] >= t["hi"]))), F.lit(0.0), lambda s, x: s + x["w"]), 6)
    weighed = lambda h: F.transform(_best_stretches(h), lambda t: F.struct(weight(h, t).alias("w"), t["lo"].alias("lo"), t["hi"].alias("hi")))
    heaviest = lambda t: let(F.array_max(F.transform(t, lambda x: x["w"])), lambda w: F.filter(t, lambda x: x["w"] == w))
    ends = lambda t: F.struct(F.array_min(F.transform(t, lambda x: x["lo"])).alias("lo"), F.array_max(F.transform(t, lambda x: x["hi"])).alias("hi"))
    first = lambda x: plain(x[0])
    alone = (F.size(sets) == 1) & sets[0]["span"].isNotNull()
    only = F.struct(first(sets)["lo"].alias("lo"), first(sets)["hi"].alias("hi"))
    return F.when(alone, only).otherwise(let(F.flatten(F.transform(sets, spread)), lambda h: let(weighed(h), lambda t: let(heaviest(t), ends))))


def set_votes(reads: DataFrame, sets: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(read_id, taxid) with a table of taxon sets: most k-mers, then most weight (1/size each), then the LCA.

    A k-mer of all genomes has a set as large as the taxonomy, so sets aren't spelt out for the reads. Taxa with k-mers are
    numbered in preorder; a set is a few stretches of these places, as k-mers are shared within clades. Where a read's smallest
    set is in all its others, that set wins: at once if these are clades, after one test for each pair of sets if not. For the
    remaining reads votes are counted by stretch, and the best places found where stretches begin and end.
    """
    known = sets.select(F.explode("taxids").alias("taxid")).distinct().join(tree.select("taxid", "pre", "path"), "taxid")
    places = known.withColumn("place", F.row_number().over(Window.orderBy("pre")).cast("bigint")).persist()  # a row a taxon
    names = dna.code_columns(k)
    spans, odd = _spans(sets, places)
    coded = spans.select(*[c.alias(n) for c, n in zip(dna.codes(F.col("kmer"), k), names)], "span", "odd")
    votes = dna.with_codes(reads, k).join(coded, names).select("read_id", "span", "odd").repartition("read_id").groupBy("read_id", "span", "odd").agg(F.count("*").alias("n"))
    per_read = votes.groupBy("read_id").agg(F.collect_list(F.struct("span", "odd", "n")).alias("x")).select("read_id", "x", let(F.col("x"), _smallest).alias("s"))
    judged = per_read.select("read_id", "s.lo", "s.hi", "s.name", "s.sure", F.when(~F.col("s.sure") & ~F.col("s.outside"), F.col("s.others")).alias("others"), F.when(~F.col("s.sure"), F.col("x")).alias("x")).persist()
    asked = judged.where("others is not null").select("read_id", "lo", "hi", "name", F.size("others").alias("n"), F.explode("others").alias("other"))
    nested = asked.join(_contained(asked.select("lo", "hi", "name", "other").distinct(), odd), ["lo", "hi", "name", "other"]).groupBy("read_id", "lo", "hi", "n").agg(F.count("*").alias("found")).where("found = n").select("read_id", "lo", "hi")
    left = judged.where("not sure").join(nested.select("read_id"), "read_id", "left_anti").select("read_id", F.explode("x").alias("x")).select("read_id", "x.span", F.col("x.odd.name").alias("name"), F.col("x.odd.size").alias("size"), "x.n")
    spelt = left.join(odd, "name", "left").select("read_id", F.struct(F.when(F.col("name").isNull(), F.col("span")).alias("span"), F.when(F.col("name").isNotNull(), F.struct("size", "stretches")).alias("more"), "n").alias("y"))
    walked = spelt.groupBy("read_id").agg(F.collect_list("y").alias("y")).select("read_id", _ends_of_best(F.col("y")).alias("e")).select("read_id", "e.lo", "e.hi")
    ends = judged.where("sure").select("read_id", "lo", "hi").unionByName(nested).unionByName(walked)
    end = lambda c: F.broadcast(places.select(F.col("place").alias(c), F.col("path").alias(f"{c}p")))
    calls = ends.join(end("lo"), "lo").join(end("hi"), "hi").select("read_id", common_prefix_end(F.col("lop"), F.col("hip")).alias("call"))
    return reads.select("read_id").join(calls, "read_id", "left").select("read_id", F.coalesce("call", F.lit(0)).cast("bigint").alias("taxid"))


def hitlists(reads: DataFrame, hits: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, hitlist): run lengths of codes in read order, ``A`` for ambiguous windows; ``0:0`` without windows."""
    read = Window.partitionBy(key).orderBy("pos")
    coded = hits.withColumn("code", F.when(F.col("ambig"), "A").otherwise(F.col("taxon").cast("string")))
    starts = coded.withColumn("new", F.coalesce((F.lag("code").over(read) != F.col("code")).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(read.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run").agg(F.first("code").alias("code"), F.count("*").alias("n"))
    text = runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", F.concat_ws(":", "code", "n").alias("t")))), lambda x: x["t"]), " ").alias("hitlist"))
    return reads.select(key).join(text, key, "left").select(key, F.coalesce("hitlist", F.lit("0:0")).alias("hitlist"))


def decode_hitlist(classified: DataFrame) -> DataFrame:
    """(read_id, ord, code, n) from hitlist text."""
    each = classified.select("read_id", F.posexplode(F.split("hitlist", " ")).alias("ord", "item"))
    return each.select("read_id", F.col("ord").cast("bigint").alias("ord"), F.split_part("item", F.lit(":"), F.lit(1)).alias("code"), F.split_part("item", F.lit(":"), F.lit(2)).cast("bigint").alias("n"))


def let(value, use):
    """``use`` of a value computed once; named columns would be put into lambdas and computed at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rendered(runs):
    """Hit list of an array of (code, n) in read order; -1 is ambiguous."""
    return F.array_join(F.transform(runs, lambda x: F.concat(F.when(x["code"] == -1, "A").otherwise(x["code"].cast("string")), F.lit(":"), x["n"].cast("string"))), " ")


def classified_in_one_pass(reads: DataFrame, table: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(record, read_id, taxid, length, hitlist) of reads with records: after the lookup windows are dealt by record once, and of
    each run of one code only its first goes on; hit list, counts and vote follow from these few, and the taxonomy's paths join
    in without moving the reads again."""
    code = F.when(F.col("ambig"), F.lit(-1)).otherwise(F.col("taxon")).cast("bigint")
    coded = lookup(reads, table, k, key="record").select("record", "pos", code.alias("code")).repartition("record")
    firsts = coded.withColumn("was", F.lag("code").over(Window.partitionBy("record").orderBy("pos"))).where("was is null or was <> code")
    starts = firsts.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("s"))
    windows = (F.octet_length(dna.tidy(F.col("seq"))) - (k - 1)).cast("bigint")
    sized = reads.select("record", "read_id", F.length("seq").cast("bigint").alias("length"), windows.alias("windows"))
    runs = F.transform("s", lambda x, i: F.struct(x["code"].alias("code"), (F.coalesce(F.get("s", i + 1)["pos"], F.col("windows")) - x["pos"]).alias("n")))
    whole = sized.join(starts, "record", "left").select("record", "read_id", "length", runs.alias("r"))
    hit = lambda r: F.array_distinct(F.transform(F.filter(r, lambda x: x["code"] > 0), lambda x: x["code"]))
    count = lambda r, t: F.aggregate(F.filter(r, lambda x: x["code"] == t), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    taxa = F.transform(hit(F.col("r")), lambda t: F.struct(t.alias("taxon"), count(F.col("r"), t).alias("n")))
    each = whole.select("record", "read_id", "length", F.coalesce(_rendered(F.col("r")), F.lit("0:0")).alias("hitlist"), F.explode_outer(taxa).alias("t")).select("record", "read_id", "length", "hitlist", "t.taxon", "t.n")
    paths = each.join(paths_of(tree, "taxon"), "taxon", "left")
    voted = paths.groupBy("record").agg(F.first("read_id").alias("read_id"), F.first("length").alias("length"), F.first("hitlist").alias("hitlist"), F.collect_list(F.when(F.col("path").isNotNull(), F.struct("taxon", "n", "path"))).alias("h"))
    total = lambda h, t: F.aggregate(h, F.lit(0).cast("bigint"), lambda s, u: s + F.when(F.array_contains(t["path"], u["taxon"]), u["n"]).otherwise(0))
    scores = lambda h: F.transform(h, lambda t: F.struct(total(h, t).alias("score"), t["path"].alias("path")))
    top = lambda s: _top_end(F.transform(F.filter(s, lambda x: x["score"] == F.array_max(F.transform(s, lambda y: y["score"]))), lambda x: x["path"]))
    call = F.when(F.size("h") > 0, let(scores(F.col("h")), top)).otherwise(0).cast("bigint")
    return voted.select("record", "read_id", call.alias("taxid"), F.coalesce("length", F.lit(0)).alias("length"), "hitlist")


def classify(reads: DataFrame, tables: list[DataFrame], tree: DataFrame, k: int, quick: bool = False, min_hits: int = 1, only_classified: bool = False, print_sequence: bool = False, keep_record: bool = False) -> DataFrame:
    """Classification rows: status, read_id, taxid, length, hitlist[, seq][, record]; one for each read, also where ids repeat.

    A column ``record`` that tells reads apart is used where the reads have one; else one is made (see ``with_records``).
    """
    table = merge_databases(tables)
    reads = reads if "record" in reads.columns else with_records(reads)
    if quick:
        calls = quick_calls(reads, lookup(reads, table, k, key="record"), min_hits, "record")
        rows = reads.select("record", "read_id", F.length("seq").cast("bigint").alias("length")).join(calls.select("record", "taxid", F.concat(F.lit("Q:"), F.col("hits").cast("string")).alias("hitlist")), "record")
    else:
        rows = classified_in_one_pass(reads, table, tree, k)
    if print_sequence:
        rows = rows.join(reads.select("record", "seq"), "record")
    out = rows.select(F.when(F.col("taxid") != 0, "C").otherwise("U").alias("status"), "read_id", "taxid", "length", "hitlist", *(["seq"] if print_sequence else []), *(["record"] if keep_record else []))
    return out.where("taxid <> 0") if only_classified else out


def merge_pairs(first: DataFrame, second: DataFrame, check_names: bool = False) -> DataFrame:
    """(read_id, seq) of mates by record number, joined by N; reads without a mate pass alone."""
    name = lambda c: dna.strip_mate(F.regexp_extract(c, "^(\\S*)", 1), underscore=True)
    a, b = first.select("rec_no", name("read_id").alias("n1"), F.col("seq").alias("s1")), second.select("rec_no", name("read_id").alias("n2"), F.col("seq").alias("s2"))
    both = a.join(b, "rec_no", "full")
    if check_names:
        both = both.where(F.assert_true(F.col("n1").isNull() | F.col("n2").isNull() | (F.col("n1") == F.col("n2")), "mates' names differ").isNull())
    return both.select("rec_no", F.coalesce("n1", "n2").alias("read_id"), F.concat_ws("N", "s1", "s2").alias("seq"))


def in_read_order(rows: DataFrame, reads: DataFrame, key: str = "read_id", order: str = "rec_no") -> DataFrame:
    """Rows in the order of their reads' numbers, by a range sort."""
    return rows.join(reads.select(key, order), key).orderBy(order).drop(order)


def with_rates(stats: DataFrame, seconds: float) -> DataFrame:
    """Statistics of a run with thousands of sequences and millions of bases a minute."""
    minutes = F.lit(float(seconds)) / 60
    return stats.withColumn("kseq_per_min", F.col("sequences") / 1e3 / minutes).withColumn("mbp_per_min", F.col("bases") / 1e6 / minutes)


def run_stats(reads: DataFrame, calls: DataFrame) -> DataFrame:
    both = reads.select("read_id", F.length("seq").alias("l")).join(calls, "read_id")
    n, c = F.count("*"), F.sum((F.col("taxid") != 0).cast("bigint"))
    return both.agg(n.alias("sequences"), F.sum("l").cast("bigint").alias("bases"), c.alias("classified"), (n - c).alias("unclassified"), (F.lit(100.0) * c / n).alias("classified_pct"))
