"""Benchmark decontamination by template canonicalisation; DataFrame and SQL operations only.

Texts become words, lower-cased and without punctuation; numbers, the units after them and capitalised names inside
sentences become typed placeholders (slots). All windows of ``WINDOW`` template words of the benchmark are hash-joined
with all windows of the documents, so a question asked again with other numbers, names or units still matches. For
each document and item that share enough windows, the words are then laid side by side along their alignment. Windows
are consistent where each slot value of the item goes to one value of the document in all of them; different values may
become equal. Of each alignment the largest run of windows that are consistent among themselves counts, or all verbatim
windows where these are more: a conflict elsewhere takes nothing from them. An item counts as leaked where its
consistent windows are at least ``ENOUGH`` (13 words in a row) or all that it has.

Items without a window of enough literal words (short ones, questions full of numbers or names) and items in scripts
without spaces are searched for as they stand: windows of plain words, where each character of such a script is a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, ENOUGH = 8, 6
#: Templates of fewer words than this match by chance, so such items are searched verbatim; those below ``WINDOW`` are one window of their own length.
LEAST = 5
#: Template words of a window that must not be slots.
LITERAL = 4
#: Benchmark windows, and document-item pairs, up to which they are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000
_UNITS = "km|cm|mm|m|kg|mg|g|lbs?|oz|ml|l|s|secs?|seconds?|mins?|minutes?|hrs?|h|hours?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|watts?|volts?|tons?|pounds?|liters?|litres?|meters?|metres?"
_UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\p{IsTibetan}]"
_N, _U, _P = "\u0001", "\u0003", "\u0002"


def words(text: Column) -> Column:
    """Array of words; names start with U+0002, units with U+0003, numbers with a digit. Null for null."""
    t = F.regexp_replace(F.translate(text, _N + _P + _U, "   "), f"(?i)(?<=[0-9]) ?\\b({_UNITS})\\b", f" {_U}$1")
    t = F.regexp_replace(t, "(?<=[\\p{Ll}0-9,;:)] )(?=\\p{Lu}\\p{Ll})", _P)
    t = F.regexp_replace(F.lower(t), "(?<=[0-9])[.,](?=[0-9])", "")
    return F.filter(F.split(t, f"[^\\p{{L}}\\p{{N}}{_U}{_P}]+"), lambda w: w != "")


def _slot(w: Column) -> Column:
    """The placeholder's kind, or null."""
    first = F.substring(w, 1, 1)
    return F.when(first == _P, _P).when(first == _U, _U).when((first >= "0") & (first <= "9"), _N)


def _codes(w: Column) -> Column:
    """Hash of each template word; slots have small codes of their own."""
    first = lambda x: F.substring(x, 1, 1)
    return F.transform(w, lambda x: F.when(x >= ":", F.xxhash64(x)).when(first(x) == _P, F.lit(2).cast("long")).when(first(x) == _U, F.lit(3).cast("long")).otherwise(F.lit(1).cast("long")))  # letters sort after ':'


def _windows(codes: Column, size: int) -> Column:
    """(pos, h) of every window of that many words; none in shorter texts."""
    n = F.size(codes) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(codes, i, size)).alias("h"))))


def _plain(w: Column) -> Column:
    """The word without its mark."""
    return F.translate(w, _P + _U, "")


def _every(codes: Column, least: int) -> Column:
    """Windows of the length in ``size``."""
    return F.coalesce(*[F.when(F.col("size") == k, _windows(codes, k)) for k in range(least, WINDOW + 1)])


def _templates(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, text, words, size, codes, good, total): items with words; good windows have enough literal words."""
    w = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).withColumn("words", words(F.col("text"))).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    w = w.withColumn("size", F.least(F.size("words"), F.lit(WINDOW))).withColumn("codes", _codes(F.col("words")))
    good = F.filter(_every(F.col("codes"), LEAST), lambda x: F.size(F.filter(F.slice(F.col("codes"), x["pos"], F.col("size")), lambda c: ~c.between(1, 3))) >= LITERAL)
    return w.withColumn("good", good).withColumn("total", F.when(F.size("words") >= LEAST, F.size("good")).otherwise(0))


def _spelled(text: Column) -> Column:
    """Array of plain words; each character of a script without spaces is one."""
    return F.transform(words(F.regexp_replace(text, f"({_UNSPACED})", " $1 ")), _plain)


def _verbatim(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, total, size, at, h): windows of plain words of the items that templates can't find."""
    w = _templates(items, item_col, text_col).where((F.col("total") == 0) | F.col("text").rlike(_UNSPACED)).select("item_id", F.transform(_spelled(F.col("text")), lambda x: F.xxhash64(x)).alias("codes"))
    w = w.withColumn("size", F.least(F.size("codes"), F.lit(WINDOW))).withColumn("x", _every(F.col("codes"), 1)).withColumn("total", F.size("x"))
    return w.select("item_id", "total", "size", F.explode("x").alias("x")).select("item_id", "total", "size", F.col("x.pos").alias("at"), "x.h")


def _benchmark(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words, size, total, pos, h): windows with enough literal words; total counts their places.

    Each place has the window as it stands; with names and units as words, for documents all in one case; and, at the
    start, with the first word as a name, which is how its capital looks in the midst of another sentence.
    """
    w = _templates(items, item_col, text_col).where("total > 0")
    plain, named = _codes(F.transform("words", _plain)), F.concat(F.array(F.lit(2).cast("long")), F.slice("codes", 2, F.size("codes")))
    every = lambda codes: _every(codes, LEAST)
    ways = F.array_union(F.col("good"), F.array_union(every(plain), F.slice(every(named), 1, 1)))
    places = F.filter(F.array_distinct(ways), lambda x: F.array_contains(F.transform("good", lambda g: g["pos"]), x["pos"]))
    return w.select("item_id", "words", "size", "total", F.explode(places).alias("x")).select("item_id", "words", "size", "total", "x.pos", "x.h")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", enough: int = ENOUGH) -> DataFrame:
    """One row per document and item leaked into it: id, ``item_id``, ``windows`` (consistent ones of the item's), ``of`` (the item's), ``verbatim`` (no slot differs).

    Null and empty texts, on either side, match nothing; items without an id aren't searched; items that are searched as
    they stand count windows of plain words; documents without an id
    are reported with a null id; repeated rows are one document. Empty tables give an empty one. Other columns aren't read.
    """
    from strandlake.llm._work import materialise

    bench = materialise(_benchmark(items, item_col, item_text_col), "benchmark-windows")
    short = sorted(r[0] for r in bench.where(F.col("size") < WINDOW).select("size").distinct().collect())  # at most WINDOW - LEAST values
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col), text)
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("row"))
    coded = slim.select("row", _codes(words(F.col("text"))).alias("codes"))
    found = F.flatten(F.array(*[F.coalesce(_windows(F.col("codes"), k), F.array().cast("array<struct<pos:int,h:bigint>>")) for k in [*short, WINDOW]]))
    lookup = bench.select("item_id", "total", F.col("pos").alias("at"), "h")
    hits = coded.select("row", F.explode(found).alias("x")).select("row", "x.pos", "x.h").join(_small(lookup), "h")
    # A diagonal is an alignment of document and item; rows of one document meet here, and only what matched.
    diagonal = hits.groupBy("row", "item_id", "total", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count_distinct("at").alias("n"))
    best = materialise(diagonal.groupBy("row", "item_id", "total").agg(F.sum("n").alias("n"), F.collect_set("shift").alias("shifts")).where(F.col("n") >= F.least(F.lit(enough), "total")), "candidates")
    texts = slim.join(_small(best.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"]).select("row", "id", words(F.col("text")).alias("words"))
    item_words = bench.select("item_id", F.col("words").alias("item"), "size", F.col("pos")).groupBy("item_id", "item", "size").agg(F.collect_set("pos").alias("starts"))
    pair = best.join(texts, "row").join(item_words, "item_id")
    one = pair.select("id", "row", "item_id", "item", "size", "starts", "total", "words", F.explode("shifts").alias("shift"))
    # Windows of this alignment that match word by word, slots by kind.
    kind = lambda w: F.coalesce(_slot(w), w)
    same = F.zip_with("item", F.slice(F.concat(F.array_repeat(F.lit("\u0004"), F.greatest(-F.col("shift"), F.lit(0))), "words"), F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item")), lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.coalesce((kind(a) == kind(b)) | (_plain(a) == _plain(b)), F.lit(False)).alias("ok")))
    # Each of these is read many times by the next step's lambdas, and the optimiser would put it inside them.
    laid = materialise(one.withColumn("laid", same).drop("words", "item"), "laid")
    laid = laid.withColumn("hit", F.array_sort(F.filter("starts", lambda s: F.forall(F.slice("laid", s, F.col("size")), lambda x: x["ok"]))))
    laid = laid.withColumn("exact", F.filter("hit", lambda s: F.forall(F.slice("laid", s, F.col("size")), lambda x: _plain(x["a"]) == _plain(x["b"]))))
    laid = materialise(laid, "hits")
    numbered = F.transform("laid", lambda x, i: F.struct((i + 1).alias("at"), _plain(x["a"]).alias("a"), _plain(x["b"]).alias("b"), _slot(x["a"]).isNotNull().alias("slot")))
    inside = F.filter(numbered, lambda x: x["slot"] & F.exists("hit", lambda s: (x["at"] >= s) & (x["at"] < s + F.col("size"))))
    slots = materialise(laid.withColumn("slots", inside).drop("laid"), "slots")
    # For each slot the last one before it that contradicts it.
    clash = F.transform("slots", lambda y: F.struct(F.array_max(F.transform(F.filter("slots", lambda x: (x["at"] < y["at"]) & (x["a"] == y["a"]) & (x["b"] != y["b"])), lambda x: x["at"])).alias("first"), y["at"].alias("second")))
    slots = materialise(slots.withColumn("clashes", F.filter(clash, lambda c: c["first"].isNotNull())), "clashes")
    # A run from s ends before the first clash that lies within it.
    end = lambda s: F.array_min(F.transform(F.filter("clashes", lambda c: c["first"] >= s), lambda c: c["second"]))
    runs = F.transform("hit", lambda s: F.struct(s.alias("from"), F.coalesce(end(s), F.lit(2**31 - 1)).alias("end")))
    slots = materialise(slots.withColumn("runs", F.when(F.size("clashes") > 0, runs)), "runs")
    run = lambda r: F.filter("hit", lambda t: (t >= r["from"]) & (t + F.col("size") <= r["end"]))
    sets = F.transform("runs", lambda r: F.struct(F.size(run(r)).alias("n"), run(r).alias("windows")))
    longest = F.coalesce(F.array_max(sets)["windows"], F.col("hit"))
    kept = slots.withColumn("best", F.when(F.size(longest) >= F.size("exact"), longest).otherwise(F.col("exact")))
    verbatim = F.forall("slots", lambda x: x["a"] == x["b"])
    merged = kept.groupBy("id", "row", "item_id", "total").agg(F.size(F.array_distinct(F.flatten(F.collect_list("best")))).alias("windows"), F.every(verbatim).alias("verbatim"))
    spelled = materialise(_verbatim(items, item_col, item_text_col), "verbatim-windows")
    sizes = sorted(r[0] for r in spelled.select("size").distinct().collect())  # at most WINDOW values
    if sizes:
        plain = slim.select("id", "row", F.transform(_spelled(F.col("text")), lambda x: F.xxhash64(x)).alias("codes"))
        seen = F.flatten(F.array(*[F.coalesce(_windows(F.col("codes"), k), F.array().cast("array<struct<pos:int,h:bigint>>")) for k in sizes]))
        alike = plain.select("id", "row", F.explode(seen).alias("x")).select("id", "row", "x.pos", "x.h").join(_small(spelled.drop("size")), "h")
        aligned = alike.groupBy("id", "row", "item_id", "total", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count_distinct("at").alias("windows"))
        exact = aligned.groupBy("id", "row", "item_id", "total").agg(F.max("windows").cast("int").alias("windows")).withColumn("verbatim", F.lit(True))
        merged = merged.unionByName(exact)
    leaked = merged.where(F.col("windows") >= F.least(F.lit(enough), "total"))
    if sizes:  # an item may be found in both ways
        leaked = leaked.groupBy("id", "row", "item_id").agg(F.max(F.struct("windows", "total", "verbatim")).alias("x")).select("id", "row", "item_id", "x.*")
    return leaked.select(F.col("id").alias(id_col), "item_id", F.col("windows").cast("long"), F.col("total").cast("long").alias("of"), "verbatim")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of documents into which no item leaked, columns as they are. Rows without an id stay."""
    from strandlake.llm._work import materialise

    leaked = materialise(matches(docs, items, id_col, text_col, **names).select(F.col(id_col).alias("__leaked")).where("__leaked is not null").distinct(), "leaked")
    return docs.join(_small(leaked), F.col(id_col) == F.col("__leaked"), "left_anti")
