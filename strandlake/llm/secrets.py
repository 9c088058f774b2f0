"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL operations only.

A candidate is a run of ``MIN_LENGTH`` or more letters, digits and ``_ + / -`` with up to two ``=``. Splitting a text at
its candidates gives the stretches between them, whose ends are the neighbouring words, with the candidate before. The
forest looks at

* length, and shares of digits, upper case, vowels and distinct characters, whether all is hexadecimal;
* character transitions: changes of class, and how many adjacent letters are frequent pairs of written language;
* dictionary coverage: the share that common words and code terms make up;
* path: slashes and dots in and around it, and whether the document's path names tests, examples or lock files;
* neighbouring words that go with credentials, with digests and identifiers, and an assignment just before.

It is trained on labelled findings, bounded by construction: ``labelled_findings`` makes them, and callers can pass
their own of the same columns. The trees become one SQL expression, which is applied within each row, so scanning
needs no shuffle and Spark can run any partition again alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 16
CANDIDATE = f"[A-Za-z0-9_+/\\-]{{{MIN_LENGTH},}}={{0,2}}"
#: Share of trees that must call a candidate a secret.
THRESHOLD = 0.6
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|hi|ri|ro|ic|ne|ll|ra|li|ch|om|ur|ei|ie|ge|un|au|sc|qu|ment|la|de|be|tz|pf|eu|bl|ly|wh|ed|nn|em"
_WORDS = "the|and|with|that|this|from|have|not|your|you|example|sample|dummy|fake|test|demo|placeholder|change|replace|insert|here|todo|name|value|string|number|index|config|default|public|private|static|class|function|return|import|module|package|version|release|build|file|path|user|admin|service|server|client|request|response|session|token|secret|password|access|api|key|http|https|www|com|org|net|src|lib|bin|usr|var|home|data|table|column|type|list|array|map|set|get|put|post|header|content|text|html|json|xml|image|icon|button|time|date|hour|tion|ment|ing|ung|heit|keit|lich|ation|elle|mente|cion"
_FOR = "(key|token|secret|passw|pwd|auth|credential|bearer|api|private|signature|access)"
_AGAINST = "(sha|md5|commit|hash|checksum|digest|uuid|guid|etag|integrity|revision|example|dummy|placeholder|sample|fixture|version|href|src=|url|image|blob)"
FEATURES = ["length", "digits", "upper", "vowels", "distinct_chars", "hexadecimal", "transitions", "pairs", "dictionary", "slashes", "in_path", "test_path", "credential_words", "digest_words", "assigned"]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(c: Column, left: Column, right: Column, path: Column) -> list[Column]:
    """The forest's inputs, in the order of ``FEATURES``; neighbours are what stands before and after, path may be null."""
    n = F.length(c).cast("double")
    low = F.lower(c)
    before, after = F.lower(F.right(left, F.lit(40))), F.lower(F.left(right, F.lit(20)))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]+", "U"), "[a-z]+", "l"), "[0-9]+", "d")
    around = F.concat(before, F.lit(" "), after)
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        n, _count(c, "[0-9]") / n, _count(c, "[A-Z]") / n, _count(low, "[aeiou]") / n, F.size(F.array_distinct(F.split(c, ""))) / n,
        yes(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), (F.length(F.regexp_replace(kinds, "[^A-Za-z0-9]", "ss")) - 1) / n, _count(low, _PAIRS) / n, _count(low, _WORDS) / n,
        _count(c, "/") / n, yes(F.right(left, F.lit(3)).rlike("[/.\\\\]$") | F.left(right, F.lit(2)).rlike("^[/\\\\]|^\\.[a-z]")), yes(F.lower(path).rlike("test|example|sample|fixture|mock|doc|vendor|\\.lock")),
        yes(before.rlike(_FOR)), yes(around.rlike(_AGAINST)), yes(before.rlike("[=:]\\s*[\"'`]?$")),
    ]


def labelled_findings(spark: SparkSession, each: int = 300, first: int = 0) -> DataFrame:
    """(candidate, before, after, path, label): ``each`` findings of every kind, made by hashing a counter from ``first`` on.

    Secrets are random strings of usual alphabets and lengths, mostly beside credential words; the rest are digests,
    identifiers, paths, constants, placeholders, long words and numbers, mostly beside the words that go with them.
    """
    h = lambda salt: F.concat(F.sha2(F.concat(F.lit(salt), F.col("n").cast("string")), 256), F.md5(F.concat(F.lit(salt), F.col("n").cast("string"))))
    b64 = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "=", "")
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(salt), "n"), F.lit(len(xs))) + 1).cast("int"))
    syllables = ["the", "ing", "tion", "er", "an", "re", "on", "at", "en", "nd", "sch", "keit", "ung", "lich", "ment", "eau", "elle", "cion", "mente", "ado", "un", "st", "ver", "be", "que", "our", "ble", "ly", "ber", "ersch", "tz", "pf", "ach", "ge", "ein", "au"]
    word = lambda salt, k: F.concat(*[pick(f"{salt}{i}", *syllables) for i in range(k)])
    terms = ["user", "config", "default", "service", "request", "session", "value", "index", "path", "public", "server", "token", "table", "header", "access", "client", "module", "build"]
    term = lambda salt, sep, k: F.concat_ws(sep, *[pick(f"{salt}{i}", *terms) for i in range(k)])
    credential = pick("c", 'token = "', "api_key: ", 'password="', "Authorization: Bearer ", "SECRET_KEY=", "access token '", "client_secret = '", "auth=")
    prose = pick("p", "the value is ", "and then ", "Ce qui est ", "in der ", "see also ", "of ", "")
    digest = pick("d", "commit ", "sha256: ", "md5=", "checksum ", "etag: \"", "integrity sha1-", "revision ", "digest = '")
    path = pick("f", "src/app.py", "config/prod.env", "notes.txt", "web/index.html", None)
    test_path = pick("g", "tests/test_api.py", "examples/demo.md", "vendor/x.lock", "docs/usage.md")
    size = lambda lo, hi: (F.lit(lo) + F.pmod(F.xxhash64(F.lit("s"), "n"), F.lit(hi - lo + 1))).cast("int")
    mixed = lambda a, b: F.when(F.pmod(F.xxhash64(F.lit("m"), "n"), F.lit(5)) > 0, a).otherwise(b)
    kinds = [
        (F.left(h("a"), pick("l", 32, 40, 64)), credential, path, 1), (F.left(b64("b"), size(24, 44)), mixed(credential, prose), path, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.left(F.translate(b64("k"), "+/", "ab"), F.lit(16)))), mixed(credential, prose), path, 1),
        (F.concat(pick("x", "ghp_", "sk_live_", "xoxb-", "glpat-"), F.left(F.translate(b64("g"), "+/", "ab"), size(24, 36))), mixed(credential, prose), path, 1),
        (F.left(F.translate(b64("r"), "+/", "-_"), size(20, 43)), credential, path, 1), (F.left(h("z"), size(24, 40)), credential, path, 1),
        (F.left(h("e"), pick("l", 32, 40, 64)), digest, path, 0), (F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12)), mixed(pick("i", "id: ", "uuid=", "guid ", "request "), prose), path, 0),
        (word("w", 5), prose, path, 0), (F.initcap(word("v", 6)), prose, path, 0), (F.upper(word("y", 5)), prose, path, 0), (F.upper(word("ya", 7)), prose, path, 0), (F.upper(word("yb", 4)), prose, path, 0), (word("q", 4), credential, path, 0),
        (F.concat_ws("/", word("a", 2), word("b", 2), term("p", "_", 2)), pick("t", "/", "./", "see /", "http://example/"), path, 0), (F.upper(term("t", "_", 3)), mixed(credential, prose), path, 0), (term("h", "-", 3), mixed(credential, prose), path, 0),
        (F.concat(pick("o", "your_", "my-", "example_", "insert_", "dummy-"), term("o", "_", 2), F.lit("_here")), credential, mixed(test_path, path), 0), (F.repeat(pick("j", "x", "0", "a", "-", "_", "1"), size(16, 40)), mixed(credential, prose), path, 0),
        (F.translate(F.left(h("n"), size(16, 24)), "abcdef", "012345"), prose, path, 0), (F.left(h("t"), F.lit(32)), credential, test_path, 0),
    ]
    rows = [F.struct(c.alias("candidate"), b.alias("before"), pick("e", '"', "'", " ", "\n", ",", "").alias("after"), p.alias("path"), F.lit(y).cast("double").alias("label")) for c, b, p, y in kinds]
    return spark.range(first, first + each).withColumnRenamed("id", "n").select(F.explode(F.array(*rows)).alias("x")).select("x.*").where(F.length("candidate") >= MIN_LENGTH)


def _expression(tree: str) -> str:
    """A printed decision tree as nested SQL conditions."""
    lines = [x.strip() for x in tree.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        f, x = re.match(r"If \(feature (\d+) <= ([-+.\dEe]+)\)", line).groups()
        yes = node()
        at += 1  # the Else line
        return f"IF(x[{f}] <= {float(x)!r}D, {yes}, {node()})"

    return node()


def train(findings: DataFrame, trees: int = 25, depth: int = 7, seed: int = 5) -> str:
    """Random forest over labelled findings -> SQL expression over ``x``, the array of features: the share of trees that say secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    x = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    # One partition in a fixed order: bootstraps follow it, so the same findings give the same forest.
    rows = findings.select("label", *(f.alias(n) for f, n in zip(x, FEATURES, strict=True))).repartition(1).sortWithinPartitions("label", *FEATURES).cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="x", labelCol="label", featureSubsetStrategy="sqrt").fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    rows.unpersist()
    return f"({' + '.join(_expression(t.toDebugString) for t in model.trees)}) / {trees}"


def _scored(docs: DataFrame, model: str, text_col: str, path_col: str | None, keep: str) -> DataFrame:
    """``keep``: array column (candidate, secret, score); ``__gaps``: what stands between candidates."""
    text = F.col(text_col).cast("string")
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    has = docs.withColumn("__found", F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))).withColumn("__gaps", F.when(F.col("__found").isNotNull(), F.split(text, CANDIDATE, -1)))
    # A long name before the value (CLIENT_SECRET_KEY=...) is a candidate itself, and yet the value's neighbour.
    left = lambda i: F.concat(F.coalesce(F.get("__found", i - 1), F.lit("")), F.col("__gaps")[i])
    vector = has.withColumn("__x", F.transform("__found", lambda c, i: F.array(*features(c, left(i), F.col("__gaps")[i + 1], path))))
    score = vector.withColumn("__score", F.expr(f"transform(__x, x -> {model})"))
    return score.withColumn(keep, F.arrays_zip(F.col("__found").alias("candidate"), F.col("__score").alias("score"))).drop("__x", "__score", "__found")


def scan(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per secret found: id, ``start`` (characters before it), ``length``, ``score``, ``sha256`` (never the secret).

    Null and empty texts have none; null ids stay null; repeated rows report again; an empty table gives an empty one.
    """
    found = _scored(docs.select(F.col(id_col), F.col(text_col), *([path_col] if path_col and path_col in docs.columns and path_col not in (id_col, text_col) else [])), model, text_col, path_col, "__hits")
    # Numbering rows first keeps the filter above: pushed down, it would put the splitting of the text into its lambdas.
    some = found.select(F.col(id_col).alias("id"), "__gaps", "__hits", F.monotonically_increasing_id().alias("row")).where(F.exists("__hits", lambda x: x["score"] >= threshold))
    each = some.select("id", "row", F.posexplode(F.transform("__hits", lambda x, i: F.struct(x["candidate"].alias("c"), x["score"].alias("score"), F.length(F.col("__gaps")[i]).alias("gap")))).alias("seq", "x"))
    spans = each.selectExpr("id", "x.c", "x.score", "sum(x.gap + length(x.c)) OVER (PARTITION BY row ORDER BY seq ROWS UNBOUNDED PRECEDING) - length(x.c) AS start")
    return spans.where(F.col("score") >= threshold).select(F.col("id").alias(id_col), F.col("start").cast("long"), F.length("c").alias("length"), F.col("score"), F.sha2("c", 256).alias("sha256"))


def redact(docs: DataFrame, model: str, text_col: str = "text", path_col: str | None = "source", mark: str = "<secret>", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, each secret in the text replaced by ``mark``; everything else stays as it is."""
    found = _scored(docs, model, text_col, path_col, "__hits")
    parts = F.transform("__hits", lambda x, i: F.concat(F.col("__gaps")[i], F.when(x["score"] >= threshold, F.lit(mark)).otherwise(x["candidate"])))
    text = F.when(F.exists("__hits", lambda x: x["score"] >= threshold), F.concat(F.array_join(parts, ""), F.element_at("__gaps", -1))).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(docs.columns)
