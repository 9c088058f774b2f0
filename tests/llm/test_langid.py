import zlib

import numpy as np
from pyspark.sql import functions as F
from strandlake.llm import langid

from .conftest import AWKWARD


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_label_and_source_are_not_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    a = langid.predicted(docs, model).select("doc_id", "lang_pred").collect()
    b = langid.predicted(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).select("doc_id", "lang_pred").collect()
    assert sorted(a) == sorted(b)
    hidden = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.learn(hidden).languages


def test_awkward(awkward, nothing):
    got = langid.identify(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert sorted(map(str, ((r.doc_id, r.held_out) for r in got))) == sorted(str((i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2)) for i, *_ in AWKWARD)
    letterless = {r.doc_id: r.lang_pred for r in got}
    assert letterless[2] == letterless[3] == letterless[4] == letterless[9] == "und" and letterless[1] == "en"
    assert langid.identify(nothing).count() == 0


def test_rare_languages_and_huge_tables_are_learned_from(spark, monkeypatch):
    texts = {"en": "the cat sat on the mat", "de": "der hund und die katze", "qq": "zyx wvu zyx qoph"}
    rows = [(i, texts["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(3000)] + [(5000 + i, texts["qq"], "qq") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(docs, most=30).languages == ["de", "en", "qq"]


def test_clashing_output_names(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 5.0, "x")], "doc_id long, text string, lang string, score double, lang_pred string")
    out = langid.predicted(docs, langid.learn(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and 0 <= out.first().score <= 1


def test_table_equals_vectors():
    texts = ["abc abd", "xyz zyx xxy", "abc xyz"]
    docs, keys, n = langid._profiles(*langid._trigrams(texts))
    known = np.unique(keys)
    weights = np.stack([np.bincount(np.searchsorted(known, keys[docs == d]), n[docs == d], len(known)) for d in (0, 1)], 1)
    model = langid.Prototypes(["a", "x"], known, weights)
    bundled = weights.T @ langid.vectors(known)
    doc = np.bincount(np.searchsorted(known, keys[docs == 2]), n[docs == 2], len(known)) @ langid.vectors(known)
    cosines = bundled @ doc / np.linalg.norm(bundled, axis=1) / np.linalg.norm(doc)
    langs, scores = model.predict(texts)
    assert langs[:2] == ["a", "x"] and langs[2] == ["a", "x"][cosines.argmax()] and abs(scores[2] - cosines.max()) < 0.05
