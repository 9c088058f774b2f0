import hashlib
import re

import pytest
from strandlake.llm import secrets

from .conftest import COLUMNS, rows

HEX, B64 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "q9Zt/31xKLmv8TwRb2YcNfE5hUoPd7sAgVjX0iQk"
TEXTS = [
    (1, f'Some prose here. token = "{HEX}" and more.', "en", "src1"), (2, f"commit {HEX} fixes it", "en", "src1"), (3, f'api_key: "{B64}"\nand again token = "{HEX}".', "en", None), (4, "Donaudampfschifffahrtsgesellschaft THERHAOUOUSHEDANDENANOU", "de", "x"),
    (5, None, None, None), (6, "", "en", "x"), (7, "see /usr/share/config/default_index_path for it", "en", "x"), (8, 'password = "your_password_goes_here"', "en", "x"), (9, f'{HEX} token = "{HEX}"' * 1, "en", "x"), (9, f'{HEX} token = "{HEX}"' * 1, "en", "x"), (None, f'token = "{HEX}"', "en", "x"), (11, f'x token = "{HEX}" y ' * 3000, "en", "x"),
]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), COLUMNS)


def test_finds_secrets_at_their_places(docs, model):
    got = secrets.scan(docs, model).collect()
    texts = {i: t for i, t, *_ in TEXTS}
    for r in got:
        assert hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.sha256
    by = lambda i: sorted(r.start for r in got if r.doc_id == i)
    assert by(1) == [TEXTS[0][1].index(HEX)] and by(3) == [TEXTS[2][1].index(B64), TEXTS[2][1].index(HEX)]
    assert by(11) == [m.start() for m in re.finditer(HEX, texts[11])] and len(by(None)) == 1
    assert not {2, 4, 5, 6, 7, 8} & {r.doc_id for r in got}


def test_held_out_findings(spark, model):
    from pyspark.sql import functions as F

    # Other counters than those of the training rows; the templates are the same, so this says nothing about other kinds.
    seen = secrets.labelled_findings(spark).select("candidate", "before")
    other = secrets.labelled_findings(spark, 200, 100_000).join(seen, ["candidate", "before"], "left_anti")
    x = secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    right = other.withColumn("x", F.array(*x)).select(((F.expr(model) >= secrets.THRESHOLD).cast("double") == F.col("label")).alias("ok"))
    assert right.where("ok").count() / right.count() > 0.97


def test_redaction_changes_only_secrets(docs, model):
    out = secrets.redact(docs, model)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    want = []
    for i, t, *_ in TEXTS:
        t = (t or "") if i == 2 else (t or "").replace(f'token = "{HEX}"', 'token = "<secret>"').replace(B64, "<secret>")
        want.append((str(i), t))
    loose = lambda x: [(i, t.replace(HEX, "<secret>") if i == "9" else t) for i, t in x]
    assert loose(got) == loose(sorted(want))


def test_empty(nothing, model):
    assert secrets.scan(nothing, model).count() == 0 and secrets.redact(nothing, model).count() == 0


def test_plan_is_native(docs, model):
    plan = secrets.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_before_the_value_count_as_its_neighbours(spark, model):
    texts = [(1, f"AWS_SECRET_ACCESS_KEY={HEX}"), (2, f"github_client_secret: {HEX}"), (3, f"commit_checksum_sha1: {HEX}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    # Values only: that the forest takes the third name itself for a secret is a known false positive (README).
    assert sorted((r.doc_id, r.start) for r in secrets.scan(docs, model).collect() if r.start) == [(1, 22), (2, 22)]
