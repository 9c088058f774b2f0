import hashlib
import re

import corpus_pipeline
import public_tokenizers as P
from strandlake.llm._work import on_workers
from tokenizers import Tokenizer

from .test_simhash import brute_components, brute_fingerprint


def test_stages_and_run_against_brute_force(spark):
    on_workers(spark)
    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and any(c.isalpha() for c in r.text)]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    points = {}
    for i, f in sorted(fps.items()):
        points.setdefault(f, i)
    classes = brute_components(points)
    docs = [r for r in docs if classes[fps[r.doc_id]] == r.doc_id]
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [r for r in docs if not any(i in norm(r.text) for i in items)]
    library, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in docs:
        text = re.sub(r'token = "[0-9a-f]{40}"', 'token = "<secret>"', r.text)
        ids = library.encode(text, add_special_tokens=False).ids
        want[r.doc_id] = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_stages_take_awkward_documents(spark, awkward, nothing):
    on_workers(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (awkward.select(columns), nothing.select(columns)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert k == 4 or out.columns == columns
            assert (out.count() > 0) == (docs is not None and not docs.isEmpty())
