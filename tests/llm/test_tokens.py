import hashlib
import random

import public_tokenizers as P
import pytest
from strandlake.llm import bpe
from strandlake.llm.tokens import encode_decode, round_trip, token_counts
from tokenizers import Tokenizer

from .conftest import AWKWARD

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_same_ids_and_text_as_the_library(path):
    ours, library, rng = bpe.Bpe(path), Tokenizer.from_file(path), random.Random(1)
    parts = ["abc", "'s", "'RE", "é", "ß", "İ", "Σ", "ς", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "12", "½", "中文", "🙂", "é", "<|endoftext|>", "<|startoftext|>", "!", "...", "the", "\x00", "ª", "“", "unbelievabletion", "Xy9"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == ids
        assert ours.decode(ours.encode(text)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_backtracking_needs_more_than_greedy_matches():
    ours, library, rng = bpe.Bpe(WORD), Tokenizer.from_file(WORD), random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(1, 25)))
        assert ours.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_tables_age_without_changing_results():
    small = bpe._Table(room=3)
    made = [small.all_of({str(i % 7), str(i % 5)}, lambda keys: [k * 2 for k in keys]) for i in range(100)]
    assert all(m == {k: k * 2 for k in m} for m in made) and [set(m) for m in made] == [{str(i % 7), str(i % 5)} for i in range(100)]
    assert len(small.young) <= 3 and len(small.old) <= 3
    long = "x" * (bpe.KEPT_LETTERS + 1)
    assert small.all_of({long}, lambda keys: [1]) == {long: 1} and long not in small.young


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_columns_and_counts_are_those_of_single_texts(path):
    coder, library, rng = bpe.Bpe(path), Tokenizer.from_file(path), random.Random(4)
    parts = ["abc", " ", "  ", "\n", "don't", "12.5", "é", "İ", "\x1c", "\x85", "中", "<|endoftext|>", "Wörter,", "thonti", "q" * 60, "(x)"]
    texts = [None, "", " "] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    ids, count = coder.encode_column(bpe.pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and count.tolist() == [len(w) for w in want] == list(coder.count_all(texts))
    assert [b.decode() for b in coder.decode_all(ids, count)] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert coder.encode_column(bpe.pa.array([], bpe.pa.string()))[1].tolist() == []


def test_encode_decode_awkward(awkward, nothing):
    library = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, encode_decode(awkward, WORD, keep_ids=True).collect()), key=str)
    want = []
    for i, t, *_ in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    assert encode_decode(nothing, WORD).count() == 0


def test_counts_awkward(awkward, nothing):
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, token_counts(awkward, BYTE, limit=10).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 10) for i, t, *_ in AWKWARD]
    assert got == sorted(want, key=str)
    assert token_counts(nothing, BYTE).count() == 0


def test_round_trip_keeps_other_columns(awkward):
    out = round_trip(awkward, BYTE, out_col="text")
    assert out.columns == awkward.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t, *_ in AWKWARD)


def test_a_worker_gives_its_memory_back(spark, monkeypatch):
    import ctypes
    import gc

    import psutil
    import pyarrow as pa

    docs, taken = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, g=type(docs).mapInArrow: taken.append(f) or g(self, f, schema))
    encode_decode(docs, WORD)
    rng, resident = random.Random(7), lambda: psutil.Process().memory_info().rss >> 20
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(6000)]
    run, batch = taken[-1], pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts)], names=["id", "text"])
    list(run(iter([batch.slice(0, 10)])))  # the vocabulary is loaded
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    before, peak = resident(), 0
    for _ in run(iter([batch])):
        peak = max(peak, resident())
    assert peak - before < 200 and resident() - before < 25
