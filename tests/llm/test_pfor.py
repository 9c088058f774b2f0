import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandlake.llm import pfor
from tokenizers import Tokenizer

from .conftest import AWKWARD

WORD = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.integers(0, 32))
def test_pack_round_trip(values, bits):
    ids = (np.array(values, np.uint64) >> np.uint64(32 - bits)).astype(np.uint32)
    blocks, starts = pfor.pack(ids)
    assert (pfor.unpack(b"".join(blocks), starts, len(ids)) == ids).all()


def test_file_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(5000) < 0.03, rng.integers(0, 2**31, 5000), rng.integers(0, 500, 5000)).astype(np.uint32)
    data = pfor.write_bytes([1, None, 3], [2000, 0, 3000], ids)
    docs, sizes, back = pfor.read_bytes(data)
    assert docs == [1, None, 3] and sizes.tolist() == [2000, 0, 3000] and (back == ids).all() and len(data) < 4 * 5000
    for a, b in ((0, 1), (255, 257), (100, 4900), (4999, 5000), (7, 7), (4000, 9999)):
        assert (pfor.read_ids(data, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError, match="format"):
        pfor.read_bytes(b"x" * 64)


@pytest.mark.parametrize("file_ids", [pfor.FILE_IDS, 50])
def test_awkward(awkward, nothing, monkeypatch, file_ids):
    monkeypatch.setattr(pfor, "FILE_IDS", file_ids)
    library = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, pfor.token_files(awkward, WORD).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t, *_ in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert pfor.token_files(nothing, WORD).count() == 0


def test_files_lie_in_the_folder_and_open_by_path(spark, awkward, tmp_path):
    manifest = pfor.write_files(awkward, WORD, str(tmp_path / "out")).collect()
    library, texts = Tokenizer.from_file(WORD), {}
    for r in manifest:
        docs, sizes, ids = pfor.read_bytes((tmp_path / "out" / r.name).read_bytes())
        assert len(ids) == r.n_tokens == sizes.sum()
        for d, end, n in zip(docs, np.cumsum(sizes), sizes, strict=True):
            texts.setdefault(d, []).append(ids[end - n : end].tolist())
    want = {}
    for i, t, *_ in AWKWARD:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in want.items()}
    assert {r.name for r in manifest} == {f.name for f in (tmp_path / "out").iterdir() if f.suffix == ".pfor"}
