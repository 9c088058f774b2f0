"""Language identification with hyperdimensional letter profiles.

Every letter has a random vector of +-1 in ``DIMENSIONS`` places, fixed by its code point. A trigram binds its letters'
vectors, each rotated by its place, through the element-wise product; a document or language bundles (adds) those of
its trigrams. Word ends are a letter of their own. A document goes to the prototype of largest cosine.

Bundling and the dot product are linear, so a document's dot product with a prototype is the sum over its trigrams of
count * <trigram, prototype>; those products are tabled once per trigram, and no document vector is laid out. The
document's own length is common to all prototypes, so it can't change the choice; the score divides by its expected
value, sqrt(DIMENSIONS * sum of squared counts), which holds since random vectors are nearly orthogonal.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tokens import slices

DIMENSIONS = 4096
#: Documents that prototypes are learned from, about: an equal number of each language, chosen by hash; all of a language with fewer.
TRAINING_DOCUMENTS = 20_000
SLICE = 128


@functools.lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, key) of every trigram centred on a letter; a key packs three code points of 21 bits."""
    joined = "\n\n".join(t or "" for t in texts) + "\n"
    codes = _lower_letters()[np.frombuffer(("\n" + joined).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
    sizes = np.array([len(t or "") for t in texts])
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    at = np.flatnonzero(codes)
    return np.searchsorted(starts, at, side="right") - 1, codes[at - 1] << 42 | codes[at] << 21 | codes[at + 1]


def _profiles(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, count), each pair once."""
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(keys) != 0)])) if len(docs) else np.zeros(0, int)
    return docs[first], keys[first], np.diff(np.append(first, len(docs)))


def vectors(keys: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The trigrams' vectors, int8."""
    letters = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF])
    known, where = np.unique(letters, return_inverse=True)
    table = np.stack([np.random.default_rng([7, int(c)]).integers(0, 2, dimensions, np.int8) * 2 - 1 for c in known]) if len(known) else np.zeros((0, dimensions), np.int8)
    a, b, c = where.reshape(3, -1)
    return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


class Prototypes:
    """Languages, and the table trigram -> cosine numerators with each language's prototype."""

    def __init__(self, languages: list[str], keys: np.ndarray, weights: np.ndarray, dimensions: int = DIMENSIONS):
        """keys: sorted distinct trigrams; weights: (trigram, language) bundled weight."""
        self.languages, self.keys, self.dimensions = languages, keys, dimensions
        bundled = np.zeros((len(languages), dimensions))
        for at in range(0, len(keys), 4096):
            bundled += weights[at : at + 4096].T @ vectors(keys[at : at + 4096], dimensions)
        length = np.linalg.norm(bundled, axis=1)
        bundled /= np.where(length, length, 1)[:, None]
        products = [vectors(keys[at : at + 4096], dimensions) @ bundled.T for at in range(0, len(keys), 4096)]
        self.table = np.concatenate([*products, np.zeros((1, len(languages)))])  # last: trigrams never learned

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine for each text; `und` and 0 where there are no letters."""
        n, out = len(texts), np.zeros((len(texts), max(1, len(self.languages))))
        squares, any_letter = np.zeros(n), np.zeros(n, bool)
        docs, keys = _trigrams(texts)
        any_letter[docs] = True
        if self.languages and len(docs):
            row = np.searchsorted(self.keys, keys)
            row[(row == len(self.keys)) | (self.keys[np.minimum(row, len(self.keys) - 1)] != keys)] = len(self.keys)
            width = len(self.keys) + 1
            for lo in range(0, n, 16):  # dense counts of a few documents at a time
                hi = min(n, lo + 16)
                a, b = np.searchsorted(docs, [lo, hi])
                counts = np.bincount((docs[a:b] - lo) * width + row[a:b], minlength=(hi - lo) * width).reshape(hi - lo, width).astype(float)
                squares[lo:hi] = (counts**2).sum(1)
                out[lo:hi] = counts @ self.table
        best = out.argmax(1)
        score = out[np.arange(n), best] / np.sqrt(self.dimensions * np.maximum(squares, 1))
        known = any_letter & bool(self.languages)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is held out of learning: crc32 of its id as text, modulo 4, is 2. A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAINING_DOCUMENTS) -> Prototypes:
    """Prototypes from documents that aren't held out and have an id, a text and a language: about ``most`` of them, in
    equal shares by language, so that a rare language keeps its prototype however large the table is.

    A document's profile is brought to length 1 before it is bundled, so long ones don't outweigh the others. What
    comes to the driver is one row per language, and one per language and trigram of the sample.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}  # a row a language
    each = most / max(1, len(sizes))
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    draw = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    share = draw < shares[F.col(lang_col).cast("string")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs == lang)
                for at in range(0, len(mine), SLICE):
                    d, k, c = _profiles(*_trigrams([batch.column(0)[int(i)].as_py() for i in mine[at : at + SLICE]]))
                    if len(d):
                        size = np.sqrt(np.bincount(d, c.astype(float) ** 2))
                        keys, where = np.unique(k, return_inverse=True)
                        weight = np.bincount(where, c / size[d])
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(weight)], names=["lang", "key", "weight"])

    chosen = known.where(share).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")
    found = chosen.mapInArrow(count, "lang string, key long, weight double").groupBy("lang", "key").agg(F.sum("weight").alias("weight")).toPandas()
    languages = sorted(set(found.lang))
    keys, row = np.unique(found.key.to_numpy(np.int64), return_inverse=True)
    weights = np.zeros((len(keys), len(languages)))
    weights[row, [languages.index(x) for x in found.lang]] = found.weight
    return Prototypes(languages, keys, np.round(weights, 6))


def predicted(docs: DataFrame, model: Prototypes, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns, with the language (`und`: null text or no letters) and its cosine, 0 to 1. Only the text is looked at.

    An input column that has an output's name is left out in its favour; name the outputs otherwise to keep it.
    """
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    at = kept.index(text_col) if text_col in kept else None
    if at is None:
        raise ValueError(f"{text_col} can't be an output column")
    slim = docs.select(kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x trigrams seen in a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (few.slice(i, SLICE) for few in slices(batch, at) for i in range(0, few.num_rows, SLICE)):
                langs, scores = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*kept, lang_out, score_out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{fields}, `{lang_out}` string, `{score_out}` double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score``.

    Learns from the table itself, without what is held out. With nothing to learn from, everything is `und`. An empty
    table gives an empty one; repeated rows repeat; a null id stays null, isn't held out and isn't learned from.
    """
    model = learn(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predicted(slim, model).drop("text")
