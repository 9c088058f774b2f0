"""Exact byte-pair encoding by longest matches and backtracking; decoding by an offset table.

The encoder takes, at each position of a pre-token, the longest vocabulary entry that an Aho-Corasick automaton
finds there, and keeps it if the pair with its predecessor is *compatible*, that is if the merge rules would leave
exactly this boundary between the two. Otherwise it tries shorter entries and finally steps back; positions proved
dead are marked, so every (position, entry) is tried once and the work is linear in the pre-token's length. The
result is what applying the merges in rank order gives.

Texts come in batches. All pre-tokens of a batch that aren't in the worker's bounded table yet are run through the
automaton together, as one string with separators; where all pairs along the greedy path are compatible, the path is
the encoding, and only other pre-tokens are searched one by one. Full tables age out and long pre-tokens are not
kept, which costs time only. Texts with characters outside a checked Latin range are split by the tokenizers library
itself, so the split always is the library's; the encoding of the pieces always is the one here.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of each of the two generations of a table of encoded pre-tokens in a worker process, and the longest kept.
TABLE_ENTRIES, KEPT_LETTERS = 250_000, 48
#: Letters of texts that are encoded together, and the size of the table of pair compatibility.
BATCH_LETTERS, PAIR_BITS = 3_000_000, 20
_L = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters outside these make a text take the library's own splitter. U+0130 grows when lower-cased.
_UNCHECKED = re.compile("[^\0-įı-ɏ‐-‧₠-₿]")
#: What isn't letters or white space, piece by piece.
_APART = f"({_SHORT}|[{_N}]|[^{_S}{_L}{_N}]+)"
#: Texts with these are not split at white space by Arrow.
_STRANGE = "[\x1c-\x1f]|[^\x00-\u012f\u0131-\u024f\u2010-\u2027\u20a0-\u20bf]"
_FAST = {
    "words": re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
    "bytes": re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Table:
    """What is made of pre-tokens, in two generations: when the younger is full it becomes the older one, from which what is still used returns."""

    def __init__(self, room: int = TABLE_ENTRIES):
        self.room, self.young, self.old = room, {}, {}

    def all_of(self, keys: set, make: Callable[[list], list]) -> dict:
        """Every key's value; those in neither generation are made together."""
        get, old = self.young.get, self.old.get
        found = {k: v for k in keys if (v := get(k)) is not None}
        rest = keys.difference(found)
        if rest:
            more = {k: v for k in rest if (v := old(k)) is not None}
            new = list(rest.difference(more))
            more.update(zip(new, make(new) if new else (), strict=True))
            found.update(more)
            if len(self.young) + len(more) > self.room:
                self.young, self.old = {}, self.young
            if len(more) > self.room or max(map(len, more)) > KEPT_LETTERS:
                more = {k: v for k, v in more.items() if len(k) <= KEPT_LETTERS} if len(more) <= self.room else {}
            self.young.update(more)
        return found


class Bpe:
    """One vocabulary file of the tokenizers library's JSON format: byte-level, with or without word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model = path, spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        self.lower = spec["normalizer"] is not None
        self.end = model.get("end_of_word_suffix") or ""
        self.split = _FAST["words" if self.end else "bytes"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.letters = _byte_letters()
        # Ranks: base symbols first, then merges in order. Every merged entry must have one derivation.
        joined = [a[: len(a) - len(self.end)] + b if self.end and a.endswith(self.end) else a + b for a, b in merges]
        base = sorted(set(vocab) - set(joined), key=vocab.get)
        if len(set(joined)) != len(joined) or len(base) + len(joined) != len(vocab):
            raise ValueError(f"{path}: some entry has no or several derivations")
        rank = {t: i for i, t in enumerate([*base, *joined])}
        self.ids = [vocab[t] for t in rank]
        self.pairs = {(rank[a], rank[b]): rank[t] for (a, b), t in zip(merges, joined, strict=True)}
        self.halves = [(i, i) for i in range(len(base))] + [(rank[a], rank[b]) for a, b in merges]
        # A word-final letter is a symbol of its own: move it to a private plane, so that one entry letter is one symbol.
        self.automaton = ahocorasick.Automaton()
        for t, i in rank.items():
            s = self._closed(t[: -len(self.end)]) if self.end and t.endswith(self.end) else t
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        # For each entry its length, and the next shorter one that it starts with.
        closed = {s: i for s, i in self.automaton.items()}
        self.shorter, self.sizes = [-1] * len(rank), [0] * len(rank)
        for s, i in closed.items():
            self.sizes[i] = len(s)
            self.shorter[i] = next((closed[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in closed), -1)
        self._sizes, self._ids, self._shorter = np.array(self.sizes), np.array(self.ids, "<u4"), np.array(self.shorter)
        self._trie(closed)
        self._pairs, self._fits = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        # Offset table for decoding: entry i is blob[offsets[i]:offsets[i + 1]], a space after each where no decoder joins.
        by_id = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.gap = b" " if spec["decoder"] is None else b""
        back = {c: b for b, c in enumerate(self.letters)}
        raw = (lambda t: t.encode()) if spec["decoder"] is None else (lambda t: bytes(back[c] for c in t) if t not in self.special else t.encode())
        entries = [raw(by_id[i]) + self.gap if i in by_id else b"" for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
        # By pre-token, and by pre-token in byte letters.
        self.bytes_of, self.mapped_of, self.count_of, self.mapped_count_of = (_Table() for _ in range(4))
        self._library = None

    def __reduce__(self):
        return load, (self.path,)

    # -- splitting ---------------------------------------------------------------------------------------------

    def _closed(self, s: str) -> str:
        return s[:-1] + chr(0xF0000 + ord(s[-1])) if s else s

    def _letters(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The pre-tokens of a text without special tokens; True: they are in byte letters already."""
        if _UNCHECKED.search(text) is None:
            return self.split.findall(text.lower() if self.lower else text), False
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(text)], True

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Plain stretches, and special tokens with their ids."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    # -- encoding ----------------------------------------------------------------------------------------------

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the letters of entries a and b in rank order gives back exactly [a, b]."""
        limit = len(self.halves) + 1
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        return True

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """The table of pair compatibility (left << 20 | right), filled as pairs turn up; a slot holds the last pair that met it."""
        slot = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        strange = self._pairs[slot] != pairs
        fits = self._fits[slot]
        if strange.any():
            new, where = np.unique(pairs[strange], return_inverse=True)
            found = np.fromiter((self._compatible(ab >> 20, ab & 0xFFFFF) for ab in new.tolist()), bool, len(new))
            fits[strange] = found[where]
            self._pairs[slot[strange]], self._fits[slot[strange]] = pairs[strange], fits[strange]
        return fits

    def _trie(self, entries: dict[str, int]) -> None:
        """Entries as sorted keys (node, letter) with the nodes they lead to; node 0 is the root."""
        child, value = {}, [-1]
        for s, i in entries.items():
            node = 0
            for c in map(ord, s):
                key = node << 20 | c
                node = child.get(key) or child.setdefault(key, len(value))
                if node == len(value):
                    value.append(-1)
            value[node] = i
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        self._edges, self._targets, self._values = keys[order], np.fromiter(child.values(), np.int64, len(child))[order], np.array(value)

    def _longest(self, letters: np.ndarray) -> np.ndarray:
        """The longest entry at each letter of pre-tokens that lie one after the other, each followed by a 0."""
        best, live = np.full(len(letters), -1), np.arange(len(letters))
        node = np.zeros(len(letters), np.int64)
        depth = 0
        while len(live):
            key = node << 20 | letters[live + depth]
            at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            on = self._edges[at] == key
            live, node = live[on], self._targets[at[on]]
            value = self._values[node]
            best[live[value >= 0]] = value[value >= 0]
            depth += 1
        return best

    def _backtracked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the entries of pre-tokens (closed), one after the other, and how many each has: all take their steps together."""
        letters = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(length + 1) - length - 1
        first, end, longest = at.copy(), at + length, self._longest(letters)
        sizes, shorter = self._sizes, self._shorter
        # What was pushed, by the place where it starts; the last entry pushed before a place, by that place.
        taken, before, dead = np.full(len(letters), -1), np.full(len(letters), -1), np.zeros(len(letters), bool)
        live = np.flatnonzero(length > 0)
        token = longest[at]
        while len(live):
            here, t = at[live], token[live]
            none = t < 0
            to = np.where(none, here, here + sizes[t])
            last = before[here]
            held = (last >= 0) & ~none & ~dead[to]
            good = ~none & ~dead[to]
            good[held] = self.compatible(last[held] << 20 | t[held])
            # A shorter entry for those that don't fit.
            token[live] = shorter[t]
            # Back to the entry before, where none is left.
            if none.any():
                w, h = live[none], here[none]
                if (h == first[w]).any():
                    raise ValueError(f"no encoding of {words[int(w[h == first[w]][0])]!r}")
                dead[h] = True
                popped = before[h]
                at[w] = h - sizes[popped]
                token[w] = shorter[popped]
            w, h, forth = live[good], here[good], to[good]
            taken[h], before[forth] = t[good], t[good]
            at[w] = forth
            token[w] = longest[np.minimum(forth, len(longest) - 1)]
            live = live[at[live] < end[live]]
        # Entries of the final path, from the ends backwards, are those whose successors were kept.
        keep, at = np.zeros(len(letters), bool), end.copy()
        live = np.flatnonzero(length > 0)
        while len(live):
            at[live] -= sizes[before[at[live]]]
            keep[at[live]] = True
            live = live[at[live] > first[live]]
        where = np.flatnonzero(keep)
        return taken[where], np.bincount(np.searchsorted(first, where, "right") - 1, minlength=len(words))

    def entries(self, letters: str) -> list[int]:
        """Ranks of the entries that one pre-token in byte letters becomes."""
        return self._backtracked([self._closed(letters) if self.end and letters else letters])[0].tolist()

    def encode_piece(self, letters: str) -> list[int]:
        """The ids of one pre-token given in byte letters."""
        return [self.ids[t] for t in self.entries(letters)]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in byte letters, one after the other, and how many each has."""
        if self.end:
            closed = [self._closed(p) for p in pieces]
        else:
            closed = pieces
        # Line feeds are no byte letters, so no entry reaches over one.
        flat = np.fromiter(chain.from_iterable(self.automaton.iter_long("\n".join(closed))), np.int64)
        token, size = flat[1::2], self._sizes[flat[1::2]]
        length = np.fromiter(map(len, closed), np.int64, len(closed))
        begin = np.cumsum(length + 1) - length - 1
        word = np.searchsorted(begin, flat[0::2] - size + 1, "right") - 1
        sound = np.bincount(word, size, len(closed)) == length
        inner = np.flatnonzero(word[1:] == word[:-1])
        sound[word[inner[~self.compatible(token[inner] << 20 | token[inner + 1])]]] = False
        count = np.bincount(word, minlength=len(closed))
        wrong = np.flatnonzero(~sound)
        if not len(wrong):
            return self._ids[token], count
        # Those off the greedy path are searched and put in their places.
        own, count[wrong] = self._backtracked([closed[w] for w in wrong.tolist()])
        keep = sound[word]
        place = np.argsort(np.concatenate([word[keep], np.repeat(wrong, count[wrong])]), kind="stable")
        return self._ids[np.concatenate([token[keep], own])[place]], count

    def _bytes(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens in byte letters."""
        ids, count = self._encoded(pieces)
        raw, end = ids.tobytes(), (4 * np.cumsum(count)).tolist()
        return [raw[a:b] for a, b in zip([0, *end], end, strict=False)]

    def _counts(self, pieces: list[str]) -> list[int]:
        return self._encoded(pieces)[1].tolist()

    def _mapped(self, make: Callable) -> Callable:
        return lambda words: make([self._letters(w) for w in words])

    def _batches(self, texts: list[str | None]) -> Iterator[list[str]]:
        part, held = [], 0
        for text in texts:
            part.append(text or "")
            held += len(part[-1])
            if held >= BATCH_LETTERS:
                yield part
                part, held = [], 0
        if part:
            yield part

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers; null is the empty text."""
        for batch in self._batches(texts):
            tables = ((self.bytes_of, self._mapped(self._bytes)), (self.mapped_of, self._bytes))
            keys, plans = (set(), set()), []
            for text in batch:
                plan = []
                for part, special in self.segments(text):
                    if special is not None:
                        plan.append((-1, special.to_bytes(4, "little")))
                        continue
                    pieces, mapped = self.pieces(part)
                    keys[mapped].update(pieces)
                    plan.append((mapped, pieces))
                plans.append(plan)
            known = [table.all_of(k, make).__getitem__ for (table, make), k in zip(tables, keys, strict=True)]
            for plan in plans:
                yield b"".join([x if kind < 0 else b"".join(map(known[kind], x)) for kind, x in plan])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, as uint32; tokens of each text). Null is the empty text.

        Where white space is dropped, blanks around what isn't letters make pre-tokens of what is between blanks; so Arrow
        splits common texts and finds their distinct pre-tokens, and one gather lays out the ids. Other texts go one by one.
        """
        texts = pc.fill_null(texts, "")
        plain = np.zeros(len(texts), bool)
        if self.end:
            strange = pc.match_substring_regex(texts, "|".join([_STRANGE, *map(re.escape, self.special)]))
            plain = ~strange.to_numpy(zero_copy_only=False)
        slow = np.flatnonzero(~plain)
        count, own = np.zeros(len(texts), np.int64), list(self.encode_all(texts.take(pa.array(slow)).to_pylist()))
        count[slow] = [len(x) // 4 for x in own]
        ids = np.zeros(0, "<u4")
        if plain.any():
            split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.filter(pa.array(plain))), _APART, r" \1 "))
            found = split.flatten().dictionary_encode()
            keys, index = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
            known = self.bytes_of.all_of(set(keys), self._mapped(self._bytes))
            raw = [known[k] for k in keys]
            table, size = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            start = np.cumsum(size) - size
            n = size[index]
            ends = np.concatenate([[0], np.cumsum(n)])
            offsets = split.offsets.to_numpy()
            count[plain] = np.diff(ends[offsets - offsets[0]])
            kind = np.int32 if ends[-1] < 1 << 31 else np.int64
            ids = table[np.repeat((start[index] - ends[:-1]).astype(kind), n) + np.arange(ends[-1], dtype=kind)]
        if len(slow):
            where = np.repeat(plain, count)
            every = np.empty(len(where), "<u4")
            every[where], every[~where] = ids, np.frombuffer(b"".join(own), "<u4")
            ids = every
        return ids, count

    def count_all(self, texts: list[str | None]) -> Iterator[int]:
        """Tokens of each whole text: frequencies of its distinct pre-tokens times their counts; ids are not laid out."""
        for batch in self._batches(texts):
            tables = ((self.count_of, self._mapped(self._counts)), (self.mapped_count_of, self._counts))
            keys, plans = (set(), set()), []
            for text in batch:
                plan = []
                for part, special in self.segments(text):
                    if special is None:
                        pieces, mapped = self.pieces(part)
                        plan.append((mapped, frequencies := Counter(pieces)))
                        keys[mapped].update(frequencies)
                    else:
                        plan.append((-1, None))
                plans.append(plan)
            known = [table.all_of(k, make) for (table, make), k in zip(tables, keys, strict=True)]
            for plan in plans:
                yield sum(1 if kind < 0 else sum([known[kind][p] * n for p, n in x.items()]) for kind, x in plan)

    def encode_bytes(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the ids' text; bytes that aren't UTF-8 are replaced."""
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The texts of several documents, whose ids lie one after the other, gathered through the offset table in one pass."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        out = memoryview(self.blob[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])])
        stops = ends[np.cumsum(count)].tolist()
        gap, texts = len(self.gap), []
        for a, b in zip([0, *stops], stops, strict=False):
            one = out[a : max(a, b - gap)]
            texts.append(bytes(one) if gap else bytes(one).decode("utf-8", "replace").encode())
        return texts


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One instance for each file and process."""
    return Bpe(path)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
