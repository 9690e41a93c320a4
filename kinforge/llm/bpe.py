"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into *units* at single spaces that stand between two visible
characters.  No token of the byte-level pre-tokeniser crosses such a space, so
a unit (with the space before it) is encoded once and kept.  Units are found by
hash in a table and compared byte by byte; those met for the first time are cut into words and all their
words are merged together: the symbols of many words lie in one flat array and
each round finds the rank of every neighbouring pair by binary search over the
sorted pair keys and merges the lowest-ranked pair of every word.

The ids equal those of the `tokenizers` library with the same file and
add_special_tokens=False; the text of a special token gives its id.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

from kinforge.llm.ragged import gather, hash_slices, padded

#: The pre-tokeniser's pattern (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Units kept by a worker; beyond it the table starts anew, so its memory is bounded.
MAX_UNITS = 1_500_000
_SLOTS = 1 << 22
_NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge ranks and the bytes of every id, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            table[i] = token.encode()
        self.table = table
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = np.int64(size)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.byte_rank = self._rank(np.repeat(self.first, 256), np.tile(self.first, 256))
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.raw = re.compile(b"|".join(re.escape(t.encode()) for t in self.special)) if self.special else None
        self.pattern = regex.compile(PATTERN)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def merge(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of words at once: (ids, tokens in each word).

        raw: the bytes of all words; start: where each (nonempty) word starts."""
        n_words = len(start)
        length = np.diff(np.append(start, len(raw)))
        done_ids, done_word = [], []
        symbols = self.first[raw]
        word = np.repeat(np.arange(n_words), length)
        # rank of the pair that begins at each symbol; a pair of bytes is looked up in a table
        rank = np.append(self.byte_rank[raw[:-1].astype(np.int64) * 256 + raw[1:]], _NO_RANK)[: len(raw)]
        rank[start[1:] - 1] = _NO_RANK
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(heads, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, heads), size)
            live = best < _NO_RANK
            if not live.all():  # finished words leave the round
                done_ids.append(symbols[~live])
                done_word.append(word[~live])
            spots = np.flatnonzero((rank == best) & live)
            if not len(spots):
                break
            # of neighbouring equal pairs ("aaa") every second one from the left merges
            run_start = np.append(True, spots[1:] != spots[:-1] + 1)
            if not run_start.all():
                run = np.cumsum(run_start) - 1
                spots = spots[(spots - spots[run_start][run]) % 2 == 0]
            symbols[spots] = self.made[rank[spots]]
            live[spots + 1] = False
            moved = (np.cumsum(live) - 1)[spots]
            symbols, word, rank = symbols[live], word[live], rank[live]
            near = np.zeros(len(symbols), bool)
            near[moved] = True
            near[moved[moved > 0] - 1] = True
            stale = np.flatnonzero(near)
            inner = stale[stale + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[stale] = _NO_RANK
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(n_words, np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n_words)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode short texts: (all ids, number of ids of each text)."""
        known: dict[str, int] = {}
        parts: list[int] = []  # word numbers, or ~id of a special token
        n_parts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(parts)
            at = 0
            for special in self.cut.finditer(text) if self.cut and "<" in text else ():
                parts += [known.setdefault(w, len(known)) for w in self.pattern.findall(text[at : special.start()])]
                parts.append(~self.special[special[0]])
                at = special.end()
            parts += [known.setdefault(w, len(known)) for w in self.pattern.findall(text[at:] if at else text)]
            n_parts[i] = len(parts) - before
        raw = [w.encode() for w in known]
        size = np.array([len(w) for w in raw], np.int64)
        ids, n_ids = self.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size)
        # special tokens are words of one id behind the others
        codes = sorted({~p for p in parts if p < 0})
        place = {~c: len(known) + k for k, c in enumerate(codes)}
        part = np.array([p if p >= 0 else place[p] for p in parts], np.int64)
        ids = np.append(ids, np.array(codes, np.int64))
        n_ids = np.append(n_ids, np.ones(len(codes), np.int64))
        where = np.cumsum(n_ids) - n_ids
        out = gather(ids, where[part], n_ids[part])
        owner = np.repeat(np.arange(len(texts)), n_parts)
        return out, np.bincount(owner, weights=n_ids[part], minlength=len(texts)).astype(np.int64)


def _blank_near(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of bytes that may end, or begin, a blank character: then the space
    beside it is no cut.  Too many is harmless: longer units, the same ids."""
    n = len(data)
    ends = data < 0x21
    begins = ends.copy()
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        c2 = high[data[high] == 0xC2]
        c2 = c2[c2 + 1 < n]
        c2 = c2[(data[c2 + 1] == 0x85) | (data[c2 + 1] == 0xA0)]
        begins[c2] = True
        ends[c2 + 1] = True
        e = high[(data[high] >= 0xE1) & (data[high] <= 0xE3)]
        e = e[e + 2 < n]
        pair = data[e].astype(np.int32) * 256 + data[e + 1]
        e = e[np.isin(pair, [0xE19A, 0xE280, 0xE281, 0xE380])]
        begins[e] = True
        ends[e + 2] = True
    return ends, begins


_LETTER, _MARK = np.uint8(1), np.uint8(2)
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<"]] = _MARK
_KIND[[b for b in range(128) if chr(b).isalpha()]] = _LETTER


def _kinds(data: np.ndarray) -> np.ndarray:
    """_LETTER for the bytes of Latin letters up to U+00FF, _MARK for ASCII marks
    but the apostrophe (it begins contractions) and < (it begins special tokens), else 0."""
    kind = _KIND[data]
    high = np.flatnonzero(data == 0xC3)
    high = high[high + 1 < len(data)]
    high = high[(data[high + 1] != 0x97) & (data[high + 1] != 0xB7)]
    kind[high] = _LETTER
    kind[high + 1] = _LETTER
    return kind


class Encoder:
    """Encoder with a bounded table of units; one lives in each Python worker."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._reset()

    def _reset(self) -> None:
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.n, self.used = 0, 0
        self.key = np.zeros((1 << 16, 2), np.uint64)  # hash and first bytes of each unit
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 19, np.uint16 if self.vocabulary.width <= 65536 else np.int32)
        self.size = np.zeros(1 << 16, np.int64)  # bytes of each unit, and where they are
        self.place = np.zeros(1 << 16, np.int64)
        self.text, self.written = np.zeros(1 << 20, np.uint8), 0

    def _find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Number of each unit, -1 where unknown (open addressing, linear probing)."""
        found = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        at = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            unit = self.slot[at]
            full = unit >= 0
            key = self.key[unit]
            same = full & (key[:, 0] == h[todo]) & (key[:, 1] == head[todo])
            found[todo[same]] = unit[same]
            go = full & ~same
            todo, at = todo[go], (at[go] + 1) & (_SLOTS - 1)
        return found

    def _encode_units(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of letters only, or of marks only, are one word; others are cut by the pattern."""
        kinds = gather(kind, start, size)
        where = np.cumsum(size) - size
        blank = data[start] == 0x20  # the space before a word
        kinds[where[blank & (size > 1)]] = _LETTER | _MARK
        one = np.bitwise_and.reduceat(kinds, where) > 0
        raw = gather(data, start[one], size[one])
        ids, n_ids = self.vocabulary.merge(raw, np.cumsum(size[one]) - size[one]) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if one.all():
            return ids, n_ids
        rest = np.flatnonzero(~one)
        texts = [data[a : a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
        more, n_more = self.vocabulary.units(texts)
        length = np.zeros(len(start), np.int64)
        length[one], length[rest] = n_ids, n_more
        at = np.zeros(len(start), np.int64)
        at[one] = np.cumsum(n_ids) - n_ids
        at[rest] = len(ids) + np.cumsum(n_more) - n_more
        return gather(np.concatenate([ids, more]), at, length), length

    def _other(self, unit: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which slices of `data` are not the unit found for them (none, or another of its hash)."""
        wrong = (unit < 0) | (self.size[unit] != size)
        long = np.flatnonzero(~wrong & (size > 8))  # the first eight bytes are part of the key
        mine, theirs = gather(data, start[long] + 8, size[long] - 8), gather(self.text, self.place[unit[long]] + 8, size[long] - 8)
        if not np.array_equal(mine, theirs):
            wrong[long[np.unique(np.repeat(np.arange(len(long)), size[long] - 8)[mine != theirs])]] = True
        return wrong

    def _add(self, h: np.ndarray, head: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        m = len(h)
        while len(self.text) < self.written + len(raw):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.written : self.written + len(raw)] = raw
        for name in ("key", "start", "length", "size", "place"):
            a = getattr(self, name)
            while len(a) < self.n + m:
                a = np.concatenate([a, np.zeros_like(a)])
            setattr(self, name, a)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = slice(self.n, self.n + m)
        self.key[new, 0], self.key[new, 1] = h, head
        self.length[new], self.size[new] = n_ids, size
        self.place[new] = self.written + np.cumsum(size) - size
        self.written += len(raw)
        self.start[new] = self.used + np.cumsum(n_ids) - n_ids
        self.ids[self.used : self.used + len(ids)] = ids
        todo = np.arange(m)
        at = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = self.n + todo[free]  # of several for one slot the last stays
            placed = free & (self.slot[at] == self.n + todo)
            todo, at = todo[~placed], (at[~placed] + ~free[~placed]) & (_SLOTS - 1)
        self.n += m
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        rows = len(offsets) - 1
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        kind = _kinds(data)
        cut = np.zeros(n, bool)
        space = np.flatnonzero(data == 0x20)
        space = space[(space > 0) & (space < n - 1)]
        ends, begins = _blank_near(data)
        cut[space[~ends[space - 1] & ~begins[space + 1]]] = True
        # a mark after a letter, and a line end between visible ASCII characters, begin a token too
        cut[1:] |= (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
        line = np.flatnonzero(data == 0x0A)
        line = line[(line > 0) & (line < n - 1)]
        line = line[(kind[line - 1] > 0) & (kind[line + 1] > 0)]
        cut[line] = True
        cut[line + 1] = True
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        cut[edge - 1] &= data[edge - 1] != 0x20  # a space at a row's end is no cut
        for special in self.vocabulary.raw.finditer(data) if self.vocabulary.raw else ():
            cut[special.start() + 1 : special.end()] = False
        cut[0] = True
        cut[edge] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        size = end - start
        h, head = hash_slices(padded(data), start, end)
        unit = self._find(h, head)
        new = np.flatnonzero(unit < 0)
        if len(new):
            if self.n + len(new) > MAX_UNITS:
                self._reset()
                new = np.arange(len(start))
            _, pick = np.unique(h[new], return_index=True)
            new = new[pick]
            self._add(h[new], head[new], gather(data, start[new], size[new]), size[new], *self._encode_units(data, kind, start[new], size[new]))
            unit = self._find(h, head)
        n_ids, at, ids = self.length[unit], self.start[unit], self.ids
        wrong = np.flatnonzero(self._other(unit, data, start, size))
        if len(wrong):  # units that share a hash with another one
            more, n_more = self._encode_units(data, kind, start[wrong], size[wrong])
            n_ids[wrong], at[wrong] = n_more, len(ids) + np.cumsum(n_more) - n_more
            ids = np.concatenate([ids, more])
        ids = gather(ids, at, n_ids)
        owner = np.searchsorted(offsets, start, side="right") - 1
        return ids, np.bincount(owner, weights=n_ids, minlength=rows).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; the text is their UTF-8 with U+FFFD for what is not valid."""
        v = self.vocabulary
        ids = np.asarray(ids, np.int64)
        return gather(v.flat, v.starts[ids], v.lengths[ids]).tobytes()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)
