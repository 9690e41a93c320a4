"""Operator 2: substring dedup by seed and extend.

Every run of `min_words` words (a window) has one *anchor*, the place of the
smallest hash among its runs of `seed_words` words (winnowing), so equal windows
have equal anchors at equal places.

1. Seeds: documents are dealt into blocks of some megabytes.  Each block sends
   its distinct anchors to buckets of the hash space; a bucket answers each
   block with the anchors that lie in two documents or more.
2. Extension: a block sends every place of a shared anchor with the words around
   it (as far as windows with that anchor reach) to the anchor's bucket.  There
   documents are joined on the anchor: all places of it are extended together,
   word by word to the right and to the left, and are split into classes of
   equal words as they part.  A window is equal to another if both sides reach
   `min_words` words in one class, and the smallest document of the class owns
   it.  Words are compared as bytes, hashes only bring them together.
3. A block marks the words under windows that a smaller document owns; runs of
   marked words are the maximal repeats of at least `min_words` words that
   smaller documents have.

No pair of documents is ever written.  Equal surroundings are one entry for each
block, however frequent; an anchor of more than `hot_places` places is sent as
single windows dealt by their own hash, so unlike surroundings of a very common
phrase spread over all buckets.  Entries travel as packed columns; blocks
and buckets grow with the root of the measured input, up to `MAX_BYTES`.

Defined cases: a null or empty text has no words; a null doc_id is larger than
every other and equal to itself; rows that repeat a doc_id are one document for
the order (none is smaller than the other) but a row each in the result; a text
of any length is one, held whole by the task of its block; an empty table gives
no rows; a repeat within one document stays; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.frames import mark_of
from kinforge.llm.ragged import chunks, covered, gather, hash_slices, mix, padded, window_hash, words

MIN_WORDS, SEED_WORDS = 13, 5
#: Text in a block, and three times what is in a bucket: at least and at most.
MIN_BYTES, MAX_BYTES = 4 << 20, 64 << 20
#: Places of an anchor (a document in which it stands again counts once for each run) beyond
#: which it is dealt by single windows.
HOT_PLACES = 4096
_NULL_ID = np.iinfo(np.int64).max

SENT = "bucket long, block long, n long, packed binary, words binary"
ANSWER = "block long, bucket long, n long, packed binary"
KEPT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("kept", T.StringType()),
    ]
)


# --- packed columns ---


def planes(values: np.ndarray) -> bytes:
    """64-bit values by byte position, so that equal high bytes compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").reshape(-1)


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in names.split(", ")]
    kinds = [pa.binary() if kind == "binary" else pa.int64() for _, kind in fields]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[name for name, _ in fields])


def _unpacked(table: pa.Table, width: int) -> list[np.ndarray]:
    """Concatenated columns of packed rows, and which row each value is from."""
    n = table.column("n").to_pylist()
    raw = table.column("packed").to_pylist()
    out = [np.concatenate([np.zeros(0, np.uint64), *(unplanes(x[8 * m * k :], m) for x, m in zip(raw, n, strict=True))]) for k in range(width)]
    return [*out, np.repeat(np.arange(len(n)), n)]


def _bucket_cuts(key: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted keys fall into (a bucket is a range of the hash space)."""
    bucket = key // np.uint64(-(-(1 << 64) // n_buckets)) if n_buckets > 1 else np.zeros(len(key), np.uint64)
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
    return list(zip(bucket[head].astype(np.int64).tolist(), head.tolist(), [*head[1:].tolist(), len(key)], strict=True)) if len(key) else []


# --- windows and the words around their anchors ---


class _Windows:
    """The windows of a run of texts: first word and place of the anchor of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int, seed_words: int, seed_bits: int):
        self.start, self.end, self.row = words(data, offsets)
        self.h, _ = hash_slices(padded(data), self.start, self.end)
        n = len(self.h) - min_words + 1
        if n <= 0:
            self.at = self.place = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        seed = window_hash(self.h, seed_words, salt=1) >> np.uint64(64 - seed_bits)
        least, place = seed[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, min_words - seed_words + 1):  # the leftmost of equal ones
            less = seed[k : n + k] < least
            least[less] = seed[k : n + k][less]
            place[less] = k
        self.at = np.flatnonzero(self.row[:n] == self.row[min_words - 1 :])
        self.place = self.at + place[self.at]
        self.anchor = mix(least[self.at])  # minima are small numbers: mixed, they fill all buckets alike


@dataclass
class _Places:
    """Places of shared anchors in a block, and the distinct entries made of them."""

    run: np.ndarray  # which run of texts
    at: np.ndarray  # word of the run at which the anchor begins
    doc: np.ndarray
    left: np.ndarray  # words before the anchor, and behind it
    right: np.ndarray
    entry: np.ndarray  # place -> entry
    key: np.ndarray  # of each entry, in order
    least: np.ndarray  # smallest document of each entry
    some: np.ndarray  # entry -> one place
    data: np.ndarray  # words of all places, each with a space behind it
    begin: np.ndarray
    length: np.ndarray


def _places(runs: list[tuple], doc: np.ndarray, mark: np.ndarray, seeds: np.ndarray, hot: np.ndarray, min_words: int, seed_words: int) -> _Places:
    """Entries are in the order of key, document, mark of the text and place, which
    does not hang on the order in which the texts came."""
    parts: list[list[np.ndarray]] = []
    texts: list[np.ndarray] = []
    held = 0
    for number, (a, data, w) in enumerate(runs):
        if not len(w.at) or not len(seeds):
            continue
        found = np.minimum(np.searchsorted(seeds, w.anchor), len(seeds) - 1)
        hit = seeds[found] == w.anchor
        single = hit & hot[found]
        # windows of one anchor are neighbours
        mine = np.flatnonzero(hit & ~single)
        new = np.append(True, w.place[mine][1:] != w.place[mine][:-1]) if len(mine) else np.zeros(0, bool)
        last = np.append(new[1:], True) if len(mine) else new
        alone = np.flatnonzero(single)
        low = np.concatenate([w.at[mine[new]], w.at[alone]])
        high = np.concatenate([w.at[mine[last]], w.at[alone]])
        at = np.concatenate([w.place[mine[new]], w.place[alone]])
        whole = window_hash(w.h, min_words, salt=2)[w.at[alone]] if len(alone) else np.zeros(0, np.uint64)
        key = np.concatenate([w.anchor[mine[new]], whole])
        size = w.end - w.start
        spot = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        joined[gather(np.arange(len(joined)), spot, size)] = gather(data, w.start, size)
        tail = high + min_words - 1
        length = spot[tail] + size[tail] + 1 - spot[low]
        texts.append(gather(joined, spot[low], length))
        row = w.row[at]
        first_word = np.searchsorted(w.row, np.arange(int(w.row[-1]) + 1))
        begin = held + np.cumsum(length) - length
        held += int(length.sum())
        parts.append([np.full(len(at), number), at, doc[a + row], mark[a + row], at - low, tail - at - seed_words + 1, key, at - first_word[row], np.arange(len(at)) >= new.sum(), begin, length])
    empty = np.zeros(0, np.int64)
    run, at, doc_of, mark_at, left, right, key, word, alone, begin, length = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty,) * 11
    data = np.concatenate([np.zeros(0, np.uint8), *texts])
    # equal words around an anchor at the same place in them are one entry
    same = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    code = same.indices.to_numpy().astype(np.int64) * 64 + left if len(begin) else empty
    order = np.lexsort((alone, word, mark_at, doc_of, key, code))
    head = order[np.append(True, code[order][1:] != code[order][:-1])] if len(order) else order
    head = head[np.lexsort((alone[head], word[head], mark_at[head], doc_of[head], key[head]))]
    names = pd.Index(code[head])
    return _Places(run, at, doc_of, left, right, names.get_indexer(code), key[head].astype(np.uint64), doc_of[head], head, data, begin, length)


def extended(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, seed_words: int, reach: int) -> np.ndarray:
    """For each entry the windows that a smaller document has: bit l for the one
    that begins l words before the anchor.

    data: the words of all entries, a space behind each; `reach`: words of a window beside the anchor.
    Entries of a key are extended together and split into classes of equal words."""
    ends = np.flatnonzero(data == 0x20) + 1  # each word with the space behind it
    letters = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)])
    code = letters.dictionary_encode().indices.to_numpy().astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    size = left + seed_words + right
    centre = np.cumsum(size) - size + left

    def split(group: np.ndarray, offset: int) -> np.ndarray:
        """Classes of equal words at an offset from the anchor; beyond its words an entry is in a class of that."""
        inside = (offset >= -left) & (offset < seed_words + right)
        word = np.where(inside, code[np.where(inside, centre + offset, 0)], -1)
        return pd.factorize(group * (len(code) + 1) + word + 1)[0].astype(np.int64)

    group = pd.factorize(key.view(np.int64))[0].astype(np.int64)
    for k in range(seed_words):
        group = split(group, k)
    ahead, behind = [group], [group]
    for k in range(reach):
        ahead.append(split(ahead[-1], seed_words + k))
        behind.append(split(behind[-1], -1 - k))
    told = np.zeros(len(key), np.int64)
    for k in range(reach + 1):
        whole = np.flatnonzero((k <= left) & (reach - k <= right))
        both = pd.factorize(behind[k][whole] * (len(key) + 1) + ahead[reach - k][whole])[0]
        least = np.full(int(both.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, both, doc[whole])
        told[whole] |= (least[both] < doc[whole]).astype(np.int64) << k
    return told


def _least_by_key(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the smallest and largest value of each, and their number."""
    if not len(key):
        return key, value, value, key
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[head], np.minimum.reduceat(value, head), np.maximum.reduceat(value, head), np.diff(np.append(head, len(key))).astype(np.uint64)


def repeats(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    seed_words: int = SEED_WORDS,
    block_bytes: int | None = None,
    bucket_bytes: int | None = None,
    hot_places: int = HOT_PLACES,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    seed_bits: int = 64,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, spans (first and
    last word of each maximal repeat that a smaller document has), kept (the
    other words joined by one space), and the columns `carry` as in_<name>.

    `seed_bits` under 64 make unlike seeds meet; the result is the same."""
    reach = min_words - seed_words
    if not 0 <= reach < 63:
        raise ValueError("seed_words must be min_words at most, and over min_words - 63")
    carried = [F.col(c).alias(f"in_{c}") for c in carry]
    id_and_text = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    texts = docs.select(*id_and_text, mark_of(id_col, text_col).alias("mark"), *carried)
    names = [f"in_{c}" for c in carry]
    schema = T.StructType([*KEPT.fields, *(texts.schema[c] for c in names)])
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fair = min(MAX_BYTES, max(MIN_BYTES, math.isqrt(total << 11)))
    n_blocks = max(1, math.ceil(total / (block_bytes or fair)))
    n_buckets = max(1, math.ceil(total / 3 / (bucket_bytes or fair)))
    n_wide = max(1, math.ceil(total / (bucket_bytes or fair)))  # words take more than anchors
    blocks = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))

    def runs_of(table: pa.Table) -> tuple[list[tuple], np.ndarray]:
        """(first row, bytes, windows) of the runs of a block's texts, and the id of each row."""
        doc = table.column("doc_id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        return [(a, data, _Windows(data, offsets, min_words, seed_words, seed_bits)) for a, _, data, offsets in chunks(table.column("text"))], doc

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        doc = table.column("doc_id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        for a, _, data, offsets in chunks(table.column("text")):
            w = _Windows(data, offsets, min_words, seed_words, seed_bits)
            new = np.flatnonzero(np.append(True, w.place[1:] != w.place[:-1])) if len(w.at) else w.at
            found.append(w.anchor[new])
            owner.append(doc[a + w.row[w.place[new]]])
        anchor, least, most, places = _least_by_key(np.concatenate(found), np.concatenate(owner))
        several = (least != most).astype(np.uint64)  # two documents of this block share it
        block = key[0].as_py()
        return _rows(SENT, [(k, block, q - p, planes(anchor[p:q]) + planes(several[p:q]) + planes(places[p:q]), b"") for k, p, q in _bucket_cuts(anchor, n_buckets)])

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchor, several, places, source = _unpacked(table, 3)
        order = np.argsort(anchor, kind="stable")
        anchor, several, places, source = anchor[order], several[order], places[order], source[order]
        if not len(anchor):
            return _rows(ANSWER, [])
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(head, len(anchor)))
        keep = np.repeat((size > 1) | (np.add.reduceat(several, head) > 0), size)
        hot = np.repeat(np.add.reduceat(places, head) > hot_places, size)[keep].astype(np.uint64)
        anchor, source = anchor[keep], source[keep]
        order = np.argsort(source, kind="stable")
        anchor, hot, source = anchor[order], hot[order], source[order]
        cuts = np.flatnonzero(np.append(True, source[1:] != source[:-1])).tolist() if len(source) else []
        block, bucket = table.column("block").to_pylist(), -1 - key[0].as_py()
        return _rows(ANSWER, [(block[source[p]], bucket, q - p, planes(anchor[p:q]) + planes(hot[p:q])) for p, q in zip(cuts, [*cuts[1:], len(source)], strict=False)])

    def placed(table: pa.Table, answers: pa.Table) -> tuple[list[tuple], _Places]:
        seeds, hot, _ = _unpacked(answers, 2)
        order = np.argsort(seeds, kind="stable")
        runs, doc = runs_of(table)
        return runs, _places(runs, doc, table.column("mark").combine_chunks().to_numpy(), seeds[order], hot[order] > 0, min_words, seed_words)

    def around(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        _, x = placed(table, answers)
        block, rows = key[0].as_py(), []
        for k, p, q in _bucket_cuts(x.key, n_wide):
            mine = x.some[p:q]
            packed = planes(x.key[p:q]) + planes(x.least[p:q].astype(np.uint64)) + x.left[mine].astype(np.uint8).tobytes() + x.right[mine].astype(np.uint8).tobytes()
            rows.append((k, block, q - p, packed, gather(x.data, x.begin[mine], x.length[mine]).tobytes()))
        return _rows(SENT, rows)

    def owned(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchor, doc, source = _unpacked(table, 2)
        n, raw = table.column("n").to_pylist(), table.column("packed").to_pylist()
        sides = [np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8, m, 16 * m + k * m) for x, m in zip(raw, n, strict=True))]).astype(np.int64) for k in (0, 1)]
        data = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8)
        told = extended(anchor, doc.astype(np.int64), *sides, data, seed_words, reach)
        ends = np.cumsum(n).tolist()
        block, bucket = table.column("block").to_pylist(), key[0].as_py()
        return _rows(ANSWER, [(b, bucket, m, planes(told[e - m : e].astype(np.uint64))) for b, m, e in zip(block, n, ends, strict=True)])

    def removed(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = answers.column("bucket").to_numpy()
        runs, x = placed(table, answers.filter(pa.array(bucket < 0)))
        order = np.argsort(bucket, kind="stable")
        told, _ = _unpacked(answers.take(pa.array(order[bucket[order] >= 0])), 1)
        if len(told) != len(x.key):
            raise RuntimeError("a block's entries and the answers to them differ")
        # where the entry's own smallest document is smaller, all windows are repeats
        bits = told.astype(np.int64)[x.entry]
        for k in range(reach + 1):
            bits |= ((x.doc > x.least[x.entry]) & (k <= x.left) & (reach - k <= x.right)).astype(np.int64) << k
        parts = []
        for number, (a, data, w) in enumerate(runs):
            mine = np.flatnonzero(x.run == number)
            starts = [x.at[mine[(bits[mine] >> k & 1) > 0]] - k for k in range(reach + 1)]
            cut = covered(np.concatenate(starts), min_words, len(w.start)) if len(w.start) else np.zeros(0, bool)
            n = (runs[number + 1][0] if number + 1 < len(runs) else table.num_rows) - a
            part = _result(table.column("doc_id").slice(a, n), data, w, cut)
            for c in names:
                part = part.append_column(c, table.column(c).slice(a, n))
            parts.append(part)
        return pa.concat_tables(parts) if parts else pa.schema([*KEPT_ARROW, *(table.schema.field(c) for c in names)]).empty_table()

    seeds = blocks.groupBy("block").applyInArrow(anchors, SENT).groupBy("bucket").applyInArrow(shared, ANSWER)
    surrounded = blocks.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(around, SENT)
    told = surrounded.groupBy("bucket").applyInArrow(owned, ANSWER)
    return blocks.groupBy("block").cogroup(seeds.unionByName(told).groupBy("block")).applyInArrow(removed, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with the same columns; a text that has repeats keeps its other words,
    joined by one space, any other text stays as it is."""
    found = repeats(docs, id_col=id_col, text_col=text_col, carry=tuple(docs.columns), **how)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"in_{text_col}"))
    return found.select(*((text if c == text_col else F.col(f"in_{c}")).alias(c) for c in docs.columns))


SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(SPAN)), ("kept", pa.string())])


def _result(doc_id: pa.ChunkedArray, data: np.ndarray, w: _Windows, cut: np.ndarray) -> pa.Table:
    n = len(doc_id)
    first_word = np.searchsorted(w.row, np.arange(n + 1))
    n_words = np.diff(first_word)
    n_removed = np.bincount(w.row[cut], minlength=n)
    # spans: runs of cut words of one row
    begin = cut.copy()
    begin[1:] &= ~cut[:-1] | (w.row[1:] != w.row[:-1])
    stop = cut.copy()
    stop[:-1] &= ~cut[1:] | (w.row[1:] != w.row[:-1])
    p, q = np.flatnonzero(begin), np.flatnonzero(stop)
    row = w.row[p]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(p - first_word[row]), pa.array(q - first_word[row])], fields=list(SPAN)),
    )
    # kept words with a space behind each but the last of a row
    k = np.flatnonzero(~cut)
    length = w.end[k] - w.start[k]
    gap = np.ones(len(k), np.int64)
    if len(k):
        gap[np.append(w.row[k][1:] != w.row[k][:-1], True)] = 0
    place = np.cumsum(length + gap) - length - gap
    text = np.full(int((length + gap).sum()), 0x20, np.uint8)
    text[gather(np.arange(len(text)), place, length)] = gather(data, w.start[k], length)
    size = np.bincount(w.row[k], weights=length + gap, minlength=n).astype(np.int64)
    kept = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(text))
    return pa.table([doc_id, pa.array(n_words), pa.array(n_removed), spans, kept], schema=KEPT_ARROW)
