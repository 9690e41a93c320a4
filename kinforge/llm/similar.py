"""The pipeline's near-dedup: SimHash candidates, verified by shared shingles.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  Candidates come from SimHash fingerprints: each text
has `PRINTS` independent ones over its two-word shingles (those of texts that
share 80 % of their five-word shingles lie nearer together than five-word ones).
Texts are candidates when one of their fingerprints differs in at most seven
bits and none in more than `MAX_OTHER`; what such links join is a candidate
group.  Within a group all pairs are compared, so a link does not hang on the
order or on the fingerprint's distance.

With seven differing bits at least nine of the sixteen half bytes are equal, so
one half of a fingerprint has five equal half bytes of eight, and these hold one
of fourteen quadruples whole: twenty-eight keys of sixteen bits miss no pair.
(Keys do not grow beyond that, so the lists of a corpus of billions of unlike
texts take work that grows faster than it; README has figures.)

Texts with equal shingle sets are one node (`same`, a hash of the set).  Groups
beyond `block` sets or `block_shingles` shingles are split and each pair of
blocks is compared in a task of its own.  Defined cases as in `simhash`: null
and empty texts have equal (empty) sets, texts of under five words are one
shingle, null ids are ignored when the smallest id is taken; of each group one
row stays, that of the smallest id (null last) and, of rows that repeat it, that
of the smallest hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.components import components
from kinforge.llm.frames import checkpointed, map_texts, marked
from kinforge.llm.ragged import chunks, words
from kinforge.llm.simhash import LINKS, SEED, by_first, firsts, listed_links, pairs, quadruples, two_sided
from kinforge.operators.joins import split_join

SHINGLE, CANDIDATE_SHINGLE, PRINTS, MAX_BITS, MAX_OTHER = 5, 2, 3, 7, 18
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Lists up to this size are looked at together.
SMALL_LIST = 32
#: Odd multipliers: one for each word of a shingle, one for each fingerprint.
_WORD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_PRINT = np.array([0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def _masks() -> list[int]:
    """Four of the eight half bytes of each half of a fingerprint."""
    raw = [sum(15 << 4 * (8 * half + i) for i in four) for half in (0, 1) for four in quadruples()]
    return [m - (1 << 64) if m >> 63 else m for m in raw]


def near_prints(fps: np.ndarray, owner: np.ndarray, side: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i, j) within each list: few half bytes need be equal, so their
    tally would rule out little and bits are counted at once.  Of a list with two
    blocks only pairs across them count."""
    per_print, several = len(_masks()), two_sided(owner, side, len(k))
    at = np.searchsorted(owner, np.arange(len(k) + 1))
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.diff(at)[owner] <= SMALL_LIST
    place = np.flatnonzero(small)
    i, j = (place[x] for x in pairs(owner[place]))
    tasks = [(i, j)]
    for x in np.flatnonzero(np.diff(at) > SMALL_LIST):
        here = np.arange(at[x], at[x + 1])
        for a in range(0, len(here), 128):
            strip = here[a : a + 128]
            near = np.bitwise_count(fps[strip, k[x] // per_print][:, None] ^ fps[here, k[x] // per_print][None, :]) <= MAX_BITS
            p, q = np.nonzero(near & (strip[:, None] < here[None, :]))
            tasks.append((strip[p], here[q]))
    for i, j in tasks:
        if not len(i):
            continue
        split = several[owner[i]]
        bits = np.bitwise_count(fps[i] ^ fps[j])
        good = (bits[np.arange(len(i)), k[owner[i]] // per_print] <= MAX_BITS) & (bits.max(axis=1) <= MAX_OTHER) & (~split | (side[i] != side[j]))
        out_i.append(i[good])
        out_j.append(j[good])
    return np.concatenate(out_i), np.concatenate(out_j)


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * by
    h = (h ^ (h >> np.uint64(29))) * _WORD[3]
    return h ^ (h >> np.uint64(32))


def _shingles(word: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles; a row of fewer words has one of all of them."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    size = np.diff(first)
    full = np.zeros(len(word), np.uint64)
    n = len(word) - k + 1
    whole = np.zeros(len(word), bool)
    if n > 0:
        full[:n] = sum(word[j : n + j] * _WORD[j] for j in range(k))
        whole[:n] = row[:n] == row[k - 1 :]
    for r in np.flatnonzero((size > 0) & (size < k)):
        a, b = first[r], first[r + 1]
        full[a] = (word[a:b] * _WORD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        whole[a] = True
    return _mixed(full[whole], _WORD[4]), row[whole]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words, letters of A to Z in lower case."""
    upper = (data >= 0x41) & (data <= 0x5A)
    data = data + (upper.astype(np.uint8) << 5)
    start, end, row = words(data, offsets)
    raw, h64 = data.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((h64(raw[p:q], SEED) for p, q in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start)), row


def shingle_sets(word: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the distinct five-word shingles of each text, sorted."""
    h, owner = _shingles(word, row, n_rows, SHINGLE)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n_rows + 1))


def prints_of(word: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """`PRINTS` fingerprints of each text."""
    h, owner = _shingles(word, row, n_rows, CANDIDATE_SHINGLE)
    out = np.zeros((n_rows, PRINTS), np.uint64)
    if not len(h):
        return out
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(head, len(owner)))
    for p in range(PRINTS):
        bits = np.unpackbits(_mixed(h, _PRINT[p]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
        out[owner[head], p] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _same(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    raw, cuts = h.tobytes(), (at * 8).tolist()
    return np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(cuts, cuts[1:])], np.uint64).view(np.int64)


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, same, size, fps): hash and number of the shingles, fingerprints."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in chunks(batch.column(1)):
            word, row = _word_hashes(data, offsets)
            h, at = shingle_sets(word, row, b - a)
            fps = prints_of(word, row, b - a)
            lists = _lists(fps.ravel(), np.arange(b - a + 1) * PRINTS)
            ids = [batch.column(c).slice(a, b - a) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(_same(h, at)), pa.array(np.diff(at)), lists], names=["doc_id", "mark", "same", "size", "fps"])

    return map_texts(marked(docs, id_col, text_col), rows, "doc_id long, mark long, same long, size long, fps array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(same, shingles) of (doc_id, text)."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in chunks(batch.column(1)):
            h, at = shingle_sets(*_word_hashes(data, offsets), b - a)
            yield pa.RecordBatch.from_arrays([pa.array(_same(h, at)), _lists(h, at)], names=["same", "shingles"])

    return map_texts(texts, rows, "same long, shingles array<long>")


def alike(same: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) from each set to the smallest `same` that it reaches over
    pairs with Jaccard similarity of 0.8 or more.

    A set that was reached is compared once with all not yet reached."""
    size = np.diff(at)
    code = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(same)), size)
    held = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    left = np.ones(len(same), bool)
    u, v = [], []
    for root in np.argsort(same, kind="stable"):
        if not left[root]:
            continue
        left[root] = False
        reached = [root]
        while reached:
            x = reached.pop()
            mine = code[at[x] : at[x + 1]]
            held[mine] = True
            shared = np.bincount(owner, weights=held[code], minlength=len(same)).astype(np.int64)
            held[mine] = False
            # shared / (a + b - shared) >= 4 / 5
            for i in np.flatnonzero(left & (9 * shared >= 4 * (size + size[x]))):
                left[i] = False
                reached.append(i)
                u.append(same[i])
                v.append(same[root])
            if not left.any():
                break
    return np.array(u, np.int64), np.array(v, np.int64)


def _classes(docs: DataFrame, block: int, block_shingles: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signature of every row, and (same, root, least, first) of every distinct shingle set."""
    signed = checkpointed(signatures(docs, id_col, text_col))
    # texts with equal fingerprints are one node
    nodes = signed.select(F.xxhash64("fps").alias("node"), "fps").distinct()
    posted = [F.struct(F.lit(p * len(_masks()) + k).alias("k"), F.col("fps")[p].bitwiseAND(F.lit(m)).alias("key")) for p in range(PRINTS) for k, m in enumerate(_masks())]
    postings = nodes.select("node", "fps", F.explode(F.array(*posted)).alias("p")).select("p.k", "p.key", "node", "fps")
    roots = components(listed_links(postings, near_prints, PRINTS))
    coarse = signed.select(F.xxhash64("fps").alias("node"), "same", "size").distinct()
    coarse = coarse.join(roots, "node", "left").select(F.coalesce("root", "node").alias("group"), "same", "size").distinct()
    groups = coarse.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).filter("n > 1")
    members = checkpointed(split_join(coarse.select("group", "same"), groups, ["group"]))
    least = signed.groupBy("same").agg(F.min("doc_id").alias("least"), F.min(by_first()).alias("first"))
    chosen = least.join(members.select("same").distinct(), "same", "left_semi").select(F.coalesce("first.doc_id", F.lit(0).cast("long")).alias("number"), "first.mark")
    texts = marked(docs, id_col, text_col).withColumn("number", F.coalesce("doc_id", F.lit(0).cast("long")))
    sets = _sets(texts.join(chosen, ["number", "mark"], "left_semi").select("doc_id", "text")).dropDuplicates(["same"])
    n_blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("total") / F.lit(block_shingles)))
    dealt = members.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("same"), F.col("n_blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.select("group", "same", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compared(table: pa.Table) -> pa.Table:
        lists = table["shingles"].combine_chunks()
        at = lists.offsets.to_numpy().astype(np.int64)
        u, v = alike(table["same"].to_numpy(), lists.values.to_numpy()[at[0] : at[-1]], at - at[0])
        return pa.table([pa.array(u), pa.array(v)], names=LINKS.names)

    found = dealt.join(sets, "same").groupBy("group", "low", "high").applyInArrow(compared, LINKS)
    reached = components(found).withColumnRenamed("node", "same")
    return signed, least.join(reached, "same", "left").withColumn("root", F.coalesce("root", "same"))


def similar(docs: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row; component_id is the smallest doc_id
    reachable over texts that share 80 % of their shingles."""
    signed, classes = _classes(docs, block, block_shingles, id_col, text_col)
    first = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = split_join(classes.select("same", "root"), first, ["root"]).select("same", "component_id")
    return signed.join(named, "same").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component (see `simhash.firsts`), with the same columns."""
    _, classes = _classes(docs, block, block_shingles, id_col, text_col)
    return firsts(docs, classes.groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)
