"""Operator 8: SimHash near-dedup over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most three bits have at least five of
their eight bytes equal.  The index posts every distinct fingerprint under byte
positions and their values.  A posting key joins the bytes of some positions, so
two fingerprints that meet under it share that many; within its list the other
positions are posted one by one, each pair that meets there is tallied, pairs
that reach the guaranteed five shared bytes are kept, and the differing bits of
these are counted.

A list of one position and one byte value would hold a 256th of all
fingerprints, so a key joins the bytes of four positions: the fourteen blocks of
the quadruple system over eight points, of which any five positions hold one
whole, so no pair is missed.  A list then has about one fingerprint for every
four billion; `positions` makes the keys shorter, the result is the same.

Copies share one posting (fingerprints are made distinct before the index).  A
list beyond `block` entries is split into blocks and each pair of blocks is
compared in a task of its own.  From each comparison only links to the smallest
fingerprint of each linked set leave, never all pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; texts of one or two words are one shingle; null
ids are ignored when the smallest id of a component is taken (a component
without any id has a null component_id); repeated rows get a row each; a text of
any length is read whole, in memory of some times its size; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.components import components
from kinforge.llm.frames import checkpointed, free_name, map_texts, mark_of, marked
from kinforge.llm.ragged import chunks, gather, words
from kinforge.operators.joins import split_join

SHINGLE, SEED, MAX_BITS, MIN_BYTES = 3, 42, 3, 5
#: Pairs tallied at once within a task.
PAIRS = 1 << 21
FINGERPRINTS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "mark", "fp")])
LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def shingle_slices(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, end, row) of the k-word shingles, space-joined; a row of
    fewer words has one shingle of all of them."""
    start, end, row = words(data, offsets)
    length = end - start
    place = np.cumsum(length + 1) - length - 1
    buffer = np.full(int((length + 1).sum()), 0x20, np.uint8)
    buffer[gather(np.arange(len(buffer)), place, length)] = gather(data, start, length)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    size = np.diff(first)
    n = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    head = gather(np.arange(len(row)), first[:-1], n)
    owner = np.repeat(np.arange(n_rows), n)
    tail = np.minimum(head + k, first[owner + 1]) - 1
    return buffer.tobytes(), place[head], place[tail] + length[tail], owner


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    upper = (data >= 0x41) & (data <= 0x5A)
    raw, start, end, row = shingle_slices(data + (upper.astype(np.uint8) << 5), offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(row):
        return out
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(raw[p:q], SEED) for p, q in zip(start.tolist(), end.tolist(), strict=True)), "<u8", len(start))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(head, len(row)))
    ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
    out[row[head]] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): `mark` tells rows of one id apart by their text, the
    fingerprint is a signed long of the same bits."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in chunks(batch.column(1)):
            fp = simhash(data, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 2)), pa.array(fp)], names=FINGERPRINTS.names)

    return map_texts(marked(docs, id_col, text_col), rows, FINGERPRINTS)


def quadruples() -> list[tuple[int, ...]]:
    """Sets of four of eight points of which any five points hold one whole.

    Five points have all of one half, or two of a pair's kind in each: a triple of
    a half holds a pair of every matching of that half, so matchings of both
    halves are joined pair by pair."""
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    crossed = [(*p, *(4 + x for x in q)) for m in matchings for p in m for q in m]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *crossed]


def position_sets(positions: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any five positions hold one whole."""
    if positions == 2:
        return [(0, 1), (2, 3), (4, 5), (6, 7)]
    if positions == 3:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    if positions == 4:
        return quadruples()
    if positions == MIN_BYTES:
        return list(combinations(range(8), MIN_BYTES))
    raise ValueError("positions must be 2, 3, 4 or 5")


def _mask(positions: tuple[int, ...]) -> int:
    return int.from_bytes(bytes(255 if i in positions else 0 for i in range(8)), "little", signed=True)


def pairs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair (i, j), i < j, of places with equal values of `code`."""
    order = np.argsort(code, kind="stable")
    value = code[order]
    head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(value)))
    before = np.arange(len(value)) - np.repeat(head, size)  # entries of the same value that come earlier
    later = np.repeat(np.arange(len(value)), before)
    step = np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before)
    return order[later - before[later] + step], order[later]


def two_sided(owner: np.ndarray, side: np.ndarray, n: int) -> np.ndarray:
    """Which of n lists have entries of two blocks."""
    out = np.zeros(n, bool)
    out[owner[side != side[np.searchsorted(owner, owner)]]] = True
    return out


def tallied(fp: np.ndarray, owner: np.ndarray, side: np.ndarray, held: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near fingerprints in the same list.

    owner: list of each entry; side: block within it (pairs of one block count
    only where the list has one); held: for each list, which byte positions its
    key holds.  All other positions are posted, pairs are tallied over them and
    those that reach the guaranteed number of equal bytes are verified."""
    n = len(fp)
    octets = fp.astype("<u8").view(np.uint8).reshape(-1, 8)
    need = MIN_BYTES - held.sum(axis=1)
    split = two_sided(owner, side, len(held))
    met = []
    free = np.flatnonzero(need[owner] <= 0)  # the key alone proves enough
    for position in (-1, *range(8)):
        here = free if position < 0 else np.flatnonzero((need[owner] > 0) & ~held[owner, position])
        value = owner[here] if position < 0 else owner[here] * 256 + octets[here, position]
        i, j = (here[x] for x in pairs(value))
        across = ~split[owner[i]] | (side[i] != side[j])
        met.append(np.minimum(i, j)[across] * n + np.maximum(i, j)[across])
    pair, tally = np.unique(np.concatenate(met), return_counts=True)
    i, j = pair // max(n, 1), pair % max(n, 1)
    enough = tally >= need[owner[i]]
    i, j = i[enough], j[enough]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
    return i[near], j[near]


def to_smallest(node: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) from each node to the smallest one of its list that it reaches
    over the pairs (i, j) of places."""
    order = np.lexsort((node, owner))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(node))
    label = rank.copy()  # the smallest rank reached so far
    while len(i):  # smallest label over links, with jumps
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    moved = label != rank
    return node[moved], node[order[label[moved]]]


#: (fingerprints (entry, print), list of each entry, block within it, key of each list) -> near pairs (i, j)
Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def listed_links(postings: DataFrame, near: Near, n_prints: int, block: int = 1024) -> DataFrame:
    """Links (u, v) between the nodes of `postings` (k, key, node, fps), enough to
    join all that some list shows to be near."""
    sizes = postings.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = split_join(postings, sizes, ["k", "key"])
    n_blocks = F.ceil(F.col("n") / F.lit(block))
    dealt = shared.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    task = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    lists = dealt.select("k", "key", *task, F.struct("own", "node", *(F.col("fps")[p].alias(f"fp{p}") for p in range(n_prints))).alias("entry"))
    lists = lists.groupBy("k", "key", "low", "high").agg(F.collect_list("entry").alias("entries")).select("k", "entries")

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            k, entries = batch.column(0).to_numpy(), batch.column(1)
            at = entries.offsets.to_numpy().astype(np.int64)
            side, node = entries.values.field(0).to_numpy(), entries.values.field(1).to_numpy()
            fps = np.stack([entries.values.field(2 + p).to_numpy().view(np.uint64) for p in range(n_prints)], axis=1)
            size = np.diff(at)
            work = np.cumsum(size * size)
            a, us, vs = 0, [], []
            while a < len(size):  # lists whose pairs are looked at together
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + PAIRS, side="right")))
                mine = slice(at[a], at[b])
                owner = np.repeat(np.arange(b - a), size[a:b])
                u, v = to_smallest(node[mine], owner, *near(fps[mine], owner, side[mine], k[a:b]))
                us.append(u)
                vs.append(v)
                a = b
            u, v = (np.concatenate([node[:0], *x]) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=LINKS.names)

    return lists.mapInArrow(found, LINKS)


def links(distinct: DataFrame, positions: int = 4, block: int = 1024) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp`, enough to join all that differ in at most three bits."""
    held = np.array([[p in s for p in range(8)] for s in position_sets(positions)])
    posted = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key")) for k, s in enumerate(position_sets(positions))])
    postings = distinct.select("fp", F.explode(posted).alias("p")).select("p.k", "p.key", F.col("fp").alias("node"), F.array("fp").alias("fps"))
    return listed_links(postings, lambda fps, owner, side, k: tallied(fps[:, 0], owner, side, held[k]), 1, block)


def _classes(docs: DataFrame, positions: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row, and (fp, root, least, first) of every distinct one."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(by_first()).alias("first"))
    roots = components(links(distinct.select("fp"), positions, block))
    return prints, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, positions: int = 4, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest
    doc_id reachable over fingerprints that differ in at most three bits."""
    prints, classes = _classes(docs, positions, block, id_col, text_col)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = split_join(classes.select("fp", "root"), least, ["root"]).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, positions: int = 4, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component (see `firsts`), with the same columns."""
    _, classes = _classes(docs, positions, block, id_col, text_col)
    return firsts(docs, classes.groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)


def by_first() -> Column:
    """Order of the rows of a component: by id, null last, then by the mark of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("mark"))


def firsts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `chosen` names in its column `first`, one a component.

    A row is named by its id and the mark of its text, so rows that repeat an id
    with unlike texts are told apart; of rows equal in both one stays.  These are
    made one before the shuffle, so a row repeated without bound is one row a
    task there; the semi-join then needs no shuffle of texts of its own."""
    number, mark = free_name(docs, "first_id"), free_name(docs, "first_mark")
    keyed = docs.withColumns({number: F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), mark: mark_of(id_col, text_col)})
    named = chosen.select(F.coalesce("first.doc_id", F.lit(0).cast("long")).alias(number), F.col("first.mark").alias(mark))
    return keyed.dropDuplicates([number, mark]).join(named, [number, mark], "left_semi").select(*docs.columns)
