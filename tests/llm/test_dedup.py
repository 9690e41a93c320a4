import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinforge.llm import queries, similar, simhash, substrings
from kinforge.llm.components import components


def brute_repeats(rows, width=13):
    """Removed words of each row by a table of all windows."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        cut = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < order(i):
                cut[k : k + width] = [True] * width
        out.append((i, len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def test_query_against_brute_force(spark, sf, doc_rows):
    got = sorted(map(tuple, queries.op2_seed_and_extend_dedup(spark, sf).collect()), key=str)
    want = brute_repeats(doc_rows)
    assert got == want and sum(r[2] for r in want) > 0


def test_small_blocks_and_buckets(spark):
    rng = random.Random(5)
    shared = [" ".join(rng.choices("abcdefg", k=rng.randint(10, 40))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*shared, " ".join(rng.choices("hijkl", k=rng.randint(0, 9)))]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(substrings.repeats(df, block_bytes=800, bucket_bytes=500)) == brute_repeats(rows)
    assert digest(substrings.repeats(df, min_words=7, seed_words=3, block_bytes=3000)) == brute_repeats(rows, 7)
    assert digest(substrings.repeats(df, min_words=5, seed_words=5, block_bytes=2000)) == brute_repeats(rows, 5)


@pytest.mark.parametrize("how", [{"seed_bits": 1}, {"seed_bits": 5}, {"hot_places": 0}, {"hot_places": 6}, {"hot_places": 4, "seed_bits": 3}])
def test_unlike_seeds_that_meet_and_hot_anchors(spark, how):
    """Forced collisions of the seeds' hashes, and anchors dealt by single windows."""
    rng = random.Random(11)
    line = " ".join(f"l{k}" for k in range(15))
    shared = [" ".join(rng.choices("abcd", k=rng.randint(12, 30))) for _ in range(4)] + [line, line[3:], "the same seed here now"]
    rows = [(rng.choice([None, *range(60)]), " ".join(rng.choice([*shared, f"own{k} {rng.random()}"]) for _ in range(rng.randint(0, 7)))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(substrings.repeats(df, block_bytes=700, bucket_bytes=300, **how)) == brute_repeats(rows)


def test_extension_by_classes_of_equal_words():
    """Every entry against every other."""
    rng = random.Random(2)
    for _ in range(30):
        n, reach, seed = 40, 4, 2
        left = [rng.randint(0, reach) for _ in range(n)]
        right = [max(reach - a, rng.randint(0, reach)) for a in left]
        text = [[rng.choice("ab") for _ in range(a + seed + b)] for a, b in zip(left, right, strict=True)]
        doc = [rng.randint(0, 5) for _ in range(n)]
        key = [rng.randint(0, 1) for _ in range(n)]
        data = np.frombuffer(b"".join(f"{' '.join(t)} ".encode() for t in text), np.uint8)
        got = substrings.extended(np.array(key, np.uint64), np.array(doc), np.array(left), np.array(right), data, seed, reach)
        window = lambda i, k: tuple(text[i][left[i] - k : left[i] - k + seed + reach]) if k <= left[i] and reach - k <= right[i] else None
        for i in range(n):
            want = [window(i, k) is not None and any(key[j] == key[i] and doc[j] < doc[i] and window(j, k) == window(i, k) for j in range(n)) for k in range(reach + 1)]
            assert [bool(got[i] >> k & 1) for k in range(reach + 1)] == want


def test_spans_are_the_removed_words(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"x {passage} y"), (2, f"a b {passage} c {passage}")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substrings.repeats(df).collect()}
    assert rows[1]["spans"] == [] and [tuple(s) for s in rows[2]["spans"]] == [(2, 21), (23, 42)] and rows[2]["kept"] == "a b c"


def test_odd_rows(odd, odd_rows):
    assert digest(substrings.repeats(odd)) == brute_repeats(odd_rows)
    out = substrings.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    empty = odd.limit(0)
    assert substrings.repeats(empty).count() == 0 and substrings.without_repeats(empty).columns == odd.columns


def fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, bits=3):
    """(id, fingerprint) -> smallest id reachable, by comparing all."""
    fps = [f for _, f in pairs]
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(pairs):
        known = [x for x in (least.get(root(i)), doc_id) if x is not None]
        least[root(i)] = min(known) if known else None
    return [(doc_id, f, least[root(i)]) for i, (doc_id, f) in enumerate(pairs)]


def test_near_dedup_query(spark, sf, doc_rows):
    want = sorted((i, f"{f:016x}", c) for i, f, c in brute_components([(i, fingerprint(t)) for i, t in doc_rows]))
    got = sorted(map(tuple, queries.op8_simhash_near_dedup(spark, sf).collect()))
    assert got == want and any(i != c for i, _, c in want)


@pytest.mark.parametrize("positions, block", [(4, 1024), (4, 4), (3, 1024), (3, 4), (2, 16), (5, 1024)])
def test_links_join_all_near_fingerprints(spark, positions, block):
    rng = random.Random(positions * 100 + block)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = set()
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(df, positions, block)
    assert found.count() <= 56 * len(fps) * (len(fps) // block + 1)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    want = brute_components(list(zip(signed, fps, strict=True)))
    groups = {}
    for s, _, least in want:
        groups.setdefault(least, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def kept_of(rows, classes):
    """The rows that stay: of each class the first by id (null last); ties may go either way."""
    groups = {}
    for (i, t), c in zip(rows, classes, strict=True):
        groups.setdefault(c, []).append((i is None, i or 0, t))
    return [[(None if no else i, t) for no, i, t in g if (no, i) == min(x[:2] for x in g)] for g in groups.values()]


def assert_kept(got, wanted):
    """One row of each list of choices, and no other."""
    left = list(got)
    for choices in wanted:
        mine = next(r for r in left if r in choices)
        left.remove(mine)
    assert not left


def fingerprint_classes(rows):
    prints = [(k, fingerprint(t)) for k, (_, t) in enumerate(rows)]
    return [c for _, _, c in brute_components(prints)]


def test_near_dedup_odd_rows(odd, odd_rows):
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted(brute_components([(i, fingerprint(t)) for i, t in odd_rows]), key=str)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert_kept([(r["doc_id"], r["text"]) for r in kept.collect()], kept_of(odd_rows, fingerprint_classes(odd_rows)))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.one_of_each(odd.limit(0)).count() == 0


X, Y, Z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")


@pytest.mark.parametrize("rows, want", [([(5, X), (5, Y), (7, Z)], {(5, X), (5, Y), (7, Z)}), ([(3, X), (5, X), (5, Y), (7, Z)], {(3, X), (5, Y), (7, Z)}), ([(None, X), (0, X), (None, Y), (None, Y)], {(0, X), (None, Y)})])
def test_unlike_texts_of_one_id_are_told_apart(spark, rows, want):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, more int")
    for module in (simhash, similar):
        kept = module.one_of_each(df)
        assert kept.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows_with_repeated_and_null_ids(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(12)] + ["", None, "one two"]
    rows = [(rng.choice([None, *range(8)]), rng.choice(texts)) for _ in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert_kept([tuple(r) for r in simhash.one_of_each(df).collect()], kept_of(rows, fingerprint_classes(rows)))


def test_any_five_of_eight_hold_a_key():
    for positions in (2, 3, 4, 5):
        keys = list(map(set, simhash.position_sets(positions)))
        assert all(any(k <= set(five) for k in keys) for five in itertools.combinations(range(8), 5))
    assert len(simhash.quadruples()) == 14


def test_tally_finds_the_near_pairs_of_each_list():
    rng = np.random.default_rng(7)
    for positions in (2, 3, 4, 5):
        sets = simhash.position_sets(positions)
        held, fp, owner, side = [], [], [], []
        for k in range(60):
            key = sets[k % len(sets)]
            n = int(rng.integers(2, 12))
            base = rng.integers(0, 1 << 63, dtype=np.uint64)
            mine = np.full(n, base)
            for x in range(n):
                for b in rng.choice([b for b in range(64) if b // 8 not in key], int(rng.integers(0, 6)), replace=False):
                    mine[x] ^= np.uint64(1) << np.uint64(b)
            fp.append(mine)
            owner += [k] * n
            side += rng.integers(0, 2, n).tolist() if k % 3 == 0 else [0] * n
            held.append([p in key for p in range(8)])
        fp, owner, side = np.concatenate(fp), np.array(owner), np.array(side)
        i, j = simhash.tallied(fp, owner, side, np.array(held))
        split = {k for k in set(owner.tolist()) if len(set(side[owner == k].tolist())) > 1}
        want = {(a, b) for b in range(len(fp)) for a in range(b) if owner[a] == owner[b] and (fp[a] ^ fp[b]).item().bit_count() <= 3 and (owner[a] not in split or side[a] != side[b])}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
