import random

import pytest

import corpus_pipeline
from kinforge.llm import similar
from tests.llm.test_dedup import brute_components


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_similar(pairs):
    """(id, text) -> smallest id reachable over pairs with Jaccard >= 0.8."""
    sets = [shingles(t) for _, t in pairs]
    group = list(range(len(pairs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group[root(i)] = root(j)
    # the root's number stands for a fingerprint with no bit of reach
    return [(i, c) for i, _, c in brute_components([(doc_id, root(k)) for k, (doc_id, _) in enumerate(pairs)], bits=0)]


def rows_of(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in df.collect()), key=str)


def test_near_copies_of_the_stage(spark, sf):
    """Copies with some words changed, far beyond three bits of op 8's fingerprint."""
    rng = random.Random(3)
    rows = []
    for k in range(20):
        w = [f"w{rng.randrange(3000)}" for _ in range(200)]
        other = list(w)
        for p in rng.sample(range(5, 195, 15), 3):  # 15 of 196 shingles: similarity 0.86
            other[p] = f"x{k}{p}"
        far = [x if j % 20 else "y" for j, x in enumerate(w)]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(other)), (3 * k + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf).collect()}
    assert kept == {i for i, _ in rows if i % 3 != 1}


@pytest.mark.parametrize("block, block_shingles", [(1024, 1 << 19), (3, 1 << 19), (1024, 300)])
def test_against_brute_force(docs, doc_rows, block, block_shingles):
    want = sorted(brute_similar(doc_rows), key=str)
    assert rows_of(similar.similar(docs, block, block_shingles)) == want and sum(i != c for i, c in want) > 10


def test_similar_odd_rows(odd, odd_rows):
    assert rows_of(similar.similar(odd)) == sorted(brute_similar(odd_rows), key=str)
    assert similar.similar(odd.limit(0)).count() == 0 and similar.one_of_each(odd.limit(0)).columns == odd.columns


def test_masks_miss_no_pair():
    rng, masks = random.Random(1), [m % (1 << 64) for m in similar._masks()]
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), similar.MAX_BITS))
        assert any(not m & differ for m in masks)
