import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinforge.functions import similarity as s

# (a, b, levenshtein, jaro-winkler, token sort), published to four digits
GOLDEN = [
    ("keely owen signature wells", "keely owen", 0.3846, 0.8769, 0.5556),
    ("kci polytechnic", "kcipolytechnic com", 0.7222, 0.9326, 0.8485),
    ("kestic coastal llc", "llc kestic coosastla", 0.5000, None, 0.8947),
    ("runnion and bravo twin", "bravo bravo jones midtown incorporated", 0.1842, 0.6475, 0.5000),
    ("kopp cary d m d", "kopp anchor cádenza incorporated", 0.3125, 0.6621, 0.4681),
    ("federal corporation clinic", "8righteus estate", 0.1154, 0.3686, 0.2381),
    ("e g xii", "dixon college", 0.0769, 0.4420, 0.4000),
]


@pytest.mark.parametrize("a, b, lev, jw, sort", GOLDEN)
def test_golden(a, b, lev, jw, sort):
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    assert round(2 * int(s.common_subsequences([x], [y])[0]) / (len(x) + len(y)), 4) == sort
    if jw:
        assert round(float(s.jaro_winklers([a], [b])[0]), 4) == jw


def test_golden_levenshtein(spark):
    df = spark.createDataFrame([(a, b) for a, b, *_ in GOLDEN], "a string, b string")
    got = [round(r[0], 4) for r in df.select(s.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [g[2] for g in GOLDEN]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_jaro_winkler(a, b):
    """Letter by letter: the first letter of b that is free and near enough."""
    if not a or not b:
        return float(not a and not b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            hits.append(c)
    if not hits:
        return 0.0
    m = len(hits)
    swapped = sum(x != y for x, y in zip(hits, [c for c, f in zip(b, free, strict=True) if not f], strict=True)) // 2
    value = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
    return value + 0.1 * prefix * (1 - value) if value > 0.7 else value


TEXTS = st.one_of(st.text("abcé ", max_size=12), st.text("ab", min_size=50, max_size=150), st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=70))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=12))
def test_many_pairs_at_once(pairs):
    pairs += [(a, a) for a, _ in pairs]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert s.common_subsequences(a, b).tolist() == [brute_lcs(x, y) for x, y in pairs]
    assert s.jaro_winklers(a, b).tolist() == pytest.approx([brute_jaro_winkler(x, y) for x, y in pairs])
    assert all(s.jaro_winklers(a, a) == 1.0) and len(s.jaros([], [])) == len(s.common_subsequences([], [])) == 0


def brute_set_ratio(a, b):
    both, x, y = sorted(set(a) & set(b)), sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if not x or not y:
        return float(bool(both))
    x, y, shared = " ".join(x), " ".join(y), len(" ".join(both))
    gap = int(shared > 0)
    n, m = shared + gap + len(x), shared + gap + len(y)
    found = [1 - (len(x) + len(y) - 2 * brute_lcs(x, y)) / (n + m)]
    return max(found + ([1 - (gap + len(x)) / (shared + n), 1 - (gap + len(y)) / (shared + m)] if shared else []))


def test_set_ratio(spark):
    rng = random.Random(1)
    rows = [(["a"], ["a", "b"]), ([], ["b"]), (["ab"], ["ab"]), (["x", "y", "ab"], ["x", "y", "cd"]), ([], []), (None, ["a"])]
    rows += [(sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}), sorted({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))})) for _ in range(100)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    got = df.select("k", s.token_set_ratio(F.col("a"), F.col("b")).alias("v"), s.token_sort_ratio(F.col("a"), F.col("b")).alias("w")).orderBy("k").collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert r["v"] == (None if a is None else pytest.approx(brute_set_ratio(a, b)))
        if a is not None:
            x, y = " ".join(sorted(a)), " ".join(sorted(b))
            assert r["w"] == pytest.approx(2 * brute_lcs(x, y) / (len(x) + len(y)) if x or y else 1.0)


def test_native_parts(spark):
    df = spark.createDataFrame([("abcd", "006201 x 000 6201"), ("ab", ""), ("", "१२ 7")], "t string, d string")
    rows = df.select(s.qgrams(F.col("t")).alias("q"), s.digit_sets(F.col("d")).alias("d")).collect()
    assert [sorted(r["q"]) for r in rows] == [["abc", "bcd"], ["ab"], []]
    texts = ["abcabc", "a", "ab", "", "éa😀éa😀", "aaaa"]
    codes = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", s.qgrams(F.col("t")).alias("q"), s.trigram_codes(F.col("t")).alias("c")).orderBy("k").collect()
    number = lambda g: sum(ord(c) << 21 * (2 - i) for i, c in enumerate(g))
    assert all(sorted(map(number, r["q"])) == sorted(r["c"]) for r in codes)
    assert [sorted(r["d"]) for r in rows] == [["0", "6201"], [], ["7", "१२"]]
