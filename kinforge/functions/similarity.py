"""String similarities: native where Spark has the parts; Jaro-Winkler and common
subsequences are Arrow UDFs that work on all pairs of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def jaccard(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Of two sets without repeats; 0 for two empty ones.

    shared: how many elements both have, where it is known."""
    shared = F.size(F.array_intersect(a, b)) if shared is None else shared
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def qgrams(text: Column, q: int = 3) -> Column:
    """Set of substrings of q characters; a shorter text is its own only one."""
    n = F.length(text)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(q))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < q, F.array(text)).otherwise(many)


def trigram_codes(text: Column) -> Column:
    """`qgrams` of three characters, each as one number made of their code points, so
    that sets of them are compared as numbers."""
    n = F.length(text)

    def code(i: Column) -> Column:
        one, two, three = (F.ascii(F.substring(text, i + k, F.lit(1))).cast("long") for k in range(3))
        return F.shiftleft(one, 42).bitwiseOR(F.shiftleft(two, 21)).bitwiseOR(three)

    made = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), code))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(made)


def digit_sets(text: Column) -> Column:
    """Set of the digit runs of a text without leading zeros."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), 0)
    return F.array_distinct(F.transform(runs, lambda x: F.regexp_replace(x, "^0+(?=.)", "")))


def sorted_tokens(tokens: Column) -> Column:
    return F.array_join(F.sort_array(tokens), " ")


# --- many pairs at once, as bits of 64-bit words ---

_ONES = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
#: Character comparisons made at once.
_WORK = 1 << 24


def _letters(texts: list[str], width: int, pad: int) -> np.ndarray:
    """Code points, one row a text, padded to a width."""
    out = np.full((len(texts), width), pad, np.uint32)
    raw = np.array(texts, f"U{max(1, max(map(len, texts), default=1))}").view(np.uint32).reshape(len(texts), -1)
    size = np.array([len(t) for t in texts])
    inside = np.arange(raw.shape[1]) < size[:, None]
    out[:, : raw.shape[1]][inside] = raw[inside]
    return out


def _batches(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which pairs, letters of a, letters of b, equal): pairs of about the same size
    together; equal[n, i, w] has the bits of the places of b that have letter i of a."""
    size = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    order = np.lexsort((size[:, 0], -(-size[:, 1] // 64)))
    at = 0
    while at < len(order):
        end, wide, long = at, 0, 0
        while end < len(order):
            n, m = size[order[end]]
            wide, long = max(wide, -(-int(m) // 64) * 64), max(long, int(n))
            if end > at and (end - at + 1) * max(1, wide) * max(1, long) > _WORK:
                break
            end += 1
        pick = order[at:end]
        at = end
        wide, long = max(64, -(-int(size[pick, 1].max()) // 64) * 64), max(1, int(size[pick, 0].max()))
        left, right = _letters([a[i] for i in pick], long, 0xFFFFFFFE), _letters([b[i] for i in pick], wide, 0xFFFFFFFF)
        equal = np.packbits(left[:, :, None] == right[:, None, :], axis=2, bitorder="little").view("<u8")
        yield pick, left, right, equal


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, by bits with carry."""
    out = np.zeros(len(a), np.int64)
    size = np.array([len(y) for y in b], np.int64)
    for pick, _, _, equal in _batches(a, b):
        n, long, width = equal.shape
        state = np.full((width, n), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(long):
            carry = np.zeros(n, np.uint64)
            for w in range(width):
                hit = state[w] & equal[:, i, w]
                first = state[w] + hit
                total = first + carry
                carry = ((first < hit) | (total < first)).astype(np.uint64)
                state[w] = total | (state[w] - hit)
        held = _ONES[np.clip(size[pick][None, :] - 64 * np.arange(width)[:, None], 0, 64)]
        out[pick] = np.bitwise_count(~state & held).sum(axis=0)
    return out


def jaros(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of each pair; 1 for two empty texts, 0 for one."""
    out = np.zeros(len(a))
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for pick, left, right, equal in _batches(a, b):
        n, long, width = equal.shape
        na, nb = sizes[pick].T
        reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
        taken = np.zeros((width, n), np.uint64)
        hit = np.zeros((n, long), bool)
        for i in range(long):
            low, high = np.maximum(i - reach, 0), np.minimum(i + reach + 1, nb)
            open_ = i < na
            for w in range(width):
                near = _ONES[np.clip(high - 64 * w, 0, 64)] & ~_ONES[np.clip(low - 64 * w, 0, 64)]
                free = np.where(open_, equal[:, i, w] & near & ~taken[w], np.uint64(0))
                taken[w] |= free & (~free + np.uint64(1))  # the first place
                found = free != 0
                hit[:, i] |= found
                open_ = open_ & ~found
        used = np.unpackbits(np.ascontiguousarray(taken.T).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
        m = hit.sum(axis=1)
        row = np.repeat(np.arange(n), m)
        swapped = np.bincount(row, weights=left[hit] != right[used], minlength=n).astype(np.int64) // 2
        some = np.maximum(m, 1)
        value = (m / np.maximum(na, 1) + m / np.maximum(nb, 1) + (m - swapped) / some) / 3
        out[pick] = np.where(m > 0, value, (na + nb == 0).astype(float))
    return out


def jaro_winklers(a: list[str], b: list[str], weight: float = 0.1, least: float = 0.7) -> np.ndarray:
    """Jaro similarity, raised by up to four equal first letters where it is over `least`."""
    value = jaros(a, b)
    if not len(value):
        return value
    heads = [_letters([x[:4] for x in side], 4, pad) for side, pad in ((a, 0xFFFFFFFE), (b, 0xFFFFFFFF))]
    prefix = np.cumprod(heads[0] == heads[1], axis=1).sum(axis=1)
    return np.where(value > least, value + prefix * weight * (1 - value), value)


def _of_pairs(a: pd.Series, b: pd.Series, measure) -> pd.Series:
    """The measure of the distinct pairs that have both texts; null for all other."""
    both = a.notna() & b.notna()
    pairs = pd.DataFrame({"a": a[both], "b": b[both]})
    which = pairs.groupby(["a", "b"], sort=False).ngroup() if len(pairs) else pd.Series([], dtype="int64")
    first = pairs[~which.duplicated()]
    out = pd.Series(np.nan, index=a.index)
    out[both] = measure(first["a"].tolist(), first["b"].tolist())[which.to_numpy()] if len(pairs) else np.nan
    return out


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(a, b, jaro_winklers)


@F.pandas_udf(T.DoubleType())
def common_subsequence_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(a, b, common_subsequences)


def ratio(a: Column, b: Column) -> Column:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * common_subsequence_udf(a, b) / total)


def token_parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Of two token arrays: length of the shared tokens' text, text of either side's own tokens."""
    only = [F.array_join(F.sort_array(F.array_except(x, y)), " ") for x, y in ((a, b), (b, a))]
    return F.length(F.array_join(F.array_intersect(a, b), " ")), *only


def token_set_ratio(a: Column, b: Column, parts: tuple[Column, Column, Column] | None = None) -> Column:
    """Best of three ratios of shared and own tokens of two token arrays (all sorted, without repeats).

    parts: `token_parts` of both, where they are columns already."""
    shared, *only = token_parts(a, b) if parts is None else parts
    own = [F.length(x) for x in only]
    gap = F.when(shared > 0, 1).otherwise(0)
    whole = [shared + gap + n for n in own]
    apart = own[0] + own[1] - 2 * common_subsequence_udf(*only)
    plain = 1 - apart / (whole[0] + whole[1])
    with_shared = F.greatest(plain, *(1 - (gap + n) / (shared + w) for n, w in zip(own, whole, strict=True)))
    apart_only = (own[0] > 0) & (own[1] > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(~apart_only, F.when(shared > 0, 1.0).otherwise(0.0)).when(shared > 0, with_shared).otherwise(plain)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))
