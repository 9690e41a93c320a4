"""Blocking: scored candidate pairs from shared keys, top K of each record.

One plan serves all countries: country, strategy and key together are the join
key, so no partition is as large as a country.  A catalogue's keys are built
once and written to the shared folder; all else reads them there.  Keys whose
posting lists are beyond the cap never reach the join, and those that hold a
large share of all postings not even its shuffle; that bounds how far a hot key
can spread.  Records are dealt to blocks, and each block gets every posting list
that it asks for once, as an array of numbers; the pairs themselves, many to a
record, are made, summed and cut to the best K inside the block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import rules
from kinforge.functions.keys import exploded, key_weight
from kinforge.operators.joins import split_join
from kinforge.shared import checkpointed

KEY = ["country", "strategy", "key"]


def query_keys(records: DataFrame) -> DataFrame:
    """(country, strategy, key, pos, source1_entity_id) of the records asked about."""
    keys = exploded(records.filter(F.col("country").isNotNull()), "entity_id", "country")
    return keys.withColumnRenamed("entity_id", "source1_entity_id")


#: The order in which equal candidates are listed.
ORDER = ("source", "entity_id")


def candidate_keys(records: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(country, strategy, key, candidate_entity_id, ord_<column>...); the columns of
    `order`, besides the id, by which equal candidates are listed."""
    known = records.filter(F.col("country").isNotNull()).withColumns({f"ord_{c}": F.col(c) for c in order if c != "entity_id"})
    return exploded(known, "entity_id", "country", *_ord(order)).withColumnRenamed("entity_id", "candidate_entity_id").drop("pos")


def _ord(order: tuple[str, ...]) -> list[str]:
    return [f"ord_{c}" for c in order if c != "entity_id"]


def postings(keys: DataFrame, records: DataFrame) -> DataFrame:
    """(country, strategy, key, df, idf): length of each posting list, repeats
    counted, and ln(1 + N / (1 + df)) with N candidates in the country."""
    df = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("df"))
    n = records.filter(F.col("country").isNotNull()).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "country").withColumn("idf", F.log(1.0 + F.col("n") / (1.0 + F.col("df")))).drop("n")


def under_cap(post: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Posting lists that are not too long."""
    caps = rules.POSTING_CAPS | (caps or {})
    allowed = F.create_map(*(x for s, n in caps.items() for x in (F.lit(s), F.lit(n))))
    return post.filter(F.col("df") <= allowed[F.col("strategy")])


#: Keys that are dropped before any shuffle hold at least this share of all postings, so
#: there are at most as many as its inverse, and they can be broadcast.
HOT_SHARE = 1e-5


def reachable(listed: DataFrame, post: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Catalogue keys without those of very long posting lists beyond the cap."""
    total = post.agg(F.sum("df").alias("_total"))  # one row
    over = post.join(under_cap(post, caps).select(*KEY), KEY, "left_anti").crossJoin(F.broadcast(total))
    hot = over.filter(F.col("df") >= F.col("_total") * HOT_SHARE).select(*KEY)
    return listed.join(F.broadcast(hot), KEY, "left_anti")


def weights(post: DataFrame) -> DataFrame:
    return post.select(*KEY, key_weight(F.col("strategy"), F.col("key"), F.col("idf")).alias("weight"))


def rounded(value: Column, digits: int) -> Column:
    """Rounded as SQL engines round a binary number: the product with a power of ten
    to the next integer.  Spark's own rounding goes by the shortest decimal and so
    parts from it at some halves (16.0844915 to six digits: 16.084491, not ...2)."""
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale


def scores(asked: DataFrame, weighted: DataFrame, listed: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, blocking_score, first_pos, ord_...).

    Only numbers are aggregated, so rows are summed by hash, before the shuffle too;
    an id that is listed twice takes the least of each ord column."""
    met = split_join(asked, weighted, KEY).join(listed, KEY)
    ords = [c for c in listed.columns if c.startswith("ord_")]
    summed = met.groupBy("source1_entity_id", "candidate_entity_id").agg(F.sum("weight").alias("s"), F.min("pos").alias("first_pos"), *(F.min(c).alias(c) for c in ords))
    # rounded, so that the order of adding decides no rank
    return summed.select("source1_entity_id", "candidate_entity_id", rounded(F.col("s"), 9).alias("blocking_score"), "first_pos", *ords)


def top_k(scored: DataFrame, k: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The k best candidates of each record with their rank."""
    by = ["candidate_entity_id" if c == "entity_id" else f"ord_{c}" for c in order]
    best = Window.partitionBy("source1_entity_id").orderBy(F.col("blocking_score").desc(), "first_pos", *by)
    ranked = scored.withColumn("candidate_rank", F.row_number().over(best)).filter(F.col("candidate_rank") <= k)
    return ranked.select("source1_entity_id", "candidate_entity_id", "blocking_score", "candidate_rank")


#: Records of a block.  A block's input is bounded by the caps, however large the tables are.
BLOCK = 2048
#: Pairs that are summed at once in a block.
_PAIRS = 1 << 20
_RANKED = "source1_entity_id string, num long, blocking_score double, candidate_rank int"


def numbered(candidates: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(num, candidate_entity_id): each id of a known country with a number that grows
    in the order in which equal candidates are listed."""
    once = candidates.filter(F.col("country").isNotNull()).groupBy("entity_id").agg(*(F.min(c).alias(f"ord_{c}") for c in order if c != "entity_id"))
    by = ["entity_id" if c == "entity_id" else f"ord_{c}" for c in order]
    return checkpointed(once.orderBy(*by).select(F.monotonically_increasing_id().alias("num"), F.col("entity_id").alias("candidate_entity_id")))


def ranked_in_blocks(asked: DataFrame, weighted: DataFrame, listed: DataFrame, blocks: int, k: int) -> DataFrame:
    """(source1_entity_id, num, blocking_score, candidate_rank): the k best of each record.

    listed: catalogue keys with `num`.  A record's weights are added in the order of
    its keys, so candidates that meet the same keys have exactly equal sums."""
    lists = split_join(listed.select(*KEY, "num"), weighted, KEY).groupBy(*KEY).agg(F.first("weight").alias("weight"), F.sort_array(F.collect_list("num")).alias("nums"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("source1_entity_id"), F.lit(blocks)))
    asks = dealt.groupBy("block", *KEY).agg(F.collect_list(F.struct("source1_entity_id", "pos")).alias("asks"))
    return asks.join(lists, KEY).select("block", "weight", "nums", "asks").groupBy("block").applyInArrow(_ranker(k), _RANKED)


def _ranker(k: int) -> Callable[[pa.Table], pa.Table]:
    def rank(table: pa.Table) -> pa.Table:
        nums, asks = (pa.concat_arrays(table[c].chunks) for c in ("nums", "asks"))
        weight = table["weight"].to_numpy()
        values, local = np.unique(nums.flatten().to_numpy(), return_inverse=True)
        size = nums.value_lengths().to_numpy()
        start = np.cumsum(size) - size
        key = np.repeat(np.arange(len(size)), asks.value_lengths().to_numpy())
        ids, pos = asks.flatten().flatten()
        pos = pos.to_numpy()
        record, names = pd.factorize(ids.to_numpy(zero_copy_only=False))
        order = np.lexsort((pos, record))
        key, pos, record = key[order], pos[order], record[order]
        made = np.cumsum(size[key])
        ends = np.append(np.flatnonzero(np.diff(record)) + 1, len(record))  # of records
        out, at = [], 0
        while at < len(record):
            limit = (made[at - 1] if at else 0) + _PAIRS
            end = ends[max(np.searchsorted(made[ends - 1], limit, "right") - 1, np.searchsorted(ends, at, "right"))]
            out.append(_best(key[at:end], pos[at:end], record[at:end], weight, size, start, local, len(values), k))
            at = end
        which, cand, score, place = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"source1_entity_id": pa.array(names).take(pa.array(which)), "num": values[cand], "blocking_score": score, "candidate_rank": place.astype(np.int32)})

    return rank


def _best(key, pos, record, weight, size, start, local, n, k: int) -> tuple[np.ndarray, ...]:
    """(record, candidate, score, rank) of some records' keys, which are in order of record and place."""
    times = size[key]
    spread = np.repeat(start[key] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    code = np.repeat(record.astype(np.int64) * n, times) + local[spread]
    order = np.argsort(code, kind="stable")  # of one pair, by place
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    score = np.add.reduceat(np.repeat(weight[key], times)[order], first) * 1e9
    whole = np.floor(score)
    score = (whole + (score - whole >= 0.5)) / 1e9  # as `rounded`
    first_pos = np.repeat(pos, times)[order[first]]
    which, cand = np.divmod(code[first], n)
    edges = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
    picked, places = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = score[a:b]
        pick = np.arange(a, b) if b - a <= k else a + np.flatnonzero(own >= np.partition(own, b - a - k)[b - a - k])
        pick = pick[np.lexsort((cand[pick], first_pos[pick], -score[pick]))][:k]
        picked.append(pick)
        places.append(np.arange(1, len(pick) + 1))
    picked = np.concatenate(picked)
    return which[picked], cand[picked], score[picked], np.concatenate(places)


def candidate_pairs(
    records: DataFrame,
    candidates: DataFrame,
    k: int = 50,
    caps: dict[str, int] | None = None,
    order: tuple[str, ...] = ORDER,
    strategies: tuple[str, ...] = rules.STRATEGIES,
) -> DataFrame:
    """Top k candidates of every record among candidates of the same country."""
    numbers = numbered(candidates, order)
    known = candidates.join(numbers.withColumnRenamed("candidate_entity_id", "entity_id"), "entity_id")
    asked, listed = query_keys(records), candidate_keys(known, ("num",)).withColumnRenamed("ord_num", "num")
    if tuple(strategies) != rules.STRATEGIES:
        asked, listed = (x.filter(F.col("strategy").isin(*strategies)) for x in (asked, listed))
    listed = checkpointed(listed)
    post = checkpointed(postings(listed, candidates))
    blocks = max(-(-records.count() // BLOCK), records.sparkSession.sparkContext.defaultParallelism)
    ranked = ranked_in_blocks(asked, weights(under_cap(post, caps)), reachable(listed, post, caps), blocks, k)
    return ranked.join(numbers, "num").select("source1_entity_id", "candidate_entity_id", "blocking_score", "candidate_rank")


# --- how good the blocking is ---


def attributed(truth: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which strategies find each true pair, whatever the caps: one boolean each."""
    known = truth.select("source1_entity_id", "candidate_entity_id").distinct()
    asked = query_keys(records).select("source1_entity_id", *KEY).distinct()
    listed = candidate_keys(candidates, ("entity_id",)).select("candidate_entity_id", *KEY).distinct()
    met = known.join(asked, "source1_entity_id").join(listed, ["candidate_entity_id", *KEY])
    found = met.groupBy("source1_entity_id", "candidate_entity_id").agg(*(F.max(F.col("strategy") == s).alias(s) for s in rules.STRATEGIES))
    out = known.join(found, ["source1_entity_id", "candidate_entity_id"], "left")
    return out.select("source1_entity_id", "candidate_entity_id", *(F.coalesce(s, F.lit(False)).alias(s) for s in rules.STRATEGIES))


def strategy_recall(found: DataFrame) -> DataFrame:
    """(strategy, found, total, recall), with `union` for any of them."""
    total = F.count(F.lit(1))
    named = {s: F.col(s) for s in rules.STRATEGIES} | {"union": F.greatest(*(F.col(s) for s in rules.STRATEGIES))}
    row = found.agg(total.alias("total"), *(F.sum(c.cast("long")).alias(s) for s, c in named.items()))
    pairs = ", ".join(f"'{s}', `{s}`" for s in named)
    out = row.select("total", F.expr(f"stack({len(named)}, {pairs}) as (strategy, found)"))
    return out.select("strategy", F.coalesce("found", F.lit(0)).alias("found"), "total", (F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"))


def recall_at(truth: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (10, 20, 30, 40, 50, 75), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., k, found, total, recall) of true pairs among the first k candidates."""
    pairs = ["source1_entity_id", "candidate_entity_id"]
    met = truth.join(ranked.select(*pairs, "candidate_rank"), pairs, "left")
    counted = met.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.sum((F.col("candidate_rank") <= k).cast("long")).alias(f"k{k}") for k in ks))
    stacked = ", ".join(f"{k}, coalesce(k{k}, 0L)" for k in ks)
    out = counted.select(*by, "total", F.expr(f"stack({len(ks)}, {stacked}) as (k, found)"))
    return out.select(*by, "k", "found", "total", (F.col("found") / F.col("total")).alias("recall"))


def reduction(records: DataFrame, candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """(pairs, brute_force, reduction_ratio): share of all pairs of a country not looked at."""
    a = records.groupBy("country").agg(F.count(F.lit(1)).alias("a"))
    b = candidates.groupBy("country").agg(F.count(F.lit(1)).alias("b"))
    brute = a.join(b, "country").agg(F.sum(F.col("a") * F.col("b")).alias("brute_force"))
    made = ranked.agg(F.count(F.lit(1)).alias("pairs"))
    # both sides are one row
    return made.crossJoin(brute).withColumn("reduction_ratio", 1 - F.try_divide("pairs", "brute_force"))
