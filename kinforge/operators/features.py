"""The 42 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import rules
from kinforge.functions.similarity import (
    digit_sets,
    jaccard,
    jaro_winkler_udf,
    levenshtein_similarity,
    ratio,
    sorted_tokens,
    token_parts,
    token_set_ratio,
    trigram_codes,
)
from kinforge.functions.text import normalize
from kinforge.shared import checkpointed

# Names, order and types of the feature columns.
FEATURES = (
    ("name_lev_sim", "float"), ("name_jw_sim", "float"), ("name_token_sort", "float"), ("name_token_set", "float"),
    ("name_word_jaccard", "float"), ("name_char3_jaccard", "float"), ("name_common_tokens", "smallint"),
    ("name_len_diff", "smallint"), ("name_len_ratio", "float"), ("name_exact_clean", "tinyint"), ("name_exact_raw", "tinyint"),
    ("name_suffix_match", "float"), ("addr_lev_sim", "float"), ("addr_jw_sim", "float"), ("addr_token_sort", "float"),
    ("addr_token_set", "float"), ("addr_word_jaccard", "float"), ("addr_common_tokens", "smallint"), ("addr_len_diff", "smallint"),
    ("addr_exact_norm", "tinyint"), ("postal_exact", "tinyint"), ("postal_sim", "float"), ("street_num_exact", "tinyint"),
    ("digits_overlap", "tinyint"), ("digits_jaccard", "float"), ("has_name_s1", "tinyint"), ("has_name_cand", "tinyint"),
    ("both_have_name", "tinyint"), ("has_addr_s1", "tinyint"), ("has_addr_cand", "tinyint"), ("both_have_address", "tinyint"),
    ("has_postal_s1", "tinyint"), ("has_postal_cand", "tinyint"), ("both_have_postal", "tinyint"), ("same_country", "tinyint"),
    ("country_freq", "float"), ("blocking_score", "float"), ("candidate_rank", "smallint"), ("candidate_count", "smallint"),
    ("score_gap_to_top", "float"), ("is_source2", "tinyint"), ("is_source3", "tinyint"),
)
FEATURE_NAMES = [name for name, _ in FEATURES]

_SIDE = ["n_raw", "n_norm", "n_clean", "n_has", "a_norm", "a_has", "a_postal", "a_street", "c_norm", "n_sorted", "a_sorted", "n_set", "a_set", "n_grams", "a_digits"]


def with_meta(pairs: DataFrame) -> DataFrame:
    """Ranked pairs with candidate_count (after the cut) and the best score of their record."""
    own = Window.partitionBy("source1_entity_id")
    return pairs.withColumns({"candidate_count": F.count(F.lit(1)).over(own), "top_score": F.max("blocking_score").over(own)})


def with_sides(pairs: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs with both normalized records as structs `l` and `r`; a pair with an
    unknown side is dropped.  Candidates that no pair names are not normalized."""
    asked = pairs.select("candidate_entity_id").distinct()
    named = candidates.join(asked, candidates["entity_id"] == asked["candidate_entity_id"], "left_semi")
    left = sides(records).select(F.col("entity_id").alias("source1_entity_id"), F.struct(*_SIDE).alias("l"))
    right = sides(named).select(F.col("entity_id").alias("candidate_entity_id"), F.struct(*_SIDE).alias("r"))
    return pairs.join(left, "source1_entity_id").join(right, "candidate_entity_id")


def sides(records: DataFrame) -> DataFrame:
    """Normalized records with what features need of one side only, made once a
    record instead of once a pair."""
    made = {
        "n_sorted": sorted_tokens(F.col("n_tokens")),
        "a_sorted": sorted_tokens(F.col("a_tokens")),
        "n_set": F.array_distinct("n_tokens"),
        "a_set": F.array_distinct("a_tokens"),
        "n_grams": trigram_codes(F.col("n_clean")),
        "a_digits": digit_sets(F.col("a_raw")),
    }
    return normalize(records).withColumns(made)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def features(sided: DataFrame) -> DataFrame:
    """The ids and 42 features of pairs with sides and meta columns (label, if there, last)."""

    def both(column: str) -> tuple[Column, Column]:
        return F.col(f"l.{column}"), F.col(f"r.{column}")

    def known(condition: Column, value: Column, missing: float = -1.0) -> Column:
        return F.when(condition, value).otherwise(F.lit(missing))

    n1, n2 = both("n_norm")
    a1, a2 = both("a_norm")
    t1, t2 = both("n_set")
    u1, u2 = both("a_set")
    clean1, clean2 = both("n_clean")
    grams1, grams2 = both("n_grams")
    raw1, raw2 = both("n_raw")
    named = F.col("l.n_has") & F.col("r.n_has")
    placed = F.col("l.a_has") & F.col("r.a_has")
    p1, p2 = (F.coalesce(c, F.lit("")) for c in both("a_postal"))
    coded = (p1 != "") & (p2 != "")
    s1, s2 = (F.regexp_replace(c, "^0+(?=.)", "") for c in both("a_street"))
    streets = s1.isNotNull() & s2.isNotNull()
    d1, d2 = both("a_digits")
    c1, c2 = (F.lower(c) for c in both("c_norm"))
    rates = F.create_map(*(x for c, r in rules.COUNTRY_RATES.items() for x in (F.lit(c), F.lit(r))))
    source = F.when(F.col("candidate_entity_id").startswith("S3-"), 3).otherwise(2)
    only_named = [F.when(named, c) for c in (n1, n2)]  # the UDFs get nulls for all other pairs
    only_placed = [F.when(placed, c) for c in (a1, a2)]
    len1, len2 = F.length(n1), F.length(n2)
    # columns of their own: a condition around them would keep Spark from counting them once
    shared = {"_names": (named, t1, t2), "_places": (placed, u1, u2), "_grams": (named, grams1, grams2), "_digits": (placed, d1, d2)}
    sided = sided.withColumns({c: F.when(on, F.size(F.array_intersect(a, b))) for c, (on, a, b) in shared.items()})
    for side, on, a, b in (("_name", named, t1, t2), ("_place", placed, u1, u2)):
        sided = sided.withColumns({f"{side}_{c}": F.when(on, x) for c, x in zip(("both", "left", "right"), token_parts(a, b), strict=True)})
    parts = {side: tuple(F.col(f"{side}_{c}") for c in ("both", "left", "right")) for side in ("_name", "_place")}
    values = {
        "name_lev_sim": known(named, levenshtein_similarity(n1, n2)),
        "name_jw_sim": F.coalesce(jaro_winkler_udf(*only_named), F.lit(-1.0)),
        "name_token_sort": known(named, ratio(*(F.when(named, c) for c in both("n_sorted")))),
        "name_token_set": F.coalesce(token_set_ratio(F.when(named, t1), F.when(named, t2), parts["_name"]), F.lit(-1.0)),
        "name_word_jaccard": known(named, jaccard(t1, t2, F.col("_names"))),
        "name_char3_jaccard": known(named, jaccard(grams1, grams2, F.col("_grams"))),
        "name_common_tokens": known(named, F.col("_names")),
        "name_len_diff": known(named, F.abs(len1 - len2)),
        "name_len_ratio": known(named, F.least(len1, len2) / F.greatest(len1, len2)),
        "name_exact_clean": known(named, _flag(clean1 == clean2)),
        "name_exact_raw": known(named, _flag(F.lower(raw1) == F.lower(raw2))),
        "name_suffix_match": known(named, F.lit(0.5)),
        "addr_lev_sim": known(placed, levenshtein_similarity(a1, a2)),
        "addr_jw_sim": F.coalesce(jaro_winkler_udf(*only_placed), F.lit(-1.0)),
        "addr_token_sort": known(placed, ratio(*(F.when(placed, c) for c in both("a_sorted")))),
        "addr_token_set": F.coalesce(token_set_ratio(F.when(placed, u1), F.when(placed, u2), parts["_place"]), F.lit(-1.0)),
        "addr_word_jaccard": known(placed, jaccard(u1, u2, F.col("_places"))),
        "addr_common_tokens": known(placed, F.col("_places")),
        "addr_len_diff": known(placed, F.abs(F.length(a1) - F.length(a2))),
        "addr_exact_norm": known(placed, _flag(a1 == a2)),
        "postal_exact": known(coded, _flag(p1 == p2)),
        "postal_sim": known(coded, levenshtein_similarity(p1, p2)),
        "street_num_exact": known(streets, _flag(s1 == s2)),
        "digits_overlap": known(placed, _flag(F.col("_digits") > 0)),
        "digits_jaccard": known(placed, jaccard(d1, d2, F.col("_digits"))),
        "has_name_s1": _flag(F.col("l.n_has")),
        "has_name_cand": _flag(F.col("r.n_has")),
        "both_have_name": _flag(named),
        "has_addr_s1": _flag(F.col("l.a_has")),
        "has_addr_cand": _flag(F.col("r.a_has")),
        "both_have_address": _flag(placed),
        "has_postal_s1": _flag(p1 != ""),
        "has_postal_cand": _flag(p2 != ""),
        "both_have_postal": _flag(coded),
        "same_country": _flag((c1 != "") & (c1 == c2)),
        "country_freq": F.coalesce(rates[c1], F.lit(rules.OTHER_COUNTRY_RATE)),
        "blocking_score": F.col("blocking_score"),
        "candidate_rank": F.col("candidate_rank"),
        "candidate_count": F.col("candidate_count"),
        "score_gap_to_top": F.greatest(F.col("top_score") - F.col("blocking_score"), F.lit(0.0)),
        "is_source2": _flag(source == 2),
        "is_source3": _flag(source == 3),
    }
    label = ["label"] if "label" in sided.columns else []
    return sided.select("source1_entity_id", "candidate_entity_id", *(values[f].cast(t).alias(f) for f, t in FEATURES), *label)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where they are true pairs."""
    both = ["source1_entity_id", "candidate_entity_id"]
    known = truth.select(*both).distinct().withColumn("label", F.lit(1))
    return pairs.join(known, both, "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("tinyint"))


def pair_features(ranked: DataFrame, records: DataFrame, candidates: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Feature rows of ranked candidate pairs, which are written once: they say which
    candidates are normalized and are joined with them."""
    pairs = checkpointed(with_meta(ranked) if truth is None else labelled(with_meta(ranked), truth))
    return features(with_sides(pairs, records, candidates))


def clipped(rows: DataFrame, rank: int = 100, count: int = 200) -> DataFrame:
    """Rank and count cut at scoring time."""
    return rows.withColumns({"candidate_rank": F.least("candidate_rank", F.lit(rank).cast("smallint")), "candidate_count": F.least("candidate_count", F.lit(count).cast("smallint"))})


def label_correlation(rows: DataFrame) -> DataFrame:
    """(feature, correlation, status, place): Pearson correlation with the label, the
    highest at place 1, null (last) for a constant; equal ones by name.

    Status by the signed value: near zero (below 0.01 either way), strong (over
    0.30) and moderate (over 0.10) positive, negative (under -0.10), weak."""
    row = rows.select(*(F.col(f).cast("double").alias(f) for f in FEATURE_NAMES), F.col("label").cast("double").alias("label"))
    one = row.agg(*(F.when(F.max(f) > F.min(f), F.try_divide(F.covar_pop(f, "label"), F.stddev_pop(f) * F.stddev_pop("label"))).alias(f) for f in FEATURE_NAMES))
    pairs = ", ".join(f"'{f}', `{f}`" for f in FEATURE_NAMES)
    out = one.select(F.expr(f"stack({len(FEATURE_NAMES)}, {pairs}) as (feature, correlation)"))
    r = F.col("correlation")
    out = out.withColumn("correlation", F.when(~F.isnan(r), r))
    status = (
        F.when(r.isNull(), "constant")
        .when(F.abs(r) < 0.01, "near zero")
        .when(r > 0.30, "strong positive")
        .when(r > 0.10, "moderate positive")
        .when(r < -0.10, "negative")
        .otherwise("weak")
    )
    best = Window.orderBy(F.round(r, 9).desc_nulls_last(), "feature")  # one row a feature
    return out.withColumns({"status": status, "place": F.row_number().over(best)}).orderBy("place")
