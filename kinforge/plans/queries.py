"""Registered queries over the driver's tables, most of them over a record view of `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import keys, rules, text
from kinforge.operators import blocking, features, metrics, model, split, validate
from kinforge.plans import linkage
from kinforge.plans.oracle import LOW_CAPS, MISSING_FLAGS, RANK_K, SQL
from kinforge.session import SETTINGS
from kinforge.shared import checkpointed, new_folder, settings
from kinforge.sources import records as rec
from kinforge.streaming import probe

FLAGSHIP = "block_all_topk"
IDS = ["source1_entity_id", "candidate_entity_id"]
Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _view(spark: SparkSession, sf_dir: str, digest: bool = False) -> DataFrame:
    """The record view, a few hundred bytes a text, dealt evenly to all cores by its id."""
    return rec.record_view(_docs(spark, sf_dir), digest).repartition(spark.sparkContext.defaultParallelism, "entity_id")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record view with digests in the shared folder: the texts are read once."""
    return checkpointed(_view(spark, sf_dir, digest=True))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[linkage.Inputs, DataFrame]:
    """Inputs and true pairs over one stored view."""
    view = _stored(spark, sf_dir)
    return linkage.view_inputs(view), linkage.view_truth(view)


def _inputs(spark: SparkSession, sf_dir: str) -> linkage.Inputs:
    return linkage.view_inputs(_view(spark, sf_dir))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.view_truth(_view(spark, sf_dir, digest=True))


def _pairs(inputs: linkage.Inputs, k: int = RANK_K) -> DataFrame:
    return blocking.candidate_pairs(inputs.s1, inputs.catalogue, k)


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and executors share."""
    return new_folder(spark, "kinforge")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: blocking.rounded(F.col(c).cast("double"), digits) for c in columns})


def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir).select(*rec.RECORD.names)


def source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = rec.with_source(_view(spark, sf_dir).select("entity_id"))
    return _long(tagged, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.shares(_view(spark, sf_dir).select("country"), "country"), 6, "share")


def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = {"no_name": "business_name", "no_address": "business_address"}
    counts = [F.sum(text.is_missing(F.col(c)).cast("long")).alias(n) for n, c in gone.items()]
    return _long(_view(spark, sf_dir), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *counts)


def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = []
    for side, c in (("name", "business_name"), ("address", "business_address")):
        made += [F.round(F.avg(F.length(c)), 6).alias(f"mean_{side}"), F.max(F.length(c)).cast("long").alias(f"max_{side}")]
    return _view(spark, sf_dir).groupBy("country").agg(*made)


def duplicate_name_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["country", "business_name", "business_address"]
    return _view(spark, sf_dir).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/records"
    scan_records(spark, sf_dir).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    read = rec.read_tsv(spark, path)
    return read.na.fill("", ["business_name", "business_address"])


def parquet_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, inputs = _folder(spark), _inputs(spark, sf_dir)
    for name, df in (("s2", inputs.s2), ("s3", inputs.s3)):
        rec.write_parquet(df.select("entity_id", "country"), f"{folder}/{name}")
    rec.merge_parquet(spark, [f"{folder}/s2", f"{folder}/s3"], f"{folder}/all")
    return rec.read_parquet(spark, f"{folder}/all", columns=["entity_id", "country"])


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, path = _inputs(spark, sf_dir), f"{_folder(spark)}/ids.tsv"
    rec.write_id_lists(inputs.s1.select(F.col("entity_id").alias("source1_entity_id"), F.lit("").alias("matched_entity_ids")), path)
    return rec.read_ids(spark, path)


def ground_truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir)


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return split.with_stratum(rec.matched_lists(inputs.s1, truth), inputs.s1)


def truth_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.truth_classes(_view(spark, sf_dir, digest=True))


def first_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.first_per_country(_strata(spark, sf_dir).select("source1_entity_id", "country"), 25)


def match_count_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("match_bucket").agg(F.count(F.lit(1)).alias("n"))


def match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_strata(spark, sf_dir), "match_count").groupBy("match_count").agg(F.count(F.lit(1)).alias("n"))


def stratum_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.shares(_strata(spark, sf_dir).select("stratum"), "stratum"), 6, "share")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(_strata(spark, sf_dir), 100).select("source1_entity_id", "country", "stratum")


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.uniform_sample(_view(spark, sf_dir).select("entity_id"), 50)


def semi_join_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return split.only_ids(inputs.s1.select("entity_id"), truth)


def anti_join_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return split.without_ids(inputs.s1.select("entity_id"), truth)


def union_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_inputs(spark, sf_dir).catalogue, "source").groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"))


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.normalize(_view(spark, sf_dir)).select("entity_id", "n_norm")


def normalize_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.normalize(_view(spark, sf_dir)).select("entity_id", "a_norm")


def _normalized(view: DataFrame) -> DataFrame:
    out = text.normalize(view)
    return out.select("entity_id", "n_norm", "n_clean", "n_has", "a_norm", "a_has", "a_postal", "a_street", "c_norm")


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(_view(spark, sf_dir))


def _keys(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = keys.exploded(_view(spark, sf_dir), "entity_id").filter(F.col("strategy") == strategy)
        return _long(found.select("entity_id", "key", "pos"), "pos")

    return query


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = _inputs(spark, sf_dir).catalogue
    return blocking.postings(blocking.candidate_keys(catalogue, ("entity_id",)), catalogue)


def posting_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).drop("idf")


def posting_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_postings(spark, sf_dir).drop("df"), 6, "idf")


def hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys beyond a hundredth of their family's cap."""
    caps = F.create_map(*(x for s, n in rules.POSTING_CAPS.items() for x in (F.lit(s), F.lit(n))))
    return posting_df(spark, sf_dir).filter(F.col("df") > caps[F.col("strategy")] / 100)


def _block(*strategies: str, caps: dict[str, int] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = linkage.view_inputs(checkpointed(_view(spark, sf_dir)))
        ranked = blocking.candidate_pairs(inputs.s1, inputs.catalogue, 50, caps, strategies=strategies or rules.STRATEGIES)
        return _long(_rounded(ranked, 6, "blocking_score"), "candidate_rank")

    return query


def _dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with marks, digits, legal forms and abbreviations: every rule is met by some."""
    return rec.dressed_view(_docs(spark, sf_dir)).repartition(spark.sparkContext.defaultParallelism, "entity_id")


def dressed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dressed(spark, sf_dir).select(*rec.RECORD.names)


def dressed_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(_dressed(spark, sf_dir))


def dressed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(keys.exploded(_dressed(spark, sf_dir), "entity_id").select("entity_id", "strategy", "key", "pos"), "pos")


def dressed_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = linkage.view_inputs(checkpointed(_dressed(spark, sf_dir)))
    return _long(_rounded(blocking.candidate_pairs(inputs.s1, inputs.catalogue, 50, LOW_CAPS), 6, "blocking_score"), "candidate_rank")


def dressed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = linkage.view_inputs(checkpointed(_dressed(spark, sf_dir)))
    ranked = blocking.candidate_pairs(inputs.s1, inputs.catalogue, 20, LOW_CAPS)
    return _shown(features.pair_features(ranked, inputs.s1, inputs.catalogue))


def stream_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates found by a stream of records, written batch by batch, read back."""
    folder, inputs = _folder(spark), _inputs(spark, sf_dir)
    probe.build_index(inputs.catalogue, f"{folder}/index")
    inputs.s1.select(*rec.RECORD.names).write.parquet(f"{folder}/incoming")
    stream = spark.readStream.schema(rec.RECORD).parquet(f"{folder}/incoming")
    probe.start(spark, stream, f"{folder}/index", f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out").drop("batch")
    return _long(_rounded(found, 6, "blocking_score"), "candidate_rank")


def strategy_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return _rounded(blocking.strategy_recall(blocking.attributed(truth, inputs.s1, inputs.catalogue)), 6, "recall")


KS = (10, 20, 30, 40, 50, 75)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return _rounded(blocking.recall_at(truth, _pairs(inputs), KS), 6, "recall")


def recall_at_k_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    bucket = split.with_stratum(rec.matched_lists(inputs.s1, truth), inputs.s1).select("source1_entity_id", "match_bucket")
    return _rounded(blocking.recall_at(truth.join(bucket, "source1_entity_id"), _pairs(inputs), KS, ("match_bucket",)), 6, "recall")


def recall_at_k_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    country = inputs.s1.select(F.col("entity_id").alias("source1_entity_id"), "country")
    return _rounded(blocking.recall_at(truth.join(country, "source1_entity_id"), _pairs(inputs), KS, ("country",)), 6, "recall")


def reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _ = _sides(spark, sf_dir)
    return _rounded(blocking.reduction(inputs.s1, inputs.catalogue, _pairs(inputs)), 6, "reduction_ratio")


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return features.pair_features(_pairs(inputs), inputs.s1, inputs.catalogue, truth)


def _shown(rows: DataFrame) -> DataFrame:
    """Feature rows rounded, so that engines that add in other orders agree."""
    floats = {f: blocking.rounded(F.col(f).cast("double"), 4 if f in ("blocking_score", "score_gap_to_top") else 5) for f, t in features.FEATURES if t == "float"}
    return _long(rows.withColumns(floats), *(f for f, t in features.FEATURES if t != "float"), *(["label"] if "label" in rows.columns else []))


def pair_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_feature_rows(spark, sf_dir))


def clipped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _ = _sides(spark, sf_dir)
    rows = features.clipped(features.pair_features(_pairs(inputs), inputs.s1, inputs.catalogue), 10, 20)
    return _long(rows.select(*IDS, "candidate_rank", "candidate_count"), "candidate_rank", "candidate_count")


def _features(*columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs, _ = _sides(spark, sf_dir)
        sided = features.with_sides(checkpointed(features.with_meta(_pairs(inputs))), inputs.s1, inputs.catalogue)
        return _shown(features.features(sided)).select(*IDS, *columns)

    return query


def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return _rounded(metrics.label_balance(features.labelled(_pairs(inputs), truth)), 6, "positive_rate", "scale_pos_weight")


def feature_label_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.label_correlation(_feature_rows(spark, sf_dir))
    return _rounded(found.filter(F.col("feature").isin("candidate_rank", "is_source2")).select("feature", "correlation"), 5, "correlation")


def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_rounded(features.label_correlation(_feature_rows(spark, sf_dir)), 4, "correlation"), "place")


def _scored(inputs: linkage.Inputs) -> DataFrame:
    """Candidate pairs with a hand-made score."""
    return _pairs(inputs).withColumn("score", F.least(F.lit(1.0), blocking.rounded(F.col("blocking_score") / 40.0, 6)))


def entity_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    counts = metrics.entity_counts(inputs.s1, truth, _scored(inputs).filter("score >= 0.75"))
    return _long(_rounded(metrics.entity_scores(counts), 6, "precision", "recall", "f"), "tp", "n_true", "n_pred")


_MEANS = metrics.MACRO[:5]


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return _rounded(metrics.evaluate(inputs.s1, truth, _scored(inputs).filter("score >= 0.75")), 6, *_MEANS)


def _sweep(low: float, high: float, step: float) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs, truth = _sides(spark, sf_dir)
        return _rounded(metrics.threshold_sweep(inputs.s1, truth, _scored(inputs), metrics.grid(low, high, step)), 6, *_MEANS)

    return query


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_sweep(0.10, 0.95, 0.05)(spark, sf_dir))


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, truth = _sides(spark, sf_dir)
    return _rounded(metrics.ranking_quality(features.labelled(_scored(inputs), truth)), 6, "roc_auc", "average_precision")


def blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _ = _sides(spark, sf_dir)
    rows = _scored(inputs).withColumnRenamed("score", "a").withColumn("b", 1.0 / F.col("candidate_rank"))
    return _rounded(model.blend(rows, ["a", "b"], [0.6, 0.4]).select(*IDS, "score"), 6, "score")


def match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _ = _sides(spark, sf_dir)
    return rec.matched_lists(inputs.s1, _scored(inputs).filter("score >= 0.75"))


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, _ = _sides(spark, sf_dir)
    return rec.candidate_lists(inputs.s1, _pairs(inputs))


def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on a made file that breaks each once."""
    lines = ["S1-1\tS1-1,S2-5", "S1-2\tS2-5,S2-5", "S1-3\tS2-404", "S1-3\t", "S1-9\tX-7", "no tab here", ""]
    rows = validate.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    required = spark.createDataFrame([(f"S1-{k}",) for k in (1, 2, 3, 4)], "entity_id string")
    targets = spark.createDataFrame([("S2-5",), ("S3-6",)], "entity_id string")
    return validate.list_findings(rows, required, targets)


def validate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the true lists of all records, some broken by a rule on their number."""
    inputs, truth = _sides(spark, sf_dir)
    number = F.substring_index("source1_entity_id", "-", -1).cast("long")
    turn, s1, own = F.floor(number / 20) % 16, F.col("source1_entity_id"), F.col("matched_entity_ids")

    def line(first: Column, ids: Column) -> Column:
        return F.struct(first.alias("first"), ids.alias("ids"))

    made = (
        F.when(turn == 1, F.array(line(s1, own), line(s1, own)))
        .when(turn == 2, F.array(line(s1, F.concat_ws(",", s1, F.when(own != "", own)))))
        .when(turn == 3, F.array(line(s1, F.concat(F.lit("S2-none"), number))))
        .when(turn == 4, F.array(line(s1, F.concat(F.lit("X-"), number))))
        .when(turn == 5, F.array(line(s1, F.lit("S3-none,S3-none"))))
        .when(turn == 7, F.array(line(F.concat(F.lit("S1-extra"), number), own)))
        .otherwise(F.array(line(s1, own)))
    )
    rows = rec.matched_lists(inputs.s1, truth).filter(turn != 0).select(turn.alias("turn"), F.explode(made).alias("r"))
    value = F.when(F.col("turn") == 6, F.concat(F.lit("no tab "), F.col("r.first"))).otherwise(F.concat_ws("\t", "r.first", "r.ids"))
    return validate.list_findings(validate.parsed(rows.select(value.alias("value"))), inputs.s1, inputs.catalogue)


def matched_not_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs that are not their record's best candidate, by the validator's subset check over whole lists."""
    inputs, truth = _sides(spark, sf_dir)
    lists = (rec.matched_lists(inputs.s1, truth), rec.candidate_lists(inputs.s1, _pairs(inputs, 1)))
    lines = [x.select(F.concat_ws("\t", *x.columns).alias("value")) for x in lists]
    return validate.not_in_candidates(*(validate.parsed(x) for x in lines))


#: What the wide projection of the feature rows needs in any session: the JVM only interprets
#: the one large method that Spark would make of it, and partitions joined by their bytes are
#: few and uneven where a row costs that much.
_WIDE = {"spark.sql.codegen.hugeMethodLimit": SETTINGS["spark.sql.codegen.hugeMethodLimit"], "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def _written_features(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Feature rows, written once and read again."""
    rows = _feature_rows(spark, sf_dir)
    with settings(spark, _WIDE):
        rec.write_parquet(rows, f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


def gbt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that is stored and loaded again."""
    folder = _folder(spark)
    rows = _written_features(spark, sf_dir, folder)
    model.save(model.train(rows, model.Learner("gbt", dict(model.GBT_VARIANTS["quick"]))), f"{folder}/model")
    return model.score(features.clipped(rows), model.load(f"{folder}/model")).select(*IDS, "label", "score")


def gbt_cv_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-AUC and average precision of out-of-fold scores."""
    folder = _folder(spark)
    scored = model.out_of_fold(_written_features(spark, sf_dir, folder), model.Learner("gbt", {"maxIter": 5, "maxDepth": 4}))
    return metrics.ranking_quality(scored)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_records, source_tag, country_counts, missing_profile, length_profile, duplicate_name_addr, tsv_round_trip, parquet_merge, first_ids,
        ground_truth_pairs, truth_classes, first_per_country, match_count_buckets, match_distribution, stratum_shares, stratified_split, uniform_sample, semi_join_val, anti_join_train,
        union_catalogues, normalize_names, normalize_addresses, normalized_records, posting_df, posting_idf, hot_keys, dressed_records, dressed_normalized, dressed_keys, dressed_blocking, dressed_features, stream_probe, strategy_recall,
        recall_at_k, recall_at_k_by_bucket, recall_at_k_by_country, reduction_ratio, pair_features_full, clipped_features, label_balance, feature_label_corr, feature_audit,
        entity_f05, macro_metrics, best_threshold, ranking_quality, blend_scores, match_lists, candidate_lists, validate_results, validate_lists, matched_not_candidates,
        gbt_score, gbt_cv_auc,
    )
} | {
    "keys_name": _keys("name_tokens"),
    "keys_prefix": _keys("char_ngrams"),
    "keys_soundex": _keys("phonetic"),
    "keys_address": _keys("address"),
    "block_token": _block("name_tokens"),
    "block_prefix": _block("char_ngrams"),
    "block_phonetic": _block("phonetic"),
    "block_address": _block("address"),
    "block_all_topk": _block(),
    "block_capped": _block(caps=LOW_CAPS),
    "threshold_sweep": _sweep(0.10, 0.95, 0.05),
    "threshold_sweep_fine": _sweep(0.92, 0.995, 0.005),
    "sim_char3_jaccard": _features("name_char3_jaccard"),
    "sim_levenshtein": _features("name_lev_sim", "addr_lev_sim"),
    "sim_jaro_winkler": _features("name_jw_sim", "addr_jw_sim"),
    "sim_token_jaccard": _features("name_word_jaccard", "addr_word_jaccard", "name_common_tokens", "addr_common_tokens"),
    "sim_token_ratios": _features("name_token_sort", "name_token_set", "addr_token_sort", "addr_token_set"),
    "len_features": _features("name_len_ratio", "name_len_diff", "addr_len_diff"),
    "digit_overlap": _features("digits_jaccard", "digits_overlap"),
    "exact_flags": _features("name_exact_clean", "name_exact_raw", "addr_exact_norm", "postal_exact", "street_num_exact"),
    "missing_flags": _features(*MISSING_FLAGS),
    "meta_features": _features("score_gap_to_top", "candidate_rank", "candidate_count", "is_source2", "is_source3"),
}

ORACLE_SQL: dict[str, str] = dict(SQL)
