"""The whole job: feature tables, training, inference with sinks and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators import blocking, features, metrics, model, split
from kinforge.operators.audit import Audit
from kinforge.operators.validate import Report, validate
from kinforge.shared import checkpointed
from kinforge.sources import records as rec


@dataclass
class Inputs:
    """Records of the reference table and of both catalogues, and the truth where known.

    both: the records of both catalogues with their source, where they are one table."""

    s1: DataFrame
    s2: DataFrame
    s3: DataFrame
    truth: DataFrame | None = None
    both: DataFrame | None = None

    @property
    def catalogue(self) -> DataFrame:
        if self.both is not None:
            return self.both
        return rec.with_source(rec.union_records(self.s2, self.s3))


def load(spark: SparkSession, folder: str, prefix: str, truth: bool = True) -> Inputs:
    """`<prefix>_source{1,2,3}.tsv` and `<prefix>_ground_truth.tsv` of a folder."""
    tables = [rec.read_tsv(spark, f"{folder}/{prefix}_source{k}.tsv") for k in (1, 2, 3)]
    known = rec.read_tsv(spark, f"{folder}/{prefix}_ground_truth.tsv", rec.TRUTH) if truth else None
    return Inputs(*tables, known)


def view_inputs(view: DataFrame) -> Inputs:
    """Inputs from a record view, by source."""
    sides = [view.filter(F.col("source") == k) for k in (1, 2, 3)]
    return Inputs(*sides, None, view.filter("source > 1"))


def view_truth(view: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id) of records with equal country and
    text; `view` has the text's 128-bit digest.  One row a pair: see `truth_classes`."""
    a = view.filter("source = 1").select(F.col("entity_id").alias("source1_entity_id"), "country", "digest")
    b = view.filter("source > 1").select(F.col("entity_id").alias("candidate_entity_id"), "country", "digest")
    return a.join(b, ["country", "digest"]).select("source1_entity_id", "candidate_entity_id")


def truth_classes(view: DataFrame) -> DataFrame:
    """The same truth without its pairs: (country, digest, n_source1, n_candidates,
    first) of each class of equal records that has both sides; `first` is its
    smallest id.  A class of a million copies is one row."""
    one = F.col("source") == 1
    counted = view.groupBy("country", "digest").agg(
        F.sum(one.cast("long")).alias("n_source1"), F.sum((~one).cast("long")).alias("n_candidates"), F.min("entity_id").alias("first")
    )
    return counted.filter("country is not null and digest is not null and n_source1 > 0 and n_candidates > 0")


def feature_table(
    inputs: Inputs,
    k: int = 100,
    ids: DataFrame | None = None,
    exclude: DataFrame | None = None,
    num_entities: int | None = None,
    countries: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Feature rows (with label where the truth is known) of the records wanted:
    only `ids`, or all but `exclude`, or `num_entities` of them drawn by hash."""
    s1 = inputs.s1
    if countries:
        s1 = s1.filter(F.col("country").isin(*countries))
    if ids is not None:
        s1 = split.only_ids(s1, ids)
    if exclude is not None:
        s1 = split.without_ids(s1, exclude)
    if num_entities:
        s1 = split.uniform_sample(s1, num_entities, seed)
    ranked = blocking.candidate_pairs(s1, inputs.catalogue, k)
    truth = rec.truth_pairs(inputs.truth) if inputs.truth is not None else None
    return features.pair_features(ranked, s1, inputs.catalogue, truth)


def fit_and_choose(
    train_rows: DataFrame, val_rows: DataFrame, val_ids: DataFrame, truth: DataFrame, learners: list[model.Learner], thresholds: list[float], early_stopping: bool = False
) -> tuple[list, list[float], dict]:
    """Models, blend weights and the best threshold's row (with the blend's name) on
    validation records.  The validation rows are scored once, by all models, and
    written; every blend is swept over that table.

    early_stopping: validation rows decide when boosting stops."""
    if early_stopping:
        rows = train_rows.withColumn("held", F.lit(False)).unionByName(val_rows.withColumn("held", F.lit(True)), allowMissingColumns=True)
        models = [model.train(rows, one, validation="held") if one.kind == "gbt" else model.train(train_rows, one) for one in learners]
    else:
        models = [model.train(train_rows, one) for one in learners]
    names = [f"score_{i}" for i in range(len(models))]
    scored = val_rows
    for m, name in zip(models, names, strict=True):
        scored = model.score(scored, m, name)
    scored = checkpointed(scored.select(*metrics.PAIR, *names))
    best: tuple[list[float], dict] | None = None
    for choice, weights in model.blend_choices(len(models)):
        blended = model.blend(scored, names, weights).select(*metrics.PAIR, "score")
        row = metrics.best_threshold(metrics.threshold_sweep(val_ids, truth, blended, thresholds)).first().asDict()
        if best is None or row["macro_f05"] > best[1]["macro_f05"]:
            best = (list(weights), row | {"blend": choice})
    return models, best[0], best[1]


def predict(inputs: Inputs, models: list, weights: list[float], threshold: float, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """(matched pairs, ranked candidate pairs)."""
    ranked = blocking.candidate_pairs(inputs.s1, inputs.catalogue, k)
    rows = features.clipped(features.pair_features(ranked, inputs.s1, inputs.catalogue))
    names = [f"score_{i}" for i in range(len(models))]
    for m, name in zip(models, names, strict=True):
        rows = model.score(rows, m, name)
    scored = model.blend(rows, names, weights)
    return scored.filter(F.col("score") >= threshold).select(*metrics.PAIR, "score"), ranked


def infer(spark: SparkSession, inputs: Inputs, model_dir: str, output_dir: str, k: int | None = None) -> Report:
    """Write matching_results.tsv and candidate_pairs.tsv and check them.

    The ranked pairs are written once as Parquet and read by both sinks."""
    config = rec.read_config(spark, model_dir)
    models = [model.load(f"{model_dir}/model_{i}") for i in range(len(config["weights"]))]
    ranked_path = f"{output_dir}/candidate_pairs.parquet"
    blocking.candidate_pairs(inputs.s1, inputs.catalogue, k or config.get("k", 100)).write.mode("overwrite").parquet(ranked_path)
    ranked = spark.read.parquet(ranked_path)
    rows = features.clipped(features.pair_features(ranked, inputs.s1, inputs.catalogue))
    names = [f"score_{i}" for i in range(len(models))]
    for m, name in zip(models, names, strict=True):
        rows = model.score(rows, m, name)
    matched = model.blend(rows, names, config["weights"]).filter(F.col("score") >= config["threshold"])
    rec.write_id_lists(rec.matched_lists(inputs.s1, matched), f"{output_dir}/matching_results.tsv")
    rec.write_id_lists(rec.candidate_lists(inputs.s1, ranked), f"{output_dir}/candidate_pairs.tsv")
    return validate(spark, f"{output_dir}/matching_results.tsv", f"{output_dir}/candidate_pairs.tsv", inputs.s1)


def blocking_report(inputs: Inputs, truth: DataFrame, k: int = 75, ks: tuple[int, ...] = (10, 20, 30, 40, 50, 75)) -> dict[str, DataFrame]:
    """Recall at K (all, by country, by match bucket), recall by strategy, reduction ratio."""
    ranked = blocking.candidate_pairs(inputs.s1, inputs.catalogue, k)
    country = inputs.s1.select(F.col("entity_id").alias("source1_entity_id"), "country")
    n = truth.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"))
    tagged = truth.join(country, "source1_entity_id").join(n, "source1_entity_id").withColumn("match_bucket", split.match_bucket(F.col("n")))
    found = blocking.attributed(truth, inputs.s1, inputs.catalogue)
    return {
        "recall": blocking.recall_at(truth, ranked, ks),
        "recall_by_country": blocking.recall_at(tagged, ranked, ks, ("country",)),
        "recall_by_bucket": blocking.recall_at(tagged, ranked, ks, ("match_bucket",)),
        "strategy_recall": blocking.strategy_recall(found),
        "reduction": blocking.reduction(inputs.s1, inputs.catalogue, ranked),
    }


def write_report(spark: SparkSession, inputs: Inputs, truth: DataFrame, path: str, k: int = 75, ks: tuple[int, ...] = (10, 20, 30, 40, 50, 75), first: int | None = None) -> str:
    """The blocking report as a Markdown file: tables of `blocking_report`, then time,
    rows a second and memory of each.  first: only so many records of each country."""
    if first is not None:
        chosen = split.first_per_country(inputs.s1.select(F.col("entity_id").alias("source1_entity_id"), "country"), first)
        inputs = Inputs(split.only_ids(inputs.s1, chosen), inputs.s2, inputs.s3, inputs.truth, inputs.both)
        truth = truth.join(chosen.select("source1_entity_id"), "source1_entity_id", "left_semi")
    audit, text = Audit(), ["# Blocking report", ""]
    for title, frame in blocking_report(inputs, truth, k, ks).items():
        rows = audit.collected(title, frame.orderBy(*frame.columns))
        text += [f"## {title.replace('_', ' ')}", "", *_markdown(frame.columns, rows), ""]
    text += ["## Time and memory", "", *_markdown(Audit.COLUMNS, audit.rows), ""]
    rec.write_text(spark, path, "\n".join(text))
    return "\n".join(text)


def _markdown(columns: list[str], rows: list[tuple]) -> list[str]:
    shown = [[f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    return [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}", *(f"| {' | '.join(r)} |" for r in shown)]
