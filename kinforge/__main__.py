"""Command line: python -m kinforge features|merge|train|infer|report|validate|split ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinforge.operators import metrics, model, split
from kinforge.operators.audit import Audit
from kinforge.operators.validate import validate
from kinforge.plans import linkage
from kinforge.session import session
from kinforge.sources import records as rec


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinforge")
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features", help="write a feature table")
    f.add_argument("--split", choices=["train", "val"], default="train")
    f.add_argument("--data", default="dataset/train")
    f.add_argument("--val-split")
    f.add_argument("--k", type=int, default=100)
    f.add_argument("--num-entities", type=int)
    f.add_argument("--seed", type=int, default=42)
    f.add_argument("--countries", nargs="*")
    f.add_argument("--output", required=True)
    m = sub.add_parser("merge", help="join Parquet tables of one schema")
    m.add_argument("inputs", nargs="+")
    m.add_argument("--output", required=True)
    s = sub.add_parser("split", help="draw a stratified validation split")
    s.add_argument("--data", default="dataset/train")
    s.add_argument("--size", type=int, default=25000)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--output", required=True)
    t = sub.add_parser("train", help="train on feature tables and choose a threshold")
    t.add_argument("--train", required=True)
    t.add_argument("--val", required=True)
    t.add_argument("--val-split", required=True)
    t.add_argument("--variant", choices=sorted(model.GBT_VARIANTS), default="production")
    t.add_argument("--ensemble", action="store_true")
    t.add_argument("--early-stopping", action="store_true", help="validation rows decide when boosting stops")
    t.add_argument("--model-dir", required=True)
    i = sub.add_parser("infer", help="write both result files and check them")
    i.add_argument("--model-dir", required=True)
    i.add_argument("--test-dir", required=True)
    i.add_argument("--output-dir", required=True)
    i.add_argument("--candidate-cap", type=int)
    r = sub.add_parser("report", help="write the blocking report")
    r.add_argument("--data", default="dataset/train")
    r.add_argument("--k", type=int, default=75)
    r.add_argument("--per-country", type=int, help="only the first records of each country")
    r.add_argument("--output", required=True)
    v = sub.add_parser("validate", help="check result files")
    v.add_argument("-m", "--matching", required=True)
    v.add_argument("-c", "--candidates")
    v.add_argument("-t", "--test-dir", required=True)
    v.add_argument("--check-ids", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    if args.command == "merge":
        rec.merge_parquet(spark, args.inputs, args.output)
    elif args.command == "split":
        inputs = linkage.load(spark, args.data, "train")
        rec.write_parquet(split.stratified_split(split.with_stratum(inputs.truth, inputs.s1), args.size, args.seed), args.output)
    elif args.command == "features":
        inputs = linkage.load(spark, args.data, "train")
        chosen = spark.read.parquet(args.val_split) if args.val_split else None
        which = {"ids": chosen} if args.split == "val" else {"exclude": chosen}
        rows = linkage.feature_table(inputs, args.k, num_entities=args.num_entities, countries=args.countries, seed=args.seed, **which)
        audit = Audit()
        audit.written("features", lambda: rec.write_parquet(rows, args.output), lambda: rec.read_parquet(spark, args.output))
        print(dict(zip(Audit.COLUMNS, audit.rows[0], strict=True)))
    elif args.command == "train":
        chosen = spark.read.parquet(args.val_split)
        learners = [model.Learner("gbt", dict(model.GBT_VARIANTS[args.variant]))]
        if args.ensemble:
            learners += [model.Learner("forest", {"numTrees": 100, "maxDepth": 10}), model.Learner("logistic", {"regParam": 0.001})]
        ids = chosen.select(F.col("source1_entity_id").alias("entity_id"))
        thresholds = metrics.grid(0.10, 0.90, 0.05) + metrics.grid(0.92, 0.995, 0.005)
        models, weights, row = linkage.fit_and_choose(
            spark.read.parquet(args.train), spark.read.parquet(args.val), ids, rec.truth_pairs(chosen), learners, thresholds, args.early_stopping
        )
        for k, one in enumerate(models):
            model.save(one, f"{args.model_dir}/model_{k}")
        rec.write_config(spark, args.model_dir, {"method": "blend" if args.ensemble else "single", "weights": weights, "threshold": row["threshold"]})
        print(row)
    elif args.command == "infer":
        report = linkage.infer(spark, linkage.load(spark, args.test_dir, "test", truth=False), args.model_dir, args.output_dir, args.candidate_cap)
        report.frame(spark).show(truncate=False)
        return report.exit_code
    elif args.command == "report":
        inputs = linkage.load(spark, args.data, "train")
        linkage.write_report(spark, inputs, rec.truth_pairs(inputs.truth), args.output, args.k, first=args.per_country)
    elif args.command == "validate":
        required = rec.read_ids(spark, f"{args.test_dir}/test_source1.tsv")
        targets = None
        if args.check_ids:
            targets = rec.read_ids(spark, f"{args.test_dir}/test_source2.tsv").union(rec.read_ids(spark, f"{args.test_dir}/test_source3.tsv"))
        report = validate(spark, args.matching, args.candidates, required, targets)
        report.frame(spark).show(truncate=False)
        return report.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
