"""Checks of id-list files: a report of findings, none of which stops the others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.sources.records import CANDIDATE_HEADER, MATCHING_HEADER

REPORT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("examples", T.StringType()),
    ]
)
EXAMPLES = 5


@dataclass
class Report:
    rows: list[tuple] = field(default_factory=list)

    def add(self, file: str, check: str, severity: str = "error", n: int = 1, examples: str = "") -> None:
        self.rows.append((file, check, severity, n, examples))

    @property
    def exit_code(self) -> int:
        return int(any(r[2] == "error" for r in self.rows))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REPORT)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def header_problem(first_line: str | None, expected: tuple[str, ...]) -> str | None:
    if first_line is None:
        return "empty_file"
    if "\t" not in first_line and "," in first_line:
        return "comma_separated"
    if tuple(c.strip().lower() for c in first_line.rstrip("\r\n").split("\t")) != expected:
        return "wrong_header"
    return None


def parsed(lines: DataFrame) -> DataFrame:
    """(value, ok, s1, ids, and `at` if the lines have it) of the lines below the
    header; blank lines are left out."""
    tab = F.instr("value", "\t")
    rest = F.regexp_replace(F.expr("substring(value, instr(value, '\t') + 1)"), "\r$", "")
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",", -1))
    place = ["at"] if "at" in lines.columns else []
    rows = lines.select("value", *place, (tab > 0).alias("ok"), F.substring_index("value", "\t", 1).alias("s1"), F.when(tab > 0, ids).alias("ids"))
    return rows.filter(F.col("ok") | (F.trim("s1") != ""))


def list_findings(rows: DataFrame, required: DataFrame | None, targets: DataFrame | None = None) -> DataFrame:
    """(check, n, examples) of every rule that has offenders.

    rows: `parsed`; required: entity_id of the records that need a row; targets:
    entity_id of all that may be listed."""
    good = rows.filter("ok")
    listed = good.select("s1", F.explode("ids").alias("id"))
    seen = good.select("s1").distinct()
    wrong = ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")
    found = {
        "malformed_row": rows.filter(~F.col("ok")).select(F.col("value").alias("x")),
        "duplicate_row": good.groupBy("s1").count().filter("count > 1").select(F.col("s1").alias("x")),
        "duplicate_in_list": good.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1").alias("x")).distinct(),
        "self_match": listed.filter(F.col("id").startswith("S1-")).select(F.col("id").alias("x")).distinct(),
        "wrong_prefix": listed.filter(wrong & ~F.col("id").startswith("S1-")).select(F.col("id").alias("x")).distinct(),
    }
    if targets is not None:
        known = targets.select(F.col("entity_id").alias("id"))
        found["unknown_id"] = listed.filter(~wrong).select("id").distinct().join(known, "id", "left_anti").select(F.col("id").alias("x"))
    if required is not None:
        need = required.select(F.col("entity_id").alias("s1")).distinct()
        found["missing_row"] = need.join(seen, "s1", "left_anti").select(F.col("s1").alias("x"))
        found["extra_row"] = seen.join(need, "s1", "left_anti").select(F.col("s1").alias("x"))
    parts = [part.select(F.lit(check).alias("check"), "x") for check, part in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # a few examples and a count leave each partition
    best = F.slice(F.array_sort(F.collect_set(F.when(F.col("r") <= EXAMPLES, F.col("x")))), 1, EXAMPLES)
    numbered = out.withColumn("r", F.row_number().over(_by_check()))
    counted = out.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    shown = numbered.filter(F.col("r") <= EXAMPLES).groupBy("check").agg(F.array_join(best, ", ").alias("examples"))
    return counted.join(shown, "check")


def _by_check():
    from pyspark.sql import Window

    return Window.partitionBy("check").orderBy("x")


def last_lists(rows: DataFrame) -> DataFrame:
    """The good rows; of a record's repeated rows only the last, where rows have a place."""
    good = rows.filter("ok")
    if "at" not in rows.columns:
        return good
    return good.groupBy("s1").agg(F.max_by("ids", "at").alias("ids"))


def not_in_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1, missing): matched ids that are no candidates of their record; of a
    record's repeated rows the last list counts where rows have a place (`at`)."""
    both = ["s1", "id"]
    a, b = (last_lists(x).select("s1", F.explode("ids").alias("id")).distinct() for x in (matched, candidates))
    return a.join(b, both, "left_anti").groupBy("s1").agg(F.count(F.lit(1)).alias("missing"))


def _checked(spark: SparkSession, path: str, expected: tuple[str, ...], required: DataFrame, targets: DataFrame | None, report: Report) -> DataFrame | None:
    name = path.rsplit("/", 1)[-1]
    if not _exists(spark, path):
        report.add(name, "file_missing")
        return None
    raw = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    first = raw.orderBy("at").first()
    if problem := header_problem(first["value"] if first else None, expected):
        report.add(name, problem)
        return None
    rows = parsed(raw.filter(F.col("at") != first["at"]))
    for r in list_findings(rows, required, targets).orderBy("check").collect():  # one row a rule
        report.add(name, r["check"], "error", r["n"], r["examples"])
    n = rows.filter("ok").agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("ids") == 0).cast("long")).alias("e")).first()
    report.add(name, "rows", "info", n["n"], f"{n['e'] or 0} empty")
    return rows


def validate(spark: SparkSession, matching: str, candidates: str | None, required: DataFrame, targets: DataFrame | None = None) -> Report:
    """Check a matching file and, if there is one, a candidate file."""
    report = Report()
    if targets is None:
        report.add("", "id_check_off", "warning")
    matched = _checked(spark, matching, MATCHING_HEADER, required, targets, report)
    listed = None
    if candidates and _exists(spark, candidates):
        listed = _checked(spark, candidates, CANDIDATE_HEADER, required, targets, report)
    elif candidates:
        report.add(candidates.rsplit("/", 1)[-1], "candidate_file_missing", "warning")
    if matched is not None and listed is not None:
        off = not_in_candidates(matched, listed)
        if n := off.count():
            shown = ", ".join(r["s1"] for r in off.orderBy("s1").limit(EXAMPLES).collect())
            report.add(matching.rsplit("/", 1)[-1], "matched_not_in_candidates", "warning", n, shown)
    return report
