"""Schemas, sources and sinks of records, ground truth and id lists."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.functions.text import reader_nulls

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
MATCHING_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RECORD, reader_na: bool = False) -> DataFrame:
    """A tab-separated file with a header; all columns are text.

    reader_na: texts that a reader with default settings takes for missing become null."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return df.select(*(reader_nulls(F.col(c)).alias(c) for c in df.columns)) if reader_na else df


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Snappy Parquet; an empty table keeps its schema."""
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def merge_parquet(spark: SparkSession, paths: Sequence[str], out: str) -> None:
    """Tables of one schema to one table; a missing path is an error."""
    spark.read.parquet(*paths).write.option("compression", "snappy").parquet(out)


def with_source(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """`df` with the number of the source by the id's prefix: 1, 3, and else 2."""
    c = F.col(id_col)
    return df.withColumn("source", F.when(c.startswith("S1-"), 1).when(c.startswith("S3-"), 3).otherwise(2).cast("tinyint"))


def union_records(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def id_list(c: Column) -> Column:
    """Ids of a comma list, trimmed, without empty ones; [] for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda x: x != "")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id), each pair once."""
    return truth.select("source1_entity_id", F.explode(F.array_distinct(id_list(F.col("matched_entity_ids")))).alias("candidate_entity_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first columns of a tab-separated file with a header; blank lines do not count."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    first = F.trim(F.col(f"`{rows.columns[0]}`"))
    return rows.select(first.alias("entity_id")).filter(F.col("entity_id") != "").distinct()


def record_view(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Records over a documents table: the first four words are the name, the next ten the address.

    digest: with the text's md5 as a column; the text itself is left out."""
    # matching stops behind the fourteenth word, however long the text is
    opening = F.regexp_extract("text", r"^(?:[^\p{L}\p{M}\p{N}]*[\p{L}\p{M}\p{N}]+){1,14}", 0)
    words = F.regexp_extract_all(F.lower(opening), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)
    source = (1 + F.substring("source", 4, 9).try_cast("int") % 3).cast("int")
    more = [F.md5("text").alias("digest")] if digest else []
    tagged = docs.select("doc_id", "n_chars", "lang", source.alias("source"), words.alias("w"), *more)
    return tagged.select(
        F.concat(F.lit("S"), F.col("source").cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(F.slice("w", 1, 4), " ").alias("business_name"),
        F.array_join(F.slice("w", 5, 10), " ").alias("business_address"),
        F.col("lang").alias("country"),
        F.col("source").cast("tinyint").alias("source"),
        "doc_id",
        "n_chars",
        *(["digest"] if digest else []),
    )


#: Patterns that dress a record of the view up: {1} to {4} are words of the name, {5} to {8}
#: of the address, {a}, {b} and {z} numbers.  Every rule of normalization and every kind of key
#: is met by some; which one a record gets hangs on its id.
DRESSED_NAMES = (
    "{1} {2} {3} {4}", "{1} & {2} {3} Pvt. Ltd.", "{1}'s {2} L.L.C.", "{1} {2} L.L.P.", "{1}{2}.com {3}", "{1}+{2} Intl Corp", "{1}, {2} Inc.", "Private Limited {1} and",
    "nan", "---", "{1} L. P. Tech {2}", "{1} Co. {2} GmbH & Co", "{1}@{2}.co.in", "Limited Liability Company {1} {2}", "{1} {2} Mfg. Svcs", "Inc.",
)
DRESSED_ADDRESSES = (
    "{a} {5} {6} St., {7}, {z}", "Flat {a}, Bldg {b}, {5} Rd, {6} {z}", "H.No {a} s/o {5}, Nr {6}", "00{a} {5} Ave/{6}", "{5} {6} Dist, {z}", "", "N/A", "c.o {5}; b.h {6} {7} Apt {b}",
    "{5}'s {6} & {7}, {a}", "None", "{b}, {z}", "{z}", "{5} {6} {7} No {a}", "{a}-{b} {5} Blvd W, {6}", "{5} PO {z} {6} {7} {8}", "hno {a}\\{5}, {z} SE",
)


def dressed_view(docs: DataFrame) -> DataFrame:
    """The record view with marks, digits, legal forms and abbreviations in its names and addresses."""
    view = record_view(docs)
    name, place = F.split("business_name", " "), F.split("business_address", " ")
    numbers = {"{a}": 1 + F.col("n_chars") % 997, "{b}": 1 + F.col("doc_id") % 89, "{z}": 10000 + F.col("doc_id") * 7919 % 89999}
    words = {f"{{{k + 1}}}": F.coalesce(F.get(name, F.lit(k)), F.lit("")) for k in range(4)} | {f"{{{k + 5}}}": F.coalesce(F.get(place, F.lit(k)), F.lit("")) for k in range(4)}

    def filled(patterns: tuple[str, ...], turn: Column) -> Column:
        out = F.element_at(F.array(*(F.lit(x) for x in patterns)), (turn % len(patterns) + 1).cast("int"))
        for mark, value in {**words, **numbers}.items():
            out = F.replace(out, F.lit(mark), value.cast("string"))
        return out

    return view.withColumns({"business_name": filled(DRESSED_NAMES, F.col("doc_id")), "business_address": filled(DRESSED_ADDRESSES, F.floor(F.col("doc_id") / 3))})


# --- id-list sinks ---


def matched_lists(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every id with its sorted comma list of matches, empty if none."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias("matched_entity_ids"))
    return _completed(ids, lists)


def candidate_lists(ids: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every id with the comma list of its candidates by rank, empty if none."""
    entry = F.struct("candidate_rank", "candidate_entity_id")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["candidate_entity_id"])
    lists = ranked.groupBy("source1_entity_id").agg(F.array_join(ordered, ",").alias("candidate_entity_ids"))
    return _completed(ids, lists)


def _completed(ids: DataFrame, lists: DataFrame) -> DataFrame:
    column = lists.columns[1]
    wanted = ids.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return wanted.join(lists, "source1_entity_id", "left").withColumn(column, F.coalesce(column, F.lit("")))


def write_id_parts(lists: DataFrame, path: str, sort: bool = True) -> None:
    """A folder of tab-separated parts without header, in order of the id: for lists
    that are too large for one file."""
    first, second = lists.columns[:2]
    rows = lists.orderBy(first) if sort else lists
    rows.select(F.concat_ws("\t", first, F.coalesce(second, F.lit(""))).alias("value")).write.text(path)


def write_id_lists(lists: DataFrame, path: str, sort: bool = True) -> None:
    """One tab-separated file with a header at `path`, sorted by id.

    The rows are sorted in many tasks and written as text parts in order; the
    parts are then joined to one file by copying bytes through the file system
    (and this machine: see `write_id_parts`)."""
    spark = lists.sparkSession
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    target = make(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    write_id_parts(lists, parts, sort)
    out = fs.create(target, True)
    try:
        out.write(bytearray("\t".join(lists.columns[:2]) + "\n", "utf-8"))
        names = sorted(s.getPath().toString() for s in fs.listStatus(make(parts)) if s.getPath().getName().startswith("part-"))
        for name in names:
            part = fs.open(make(name))
            jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
            part.close()
    finally:
        out.close()
        fs.delete(make(parts), True)


# --- small configuration files ---


def write_text(spark: SparkSession, path: str, text: str) -> None:
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = make(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def write_config(spark: SparkSession, folder: str, config: dict) -> None:
    write_text(spark, f"{folder}/config.json", json.dumps(config, indent=1))


def read_config(spark: SparkSession, folder: str, default: dict | None = None) -> dict:
    """The newest configuration there is: config.json, a one-line blend
    `method|w1,w2,w3|threshold` with a threshold file that goes before it, or the default."""
    out = dict(default or {"method": "single", "weights": [1.0], "threshold": 0.97})
    if text := read_text(spark, f"{folder}/config.json"):
        return out | json.loads(text)
    blend = read_text(spark, f"{folder}/ensemble_config.txt")
    if blend:
        method, weights, threshold = blend.strip().split("|")
        out |= {"method": method, "weights": [float(w) for w in weights.split(",")], "threshold": float(threshold)}
    if text := read_text(spark, f"{folder}/threshold_v{2 if blend else 1}.txt"):
        out["threshold"] = float(text.strip())
    return out
