"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.shared import checkpointed, new_folder, remove, shared_folder  # noqa: F401  (for the operators)

#: The tokenizer of operators 1 and 3, a file of the installed vocabulary package.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """A file of the vocabulary package by its name; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that no other column's name can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mark_of(id_col: str, text_col: str) -> Column:
    """Tells rows of one id apart by their text; rows without an id from those with one."""
    return F.xxhash64(F.col(id_col).cast("long").isNull(), F.col(text_col).cast("string"))


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`two_columns` and the mark of each row."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark_of(id_col, text_col).alias("mark"))


def map_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function of one batch; batches are cut to about 4 MB of text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in cut(batch):
                yield from rows(part)

    return df.mapInArrow(batches, schema)


def cut(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (second column: text or binary) of about `size` bytes."""
    n = batch.num_rows
    if n == 0 or batch.nbytes <= size:
        if n:
            yield batch
        return
    total = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
    a, held = 0, 0
    for i, more in enumerate(total.to_pylist()):
        if held and held + more > size:
            yield batch.slice(a, i - a)
            a, held = i, 0
        held += more
    yield batch.slice(a)


def append(df: DataFrame, text_col: str, added: T.StructType, make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """`df` with columns made from its text, all others passed through."""
    names = [f.name for f in added]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"the table has columns of these names already: {sorted(clash)}")
    place = df.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(place))], names=[*part.schema.names, *names])

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, *added.fields]))


def bucket_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: decides what is held out of learning; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def is_held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether a row takes no part in learning by its id; false for a null id."""
    return F.col(id_col).isNotNull() & (bucket_of(id_col, modulus) == rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most `per_class` labelled rows of either class that are not held out.

    Which ones is decided by a hash of the id, so it is the same at every run; of
    rows that repeat an id the smallest text counts, made one before the shuffle.
    At most 2 * per_class ids are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (bucket_of("doc_id", modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    texts = two_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def class_sizes(labels: DataFrame, target: str, modulus: int, held_out: int) -> tuple[int, int]:
    """How many rows of either class are not held out."""
    row = labels.filter((bucket_of("doc_id", modulus) != held_out) & F.col("doc_id").isNotNull()).agg(
        F.sum((F.col(target) == 0).cast("long")), F.sum((F.col(target) == 1).cast("long"))
    ).first()
    return row[0] or 0, row[1] or 0


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or it with underscores before it, such that no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
