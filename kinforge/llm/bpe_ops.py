"""Operator 3: BPE encoding and decoding of texts (see `bpe` for the method).

One pass without a shuffle.  Defined cases: a null or empty text has no ids and
decodes to the empty text; repeated rows and ties of doc_id give a row each; a
null doc_id stays null; a text of any length is encoded whole, in memory of some
times its size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.bpe import encoder
from kinforge.llm.frames import TOKENIZER, map_texts, tokenizer_path, two_columns
from kinforge.llm.ragged import chunks

CODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per text: doc_id, ids, and (decode) the text decoded from those ids."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path(tokenizer))
        for a, b, data, offsets in chunks(batch.column(1)):
            ids, n_ids = code.encode(data, offsets)
            ends = np.cumsum(n_ids)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            doc_id = batch.column(0).slice(a, b - a)
            texts = decoded(code, ids, ends) if decode else pa.nulls(b - a, pa.string())
            yield pa.RecordBatch.from_arrays([doc_id, lists, texts], names=CODED.names)

    return map_texts(two_columns(docs, id_col, text_col), rows, CODED)


def decoded(code, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of ids[0:ends[0]], ids[ends[0]:ends[1]], ...; what is not valid UTF-8 becomes U+FFFD."""
    raw = code.decode(ids)
    size = np.append(0, np.cumsum(code.vocabulary.lengths[ids]))
    cuts = size[np.append(0, ends)].tolist()
    return pa.array([raw[p:q].decode("utf-8", "replace") for p, q in zip(cuts, cuts[1:], strict=False)], pa.string())


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, ids."""
    return round_trip(docs, tokenizer, id_col, text_col, decode=False).select("doc_id", "ids")


def decode(coded: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: doc_id, text of the ids; null ids give the empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path(tokenizer))
        for batch in it:
            lists = batch.column(1).to_pylist()
            n = np.array([len(x or ()) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded(code, flat, np.cumsum(n))], names=schema.names)

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(rows, schema)
