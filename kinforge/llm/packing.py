"""Operator 1: packing by power-of-two decomposition.

A document of n tokens (its end token counted) is cut into pieces whose lengths
are the sequence length as often as it fits and then the powers of two of the
rest, largest first.  Each piece is a sequence of its own; sequences of equal
length form a bucket (`bucket` is the length's power of two), from which
training takes batches of one length.  So no sequence crosses documents, no
token is padded and every token lies in exactly one piece.

Work is one pass over the texts without a shuffle: a document's pieces depend
on that document alone.

Defined cases: a null or empty text is the end token alone (one piece of length
1); repeated rows and ties of doc_id are packed as rows of their own; a null
doc_id stays null; a text of any length is one document, read whole in memory of
some times its size; an empty table gives no rows; other columns are not read.
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
from kinforge.llm.ragged import chunks, gather

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("tokens", T.BinaryType()),
    ]
)


def decompose(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces of documents with n tokens each."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    whole, rest = n // most, n % most
    bits = [1 << b for b in reversed(range(most.bit_length() - 1))]
    has = np.stack([(rest & b) > 0 for b in bits], axis=1) if bits else np.zeros((len(n), 0), bool)
    n_pieces = whole + has.sum(axis=1)
    row = np.repeat(np.arange(len(n)), n_pieces)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    length = np.full(len(row), most, np.int64)
    tail = place >= whole[row]
    length[tail] = np.broadcast_to(np.array(bits, np.int64), has.shape)[has]
    before = np.cumsum(length) - length
    first = np.cumsum(n_pieces) - n_pieces
    start = before - np.repeat(before[first[n_pieces > 0]], n_pieces[n_pieces > 0])
    return row, start, length


def pack(
    docs: DataFrame,
    sequence_length: int = 1024,
    end_token: int = 0,
    tokenizer: str = TOKENIZER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, tokens
    (little-endian unsigned 32-bit ids), sequence_id, offset (always 0).

    sequence_id holds the bucket in its high bits and below them the number of
    the piece in its partition; a task that runs again gives the same numbers."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer_path(tokenizer))
        for a, b, data, offsets in chunks(batch.column(1)):
            ids, n_ids = code.encode(data, offsets)
            n = n_ids + 1
            stream = np.full(int(n.sum()), end_token, "<u4")
            at = np.cumsum(n) - n
            stream[gather(np.arange(len(stream)), at, n_ids)] = ids
            row, start, length = decompose(n, sequence_length)
            ends = np.cumsum(length) * 4
            tokens = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(stream)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(n[row]),
                    pa.array(np.log2(length).astype(np.int32)),
                    tokens,
                ],
                names=PIECES.names,
            )

    pieces = map_texts(two_columns(docs, id_col, text_col), rows, PIECES)
    number = F.shiftleft(F.col("bucket").cast("long"), 58).bitwiseOR(F.monotonically_increasing_id())
    return pieces.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))
