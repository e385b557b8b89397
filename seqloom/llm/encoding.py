"""Encoding of a corpus with a byte-level BPE tokenizer, and the inverse.

The model is written once on the driver (1 MB, fixed by the vocabulary) and sent with the tasks; each
task encodes its Arrow batches and remembers the pre-tokens it has met.  No row meets a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import byte_bpe

#: Rows encoded at a time: bounds the tokens in memory next to the Arrow batch.
ROWS = 256


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    """The place of a public vocabulary file."""
    return f"{folder}/{name}"


def _output(df: DataFrame, key: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", df.schema[key].dataType), *(T.StructField(k, t) for k, t in more.items())])


def encoded(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, ids)``: every row once, its text as token ids.

    * An empty and a null text give an empty list.  Rows of repeated or null keys are all encoded.
    * The text is taken as stored, whole; strings that look like special tokens are ordinary text.
    * Other columns are ignored, whatever their names.  Empty in, empty out.
    """
    tokens = byte_bpe.read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe.Tokenizer(tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, counts = tokenizer.encode_batch(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _output(documents, key, ids=T.ArrayType(T.IntegerType())))


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, n_tokens)``: every row once, with the length of its encoding; 0 for an empty or null text."""
    tokens = byte_bpe.read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe.Tokenizer(tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts = tokenizer.count_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], names=["key", "n_tokens"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _output(documents, key, n_tokens=T.LongType()))


def decoded(encodings: DataFrame, key: str, ids: str, vocabulary: str) -> DataFrame:
    """``(key, text)``: the texts of lists of ids; a null list gives an empty text.

    An id outside the vocabulary is an error.
    """
    tokens = byte_bpe.read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe.Tokenizer(tokens)
        for batch in batches:
            texts = [tokenizer.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = encodings.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, _output(encodings, key, text=T.StringType()))
