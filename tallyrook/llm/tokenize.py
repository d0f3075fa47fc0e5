"""Encode and decode a text column with a BPE file (see bpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import TrieBPE
from .common import lean, string_buffers


@lru_cache(maxsize=1)
def coder(path: str) -> TrieBPE:
    """One coder for each file and Python worker; it keeps some of the words it has met."""
    return TrieBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, its token ids, and the text that these ids decode to.

    Returns (id_col, ids array<int>, decoded string). Null and empty texts: no ids and
    an empty text. Special tokens' strings in a text become their ids, as the library
    does. Repeated rows are coded each. Other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            at = 0
            for ids, cut in bpe.encode_chunks(*string_buffers(b.column(1))):
                n = len(cut) - 1
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                text = pa.array(list(bpe.decode_buffer(ids, cut)), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + n], lists, text], names=schema.names)
                at += n

    return rows.mapInArrow(lean(run), schema)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but the ids and the decoded text are only returned as digests
    (they are made and hashed in the worker, so that whole texts need not go back):
    (id_col, n_tokens, ids_sha256, decoded_sha256)."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            at = 0
            for ids, cut in bpe.encode_chunks(*string_buffers(b.column(1))):
                wide, ends = ids.astype("<u4"), cut.tolist()
                hashes = [sha(wide[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                text = [sha(t) for t in bpe.decode_buffer(ids, cut)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(text)], pa.array(np.diff(cut), pa.int64()), pa.array(hashes, pa.string()), pa.array(text, pa.string())], names=schema.names)
                at += len(text)

    return rows.mapInArrow(lean(run), schema)
