"""Concatenate all documents' tokens and cut them into windows of a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, string_buffers, written
from .tokenize import coder

#: So many offsets of parts, of 12 bytes each, are broadcast at most.
BROADCAST = 1_000_000


def tokens_by_part(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """First pass: (doc_id, part, before, n, wide, tokens) where `tokens` are the document's
    n ids and the end id among them as bytes, `part` is the task, and `before` counts the ids
    of the part before the document. Written to the shared folder: the second pass must meet
    the same parts, also after an executor is lost. Ids below 65536 take two bytes each."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, total = coder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            for ids, cut in bpe.encode_chunks(*string_buffers(b.column(1))):
                rows, n = len(cut) - 1, np.diff(cut) + 1
                ids, ends = np.insert(ids, cut[1:], end_id), np.r_[0, np.cumsum(n)]
                wide = bool(ids.max(initial=0) > 65535)
                data = ids.astype("<u4" if wide else "<u2")
                tokens = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + rows], pa.array([part] * rows, pa.int32()), pa.array(total + ends[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([wide] * rows, pa.bool_()), tokens], names=schema.names)
                total, at = total + int(ends[-1]), at + rows

    return written(rows.mapInArrow(lean(run), schema), "tokens")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of `window` tokens: one row for each piece.

    Two passes: the totals of the first pass's parts are summed up in order, which gives
    every document its global offset; then the windows cut there. Columns: doc_id, start
    (ids of the document before the piece), length, ids (array<int>), ids_crc32,
    doc_tokens, sequence_id, offset. All sequences but the last are full. Null and empty
    texts are one end id; rows that repeat are packed each; an empty table gives none.
    The parts' first offsets are one row a task. They are counted, and broadcast up to
    BROADCAST rows; beyond that Spark joins them by what it measures of them.
    """
    return _cut(*_offsets(docs, path, end_id), window, True)


def pieces(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """As pack, without the ids themselves."""
    return _cut(*_offsets(docs, path, end_id), window, False)


def _offsets(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    first = tokens_by_part(docs, path, end_id)
    totals = first.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    base = written(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")), "offsets")
    return first, F.broadcast(base) if base.count() <= BROADCAST else base


def _cut(first: DataFrame, base: DataFrame, window: int, with_ids: bool) -> DataFrame:
    placed = first.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "wide", "tokens")
    long = T.LongType()
    schema = T.StructType([placed.schema[0], *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took, cols, ids_out = [], [[] for _ in range(6)], []
            for row, (at, wide, tokens) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                ids = np.frombuffer(tokens, "<u4" if wide else "<u2").astype("<u4")
                n = len(ids)
                cuts = [0, *range(window - at % window, n, window)]
                for s, e in zip(cuts, chain(cuts[1:], [n]), strict=True):
                    took.append(row)
                    for c, v in zip(cols, (s, e - s, zlib.crc32(ids[s:e].tobytes()), n, (at + s) // window, (at + s) % window), strict=True):
                        c.append(v)
                    if with_ids:
                        ids_out.append(ids[s:e].astype(np.int32))
            out = [b.column(0).take(pa.array(took, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            if with_ids:
                out.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return placed.mapInArrow(lean(run), schema)
