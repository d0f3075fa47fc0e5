"""Shared helpers: table loading, the shared scratch folder, Arrow buffers as numpy."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is
    unset on one machine, a temporary folder that is set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors on other machines need a folder that all share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyrook-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return path


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which goes on to other tasks, gives back the
    memory that it holds free."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def string_buffers(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # zero or several chunks are left
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


_CODEC = pa.Codec("zstd", 1)


def packed(values: np.ndarray) -> bytes:
    """Numbers by their bytes' places, compressed: small numbers take little room."""
    kind = values.dtype.str.encode().ljust(4) + len(values).to_bytes(8, "little")
    return kind + _CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), asbytes=True) if len(values) else kind


def unpacked(data) -> np.ndarray:
    """What packed() was given; data: bytes or a binary scalar of Arrow."""
    view = memoryview(data.as_buffer() if isinstance(data, pa.Scalar) else data)
    kind, n = np.dtype(bytes(view[:4]).decode().strip()), int.from_bytes(view[4:12], "little")
    if not n:
        return np.zeros(0, kind)
    raw = _CODEC.decompress(pa.py_buffer(view[12:]), decompressed_size=n * kind.itemsize)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()
