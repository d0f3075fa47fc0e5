"""Single small files in any store that Spark knows, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from .shared import file_system


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None if it is not there."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole: it is written under another name and put in place then, so that readers
    see the old one or the new one."""
    fs, at = file_system(spark, path)
    new = at.suffix(f".{uuid.uuid4().hex[:8]}.tmp")
    _create(spark, new.toString(), text)
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(new, at):
        fs.delete(new, False)
        raise OSError(f"{path} cannot be written")


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False, and nothing is done, if it is there."""
    fs, at = file_system(spark, path)
    if fs.exists(at):
        return False
    try:
        _create(spark, path, text)
    except Exception:
        if fs.exists(at):  # another writer was first
            return False
        raise
    return True


def names(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of the files of a folder that end so, sorted."""
    fs, at = file_system(spark, folder)
    return sorted(s.getPath().toString() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.isFile() and s.getPath().getName().endswith(ending))
