"""Tables that several runs add to: parts by session, and a log of commits.

A table is a folder with `rows/commit=<name>/part=<n>/*.parquet` and `log/<version>.json`. Rows of a
session are all in one part, a hash of its session_id modulo the number of parts, so that who works
on some sessions reads their parts only. Rows count from the moment that a log entry names their
commit. An entry is made by creating its file, which must not be there: of two writers that have
seen the same log, one fails, looks at what the other one added, and tries the next version. What a
writer leaves that dies before is never read. An entry may also take rows out, by their keys: those
of earlier commits that have such a key don't count any more. Files are read and written through
Hadoop's file systems, so that a table may lie in any store.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import empty, file_system

#: Parts of a new table. Choose so many that what one holds suits a task.
PARTS = 16
#: Seconds to wait for an entry that another writer has created and not yet filled.
PATIENCE = 30


class Conflict(Exception):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Entry:
    """A version: the commit whose rows it adds, keys that it takes out (also a commit), the last
    of the versions that it stands for, if it was made by compact(), and its writer's own mark."""

    version: int
    parts: int
    rows: str = ""
    gone: str = ""
    stands_for: int = -1
    mark: str = ""


@dataclass
class LogTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    #: What tells a row from the others of its session.
    key: str
    parts: int = PARTS
    by: str = "session_id"
    _log: dict[int, Entry] = field(default_factory=dict)

    def _at(self, *names: str) -> str:
        return "/".join([self.path.rstrip("/"), *names])

    def entries(self) -> list[Entry]:
        """The log's entries that count; those read once are kept, as they never change."""
        fs, folder = file_system(self.spark, self._at("log"))
        if not fs.exists(folder):
            return []
        names = sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        for v in names:
            if v not in self._log:
                self._log[v] = self._entry(v)
        log = [self._log[v] for v in names]
        done = max((e.stands_for for e in log), default=-1)
        return [e for e in log if e.version > done]

    def _entry(self, version: int) -> Entry:
        until = time.monotonic() + PATIENCE
        while True:
            fs, at = file_system(self.spark, self._at("log", f"{version:012d}.json"))
            stream = fs.open(at)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return Entry(version, **json.loads(text))
            if time.monotonic() > until:
                raise TimeoutError(f"{at.toString()} was begun and not finished: delete it if its writer is gone")
            time.sleep(0.2)

    def part_of(self, column: str = "") -> Column:
        """The part of a row; all writers of a table use the number that its log has. It is the hash
        by which Spark deals out rows: where these lie by session, a task has few parts."""
        log = self.entries()
        return F.pmod(F.hash(column or self.by), F.lit(log[-1].parts if log else self.parts)).cast("int")

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts that hold the rows' sessions: no more numbers than the table has parts."""
        return sorted(r.part for r in rows.select(self.part_of().alias("part")).distinct().collect())

    def _commits(self, names: list[str], schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("part", T.IntegerType())])
        if not names:
            return empty(self.spark, full)
        return self.spark.read.schema(full).option("basePath", self._at("rows")).parquet(*(self._at("rows", f"commit={n}") for n in names))

    def read(self, parts: list[int] | None = None, since: int = -1, until: int | None = None) -> DataFrame:
        """The rows that count, of some parts only, or of some versions only: after `since`, up to
        `until`."""
        log = [e for e in self.entries() if until is None or e.version <= until]
        rows = self._commits([e.rows for e in log if e.rows and e.version > since], self.schema)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        if any(e.gone for e in log):
            known = [F.struct(F.lit(name).alias("commit"), F.lit(e.version).cast("long").alias("version")) for e in log for name in (e.rows, e.gone) if name]
            versions = self.spark.range(1).select(F.inline(F.array(*known)))
            keys = T.StructType([self.schema[self.by], self.schema[self.key]])
            gone = self._commits([e.gone for e in log if e.gone], keys).join(F.broadcast(versions), "commit")
            gone = (gone if parts is None else gone.where(F.col("part").isin(parts))).groupBy("part", self.key).agg(F.max("version").alias("until"))
            rows = rows.join(F.broadcast(versions), "commit").join(gone, ["part", self.key], "left").where("until is null or version >= until")
        return rows.select(*self.schema.names)

    def _write(self, rows: DataFrame, schema: T.StructType, placed: bool = False) -> str:
        """The name of a commit of these rows. placed: the rows lie by session already. Else each
        part's rows go to few files, and a part that holds a hot session is split among tasks."""
        name = uuid.uuid4().hex
        rows = rows.select(*schema.names).withColumn("part", self.part_of())
        (rows if placed else rows.hint("rebalance", "part")).write.partitionBy("part").parquet(self._at("rows", f"commit={name}"))
        return name

    def _count(self, name: str) -> int:
        """The number of a commit's rows, from its files' footers."""
        return self._commits([name], self.schema).count()

    def _append(self, entry: Entry) -> None:
        fs, at = file_system(self.spark, self._at("log", f"{entry.version:012d}.json"))
        try:
            stream = fs.create(at, False)
        except Exception as e:
            if fs.exists(at):
                raise Conflict(entry.version) from e
            raise
        try:
            told = {k: v for k, v in vars(entry).items() if k != "version"}
            stream.write(bytearray((json.dumps(told) + "\n").encode()))
        finally:
            stream.close()

    def version(self) -> int:
        """The last version, -1 before the first."""
        log = self.entries()
        return log[-1].version if log else -1

    def marked(self, mark: str) -> bool:
        """Whether the writer of this mark has committed already. Compaction keeps the last marks."""
        return any(mark in e.mark.split("|") for e in self.entries())

    def _entry_after(self, base: int, rows: str = "", gone: str = "", stands_for: int = -1, mark: str = "") -> int:
        """Make the version after `base`; raises Conflict where that is there already."""
        log = self.entries()
        self._append(Entry(base + 1, log[-1].parts if log else self.parts, rows, gone, stands_for, mark))
        return base + 1

    def append(self, rows: DataFrame, mark: str = "", tries: int = 20) -> int:
        """Commit rows as they are; nothing, if the mark is there. Returns how many came in."""
        name = ""
        for _ in range(tries):
            base = self.version()
            if mark and self.marked(mark):
                return 0
            if not name:
                name = self._write(rows, self.schema)
                n = self._count(name)
            with suppress(Conflict):
                self._entry_after(base, name if n else "", mark=mark)
                return n
        raise Conflict(base)

    def add(self, rows: DataFrame, fresh: Callable[[DataFrame, DataFrame], DataFrame], sessions: DataFrame | None = None, placed: bool = False, tries: int = 20) -> int:
        """Commit fresh(rows, what is there in the rows' parts) and return how many these are. Rows
        are written as they are computed, once; after a conflict, what was written is compared
        with what the other writers added. `sessions` are those of the rows, if these are known."""
        seen, base = -1, self.version()
        parts = None if base < 0 else self.parts_of(rows if sessions is None else sessions)
        for _ in range(tries):
            name = self._write(fresh(rows, self.read(parts, seen, base)), self.schema, placed and seen < 0)
            n = self._count(name)
            if not n:
                return 0
            with suppress(Conflict):
                self._entry_after(base, name)
                return n
            rows = self._commits([name], self.schema).select(*self.schema.names)
            seen, base = base, self.version()
            parts = self.parts_of(rows)
        raise Conflict(base)

    def replace(self, sessions: DataFrame, rows: DataFrame, tries: int = 20) -> tuple[int, int]:
        """Make `rows` what the table has of some sessions (session_id, each once), in one commit:
        what is there and equal stays, what differs or is there no more is taken out. Returns how
        many rows were added and taken out."""
        names, keys = self.schema.names, [self.by, self.key]
        told = F.xxhash64(*(c for c in names if c not in keys))
        rows = rows.select(*names, told.alias("__now")).persist()
        new, gone = F.col("__now").isNotNull(), F.col("__was").isNotNull()
        try:
            parts = self.parts_of(sessions)
            for _ in range(tries):
                base = self.version()
                there = self.read(parts, until=base).join(sessions, self.by, "left_semi").select(*keys, told.alias("__was"))
                differ = rows.join(there, keys, "full_outer").where(~F.col("__now").eqNullSafe(F.col("__was"))).persist()
                try:
                    n, m = differ.agg(F.count_if(new), F.count_if(gone)).first()
                    if n or m:
                        added = self._write(differ.where(new), self.schema) if n else ""
                        self._entry_after(base, added, self._write(differ.where(gone), T.StructType([self.schema[c] for c in keys])) if m else "")
                    return n, m
                except Conflict:
                    continue
                finally:
                    differ.unpersist()
            raise Conflict(base)
        finally:
            rows.unpersist()

    def compact(self) -> int:
        """One commit of all rows that count, which stands for all versions so far. Readers that have
        the old list go on with its files: these stay until vacuum()."""
        log = self.entries()
        marks = [m for e in log for m in e.mark.split("|") if m][-1000:]
        if not log:
            return -1
        last = log[-1].version
        return self._entry_after(last, self._write(self.read(until=last), self.schema), stands_for=last, mark="|".join(marks))

    def vacuum(self, seconds: float) -> int:
        """Delete commits that no entry names, if they are older: writers may still be at work on
        younger ones, and readers with those of a log before compact()."""
        fs, folder = file_system(self.spark, self._at("rows"))
        named = {n for e in self.entries() for n in (e.rows, e.gone)}
        old = [s.getPath() for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName().removeprefix("commit=") not in named and s.getModificationTime() / 1000 < time.time() - seconds]
        for p in old:
            fs.delete(p, True)
        return len(old)
