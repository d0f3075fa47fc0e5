"""Substring dedup by hashing units: paragraphs, lines, and the sentences of lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, lean, written

_SENTENCE = re.compile(r"\S[^.!?。！？]*+(?:[.!?]++(?=\S)[^.!?。！？]*+)*+(?:[.!?]++|[。！？]++)?+", re.S)
# Letters of scripts that set no spaces between words; two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _size(text: str, words: list[str]) -> int:
    """The number of words, where scripts without spaces are measured by characters."""
    return len(words) if text.isascii() else max(len(words), len(_UNSPACED.findall(text)) // 2)


def units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines of at least min_words words, of the sentences of
    that size in lines of more than one, and of the paragraphs of that size (lines between
    blank ones) of more than one line. Digests are of the words in lower case, so that
    spacing, line breaks and case don't count."""
    at = size = lines = start = end = 0
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        words = line.lower().split()
        if words:
            n = _size(line, words)
            if not lines:
                start = at
            held += words
            size, lines, end = size + n, lines + 1, at + len(line)
            if n >= min_words:
                yield at, at + len(line), _digest(words)
                found = [m.span() for m in _SENTENCE.finditer(line)]
                if len(found) > 1:
                    for a, b in found:
                        words = line[a:b].lower().split()
                        if _size(line[a:b], words) >= min_words:
                            yield at + a, at + b, _digest(words)
        else:
            if lines > 1 and size >= min_words:
                yield start, end, _digest(held)
            held, size, lines = [], 0, 0
        at += len(line) + 1


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def passages(text: str, spans: list[tuple[int, int]], min_words: int, min_passage: int) -> list[tuple[int, int]]:
    """The spans of passages of min_passage words or more: spans with fewer than min_words
    words between them belong together, and the words in them count."""
    flat: list[list[int]] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1][1]:
            flat[-1][1] = max(b, flat[-1][1])
        else:
            flat.append([a, b])
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    size = 0
    for a, b in [*flat, (-1, -1)]:
        if held and (a < 0 or _size(text[held[-1][1] : a], text[held[-1][1] : a].split()) >= min_words):
            out += held if size >= min_passage else []
            held, size = [], 0
        held.append((a, b))
        size += _size(text[a:b], text[a:b].split())
    return out


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """text without the spans, and these merged: a span that is a whole line goes with its
    line break, one inside a line with the space behind it."""
    out, at, gone = [], 0, []
    for a, b in sorted(spans):
        if b <= at:
            continue
        a = max(a, at)
        whole = (a == 0 or text[a - 1] == "\n") and (b == len(text) or text[b] == "\n")
        if whole and b < len(text):
            b += 1
        elif not whole:
            while b < len(text) and text[b] in " \t":
                b += 1
        out.append(text[at:a])
        if gone and gone[-1][1] == a:
            gone[-1] = (gone[-1][0], b)
        else:
            gone.append((a, b))
        at = b
    out.append(text[at:])
    return "".join(out), gone


def drop_repeats(docs: DataFrame, min_words: int = 8, report: str | None = None, min_passage: int = 0) -> DataFrame:
    """docs with every unit taken out of text that occurs earlier in the corpus.

    Units are lines of at least min_words words, the sentences of that size in them, and
    paragraphs of that size, whose lines may be shorter.
    The first occurrence, by doc_id (nulls last) and place, stays; a unit that repeats
    inside a document goes, too. With min_passage, units go only where those that repeat
    make up so many words, with gaps below min_words. Equal rows with one doc_id are one
    occurrence and stay alike. Null texts stay null. Columns and their order stay, whatever
    their names; with `report`, that column
    is added: the removed spans as array<struct<start, end>>, in characters of the
    original text. Digests are grouped with partial sums, so that a unit may occur in a
    third of all rows.
    """
    text = F.col("text").cast("string")
    row = F.xxhash64(F.col("doc_id"), F.lit("|"), text)
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc"), text.alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took, cols = [], ([], [], [])
            for i, t in enumerate(b.column(2).to_pylist()):
                for u in units(t, min_words):
                    took.append(i)
                    for c, v in zip(cols, u, strict=True):
                        c.append(v)
            took = pa.array(took, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["row", "doc", "start", "end", "digest"])

    found = written(rows.mapInArrow(lean(run), "row long, doc long, start int, end int, digest binary"), "units")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "start")
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first")
    own, other, of, spans, removed = free(docs.columns, "row", "unit_row", "unit_doc", "spans", "removed_spans")
    again = found.join(first, "digest").where(F.col("first") != place).groupBy(F.col("row").alias(other), F.col("doc").alias(of)).agg(F.collect_set(F.struct("start", "end")).alias(spans))
    same = (F.col(own) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of))
    joined = docs.withColumn(own, row).join(again.hint("shuffle_hash"), same, "left")
    report_as = report or removed
    joined = joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], spans)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField(report_as, span)])
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for t, spans in zip(b.column(at).to_pylist(), b.column(len(b.columns) - 1).to_pylist(), strict=True):
                gone = []
                found = [(s["start"], s["end"]) for s in spans or ()]
                if min_passage:
                    found = passages(t, found, min_words, min_passage)
                if found:
                    t, gone = without(t, found)
                texts.append(t)
                removed.append([{"start": x, "end": y} for x, y in gone])
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, kind)], names=schema.names)

    out = joined.mapInArrow(lean(cut), schema)
    return out if report else out.drop(report_as)
