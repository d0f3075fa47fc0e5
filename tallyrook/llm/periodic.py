"""Periodic runs of words: stretches that repeat themselves at a lag.

A run of period q and n words has n - q pairs of equal words at distance q, so only lags with as
many pairs in the whole text as the shortest run has need a look.

1. Counts. For each lag up to a third of the text, the equal pairs at that distance. Frequent
   words are counted by autocorrelation: the sum of the power spectra of their places, which one
   inverse FFT turns into counts (sums of 0 and 1, exact after rounding). Rare words are counted
   by the differences of their places.
2. Islands. For each lag with enough pairs, the stretches in which every word equals the one a lag
   later. An island that is long enough is a run, unless it is one of a smaller period: that has
   the same ends, as the smaller period then divides the lag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: Words of a run at least, and periods.
LEAST, TIMES = 24, 3
#: A word is frequent if its places' pairs cost more than an FFT: f * f over this share of N log N.
HEAVY = 0.2
#: Pairs of places that are held at once.
PAIRS = 1 << 21


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """At each lag from 0 to `most`, how many words equal the one that lag later."""
    n = len(ids)
    size = 1 << int(n + most).bit_length()
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    many = np.diff(np.r_[first, n])
    out = np.zeros(most + 1, np.int64)
    heavy = many * many > HEAVY * size * np.log2(size)
    power = np.zeros(size // 2 + 1) if heavy.any() else None
    for a, m in zip(first[heavy], many[heavy], strict=True):
        there = np.zeros(size)
        there[order[a : a + m]] = 1
        spectrum = np.fft.rfft(there)
        power += spectrum.real**2 + spectrum.imag**2
    if power is not None:
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = ~heavy & (many > 1)
    first, many = first[light], many[light]
    # each place with all later ones of its word
    places = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    rest = np.repeat(first + many, many) - places - 1
    upto = np.cumsum(rest)
    a = 0
    while a < len(places):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        r = rest[a:b]
        left = np.repeat(places[a:b], r)
        right = left + 1 + np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
        lag = order[right] - order[left]
        out += np.bincount(lag[lag <= most], minlength=most + 1)
        a = b
    return out


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    most = n // times
    if n < least or not most:
        return []
    count = lag_counts(ids, most)
    lags = np.arange(most + 1)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero((lags > 0) & (count >= np.maximum(least, times * lags) - lags)).tolist():
        need = max(least, times * q) - q
        off = np.flatnonzero(ids[q:] != ids[:-q])
        edges = np.r_[-1, off, n - q]
        size = np.diff(edges) - 1
        for i in np.flatnonzero(size >= need).tolist():
            found.setdefault((int(edges[i]) + 1, int(size[i]) + q), q)  # of the same ends, the smallest period
    return sorted((start, length, q) for (start, length), q in found.items())


def _words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words, and for each the place of the first one that equals it."""
    words = text.split()  # of bytes, this splits at space and \x09 to \x0D
    first: dict[bytes, int] = {}
    return words, np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))


def _dropped(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Words that a run contains after its first period."""
    out = np.zeros(n, bool)
    for start, length, q in found:
        out[start + q : start + length] = True
    return out


def _mapped(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], each, kinds: list[pa.DataType]) -> DataFrame:
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("__text"))
    schema = T.StructType([rows.schema[0], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [each(t.as_py() or b"") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Each row's id, its runs (array of start, length, period, in words), and its words without the
    repeats of any run, joined by one space: (id_col, runs, collapsed).

    Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts: no runs, an empty text. Repeated rows
    are worked each; other columns are not read. Nothing is shuffled; memory is a fixed multiple
    of the longest text.
    """
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def each(text: bytes) -> tuple:
        words, ids = _words(text)
        found = runs(ids, least, times)
        gone = _dropped(found, len(words))
        kept = b" ".join(w for w, d in zip(words, gone.tolist(), strict=True) if not d) if found else b" ".join(words)
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], kept.decode()

    return _mapped(docs, id_col, text_col, [T.StructField("runs", kind), T.StructField("collapsed", T.StringType())], each, [arrow, pa.string()])


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As collapse, but of runs and texts only counts, the strongest run (greatest length a period,
    then the first) and digests come back: (id_col, n_runs, start, length, period, exponent_milli,
    runs_sha256, collapsed_sha256)."""
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    fields = [*(T.StructField(c, T.LongType()) for c in names), *(T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256"))]

    def each(text: bytes) -> tuple:
        words, ids = _words(text)
        found = runs(ids)
        best = (None,) * 4
        for r in found:  # fractions are compared exactly; of equal ones the first stays
            if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                best = (*r, 1000 * r[1] // r[2])
        if found:
            gone = _dropped(found, len(words))
            words = [w for w, d in zip(words, gone.tolist(), strict=True) if not d]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        return len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    return _mapped(docs, id_col, text_col, fields, each, [*[pa.int64()] * 5, pa.string(), pa.string()])


def looped(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, of which a tenth of all documents, chosen by a checksum of their id, repeat
    themselves from some word on. Documents without an id stay as they are."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))), " ")

    # an array of one is there to compute the words once
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(changed, F.col(text))).otherwise(F.col(text))
