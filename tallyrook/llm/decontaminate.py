"""Benchmark passages in documents, by an FM-index of each shard of the corpus.

1. Phrases. Windows of ten consecutive words of the benchmark's items (a shorter item is one
   window), each once, with the items that have it. They are searched in slices of bounded size;
   a slice is broadcast, and has its pass over the documents.
2. Index. A task cuts its documents into shards of some MB. Words are numbers of the slice's
   vocabulary; a word outside it can't be in an occurrence, so the shard is the stretches of
   words inside it that are as long as the shortest phrase, each behind an end mark of its own.
   Their suffixes are sorted by doubling, only where they still tie; the words before them, in
   that order, are kept as a wavelet matrix, whose levels are bits with counts at each 64.
3. Search. All phrases at once are searched from their last word to their first: two ranks a
   step. A phrase's rows are located by walks to the next place that is sampled: one of
   SAMPLED places of a stretch, the first always, so that no walk leaves its stretch.
4. Spans. The places are marked in the documents, and what touches or overlaps is one span.

Nothing is shuffled but the benchmark's windows, and texts that many documents share cost each
shard what they do anywhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, lean, string_buffers, written
from .words import chunks, gathered

WORDS = 10
#: Windows of a slice, which is broadcast, at most (some 100 bytes each).
SLICE = 200_000
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD = 4 << 20
#: One place in so many is sampled.
SAMPLED = 8

#: What stands for each byte: A-Z in lower case, ASCII but digits and letters as a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(_BYTES).split()


class Wavelet:
    """Numbers below 2 ** bits, as bits by level, the highest first; after a level, the numbers
    whose bit is 0 stand before the others."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        n = len(values)
        for k in range(bits - 1, -1, -1):
            bit = (values >> k) & 1 == 1
            raw = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            blocks = raw.view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(blocks), dtype=np.int64)]
            self.levels.append((blocks, before, n - int(before[-1])))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        blocks, before, _ = level
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(blocks[block] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value is among the first `at` numbers."""
        start = np.zeros_like(at)
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (value >> k) & 1 == 1
            a, b = self._ones(level, start), self._ones(level, at)
            start, at = np.where(one, level[2] + a, start - a), np.where(one, level[2] + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at some places, and how often each is before its place."""
        start, value = np.zeros_like(at), np.zeros_like(at)
        for level in self.levels:
            block, rest = at >> 6, (at & 63).astype(np.uint64)
            one = (level[0][block] >> rest) & np.uint64(1) == 1
            a, b = self._ones(level, start), self._ones(level, at)
            start, at = np.where(one, level[2] + a, start - a), np.where(one, level[2] + b, at - b)
            value = 2 * value + one
        return value, at - start


def sorted_suffixes(text: np.ndarray, top: int) -> np.ndarray:
    """The order of the suffixes of numbers from 0 to top, in which no two suffixes tie before
    a 0 (of the zeros, the first is the least). The last number is 0."""
    n = len(text)
    zero = text == 0
    rank = text.astype(np.int64) + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    top = top + int(zero.sum())
    span = 1
    if top < 1 << 30:  # two words in one number, to begin with
        key = rank * (top + 1)
        key[:-1] += rank[1:]
        rank, span = key, 2
    order = np.argsort(rank)
    new = np.r_[True, rank[order[1:]] != rank[order[:-1]]]
    while True:
        first = np.flatnonzero(new)
        group = np.repeat(first, np.diff(np.r_[first, n]))  # each place has the rank of its group's first
        rank = np.empty(n, np.int64)
        rank[order] = group
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            return order
        at = order[tied]
        # suffixes that tie don't have ended: what stands `span` further on is inside the text
        key = group[tied] * n + rank[at + span]
        rows = np.argsort(key)
        order[tied], key = at[rows], key[rows]
        new[tied] |= np.r_[True, key[1:] != key[:-1]]
        span *= 2


class FMIndex:
    """Numbers from 1 to top in stretches, each followed by a 0."""

    def __init__(self, text: np.ndarray, top: int):
        self.n = n = len(text)
        order = sorted_suffixes(text, top)
        self.bwt = Wavelet(text[order - 1].astype(np.int64), max(1, int(top).bit_length()))
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]  # how many numbers are less than each
        begin = np.r_[0, np.flatnonzero(text[:-1] == 0) + 1]
        inside = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
        self.marked = inside[order] % SAMPLED == 0
        self.places = order[self.marked]
        self.row = np.cumsum(self.marked) - 1

    def find(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: (phrases, longest) numbers, right-aligned. Returns those that occur, and the
        bounds of their rows."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            step = np.flatnonzero(sizes[live] >= k)
            c = phrases[live[step], -k]
            low[step] = self.less[c] + self.bwt.rank(c, low[step])
            high[step] = self.less[c] + self.bwt.rank(c, high[step])
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of some rows."""
        out = np.zeros(len(rows), np.int64)
        live, walked = np.arange(len(rows)), 0
        while len(live):
            done = self.marked[rows]
            out[live[done]] = self.places[self.row[rows[done]]] + walked
            live, rows = live[~done], rows[~done]
            if len(live):
                value, before = self.bwt.access(rows)
                rows, walked = self.less[value] + before, walked + 1
        return out


class Phrases:
    """A slice: distinct windows of words, and the items of each."""

    def __init__(self, windows: list[tuple[list[bytes], list[str]]]):
        self.vocabulary: dict[bytes, int] = {}
        add = self.vocabulary.setdefault
        lists = [[add(w, len(self.vocabulary) + 1) for w in window] for window, _ in windows]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        longest = int(self.sizes.max(initial=1))
        self.numbers = np.array([[0] * (longest - len(x)) + x for x in lists], np.int64).reshape(len(lists), longest)
        self.items = sorted({i for _, items in windows for i in items})
        where = {x: i for i, x in enumerate(self.items)}
        self.item_cut = np.r_[0, np.cumsum([len(items) for _, items in windows])].astype(np.int64)
        self.item = np.array([where[i] for _, items in windows for i in items], np.int64)
        self.shortest = int(self.sizes.min(initial=1))

    def occurrences(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """numbers: the words of a shard's documents, 0 for those outside; ends: where each
        document ends. Returns places and the windows that begin there."""
        inside = np.r_[numbers > 0, False]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edge = ends[:-1][inside[ends[:-1]]]
        begin[edge] = True
        starts = np.flatnonzero(begin)
        stop = np.r_[~inside, True]
        stop[edge] = True  # a document that begins inside ends the one before
        stops = np.flatnonzero(stop)
        sizes = stops[np.searchsorted(stops, starts + 1)] - starts
        long = sizes >= self.shortest
        starts, sizes = starts[long], sizes[long]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # each stretch with the place behind it, which becomes its end mark
        origin = gathered(np.arange(len(inside)), starts, sizes + 1)
        text = np.r_[numbers, 0][origin]
        text[np.cumsum(sizes + 1) - 1] = 0
        index = FMIndex(text, len(self.vocabulary))
        which, low, high = index.find(self.numbers, self.sizes)
        rows = gathered(np.arange(index.n), low, high - low)
        return origin[index.locate(rows)], np.repeat(which, high - low)


def windows_of(benchmark: DataFrame, words: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window array<binary>, items array<string>): each distinct window with the items that
    have it. Items without words have none; an item's rows of one id are each cut on their own.
    Rows without an id have windows, and count as no item."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words_of(text or b"")
                for at in range(0, len(found), 4096):
                    some = sorted({b" ".join(found[i : i + words]) for i in range(at, min(at + 4096, max(1, len(found) - words + 1)))})
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.binary())], names=schema.names)

    return rows.mapInArrow(lean(cut), schema).groupBy("window").agg(F.collect_set("item").alias("items"))


def _slices(benchmark: DataFrame, words: int, size: int) -> Iterator[Phrases]:
    """The windows in slices of at most about `size`. Windows are dealt by their hash, and
    what is collected is counted before."""
    found = written(windows_of(benchmark, words), "windows")
    n = found.count()
    parts = -(-n // size)
    for i in range(parts):
        some = found if parts == 1 else found.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == i)
        yield Phrases([(bytes(r.window).split(b" "), r.items) for r in some.toLocalIterator()])


def _searched(docs: DataFrame, phrases: Phrases, id_col: str, text_col: str, schema: T.StructType, shard: int, row) -> DataFrame:
    """row(number of words, marked words, items) of each document, in `schema` after its id."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], *schema.fields])
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        p, kinds = sent.value, to_arrow_schema(schema).types
        get = p.vocabulary.get
        for b in batches:
            buf, off = string_buffers(b.column(1))
            for a, z in chunks(off, shard):
                numbers, ends = [], [0]
                for i in range(a, z):
                    found = words_of(buf[off[i] : off[i + 1]].tobytes())
                    numbers.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
                    ends.append(ends[-1] + len(found))
                ends = np.array(ends, np.int64)
                places, which = p.occurrences(np.concatenate(numbers), ends)
                top = int(ends[-1]) + 1
                hit = np.cumsum(np.bincount(places, minlength=top) - np.bincount(places + p.sizes[which], minlength=top)) > 0
                # (document, item) pairs, each once
                doc = np.searchsorted(ends, places, "right") - 1
                pairs = np.unique(doc * len(p.sizes) + which)
                doc, which = pairs // len(p.sizes), pairs % len(p.sizes)
                many = p.item_cut[which + 1] - p.item_cut[which]
                pairs = np.unique(np.repeat(doc, many) * max(1, len(p.items)) + gathered(p.item, p.item_cut[which], many))
                doc, item = pairs // max(1, len(p.items)), pairs % max(1, len(p.items))
                cut = np.searchsorted(doc, np.arange(z - a + 1))
                out = [row(int(ends[i + 1] - ends[i]), hit[ends[i] : ends[i + 1]], [p.items[x] for x in item[cut[i] : cut[i + 1]]]) for i in range(z - a)]
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[1:], strict=True))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
DIGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE, shard: int = SHARD) -> DataFrame:
    """Each document's spans of words inside occurrences of the benchmark's windows:
    (id_col, n_words, spans array of start and end in words, items array<string>).

    Null and empty texts have no words; texts without words have no spans. Repeated rows are
    searched each, other columns are not read. With an empty benchmark nothing is found. What
    several slices find of a document is merged by its id and text's place in the input: rows
    that share an id are kept apart.
    """
    slices = _slices(benchmark, words, size)

    def row(n: int, hit: np.ndarray, items: list[str]) -> tuple:
        return n, [{"start": s, "end": e} for s, e in _spans(hit)], items

    first = next(slices, None)
    second = next(slices, None) if first else None
    if second is None:
        return _searched(docs, first or Phrases([]), id_col, text_col, FOUND, shard, row)
    # several passes: rows are numbered once, and their findings are put together
    numbered = written(docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at")).alias("__row"), F.col(text_col).cast("string").alias("__text")), "numbered")
    total = None
    for phrases in (first, second, *slices):
        part = written(_searched(numbered, phrases, "__row", "__text", FOUND, shard, row), "found")
        total = part if total is None else total.unionByName(part)
    grouped = total.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "s", F.array().cast(SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return grouped.select(F.col("__row.id").alias(id_col), "n_words", merged.alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", size: int = SLICE, shard: int = SHARD) -> DataFrame:
    """As contaminated_spans, counted: (id_col, n_words, n_hit, n_items, items_sha256,
    contaminated). Items are sorted as strings before they are hashed, joined by commas."""
    found = contaminated_spans(docs, benchmark, words, id_col, text_col, size, shard)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without spans of words: from the first one's first byte to the last one's last."""
    low = text.translate(_BYTES)
    starts, ends, at = [], [], 0
    for w in low.split():
        at = low.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for s in spans:
        out.append(text[last : starts[s["start"]]])
        last = ends[s["end"] - 1]
    return b"".join([*out, text[last:]])


def without_spans(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, text_col: str = "text", size: int = SLICE) -> DataFrame:
    """docs whose texts have lost the spans; the rest of a text and all columns stay as they
    are. Rows are numbered once and worked each, so that ids need not be unique, or there."""
    place, at, spans = free(docs.columns, "place", "at", "spans")
    numbered = written(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    found = contaminated_spans(numbered, benchmark, words, place, text_col, size).where("size(spans) > 0").select(F.col(place).alias(at), F.col("spans").alias(spans))
    joined = numbered.join(found, F.col(place) == F.col(at), "left").select(*docs.columns, spans)
    where, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = zip(b.column(where).to_pylist(), b.columns[-1].to_pylist(), strict=True)
            texts = pa.array([_cut(t.encode(), x).decode() if x else t for t, x in told], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == where else c for i, c in enumerate(b.columns[:-1])], names=schema.names)

    return joined.mapInArrow(lean(run), schema)
