"""Language-model scores by logistic context mixing, bit by bit.

A text is coded as its words' bytes, each word with a space behind it, and a line feed at
the end; a byte is eight binary decisions. Several hashed contexts predict a bit from
counts of the training texts: for a word's first byte the last 0 to 5 bytes of the word
before it, for its other bytes the 0 to 4 bytes before and the word's whole beginning. A
mixer adds the predictions in the logistic domain; its weights are chosen by a gate (the
place of the bit and how often the longest context was met) and learned online. A final
table, which follows the mixer's stream, maps the mixed probability, by gate, to what was
observed. A text's bits are coded at a total cost that the score gives as log10.

All training texts are counted and all of them teach the mixer: a bit that is learned from
is predicted from counts without its own occurrence.

So a word costs the same wherever it stands but for its first byte, whose cost belongs to
the pair of that byte and the bytes before. Both kinds of units are computed once: they go
to buckets, each of which learns on its own, in an order by hash; what is learned is
averaged. Every block of texts gets back one cost for each of its distinct units.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, packed, string_buffers, unpacked, written
from .words import _BASE, LOWER, U, Words, _byte_values, chunks, gathered, hash_ranges, mix

TAIL = 5  # bytes of the word before
TABLE_BITS = (8, 16, 18, 20, 20, 22)  # of the hashed tables: 0 to 4 bytes, and the longest context
OFFSETS = np.r_[0, np.cumsum([1 << b for b in TABLE_BITS])]
ORDERS = len(TABLE_BITS)
INPUTS = ORDERS + 1
GATE_EDGES = [0.5, 1.5, 2.5, 5.5, 15.5, 100.5]
GATES = len(GATE_EDGES) + 1
SETS = 16  # of weights: a word's bits, and those of its first byte
LEVELS = 33  # of the final table
RANGES = 64
BROADCAST = 1_000_000  # buckets, whose numbers of parts are sent to all tasks, at most
MOST = 400_000  # units of a bucket, as blocks have them, above which it is split
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], U)
_NODE = U(0x9E3779B97F4A7C15)
_END = 10


def held_out(ids: list) -> np.ndarray:
    """Which texts are not learned from."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, for each value its number among them)."""
    d = pa.array(h).dictionary_encode()
    return np.asarray(d.dictionary), np.asarray(d.indices, np.int64)


def _bucket(data: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int, lead: int = 6) -> np.ndarray:
    """Units that begin alike go to one bucket, so that they share their beginnings there."""
    key = np.zeros(len(size), U)
    for i in range(lead):
        key = key * U(257) + np.where(size > i, data[np.minimum(start + i, max(0, len(data) - 1))].astype(U) + U(1), U(0))
    return (mix(key) % U(buckets)).astype(np.int64)


class Block:
    """The distinct words of some texts, and each text as their numbers. Number 0 is the end
    of a text, and the beginning of the next one."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, U)  # sorted
        self.number = np.zeros(0, np.int64)  # of each
        self.bytes: list[np.ndarray] = [np.array([_END], np.uint8)]
        self.sizes: list[np.ndarray] = [np.ones(1, np.int64)]
        self.ends = np.array([_END], np.int64)  # of each number: the first byte, above it the last TAIL bytes
        self.counts = np.zeros(1, np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows: list[tuple] = []
        self.tokens = 0

    def add(self, ids: list, buf: np.ndarray, offsets: np.ndarray) -> None:
        w = Words(buf, offsets, lower=True)
        h = w.hashes()
        u, inverse = _distinct(h)
        top = np.maximum.accumulate(inverse) if len(inverse) else inverse
        first = np.flatnonzero(np.r_[True, top[1:] > top[:-1]]) if len(top) else top
        at = np.searchsorted(self.hashes, u)
        known = np.zeros(len(u), bool)
        known[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == u[at < len(self.hashes)]
        number = np.empty(len(u), np.int64)
        number[known] = self.number[at[known]]
        new, total = first[~known], len(self.counts)
        number[~known] = total + np.arange(len(new))
        start, size = w.starts[new], w.ends[new] - w.starts[new]
        self.sizes.append(size)
        self.bytes.append(LOWER[gathered(buf, start, size)])
        ends = np.zeros(len(new), np.int64)
        for k in range(TAIL, 0, -1):
            ends = ends << 8 | np.where(size >= k, LOWER[buf[np.maximum(start + size - k, 0)]], 0)
        self.ends = np.concatenate([self.ends, ends << 8 | LOWER[buf[start]]])
        hashes, numbers = np.concatenate([self.hashes, u[~known]]), np.concatenate([self.number, number[~known]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], numbers[order]
        out, many = held_out(ids), np.diff(w.first)
        seq = np.insert(number[inverse], w.first[1:], 0)
        train = np.repeat(~out, many + 1)
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.counts += np.bincount(seq[train], minlength=len(self.counts))
        keys, of = _distinct(self.pairs_of(self.ends, seq))
        self.pairs.append((keys, np.bincount(of[train], minlength=len(keys))))
        coded = np.bincount(w.doc, w.ends - w.starts + 1, len(many)).astype(np.int64) + 1
        self.rows.append((ids, out, many + 1, coded, seq.astype(np.uint32)))
        self.tokens += len(seq)

    @staticmethod
    def pairs_of(ends: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """For each place of a sequence, the last bytes before it and the first byte there."""
        before = np.r_[0, seq[:-1]] if len(seq) else seq
        return (ends[before] >> 8) << 8 | ends[seq] & 255

    def done(self, buckets: int) -> tuple[list[tuple], list[tuple]]:
        """Rows of units (bucket, bytes, sizes, counts), buckets from `buckets` on being pairs,
        and rows of texts; units are numbered by bucket."""
        data, size = np.concatenate(self.bytes), np.concatenate(self.sizes)
        keys, of = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([n for _, n in self.pairs]), len(keys)).astype(np.int64)
        spelt = (keys[:, None] >> np.arange(8 * TAIL, -1, -8)).astype(np.uint8)
        units, numbers = [], []
        for base, d, s, c in ((0, data, size, self.counts), (buckets, spelt.ravel(), np.full(len(keys), TAIL + 1), counts)):
            start = np.cumsum(s) - s
            bucket = _bucket(d, start, s, buckets)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            numbers.append(number)
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                i = order[cut[b] : cut[b + 1]]
                units.append((base + b, int(cut[b]), len(i), gathered(d, start[i], s[i]).tobytes(), packed(s[i].astype(np.uint32)), packed(c[i])))
        # texts count words from the most frequent one on, which takes less room
        often = np.argsort(-np.bincount(np.concatenate([r[-1] for r in self.rows]), minlength=len(size)), kind="stable")
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        texts = [(ids, out.tolist(), many.tolist(), coded.tolist(), packed(rank[seq]), None) for ids, out, many, coded, seq in self.rows]
        layout = [packed(x) for x in (np.array([rank[0]]), numbers[0][often], self.ends[often], np.diff(keys, prepend=0), numbers[1])]
        return units, [*texts, (None, None, None, None, None, layout)]


_SENT = "block string, bucket int, at long, n long, bytes binary, sizes binary, train binary, ids array<long>, out array<boolean>, many array<long>, coded array<long>, seq binary, layout array<binary>"
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def blocks(docs: DataFrame, buckets: int, most: int = 600_000) -> DataFrame:
    """First pass: rows of units and rows of texts of blocks of up to about `most` distinct
    words and eight times as many words, none over two tasks."""

    def out(block: Block, name: str) -> Iterator[pa.RecordBatch]:
        units, texts = block.done(buckets)
        rows = [(name, *u, *[None] * 6) for u in units] + [(name, *[None] * 6, *t) for t in texts]
        for i in range(0, len(rows), 8):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 8], strict=True), _KINDS, strict=True)], names=_names(_SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, block = TaskContext.get().partitionId(), 0, Block()
        for b in batches:
            buf, off = string_buffers(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j in chunks(off, 1 << 21):
                block.add(ids[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if len(block.counts) > most or block.tokens > 8 * most:
                    yield from out(block, f"{part}-{seq}")
                    seq, block = seq + 1, Block()
        if block.rows:
            yield from out(block, f"{part}-{seq}")

    return written(docs.mapInArrow(lean(run), _SENT), "lm-blocks")


_UNITS = "bucket int, sub int, block string, at long, places binary, bytes binary, sizes binary, train binary"


def _dealt(sent: DataFrame, buckets: int) -> DataFrame:
    """The rows of units with the part of the bucket they belong to: buckets of more than
    MOST units are split by the units' hashes. The parts' numbers are one row a bucket."""
    units = sent.where("bucket is not null").select("bucket", "block", "at", "n", "bytes", "sizes", "train")
    parts = units.groupBy("bucket").agg(F.ceil(F.sum("n") / MOST).cast("int").alias("parts"))
    units = units.join(F.broadcast(parts) if buckets <= BROADCAST else parts, "bucket")
    whole = units.where("parts <= 1").select("bucket", F.lit(0).alias("sub"), "block", "at", F.lit(None).cast("binary").alias("places"), "bytes", "sizes", "train")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, size, n = np.frombuffer(r["bytes"], np.uint8), unpacked(r["sizes"]).astype(np.int64), unpacked(r["train"])
                start = np.cumsum(size) - size
                sub = (hash_ranges(data, start, start + size) % U(r["parts"])).astype(np.int64)
                rows = []
                for k in np.unique(sub).tolist():
                    i = np.flatnonzero(sub == k)
                    rows.append((r["bucket"], k, r["block"], r["at"], packed(i.astype(np.uint32)), gathered(data, start[i], size[i]).tobytes(), packed(size[i].astype(np.uint32)), packed(n[i])))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(_UNITS))

    return whole.union(units.where("parts > 1").mapInArrow(lean(split), _UNITS))


_VOCAB = "bucket int, sub int, bytes binary, sizes binary, train binary, blocks array<string>, at array<long>, places array<binary>, maps array<binary>, tokens long, types long"


def vocabulary(sent: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: its distinct units with their counts over all blocks, and for
    each block the places of its units among these. tokens, types: of words in training."""

    def run(g: pa.Table) -> pa.Table:
        rows = sorted(g.to_pylist(), key=lambda r: r["block"])
        data = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
        sizes = [unpacked(r["sizes"]) for r in rows]
        size, counts = np.concatenate(sizes).astype(np.int64), np.concatenate([unpacked(r["train"]) for r in rows])
        start = np.cumsum(size) - size
        _, first, inverse = np.unique(hash_ranges(data, start, start + size), return_index=True, return_inverse=True)
        train = np.bincount(inverse, counts, len(first)).astype(np.int64)
        maps = [packed(x.astype(np.uint32)) for x in np.split(inverse, np.cumsum(list(map(len, sizes)))[:-1])]
        words = rows[0]["bucket"] < buckets
        cols = [[rows[0]["bucket"]], [rows[0]["sub"]], [gathered(data, start[first], size[first]).tobytes()], [packed(size[first].astype(np.uint32))], [packed(train)]]
        cols += [[[r[c] for r in rows]] for c in ("block", "at", "places")] + [[maps], [int(train.sum()) * words], [int((train > 0).sum()) * words]]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_names(_VOCAB))

    return written(_dealt(sent, buckets).groupBy("bucket", "sub").applyInArrow(run, _VOCAB), "lm-vocabulary")


class Shard:
    """A bucket's units as edges: bytes after a beginning, each once, whatever the number of
    units that share it. Words have edges from their second byte to the space behind them,
    pairs one edge, their last byte. Units stand in the order of their hashes, and so do
    their edges, each where it is first met."""

    def __init__(self, raw: np.ndarray, size: np.ndarray, train: np.ndarray, pairs: bool):
        size = size.astype(np.int64)
        self.train, self.n, self.set = train, len(size), 8 * pairs
        full = size if pairs else size + ~((size == 1) & (raw[np.cumsum(size) - size] == _END))
        at = np.cumsum(full) - full
        unit = np.repeat(np.arange(len(size)), full)
        place = np.arange(len(unit)) - at[unit]
        b = np.full(len(unit), 32, np.uint8)
        b[place < size[unit]] = raw
        power = np.full(int(full.max(initial=0)) + 1, _BASE, U)
        power[0] = 1
        power = np.cumprod(power, dtype=U)
        sums = np.r_[U(0), np.cumsum(_byte_values()[b] * power[place], dtype=U)]
        before = sums[:-1] - sums[at[unit]]  # hash of the unit's beginning
        use = np.flatnonzero(place == TAIL if pairs else place > 0)
        _, first, inverse = np.unique(mix(sums[use + 1] - sums[at[unit[use]]]), return_index=True, return_inverse=True)
        order = np.argsort(first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.edge, self.unit, first = rank[inverse], unit[use], use[first[order]]
        self.size = len(first)
        self.bytes, place = b[first], place[first]
        self.weight = np.bincount(self.edge, self.train[self.unit], self.size)
        self.contexts, ctx = [], np.zeros(self.size, U)
        for k in range(ORDERS - 1):
            if k:
                ctx = ctx << U(8) | np.where(place >= k, b[np.maximum(first - k, 0)], 0).astype(U)
            self.contexts.append(mix(ctx * U(32) + U(2 * k + pairs)))
        self.contexts.append(mix(before[first] * U(32) + U(2 * ORDERS + pairs)))

    def node(self, bit: int) -> np.ndarray:
        """The decisions of the byte so far, with a leading 1."""
        return (self.bytes.astype(U) >> U(8 - bit)) | (U(1) << U(bit))

    def bit(self, bit: int) -> np.ndarray:
        return (self.bytes >> (7 - bit)) & 1

    def slots(self, order: int, bit: int, at=slice(None)) -> np.ndarray:
        h = (self.contexts[order][at] + self.node(bit)[at] * _NODE) * _ODD[order]
        return (h >> U(64 - TABLE_BITS[order])).astype(np.int64) + OFFSETS[order]

    def count(self, out: np.ndarray) -> None:
        """Add to out (2 * slots) how often a bit was 0 or 1 in each slot."""
        at = np.flatnonzero(self.weight > 0)
        for bit in range(8):
            y = self.bit(bit)[at]
            for order in range(ORDERS):
                np.add.at(out, 2 * self.slots(order, bit, at) + y, self.weight[at])

    def inputs(self, bit: int, table: np.ndarray, at=slice(None), own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gate) of one decision of the edges `at`; with `own`, each without one
        occurrence of its own. table: (slots, 2)."""
        y = self.bit(bit)[at].astype(bool)
        x = np.empty((len(y), INPUTS), np.float32)
        for order in range(ORDERS):
            n = table[self.slots(order, bit, at)]
            if own:
                n[:, 0] -= ~y
                n[:, 1] -= y
            low = np.float32(0.4 if order < ORDERS - 1 else 0.05)
            x[:, order] = np.log((n[:, 1] + low) / (n[:, 0] + low))
        x[:, -1] = 0.3
        return np.clip(x, -12, 12), np.searchsorted(GATE_EDGES, n.sum(1))


def squash(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -20, 20)))


def _level(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = (np.clip(t, -7.999, 7.999) + 8) * (LEVELS - 1) / 16
    lo = f.astype(np.int64)
    return lo, f - lo


def learn(s: Shard, table: np.ndarray, rate: float = 0.01, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, how much each set of weights has seen, what the final table has seen): one
    online pass over the bits of a bucket, from even weights. A batch's mean error moves the
    weights, each by a rate that falls as its errors add up; before that, its bits are
    counted at their levels of mixed probability."""
    w, power, used = np.full((SETS, GATES, INPUTS), 0.3), np.full((SETS, GATES, INPUTS), 1e-2), np.zeros((SETS, GATES))
    met = np.zeros((2, SETS, GATES * LEVELS))
    at, eye = np.flatnonzero(s.weight > 0), np.eye(GATES)
    weight = s.weight[at] ** 0.75
    for bit in range(8 if len(at) else 0):
        x, gate = s.inputs(bit, table, at, own=True)
        y, mixed, k = s.bit(bit)[at], np.empty(len(at)), s.set + bit
        for i in range(0, len(at), batch):
            c = slice(i, i + batch)
            mixed[c] = t = np.einsum("ij,ij->i", x[c], w[k][gate[c]])
            to = eye[gate[c]] * weight[c, None]
            many = to.sum(0)
            step = to.T @ (x[c] * (y[c] - squash(t))[:, None]) / np.maximum(many, 1e-9)[:, None]
            power[k] += step**2
            w[k] += rate * step / np.sqrt(power[k])
            used[k] += many
        lo, part = _level(mixed)
        for level, share in ((lo, 1 - part), (lo + 1, part)):
            for v in (0, 1):
                met[v, k] += np.bincount(gate * LEVELS + level, s.weight[at] * share * (y == v), GATES * LEVELS)
    return w, used, met.reshape(2, SETS, GATES, LEVELS)


def averaged(weights: np.ndarray, used: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, final table) from sums over buckets: of weights times what they have seen,
    of that, and of what the final table has seen."""
    prior = squash(np.linspace(-8, 8, LEVELS))
    return np.where(used[:, :, None] > 0, weights / np.maximum(used, 1e-9)[:, :, None], 0.3), (met[1] + 20 * prior) / (met[0] + met[1] + 20)


def costs(s: Shard, table: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 of each unit's probability."""
    total = np.zeros(s.size)
    for bit in range(8 if s.size else 0):
        x, gate = s.inputs(bit, table)
        t = np.einsum("ij,ij->i", x, weights[s.set + bit][gate])
        lo, part = _level(t)
        row = refined[s.set + bit].ravel()
        r = row[gate * LEVELS + lo] * (1 - part) + row[gate * LEVELS + lo + 1] * part
        p = np.clip((squash(t) + r) / 2, 1e-9, 1 - 1e-9)
        total += np.log10(np.where(s.bit(bit) == 1, p, 1 - p))
    return np.bincount(s.unit, total[s.edge], s.n)


def _shards(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[dict, Shard]]:
    for b in batches:
        for i in range(len(b)):
            row = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
            yield row, Shard(np.frombuffer(row["bytes"].as_buffer(), np.uint8), unpacked(row["sizes"]), unpacked(row["train"]), row["bucket"].as_py() >= buckets)


def _table(vocab: DataFrame, buckets: int) -> np.ndarray:
    """(slots, 2): counts of the training texts, of a size that the corpus doesn't change.
    Tasks send the slots that they use; ranges of slots are summed up apart."""
    edge = np.linspace(0, OFFSETS[-1], RANGES + 1).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, s in _shards(batches, buckets):
            total = np.zeros(2 * OFFSETS[-1]) if total is None else total
            s.count(total)
        if total is not None:
            total = total.reshape(-1, 2)
            for r in range(RANGES):
                part = total[edge[r] : edge[r + 1]]
                used = np.flatnonzero(part.any(1))
                n = part[used].astype(np.int64)
                n = n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed(np.diff(used, prepend=0).astype(np.uint32))]), pa.array([packed(n.ravel())])], names=["r", "slots", "n"])

    def add(g: pa.Table) -> pa.Table:
        r = g["r"][0].as_py()
        out = np.zeros((edge[r + 1] - edge[r], 2), np.int64)
        for slots, n in zip(g["slots"], g["n"], strict=True):
            out[np.cumsum(unpacked(slots).astype(np.int64))] += unpacked(n).reshape(-1, 2)
        return pa.table([pa.array([r], pa.int32()), pa.array([b""]), pa.array([out.astype(np.float32).tobytes()])], names=["r", "slots", "n"])

    schema = "r int, slots binary, n binary"
    whole = np.zeros((OFFSETS[-1], 2), np.float32)
    for x in vocab.mapInArrow(lean(send), schema).groupBy("r").applyInArrow(add, schema).select("r", "n").toLocalIterator():
        whole[edge[x.r] : edge[x.r + 1]] = np.frombuffer(x.n, np.float32).reshape(-1, 2)
    return whole


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Scores of rows (doc_id, text), learned from the training rows among them: SCORES.

    base_score is that of counts of whole tokens with one added; score is log10 of the
    mixed model's probability of all tokens and the end; bits_per_byte is the same in bits,
    over the bytes that are coded (words, a space behind each, the end). Null texts are
    empty: only the end is scored. A null doc_id has the empty string's checksum. Repeated
    rows count each. What goes to the driver is bounded: the hashed tables (TABLE_BITS),
    and a task's sums of weights and of the final table. `buckets` is found from the number
    of bytes, so that results depend on the rows alone, but for the rounding of sums.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if buckets is None:
        held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, 1 << math.ceil(0.75 * math.log2(1 + held / 1e6)))
    sent = blocks(docs, buckets)
    vocab = vocabulary(sent, buckets)
    total, types = (int(x or 0) for x in vocab.agg(F.sum("tokens"), F.sum("types")).first())
    inner = vocab.select("bucket", "bytes", "sizes", "train")
    table = spark.sparkContext.broadcast(_table(inner, buckets))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, s in _shards(batches, buckets):
            w, used, met = learn(s, table.value)
            now = (w * used[:, :, None], used, met)
            sums = now if sums is None else tuple(a + b for a, b in zip(sums, now, strict=True))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in sums], names=["w", "used", "met"])

    shapes = {"w": (SETS, GATES, INPUTS), "used": (SETS, GATES), "met": (2, SETS, GATES, LEVELS)}
    sums = [np.zeros(x) for x in shapes.values()]
    for r in sorted(inner.mapInArrow(lean(fit), "w binary, used binary, met binary").collect()):
        for at, (c, shape) in zip(sums, shapes.items(), strict=True):
            at += np.frombuffer(r[c]).reshape(shape)
    last = spark.sparkContext.broadcast(averaged(*sums))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in _shards(batches, buckets):
            cost = costs(s, table.value, *last.value)
            known = s.train.astype(np.uint32) if s.train.max(initial=0) < 1 << 32 else s.train
            for block, at, places, of in zip(*(row[c] for c in ("blocks", "at", "places", "maps")), strict=True):
                i = unpacked(of)
                cols = [pa.array([block.as_py()]), pa.array([row["bucket"].as_py()], pa.int32()), pa.array([at.as_py()], pa.int64()), pa.array([places.as_py()], pa.binary()), pa.array([cost[i].tobytes()]), pa.array([packed(known[i]) if row["bucket"].as_py() < buckets else None], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "bucket", "at", "places", "cost", "count"])

    def finish(texts: pa.Table, replies: pa.Table) -> pa.Table:
        end, words, ends, keys, number = (unpacked(x) for x in next(x for x in texts["layout"] if x.is_valid))
        keys = np.cumsum(keys)
        cost, count, border = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(keys))
        for bucket, at, places, value, many in zip(*(replies[c] for c in ("bucket", "at", "places", "cost", "count")), strict=True):
            v = np.frombuffer(value.as_buffer())
            i = at.as_py() + (unpacked(places).astype(np.int64) if places.is_valid else np.arange(len(v)))
            if bucket.as_py() < buckets:
                cost[i], count[i] = v, unpacked(many)
            else:
                border[i] = v
        cost, count, border = cost[words], count[words], border[number]
        base, known = np.log10((count + 1) / (total + types + 1)), (count > 0).astype(np.int64)
        out: list[list] = [[] for _ in range(8)]
        for k in range(texts.num_rows):
            if not texts["seq"][k].is_valid:
                continue
            seq = unpacked(texts["seq"][k]).astype(np.int64)
            many, coded = (np.array(texts[c][k].as_py(), np.int64) for c in ("many", "coded"))
            first = np.cumsum(many) - many
            u, of = _distinct(Block.pairs_of(ends, np.r_[end, seq]))
            cost_at = cost[seq] + border[np.minimum(np.searchsorted(keys, u), len(keys) - 1)][of][1:]
            points = np.add.reduceat(cost_at, first)
            cols = [texts["ids"][k].as_py(), texts["out"][k].as_py(), many, np.add.reduceat(known[seq], first), np.full(len(many), total), np.add.reduceat(base[seq], first), points, -points / math.log10(2) / coded]
            for o, c in zip(out, cols, strict=True):
                o.extend(c)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=_names(SCORES))

    replies = vocab.mapInArrow(lean(reply), "block string, bucket int, at long, places binary, cost binary, count binary")
    texts = sent.where("bucket is null").select("block", "ids", "out", "many", "coded", "seq", "layout")
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, SCORES)
