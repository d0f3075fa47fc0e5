"""Document quality by labelling lines: a linear-chain CRF marks each line as content or
boilerplate (Viterbi), and the share of words in content lines decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, lean, string_buffers
from .words import Words, chunks, hash_ranges, mix, windows

# The symbols that count as such.
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_CLASSES = {  # of bytes, for the features of a line
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": b"!?", "stop": b".,;:",
}
#: Edges of the features' buckets: how many words, then shares.
_EDGES = {
    "words": [2, 4, 8, 16, 32, 64, 128], "symbols": [0.001, 0.02, 0.1, 0.3, 0.6], "upper": [0.02, 0.1, 0.3, 0.6, 0.9], "digit": [0.001, 0.02, 0.1, 0.3],
    "mark": [0.001, 0.05, 0.2, 0.5], "stop": [0.001, 0.05, 0.1, 0.2, 0.4], "same": [0.001, 0.05, 0.2, 0.5], "repeat": [0.001, 0.1, 0.3, 0.6, 0.9], "length": [2, 3, 4, 5, 6, 8, 12],
}
N_BUCKETS = 8
N_FEATURES = len(_EDGES) + 1  # and whether it repeats an earlier line


@dataclass
class Measured:
    """The base counts of each text, and of each line with a word its text, its words and
    the bucket of each feature (lines stand in the order of texts)."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    buckets: np.ndarray


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]


def _seen_before(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Is there an equal h earlier in the same text?"""
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(key), bool)
    out[first] = False
    return out


def measure(buf: np.ndarray, offsets: np.ndarray) -> Measured:
    """Base counts and line features of whole texts."""
    docs, start, end = len(offsets) - 1, offsets[:-1], offsets[1:]
    w = Words(buf, offsets, lower=False)
    h = w.hashes()
    n_words = np.diff(w.first)
    symbol = _IS_SYMBOL[buf]
    # words in windows that occur twice or more in their text
    win, at = windows(h, w.first, REPEAT_WORDS)
    key = mix(win ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WORDS, -1)
    repeated = np.cumsum(cover[:-1]) > 0 if len(h) else np.zeros(0, bool)
    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(buf == 10)
    l_start = np.union1d(start, breaks + 1)
    l_start = l_start[l_start < len(buf)] if len(buf) else l_start[:0]
    l_end = np.append(l_start[1:], len(buf))
    l_end = l_end - ((l_end > l_start) & (buf[np.maximum(l_end - 1, 0)] == 10)) if len(buf) else l_end[:0]
    a, b = np.searchsorted(w.starts, l_start), np.searchsorted(w.starts, l_end)
    some = b > a
    l_start, l_end, a, b = l_start[some], l_end[some], a[some], b[some]
    line_doc = w.doc[a] if len(a) else np.zeros(0, np.int64)
    dup = _seen_before(line_doc, hash_ranges(buf, l_start, l_end) ^ mix((l_end - l_start).astype(np.uint64)))
    line_words = b - a
    chars = np.maximum(1, _between(w.solid, l_start, l_end))
    count_of = lambda name: _between(np.isin(buf, np.frombuffer(bytes(_CLASSES[name]), np.uint8)), l_start, l_end)
    letters = np.maximum(1, (upper := count_of("upper")) + count_of("lower"))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    values = {
        "words": line_words, "symbols": _between(symbol, l_start, l_end) / line_words, "upper": upper / letters, "digit": count_of("digit") / chars,
        "mark": count_of("mark") / line_words, "stop": count_of("stop") / line_words, "same": _between(same, a, b) / line_words, "repeat": _between(repeated, a, b) / line_words, "length": chars / line_words,
    }
    buckets = np.stack([*(np.searchsorted(_EDGES[k], v, "right") for k, v in values.items()), dup.astype(np.int64)], 1) if len(a) else np.zeros((0, N_FEATURES), np.int64)
    return Measured(
        n_words, _between(w.solid & ((buf & 0xC0) != 0x80), start, end), _between(symbol, start, end), np.bincount(line_doc[dup], minlength=docs)[:docs] if len(a) else np.zeros(docs, np.int64),
        _between(repeated, w.first[:-1], w.first[1:]), line_doc, line_words, buckets,
    )


@dataclass
class Model:
    """weights[f, v]: how much value v of feature f speaks for boilerplate; step[a, b]:
    for label b (1: boilerplate) after label a; bias: for boilerplate at any line; fitted:
    whether labelled documents of both kinds were there to learn from."""

    weights: np.ndarray
    step: np.ndarray
    bias: float
    fitted: bool = True

    @classmethod
    def plain(cls) -> Model:
        """What holds without labelled documents: many symbols, capitals, repeats speak
        for boilerplate."""
        m = cls(np.zeros((N_FEATURES, N_BUCKETS)), np.array([[0.5, -0.5], [-0.5, 0.5]]), -2.0, False)
        for k, name in enumerate(_EDGES):
            if name in ("symbols", "upper", "mark", "same", "repeat"):
                m.weights[k, 3:] = 2.0
        m.weights[-1, 1] = 1.0
        return m

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(N_FEATURES), buckets].sum(1)


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of lines of one text, the longest runs first."""
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(doc)])
    order = np.argsort(-size, kind="stable")
    return start[order], size[order]


def viterbi(model: Model, line_doc: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The best label of every line, all texts in step: True is boilerplate."""
    e = model.scores(buckets)
    start, size = _chains(line_doc)
    out, back = np.zeros(len(e), bool), np.zeros((len(e), 2), np.int8)
    if not len(e):
        return out
    best = np.stack([np.zeros(len(start)), e[start]], 1)
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t, "left"))  # runs longer than t
        at = start[:n] + t
        way = best[:n, :, None] + model.step[None]
        back[at] = way.argmax(1)
        best[:n] = way.max(1)
        best[:n, 1] += e[at]
    label = best.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t, "left"))
        at = start[:n] + t
        out[at] = label[:n] == 1
        label[:n] = back[at, label[:n]]
    return out


def line_labels(line_doc: np.ndarray, line_words: np.ndarray, buckets: np.ndarray, bad: np.ndarray, turns: int = 3) -> np.ndarray:
    """Which lines are boilerplate, where only texts are labelled (bad: for each line, whether
    its text is): a classifier of single lines is fitted to the texts' labels, lines get its
    answer, and it is fitted to these again. Of a good text the half of the words that
    speaks least for boilerplate stays content, of a poor one the half that speaks most
    for it stays boilerplate."""
    y, flat = bad.astype(float), buckets + np.arange(N_FEATURES) * N_BUCKETS
    total = np.bincount(line_doc, line_words)[line_doc]
    for _ in range(turns):
        w, bias = _line_classifier(flat, y)
        score = w[flat].sum(1) + bias
        for poor in (False, True):
            at = np.flatnonzero(bad == poor)
            at = at[np.lexsort((-score[at] if poor else score[at], line_doc[at]))]
            words = np.cumsum(line_words[at]) - line_words[at]
            first = np.r_[True, line_doc[at][1:] != line_doc[at][:-1]] if len(at) else np.zeros(0, bool)
            before = words - np.maximum.accumulate(np.where(first, words, 0))
            held = 2 * before <= total[at]
            y[at] = held | (score[at] > 0) if poor else ~held & (score[at] > 0)
    return y.astype(bool)


def _line_classifier(flat: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression of lines by gradient steps; both labels weigh the same."""
    w, bias, size = np.zeros(N_FEATURES * N_BUCKETS), 0.0, max(1, len(y))
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(steps):
        d = (y - 1 / (1 + np.exp(-(w[flat].sum(1) + bias)))) * weight
        w += 0.5 * (np.bincount(flat.ravel(), np.repeat(d, N_FEATURES), len(w)) / size - ridge * w)
        bias += 0.5 * d.sum() / size
    return w, bias


def train(line_doc: np.ndarray, line_words: np.ndarray, buckets: np.ndarray, bad: np.ndarray, rounds: int = 200, ridge: float = 2e-3) -> Model:
    """Fit by gradient steps on the likelihood (forward-backward, all in step) of the chains
    of lines, as line_labels labels them. bad: for each line, whether its text is labelled
    as poor."""
    start, size = _chains(line_doc)
    if not len(line_doc) or bad.all() or not bad.any():
        return Model.plain()
    m = Model(np.zeros((N_FEATURES, N_BUCKETS)), np.zeros((2, 2)), 0.0)
    y, longest = line_labels(line_doc, line_words, buckets, bad).astype(int), int(size[0])
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]
    flat = buckets + np.arange(N_FEATURES) * N_BUCKETS
    total, chains = len(y), len(start)
    gold_step = np.zeros((2, 2))
    inner = np.flatnonzero(line_doc[1:] == line_doc[:-1]) + 1
    np.add.at(gold_step, (y[inner - 1], y[inner]), 1)
    # every text weighs the same, whatever its number of lines
    moment = [np.zeros_like(m.weights), np.zeros((2, 2)), 0.0]
    second = [np.zeros_like(m.weights), np.zeros((2, 2)), 0.0]
    for i in range(1, rounds + 1):
        e = m.scores(buckets)
        f, g = np.zeros((total, 2)), np.zeros((total, 2))
        f[start, 1] = e[start]
        for t in range(1, longest):
            at = start[: active[t]] + t
            f[at] = np.logaddexp(f[at - 1, 0, None] + m.step[0], f[at - 1, 1, None] + m.step[1])
            f[at, 1] += e[at]
        expect = np.zeros((2, 2))
        last = start + size - 1
        z = np.zeros(total)
        z[start] = np.logaddexp(f[last, 0], f[last, 1])
        for t in range(longest - 2, -1, -1):
            n = active[t + 1]
            at = start[:n] + t
            to = g[at + 1] + np.stack([np.zeros(n), e[at + 1]], 1)
            both = m.step[None] + to[:, None, :]
            g[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            expect += np.exp(f[at][:, :, None] + both - z[start[:n]][:, None, None]).sum(0)
        logz = np.repeat(z[np.sort(start)], np.diff(np.r_[np.sort(start), total]))
        p = np.exp(f[:, 1] + g[:, 1] - logz)
        d = y - p
        dw = np.bincount(flat.ravel(), np.repeat(d, N_FEATURES), N_FEATURES * N_BUCKETS).reshape(N_FEATURES, N_BUCKETS)
        for k, (grad, old) in enumerate(((dw, m.weights), (gold_step - expect, m.step), (d.sum(), m.bias))):
            grad = grad / total - ridge * old
            moment[k] = 0.9 * moment[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            move = 0.1 * (moment[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
            if k == 0:
                m.weights += move
            elif k == 1:
                m.step += move
            else:
                m.bias += float(move)
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, most_lines: int = 1000) -> Model:
    """Train on at most `sample` labelled documents, chosen by a hash of their id (a
    classifier's bounded sample; the texts' line features, not the texts, come to the
    driver); those of more than most_lines lines are no examples. Without labels of both
    kinds: Model.plain(), which says so in `fitted`."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    schema = "doc_id long, quality int, buckets array<int>, words array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_buffers(b.column(2))
            m = measure(buf, off)
            n = np.bincount(m.line_doc, minlength=len(b)) if len(m.line_doc) else np.zeros(len(b), np.int64)
            cuts = np.cumsum(n)[:-1]
            n = n.tolist()
            lists = [x.ravel().astype(np.int32) if k <= most_lines else None for x, k in zip(np.split(m.buckets, cuts), n, strict=True)] if len(b) else []
            words = [x.astype(np.int32) if k <= most_lines else None for x, k in zip(np.split(m.line_words, cuts), n, strict=True)] if len(b) else []
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))], names=["doc_id", "quality", "buckets", "words"])

    got = sorted(((r.doc_id, r.quality, r.buckets, r.words) for r in rows.mapInArrow(lean(run), schema).collect() if r.buckets), key=lambda r: (r[0], r[2]))
    if not got:
        return Model.plain()
    sizes = [len(r[2]) // N_FEATURES for r in got]
    doc = np.repeat(np.arange(len(got)), sizes)
    buckets = np.concatenate([np.array(r[2]).reshape(-1, N_FEATURES) for r in got])
    return train(doc, np.concatenate([r[3] for r in got]), buckets, np.repeat([r[1] == 0 for r in got], sizes))


def assess(docs: DataFrame, model: Model, min_share: float = 0.5, prefix: str = "") -> DataFrame:
    """Judge whole texts. Returns the columns of docs and n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), content_share (double:
    words in content lines among all; null without words), n_boilerplate_lines (long),
    model_fitted (boolean: false if there were no labels to learn from), each name after
    `prefix`; a column of docs that has such a name gets underscores before its own.

    Null and empty texts have no words and fail. Rows that repeat are judged each; an
    empty table gives an empty one.
    """
    add = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    add += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("n_boilerplate_lines", T.LongType()), T.StructField("model_fitted", T.BooleanType())]
    for field in add:
        field.name = prefix + field.name
    names = {f.name.lower() for f in add}
    clashing = [c for c in docs.columns if c.lower() in names]
    docs = docs.withColumnsRenamed(dict(zip(clashing, free([*docs.columns, *names], *clashing), strict=True))).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, *add])
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_buffers(b.column(text))
            parts: list[list[np.ndarray]] = []
            for i, j in chunks(off):
                m = measure(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                junk = viterbi(model, m.line_doc, m.buckets)
                content = np.bincount(m.line_doc, m.line_words * ~junk, j - i) if len(junk) else np.zeros(j - i)
                share = np.divide(content, m.n_words, out=np.full(j - i, np.nan), where=m.n_words > 0)
                failed = (m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)
                parts.append([m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & (share >= min_share), share, np.bincount(m.line_doc[junk], minlength=j - i) if len(junk) else np.zeros(j - i), np.full(j - i, model.fitted)])
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(add)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(t.to_pandas_dtype()), t, from_pandas=True) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    return docs.mapInArrow(lean(run), schema)
