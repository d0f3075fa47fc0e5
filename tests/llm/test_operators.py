"""Each operator against a brute-force version, and its defined edge cases."""

import array
import base64
import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import bpe, common, components, crf_quality, embedding_pairs, jaccard, line_templates, mixing_lm, packing, preference, queries, tokenize, unit_dedup, warc, words

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "  a  b ", "x" * 30000, "é \x85 ß\n日本 語 😀\x00", "word " * 4000, "\ta\n", "A b"]


def texts(n=150, seed=5):
    rng = random.Random(seed)
    vocab = ["the", "of", "Tion", "ren", "été", "un-", "x1", "a", "b.", "Ñandú", "don't", "###", "|"]
    return [" ".join(rng.choice(vocab) + rng.choice(["", "", "s", ",", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def docs(spark, rows, more=False):
    rows = list(enumerate(rows)) if not rows or not isinstance(rows[0], tuple) else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("kept", "n", "row", "tokens", "removed", "drop", "doc", "part", "__text", "__row", "__drop", "__spans", "spans", "line_row", "unit_doc", "_row") if more else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# 1 WARC


def test_warc_scan_owns_records_by_their_start():
    rng = random.Random(2)
    blob, want = b"", []
    for i in range(120):
        blob += bytes(rng.choice([0x1F, 0x8B, 8, 0, 65]) for _ in range(rng.randint(0, 40) if rng.random() < 0.2 else 0))
        want.append((len(blob), i))
        blob += warc.record(i, f"http://x/\n{i}", rng.choice([None, "", "x" * rng.randint(0, 200000), "<p>é" * 9]), rng.choice([None, 5]))
    blob += b"\x1f\x8b\x08 the end"
    for split in (97, 1000, 1 << 30):
        got = [(r.position, warc._fields(r, True)[0]) for s in range(0, len(blob), split) for r in warc.scan(io.BytesIO(blob), s, min(s + split, len(blob)), step=rng.choice([64, 4096]))]
        assert got == want
    assert list(warc.scan(io.BytesIO(b""), 0, 0)) == []


@pytest.mark.parametrize("split", [500, 1 << 25])
def test_warc_round_trip(spark, split):
    rows = [(7, "u", "same"), (3, None, "same"), (9, "u", None), (4, "u", ""), (5, "a\nb", "é" * 999), (5, "a", "é" * 999), (None, "u", "same"), (8, "u", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit(2))
    got = sorted(map(tuple, warc.round_trip(pages, split).collect()), key=str)
    firsts = {"same": 3, "": 4, "é" * 999: 5, "x" * 300000: 8}
    want = []
    for p, _, h in rows:
        body, first = (h or "").encode(), firsts[h or ""]
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_keeps_records_with_long_headers(spark, monkeypatch):
    url = "data:," + "".join(random.Random(4).choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=2 << 20))
    pages = spark.createDataFrame([(1, "u", "a"), (2, url, "b"), (3, "u", "c")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(pages).collect()) == [1, 2, 3]
    monkeypatch.setattr(warc, "read", lambda *a, f=warc.read, **kw: f(*a, **kw).where("page_id <> 2"))
    with pytest.raises(ValueError, match="3 records were written and 2 read whole"):
        warc.round_trip(pages)


def test_warc_tells_damaged_members_and_reads_in_parallel(spark, tmp_path, monkeypatch):
    members = [warc.record(i, "u", "".join(random.Random(i).choices("abcdefgh", k=4000)), None) for i in range(40)]
    broken = bytearray(members[7])
    broken[-600:-500] = bytes(100)
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*members[:7], bytes(broken), *members[8:]]))
    files = warc.list_files(spark, f"file://{tmp_path}")
    df = warc.read(files, split=4000)
    rows = df.collect()
    assert df.rdd.getNumPartitions() == -(-sum(map(len, members)) // 4000)
    assert sorted(r.page_id for r in rows if r.record_type == "response") == [i for i in range(40) if i != 7]
    assert [r.position for r in rows if r.record_type == "damaged"] == [sum(map(len, members[:7]))]


def test_warc_lists_and_reads_a_folder(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "a", None), (2, "u", "a", 1)], "page_id long, url string, html string, refers_to long"), f"file://{tmp_path}/w")
    rows = warc.read(warc.list_files(spark, f"file://{tmp_path}/w")).collect()
    assert sorted((r.page_id, r.record_type, r.payload) for r in rows) == [(1, "response", b"a"), (2, "revisit", None)]


# 2 preference pairs


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, "user", "a"), (3, "chosen", 0, None, "q"), (3, "rejected", 0, None, "q"), (None, "chosen", 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumn("common", F.lit(1)).withColumn("c", F.lit(1))
    got = {r.pair_id: r for r in preference.format_pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert (one.common_turns, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert one.chosen == "<|assistant|>\ngood<|end|>\n" and one.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["good<|end|>\n"] and [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["bad<|end|>\n"]
    assert (got[2].prompt, got[2].rejected, got[2].common_turns) == ("", None, 0) and (got[3].common_turns, got[3].chosen, got[3].chosen_spans) == (1, "", [])
    assert preference.format_pairs(df.where("false")).count() == 0


def test_preference_against_loops(spark):
    rng = random.Random(8)
    turns = [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for c in range(40) for t in range(rng.randint(0, 5))]
    conv = collections.defaultdict(list)
    for c, t, r, x in turns:
        conv[c].append((r, x))
    df = preference.neighbours(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    render = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)
    for r in preference.format_pairs(df).collect():
        a, b = conv.get(2 * r.pair_id, []), conv.get(2 * r.pair_id + 1, [])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.common_turns, r.prompt) == (n, render(a[:n])) and (r.chosen or "") == render(a[n:]) and (r.rejected or "") == render(b[n:])


# 3 BPE, 9 packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    return t


def hard_texts():
    rng = random.Random(1)
    alphabet = list("abcdeghinorstu") + list("AZ  \n\t'’éß09.,!-_#$|\x1c\x85\xa0　中😀½²\r\x00") + ["<|endoftext|>", "'ll", "  ", " \n"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["ab" * 3000, " " * 300, "<|endoftext|><|endoftext|>", "x <|endof", "a\n\n  b \n c "] + [t or "" for t in ODD]


def test_bpe_equals_the_library(library):
    coder, ts = bpe.TrieBPE(BPE, limit=500), hard_texts()
    for t, e, r in zip(ts, coder.encode_many(ts), library.encode_batch(ts, add_special_tokens=False), strict=True):
        assert list(array.array("I", e)) == r.ids, t
        assert coder.decode(e) == library.decode(r.ids, skip_special_tokens=False), t


def test_bpe_shares_prefixes_and_survives_equal_hashes(library, monkeypatch):
    coder = bpe.TrieBPE(BPE)
    ws = [b"tion", b"tions", b"ti", b"x", b"tion" * 40, b"tion" * 40 + b"s"]
    visits = []
    monkeypatch.setattr(coder, "step", lambda s, b, f=coder.step: visits.append(len(s)) or f(s, b))
    size = np.array([len(w) for w in ws])
    ids, many = coder.encode_words(np.frombuffer(b"".join(ws), np.uint8), np.cumsum(size) - size, size)
    assert [list(x) for x in np.split(ids, np.cumsum(many)[:-1])] == [library.encode(w.decode(), add_special_tokens=False).ids for w in ws]
    assert sum(visits) == len("tions") + len("x")  # the trie's nodes, each once
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "hash_ranges", lambda buf, a, b: np.zeros(len(a), np.uint64))
    ts = ["one two", "six ten one", ""]
    assert [list(array.array("I", e)) for e in coder.encode_many(ts)] == [r.ids for r in library.encode_batch(ts, add_special_tokens=False)]


def test_encode_decode_columns(spark, library):
    df = docs(spark, ODD + [ODD[5]], more=True)
    got = {r.doc_id: r for r in tokenize.encode_decode(df, BPE).collect()}
    dig = {r.doc_id: r for r in tokenize.token_digests(df, BPE).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert dig[i].n_tokens == len(ids) and dig[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and dig[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    assert tokenize.token_digests(df.where("false"), BPE).count() == 0


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_loses_nothing(spark, library, window):
    ts = ODD + texts(40)
    df = docs(spark, ts, more=True)
    rows = packing.pack(df, BPE, window).collect()
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(ts)}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == r.length and r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, ids in whole.items():
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == ids and [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts[:-1])]))
    last = max(by_seq)
    assert sorted(by_seq) == list(range(last + 1))
    for s, parts in by_seq.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts[:-1])])) and (s == last or sum(r.length for r in parts) == window)
    assert len(packing.pieces(df, BPE, window).columns) == 7 and packing.pieces(df.where("false"), BPE, window).count() == 0


# 4 quality


def base_of(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    ts = ODD + texts(300) + [" ".join(random.Random(i).choice("ab") for _ in range(i % 70)) for i in range(150)]
    df = docs(spark, ts, more=True)
    got = crf_quality.assess(df, crf_quality.Model.plain()).collect()
    assert len(got) == len(ts)
    for r in got:
        n, chars, symbols, dups, repeats = base_of(ts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats), ts[r.doc_id]
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and (r.kept is False or not r.base_failed) and (r.content_share is None) == (n == 0)
    assert crf_quality.assess(df.where("false"), crf_quality.Model.plain()).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    m = crf_quality.Model(rng.normal(size=(crf_quality.N_FEATURES, crf_quality.N_BUCKETS)), rng.normal(size=(2, 2)), 0.1)
    doc = np.repeat([0, 1, 4, 5], [5, 1, 7, 3])
    buckets = rng.integers(0, 6, (len(doc), crf_quality.N_FEATURES))
    got, e = crf_quality.viterbi(m, doc, buckets), m.scores(buckets)
    for d in set(doc):
        at = np.flatnonzero(doc == d)
        value = lambda y: sum(e[i] * v for i, v in zip(at, y)) + sum(m.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max((tuple(int(x) for x in f"{k:0{len(at)}b}") for k in range(1 << len(at))), key=value)
        assert tuple(got[at].astype(int)) == best


def test_training_tells_junk_apart(spark):
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice(["the", "tion", "re", "of", "in"]) + rng.choice("abcdefg") + rng.choice(["", ",", ".\n"]) for _ in range(80))
    junk = lambda: " ".join(rng.choice(["THE", "TION", "RE"]) + rng.choice("ABCDEFG") + rng.choice(["###", "&&&", "!!", "$$$\n"]) for _ in range(80))
    rows = [(i, junk() if i % 4 == 0 else clean()) for i in range(240)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = crf_quality.fit(df, labels)
    held_out = [r for r in crf_quality.assess(df, model).collect() if r.doc_id >= 120]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in held_out) >= 0.95 * len(held_out)
    plain = crf_quality.fit(df, labels.where("false"))
    assert plain.bias == crf_quality.Model.plain().bias and not plain.fitted and model.fitted
    # a clean body with a footer of junk has both labels, whatever the order, and stays
    lines = lambda make, n: [x for x in "\n".join(make() for _ in range(9)).split("\n") if len(x.split()) > 3][:n]
    mixed = [(i, "\n".join([*lines(clean, 9), *lines(junk, 3)] if i % 2 else [*lines(junk, 3), *lines(clean, 9)])) for i in range(60)]
    for r in crf_quality.assess(docs(spark, mixed), model).collect():
        assert r.kept and r.n_boilerplate_lines == 3 and 0.5 < r.content_share < 1


def test_line_labels_keep_half_of_a_text():
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    bad, words = (np.arange(40) % 3 == 0)[doc], rng.integers(1, 30, len(doc))
    y = crf_quality.line_labels(doc, words, rng.integers(0, 5, (len(doc), crf_quality.N_FEATURES)), bad)
    for d in range(40):
        at = doc == d
        share = words[at & (y == bad)].sum() / words[at].sum()
        assert share >= 0.5 or (at.sum() > 1 and share + words[at].max() / words[at].sum() > 0.5)


# 5 language model


def test_lm_base_and_model(spark):
    ts = ODD + texts(200, 9)
    df = docs(spark, ts + [None], more=True)
    got = {r.doc_id: r for r in mixing_lm.score(df).collect()}
    assert len(got) == len(ts) + 1
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(ts))}
    tokens = {i: [*WORD.findall(lower(t)), "\n"] for i, t in enumerate(ts)}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    if zlib.crc32(str(len(ts)).encode()) % 7 != 2:
        counts["\n"] += 1
    total, types = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0
        coded = sum(len(w.encode()) + 1 for w in ws[:-1]) + 1
        assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / coded, rel_tol=1e-9)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {r.doc_id: r.score for r in mixing_lm.score(df.repartition(5)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(math.isclose(again[i], got[i].score, rel_tol=1e-9) for i in again)
    known = [i for i in tokens if held[i] and len(tokens[i]) > 20]
    assert sum(got[i].score for i in known) > 1.1 * sum(got[i].base_score for i in known)
    empty = mixing_lm.score(df.where("false"))
    assert empty.count() == 0


def test_lm_splits_large_buckets(spark, monkeypatch):
    ts = texts(80, 3)
    whole = {r.doc_id: r for r in mixing_lm.score(docs(spark, ts), buckets=2).collect()}
    monkeypatch.setattr(mixing_lm, "MOST", 20)
    for r in mixing_lm.score(docs(spark, ts), buckets=2).collect():
        assert math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9) and (r.n_known, r.train_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].train_tokens) and abs(r.score / whole[r.doc_id].score - 1) < 0.2


def plain_scores(ts, buckets):
    """The model in loops over bits, without any sharing of work but the counts."""
    M, u64 = mixing_lm, lambda x: x % (1 << 64)
    mix1 = lambda x: int(words.mix(np.array([u64(x)], words.U))[0])
    value = [int(x) for x in words._byte_values()]
    spell = lambda b: u64(sum(value[x] * pow(words._BASE, i, 1 << 64) for i, x in enumerate(b)))
    seqs = {i: [*(w.encode() for w in WORD.findall(lower(t))), b"\n"] for i, t in enumerate(ts)}
    tail = lambda w: (b"" if w == b"\n" else w)[-M.TAIL :].rjust(M.TAIL, b"\0")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in seqs}
    units = collections.Counter()
    for i, ws in seqs.items():
        for before, w in zip([b"\n", *ws], ws):
            units[w, False] += not held[i]
            units[tail(before) + w[:1], True] += not held[i]
    shards = collections.defaultdict(list)
    for (b, pair), c in units.items():
        key = 0
        for k in range(6):
            key = u64(key * 257 + (b[k] + 1 if k < len(b) else 0))
        shards[mix1(key) % buckets, pair].append((mix1(spell(b)), b, c))

    def context(head, k):
        """The byte k places before comes first in the step that adds it, and so last here."""
        ctx = 0
        for j in range(1, k + 1):
            ctx = ctx << 8 | (head[-j] if j <= len(head) else 0)
        return ctx

    def slots(head, x, pair):
        """Of each bit: the slots, in order, and the bit."""
        for bit in range(8):
            node, out = x >> (8 - bit) | 1 << bit, []
            for k in range(M.ORDERS):
                ctx = context(head, k)
                h = mix1(ctx * 32 + 2 * k + pair) if k < M.ORDERS - 1 else mix1(spell(head) * 32 + 2 * M.ORDERS + pair)
                h = u64((h + node * int(M._NODE)) * int(M._ODD[k]))
                out.append((h >> (64 - M.TABLE_BITS[k])) + int(M.OFFSETS[k]))
            yield bit, out, x >> (7 - bit) & 1

    def edges(b, pair):
        if pair:
            return [(b[:-1], b[-1])]
        return [] if b == b"\n" else [(b[:k], x) for k, x in enumerate(b + b" ") if k]

    weight = {key: collections.Counter() for key in shards}
    for key, us in shards.items():
        for _, b, c in sorted(us):
            for e in edges(b, key[1]):
                weight[key][e] += c
    table = collections.Counter()
    for key, es in weight.items():
        for (head, x), c in es.items():
            for _, out, y in slots(head, x, key[1]):
                for s in out:
                    table[s, y] += c

    def look(out, y, own):
        n = [[table[s, 0] - (own and y == 0), table[s, 1] - (own and y == 1)] for s in out]
        x = [max(-12, min(12, math.log((b + low) / (a + low)))) for (a, b), low in zip(n, [0.4] * (M.ORDERS - 1) + [0.05])]
        return [*x, 0.3], sum(sum(n[-1]) > g for g in M.GATE_EDGES)

    squash1 = lambda t: 1 / (1 + math.exp(-max(-20, min(20, t))))
    place = lambda t: (max(-7.999, min(7.999, t)) + 8) * (M.LEVELS - 1) / 16
    sums, used, met = np.zeros((M.SETS, M.GATES, M.INPUTS)), np.zeros((M.SETS, M.GATES)), np.zeros((2, M.SETS, M.GATES, M.LEVELS))
    for (_, pair), es in weight.items():
        seen = [(e, c) for e, c in es.items() if c]
        for bit in range(8):
            k, w, power = 8 * pair + bit, np.full((M.GATES, M.INPUTS), 0.3), np.full((M.GATES, M.INPUTS), 1e-2)
            many, total = np.zeros((M.GATES, 1)), np.zeros((M.GATES, M.INPUTS))
            for (head, x), c in seen:  # a bucket here is smaller than a batch
                _, out, y = list(slots(head, x, pair))[bit]
                xs, g = look(out, y, True)
                t = sum(a * 0.3 for a in xs)
                lo = int(place(t))
                met[y, k, g, lo] += c * (1 - place(t) + lo)
                met[y, k, g, lo + 1] += c * (place(t) - lo)
                many[g] += c**0.75
                total[g] += c**0.75 * (y - squash1(t)) * np.array(xs)
            step = total / np.maximum(many, 1e-9)
            w += 0.01 * step / np.sqrt(power + step**2)
            sums[k] += w * many
            used[k] += many[:, 0]
    prior = np.array([squash1(v) for v in np.linspace(-8, 8, M.LEVELS)])
    refined = (met[1] + 20 * prior) / (met.sum(0) + 20)
    weights = np.where(used[:, :, None] > 0, sums / np.maximum(used, 1e-9)[:, :, None], 0.3)

    def cost(b, pair):
        total = 0
        for head, x in edges(b, pair):
            for bit, out, y in slots(head, x, pair):
                xs, g = look(out, y, False)
                k, t = 8 * pair + bit, float(np.dot(xs, weights[8 * pair + bit, g]))
                lo = int(place(t))
                r = refined[k, g, lo] * (1 - place(t) + lo) + refined[k, g, lo + 1] * (place(t) - lo)
                p = min(1 - 1e-9, max(1e-9, (squash1(t) + r) / 2))
                total += math.log10(p if y else 1 - p)
        return total

    return {i: sum(cost(w, False) + cost(tail(before) + w[:1], True) for before, w in zip([b"\n", *ws], ws)) for i, ws in seqs.items()}


def test_lm_against_loops(spark):
    ts = ["the cat sat on the mat", "The cats sat, the mat sat", "", None, "a mat on a cat\non the mat", "éa éa cat", "internationally the internationally", "cat cat cat", "on the mat", "the end", "sat on a"]
    want = plain_scores(ts, 2)
    for r in mixing_lm.score(docs(spark, ts), buckets=2).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-4), (r.doc_id, r.score, want[r.doc_id])


def test_lm_costs_are_a_distribution():
    """Over all next bytes behind the same bytes, coded probabilities add up to one."""
    rng = random.Random(1)
    units = [bytes([0, 0, 0, 97, 98, x]) for x in range(256)]
    n = np.array([rng.choice([0, 0, 0, rng.randint(0, 9)]) for _ in units], np.int64)
    s = mixing_lm.Shard(np.frombuffer(b"".join(units), np.uint8), np.full(256, 6), n, True)
    table = np.zeros(2 * mixing_lm.OFFSETS[-1])
    s.count(table)
    table = table.reshape(-1, 2).astype(np.float32)
    w, used, met = mixing_lm.learn(s, table)
    cost = mixing_lm.costs(s, table, *mixing_lm.averaged(w * used[:, :, None], used, met))
    assert math.isclose((10.0**cost).sum(), 1, rel_tol=1e-6)


# 6 lines and sentences


def test_repeated_units_go_and_offsets_stay(spark):
    long = "one two three four five six seven eight nine ten."
    other = "Alpha beta gamma delta epsilon zeta eta theta iota."
    rows = [(2, f"keep me\n{long}\nend"), (1, f"start {other} {long}\nbye"), (3, f"{long.upper()}"), (4, f"x\n  {long}  \ny {other} z"), (5, None), (6, ""), (7, "short line\nshort line"), (None, long), (8, f"{other}\n{other}")]
    df = docs(spark, rows, more=True)
    got = {r.doc_id: r for r in unit_dedup.drop_repeats(df, report="gone").collect()}
    assert got[1].text == rows[1][1] and got[1].gone == []
    assert got[2].text == "keep me\nend" and [rows[0][1][s.start : s.end] for s in got[2].gone] == [long + "\n"]
    assert got[3].text == "" and got[None].text == "" and got[4].text == f"x\ny {other} z" and got[5].text is None and got[6].text == "" and got[7].text == rows[6][1]
    assert got[8].text == f"{other}\n"[:-1] + "\n" or got[8].text == other + "\n"
    assert set(got[1].asDict()) == {*df.columns, "gone"} and {got[1][c] for c in df.columns[2:]} == {"clash"}
    assert unit_dedup.drop_repeats(df.where("false")).count() == 0


def test_units_against_loops(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    got = {r.doc_id: r.text for r in unit_dedup.drop_repeats(docs(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            if len(line.split()) < 8 or line not in seen:
                keep.append(line)
            seen.add(line)
        assert [x for x in got[i].split("\n") if x] == [x for x in keep if x]


def test_paragraphs_of_short_lines_and_unspaced_text_go(spark):
    poem = "\n".join(f"line {w} of it" for w in ("one", "two", "three", "four"))
    han = "今日は天気がとても良いので散歩に行きます。"
    rows = [(1, f"first\n\n{poem}\n\nend"), (2, f"second\n\n{poem.replace(' of', chr(10) + 'OF')}\n\nend"), (3, f"a{han}"), (4, f"{han}別の文"), (5, f"{han}他の話")]
    got = {r.doc_id: r.text for r in unit_dedup.drop_repeats(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "second\n\n\nend", 3: rows[2][1], 4: rows[3][1], 5: "他の話"}


def test_units_of_sentences_and_passages_against_loops(spark):
    """Sentences, lines and paragraphs in loops over a corpus, with long and repeated rows."""
    rng = random.Random(17)
    pool = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(30)]
    rows = [(i, rng.choice(["\n", "\n\n"]).join(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(70, " ".join(pool) * 200), rows[5], (5, "other " + rows[5][1]), (None, rows[7][1])]

    def units(t):
        """(start, end, words) by a plain search from each place."""
        out, lines, at = [], [], 0
        for line in t.split("\n"):
            lines.append((at, line))
            at += len(line) + 1
        for a, line in lines:
            if len(line.split()) >= 8:
                out.append((a, a + len(line)))
                ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s|$)", line)]
                cuts = [0, *ends] + ([len(line)] if not ends or line[ends[-1] :].strip() else [])
                spans = [(a + x + len(line[x:y]) - len(line[x:y].lstrip()), a + y) for x, y in zip(cuts, cuts[1:])]
                out += [s for s in spans if len(spans) > 1 and len(t[slice(*s)].split()) >= 8]
        held = []
        for a, line in [*lines, (0, "")]:
            if line.split():
                held.append((a, a + len(line)))
            else:
                if len(held) > 1 and len(t[held[0][0] : held[-1][1]].split()) >= 8:
                    out.append((held[0][0], held[-1][1]))
                held = []
        return [(x, y, tuple(t[x:y].lower().split())) for x, y in out]

    first = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for x, _, w in units(t):
            first.setdefault(w, set()).add((d is None, d, x) if d != 5 else (False, 5, x, t))
    least = {w: min(v, key=lambda k: k[:2]) for w, v in first.items()}
    for passage in (0, 20):
        got = unit_dedup.drop_repeats(docs(spark, rows), report="gone", min_passage=passage).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id == 5:  # two texts share this id: which is first goes by a hash
                continue
            t = next(t for d, t in rows if d == r.doc_id)
            want = np.zeros(len(t), bool)
            spans = sorted({(x, y) for x, y, w in units(t) if least[w][:2] != (r.doc_id is None, r.doc_id) or min(k[2] for k in first[w] if k[:2] == (r.doc_id is None, r.doc_id)) != x})
            if passage:
                size, group = 0, []
                flat = []
                for x, y in spans:
                    if flat and x <= flat[-1][1]:
                        flat[-1] = (flat[-1][0], max(y, flat[-1][1]))
                    else:
                        flat.append((x, y))
                spans = []
                for k, (x, y) in enumerate(flat):
                    group.append((x, y))
                    size += len(t[x:y].split())
                    if k + 1 == len(flat) or len(t[y : flat[k + 1][0]].split()) >= 8:
                        spans += group if size >= 20 else []
                        size, group = 0, []
            for x, y in spans:
                want[x:y] = True
            gone = np.zeros(len(t), bool)
            for s in r.gone:
                gone[s.start : s.end] = True
            assert all(not t[i].strip() for i in np.flatnonzero(want != gone)), r.doc_id
            assert r.text == "".join(c for c, g in zip(t, gone) if not g)


# 7 templates


def test_templates_with_variable_fields_go(spark):
    rows = [(i, f"unique {'abcdefghij'[i]} {'qwertyuiop'[i]} {'asdfghjkl;'[i]} text of this one\nError 4{i} at line {i} in module core now\nSomeone logged in as {'kimleojoeannbobsue'[i * 3 : i * 3 + 3]} from the office today\nshort {i}") for i in range(6)] + [(9, None), (10, ""), (None, "Error 1 at line 2 in module core now")]
    df = docs(spark, rows, more=True)
    out = line_templates.drop_templates(df, report="lines")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == rows[0][1] and got[0].lines == []
    for i in range(1, 6):
        assert got[i].text == rows[i][1].split("\n")[0] + f"\nshort {i}" and got[i].lines == [1, 2]
    assert got[9].text is None and got[10].text == "" and got[None].text == "" and {got[1][c] for c in df.columns[2:]} == {"clash"}
    assert line_templates.drop_templates(df.where("false")).count() == 0


def test_few_documents_make_no_template(spark):
    rows = [(1, "same line of some words\nsame line of some words\nsame line of some words"), (2, "same line of some words"), (2, "same line of some words")]
    assert {r.text for r in line_templates.drop_templates(docs(spark, rows)).collect()} == {r[1] for r in rows}


def test_templates_against_loops(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c1"]) for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    got = {r.doc_id: r.lines for r in line_templates.drop_templates(docs(spark, rows), report="lines").collect()}
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in line.split())
    lines = [(d, k, mask(x)) for d, t in rows for k, x in enumerate(t.split("\n")) if len(x.split()) >= 4]
    leaf = lambda m: (len(m), m[:3])
    support = collections.defaultdict(collections.Counter)
    for m, d in {(m, d) for d, _, m in lines}:
        for p, w in enumerate(m):
            support[leaf(m)][p, w] += 1
    template = {m: (leaf(m), tuple(w if w != "<*>" and support[leaf(m)][p, w] >= 3 else "*" for p, w in enumerate(m))) for _, _, m in lines}
    known = {m: t for m, t in template.items() if sum(w != "*" for w in t[1]) >= 0.5 * len(m)}
    where = collections.defaultdict(set)
    for d, _, m in lines:
        if m in known:
            where[known[m]].add(d)
    want = collections.defaultdict(list)
    for d, k, m in lines:
        if m in known and len(where[known[m]]) >= 3 and d != min(where[known[m]]):
            want[d].append(k)
    assert got == {d: sorted(want[d]) for d, _ in rows} and any(want.values())


@pytest.mark.parametrize("n", [100, 10_000])
def test_templates_with_common_values_in_fields_go(spark, n):
    """Values that recur in many documents are fields beside tokens that all lines have, and a
    rarer template of the same leaf is found, too."""
    rng = random.Random(3)
    name = lambda c: c + "".join(rng.choice("aeiou") for _ in range(6))
    names, towns = [name("n") for _ in range(200)], [name("t") for _ in range(200)]
    rows = [(i, f"This page was posted by {rng.choice(names)} from {rng.choice(towns)} on our forum") for i in range(n)]
    rows += [(n + i, f"This page was last edited some {name('d')} ago with great care") for i in range(5)]
    got = {r.doc_id: r.lines for r in line_templates.drop_templates(docs(spark, rows), report="lines").collect()}
    assert [d for d in sorted(got) if not got[d]] == [0, n]


def test_a_token_counts_once_a_document(spark):
    rows = [(1, "a b c foo x\na b c foo z\na b c foo u"), (2, "a b c bar k"), (3, "a b c baz d")]
    assert {r.doc_id: r.lines for r in line_templates.drop_templates(docs(spark, rows), report="lines").collect()} == {1: [], 2: [0], 3: [0]}


# 8 embeddings, components


@pytest.mark.parametrize("part", [20, 500_000])
def test_components_against_loops(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(5)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(None, 1), (7, 7)] + [(500, k) for k in range(501, 600)] + [(700 + k, 701 + k) for k in range(40)]
    root = {x: x for ab in links for x in ab if x is not None}
    for _ in range(400):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root[x] for a, b in links if a is not None and a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 33)) * np.exp(rng.normal(size=(60, 1)) * 5)
    q, scale, error, norm = embedding_pairs.quantise(x)
    reach = embedding_pairs.product_bound(scale, error, q)
    close = scale[:, None] * scale * (q.astype(float) @ q.T.astype(float))
    cos = (x @ x.T) / (norm[:, None] * norm)
    assert (np.abs(cos - close) <= reach[:, None] * error + error[:, None] * (reach + error) + 1e-12).all()


@pytest.mark.parametrize("tile", [7, 1024])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        base = rng.normal(size=8) if i % 3 == 0 or not rows else np.array(rows[-1][1]) + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])
        rows.append((i, [float(np.float32(v)) for v in base], int(i % 2 + (i > 60))))
    rows += [(100 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [], 1), (204, rows[0][1], None), (205, [None] * 8, 1), (206, [float("inf")] * 8, 1), (207, rows[0][1][:4], rows[0][2]), (3, rows[3][1], rows[3][2]), (5, rows[8][1], rows[8][2]), (5, rows[2][1], rows[2][2]), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = collections.Counter(map(tuple, embedding_pairs.near_vectors(df, tile=tile).collect()))
    n, fine = len(rows), [r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None for r in rows]
    link = lambda i, j: i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= 0.98
    links = [[j for j in range(n) if link(i, j)] for i in range(n)]
    big = 1 << 60
    root = [big if r[0] is None else r[0] for r in rows]
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    assert got == collections.Counter((rows[i][0], len(links[i]), root[i], None if rows[i][0] is None else rows[i][0] == root[i]) for i in range(n))
    assert embedding_pairs.near_vectors(df.where("false")).count() == 0


# 10 Jaccard


def sets_of(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def check_groups(spark, rows, **kw):
    sets = [sets_of(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and None not in (rows[i][0], rows[j][0])]
    for _ in range(len(rows)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = collections.Counter(map(tuple, jaccard.near_groups(docs(spark, rows, more=True), **kw).collect()))
    assert got == collections.Counter((d, len(s), root.get(d)) for (d, _), s in zip(rows, sets, strict=True))
    return len(links)


def test_jaccard_groups_and_edge_cases(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 90))]
        if rng.random() < 0.4:
            base += shared
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["A b", "a B", "a\tb", *ODD, ODD[5], ODD[7]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    assert check_groups(spark, [*zip(ids, rows, strict=True), (None, rows[0]), (ids[0], rows[0])], buckets=3) > 30
    check_groups(spark, [(1, None)])
    assert jaccard.near_groups(docs(spark, rows).where("false")).count() == 0


def test_jaccard_measures_alike_in_any_number_of_buckets(spark):
    """Repeated, null and empty texts, and shingles of one, two and all sets of a block."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join([passage, *(f"w{i // 2}x{k}" for k in range(i % 7))])) for i in range(40)] + [(i, f"only {i} has these six words") for i in range(40, 60)] + [(0, passage), (60, None), (61, ""), (None, passage)]
    sets = [sets_of(t) for _, t in rows]
    owners = collections.defaultdict(set)
    for s in sets:
        for x in s:
            owners[x].add(frozenset(s))
    want = collections.Counter((d, len(s), sum(len(owners[x]) > 1 for x in s)) for (d, _), s in zip(rows, sets, strict=True))
    for parts in (1, 5):
        for buckets in (1, 300):
            got = jaccard.measured(docs(spark, rows).repartition(parts), 5, buckets).select("doc_id", "n", "shared").collect()
            assert collections.Counter(map(tuple, got)) == want


def test_jaccard_chains_and_lists_of_several_parts(spark):
    """Sets that drift: neighbours link, ends do not; and texts that share most of a long
    passage without being similar."""
    rng = random.Random(13)
    w = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(w[i * 4 : i * 4 + 60])) for i in range(20)]
    passage = [f"p{i}" for i in range(80)]
    rows += [(200 + i, " ".join(passage[: 50 + i] + [f"q{i}x{k}" for k in range(rng.randint(0, 20))])) for i in range(30)]
    assert check_groups(spark, rows, buckets=2) > 10


def test_jaccard_join_gives_every_link(spark):
    """Groups of near copies, whose links are more than what connects them."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(300)]
        for i in range(12):
            copy = list(base)
            for _ in range(i % 4):
                copy[rng.randrange(300)] = f"x{rng.random()}"
            rows.append((len(rows) * 7 % 67, " ".join(copy)))  # some ids have texts of two groups
    first = {}
    for d, t in sorted(rows):
        first.setdefault(frozenset(sets_of(t)), d)
    nodes = [(d, s) for s, d in first.items()]
    want = {}
    for a, s in nodes:
        for b, t in nodes:
            if a < b and 100 * len(s & t) >= 75 * len(s | t):
                want[a, b] = max(want.get((a, b), 0), len(s & t))
    _, _, links = jaccard.join(docs(spark, rows), buckets=3)
    assert sorted(map(tuple, links.collect())) == sorted((*ab, n) for ab, n in want.items()) and len(want) > 3 * len(nodes)
    assert jaccard.join(docs(spark, rows), buckets=3, connecting=True)[2].count() < len(want)


def test_words_and_windows():
    buf, off = common.string_buffers(pa.chunked_array([pa.array(ODD[:4] + texts(50), pa.string()), pa.array(["A b"], pa.string())]))
    w = words.Words(buf, off, lower=True)
    flat = [x.lower() if x.isascii() else None for t in [*ODD[:4], *texts(50), "A b"] for x in WORD.findall(t or "")]
    by = collections.defaultdict(set)
    for x, h in zip(flat, w.hashes(), strict=True):
        if x:
            by[x].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_all_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES if k != "quality_counts"} == set(range(1, 14))
    assert set(queries.ORACLES) < set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        duck.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list) else v.asDict() if hasattr(v, "asDict") else v
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    assert got == sorted(str(list(r)) for r in want.fetchall())


@pytest.mark.parametrize(("kind", "labels"), [("string", ["a", "b", None, "1"]), ("long", [3_000_000_000, 1, None, -5]), ("double", [0.5, -0.0, None, 0.0]), ("decimal(20,3)", None)])
def test_labels_of_any_kind_group_vectors(spark, kind, labels):
    from decimal import Decimal

    labels = labels or [Decimal("1.5"), Decimal("99999999999999.001"), None, Decimal("0")]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        v = rng.normal(size=4) if i % 3 else np.ones(4) + rng.normal(size=4) * 0.01
        rows.append((i, [float(x) for x in v], labels[i % 4]))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_pairs.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}"), tile=8).collect()}
    numbers = {x: k for k, x in enumerate(dict.fromkeys(x for x in labels if x is not None))}
    same = {r.vec_id: (r.n_links, r.component_id) for r in embedding_pairs.near_vectors(spark.createDataFrame([(i, v, numbers.get(x)) for i, v, x in rows], "vec_id long, embedding array<double>, label int"), tile=8).collect()}
    assert got == same and any(n for n, _ in got.values())
