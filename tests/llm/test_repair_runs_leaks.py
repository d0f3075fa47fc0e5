"""Turn repair, periodic runs and decontamination against brute force, and their edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import decontaminate, periodic, turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMPTY = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 turn repair


def cheapest(rows, faults):
    """(cost, audit, repaired rows) by trying single edits from the cheapest and least on."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        state = "" if not shape else shape[-1]
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        new = {"u": "user", "a": "assistant"}
        for c in set(following) & set("ua"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*out, (new[c], ""))))
        if i == len(rows):
            continue
        (role, text), fault = rows[i], faults[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, shape, out))
        if fault in (None, "truncated"):
            late = fault == "truncated"
            for c in set(following) & set("ua"):
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, c, (*out, (new[c], text))))
            if role[:1] and role[:1] in following:
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*out, (role, text))))
    raise AssertionError


def judged(rows):
    """What report() tells of the rows (turn, role, text) of a conversation, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = cheapest([r[1:] for r in rows], faults)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def talk(rng, convs, most):
    rows = []
    for c in range(convs):
        turns = [t + 2 * (t > 5) for t in range(rng.randint(1, most))]
        if rng.random() < 0.3:
            turns[0] = None
        for t in turns:
            role = rng.choice(["user", "assistant", "system", "tool", "", "u", "Sys", None]) if rng.random() < 0.4 else ("user", "assistant")[(t or 0) % 2]
            text = rng.choice(["Yes.", "No", "Well!", "", " \n", "Then a\tb? ", "é。", None, "Yes.", f"{t}."])
            rows.append((c, t, role, text))
    return rows


def reports(rows, convs):
    got = {}
    for c in convs:
        mine = sorted(((t, r, x) for i, t, r, x in rows if i == c), key=lambda r: (r[0] is not None, r[0] or 0))
        got[c] = judged(mine) if mine else (0, 0, 0, 0, 0, 0, "", EMPTY)
    return got


def told(df):
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}
    assert len(found) == df.count()
    return found


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("convs", "most", "size"), [(120, 9, 1024), (12, 60, 4)])
def test_turns_against_search(spark, apart, convs, most, size):
    rng = random.Random(convs)
    rows = talk(rng, convs, most) + [(500 + c, None, "user", "Only one") for c in range(40)] + [(None, 3, "system", "A."), (None, 4, "assistant", "B.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__id", F.lit(1)).withColumn("sid", F.lit("x")).repartition(5)
    ids = {r[0] for r in rows}
    assert told(turn_repair.report_damaged(df, size)) == reports(broken(rows), ids)


def test_turns_of_one_long_conversation(spark, apart):
    """All tasks have a part of one conversation, with rows that were there in other parts."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", "Other!", f"New {t}.", f"Cut {t}", ""])) for t in range(1500)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert told(turn_repair.report(df, 64)) == reports(rows, {1, 2})
    parts = turn_repair.segments(df, 64)
    assert parts.where("size(turns) > 64").count() == 0 and parts.where("conv_id = 1").select(F.shiftright("sid", 40)).distinct().count() > 1
    kept = turn_repair.repair(df, 64).where("conv_id = 1").orderBy("sid").collect()
    assert "".join(r.audit for r in kept) == reports(rows, {1})[1][6]
    lines = [f"{e.role}:{e.text}" for r in kept for e in r.edits if e.edit != "D"]
    assert sha("\n".join(lines)) == reports(rows, {1})[1][7]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_turns_of_many_equal_rows(spark, apart):
    """Equal rows are dealt out to several tasks; all but the first are deleted."""
    rows = [(1, 5, "user", "Hi.")] * 3000 + [(1, 6, "assistant", "Ho.")]
    got = told(turn_repair.report(spark.createDataFrame(rows, SCHEMA).repartition(4), 100))
    # an insert between the duplicates and the answer costs more than none
    assert got == {1: (0, 0, 2999, 0, 2999, 3 * 2999, "K" + "D" * 2999 + "K", sha("user:Hi.\nassistant:Ho."))}


def test_turns_odd_tables(spark):
    assert turn_repair.report_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    long = [(1, 0, "user", "word " * 400000 + "."), (1, 1, "assistant", "x" * 3000000)]
    assert told(turn_repair.report(spark.createDataFrame(long, SCHEMA))) == reports(long, {1})
    named = spark.createDataFrame([("a", 1, "user", "Q?"), ("a", 2, "assistant", "A.")], "conv_id string, turn int, role string, text string")
    assert told(turn_repair.report(named))["a"][5:7] == (0, "KK")
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert told(turn_repair.report_damaged(spark.createDataFrame([(7, gone, "user", "Q?")], SCHEMA))) == {7: (0, 0, 0, 0, 0, 0, "", EMPTY)}


# 12 periodic runs


def slow_runs(words):
    """All runs, by the definition."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


def looped(doc, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def run_row(words):
    found = slow_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def repeating(rng):
    """A text of several stretches that repeat, of few words, side by side."""
    words = []
    for _ in range(rng.randint(1, 5)):
        part = [rng.choice("abcde") for _ in range(rng.randint(1, 9))]
        words += (part * 40)[: rng.randint(1, 70)] + [rng.choice("abxyz") for _ in range(rng.randint(0, 6))]
    return rng.choice([" ", "\n", "\t "]).join(words)


def test_runs_against_loops(spark):
    rng = random.Random(8)
    texts = [repeating(rng) for _ in range(160)] + [None, "", " \n", "a " * 23, "a " * 24, "a " * 25, "a b " * 12, "a b " * 11 + "a c", "é 語\x85 " * 30, "x" * 5000, "a\x0bb\x0ca\x1cb " * 9]
    rows = list(enumerate(texts)) + [(None, "a " * 30), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("x")).withColumn("runs", F.lit(2)).repartition(3)
    got = periodic.run_digests(df.withColumn("text", periodic.looped())).collect()
    want = [(i, *run_row(looped(i, t) if i is not None else WORD.findall(t))) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[1] > 1 for w in want) > 30
    full = {r.doc_id: r for r in periodic.collapse(df.where("doc_id < 160")).collect()}
    for i, t in enumerate(texts[:160]):
        words, found = WORD.findall(t), slow_runs(WORD.findall(t))
        assert [tuple(r) for r in full[i].runs] == found
        assert sha(full[i].collapsed) == run_row(words)[-1]
    assert periodic.run_digests(df.limit(0)).collect() == []


def test_lag_counts_of_frequent_and_rare_words(monkeypatch):
    rng = np.random.default_rng(4)
    for n, share in ((3000, 0.2), (20000, 0.2), (20000, 0.0), (5000, 1e9), (30, 0.2)):
        ids = np.minimum(rng.geometric(0.03, n), n - 1)
        monkeypatch.setattr(periodic, "HEAVY", share)
        most = n // 3
        got = periodic.lag_counts(ids, most)
        for q in [1, 2, 3, 7, most // 2, most - 1, most]:
            assert got[q] == int((ids[q:] == ids[:-q]).sum())
    monkeypatch.setattr(periodic, "PAIRS", 10)
    ids = rng.integers(0, 9, 400)
    monkeypatch.setattr(periodic, "HEAVY", 1e9)
    assert all(periodic.lag_counts(ids, 133)[q] == int((ids[q:] == ids[:-q]).sum()) for q in range(1, 134))


def test_runs_of_long_texts():
    rng = np.random.default_rng(5)
    part = rng.integers(0, 10**6, 40000)
    ids = np.concatenate([rng.integers(0, 10**6, 5000), np.tile(part, 4)[:150000], rng.integers(0, 50, 20000)])
    assert [r for r in periodic.runs(ids) if r[2] > 100] == [(5000, 150000, 40000)]
    assert periodic.runs(np.zeros(300000, np.int64)) == [(0, 300000, 1)]


# 13 decontamination


def leak_words(text):
    return LEAK_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items, k=10):
    """(doc_id, words, spans, items) by comparing every window."""
    windows = {}
    for item, text in items:
        words = leak_words(text)
        for i in range(max(1, len(words) - k + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = leak_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])] - {None}
        out.append((doc, len(words), sorted(hit), sorted(map(str, found))))
    return out


def leaky(rng, short):
    vocab = ["the", "of", "tion", "Été", "x1", "a", "b", "DON", "語", "u"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(say(rng.randint(10, 40)))) for i in range(30)]
    items += [(30, items[0][1]), (31, items[1][1].upper() + " and more words of it"), (0, items[2][1]), (None, " ".join(say(12))), (32, None), (33, "..."), (34, "")]
    items += [(40, "the of"), (41, "DON 語 a"), (42, "b")] if short else []
    docs = []
    for d in range(150):
        words = say(rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            part = leak_words(rng.choice(items)[1])
            a = rng.randint(0, 5)
            words += part[a : a + rng.randint(5, 30)] + rng.choice([[], ["zz"], say(3)])
        docs.append((d, rng.choice([" ", "-", ". "]).join(words)))
    docs += [(200, None), (201, ""), (202, "!!"), (203, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (204, docs[9][1] * 40), (205, "\x00" + docs[8][1])]
    return docs, items


@pytest.mark.parametrize(("short", "size", "shard"), [(False, 10**6, 4 << 20), (True, 10**6, 300), (True, 150, 2000)])
def test_leaks_against_windows(spark, short, size, shard):
    docs, items = leaky(random.Random(6 + short), short)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("__text", F.lit("y")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("z"))
    want = leaks(docs, items)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], list(r.items)) for r in decontaminate.contaminated_spans(df, bench, size=size, shard=shard).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(bool(w[2]) for w in want) > 30
    counts = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(df, bench, size=size, shard=shard).collect()]
    assert sorted(counts, key=key) == sorted(((d, n, len(h), len(i), sha(",".join(i)), bool(h)) for d, n, h, i in want), key=key)


def test_leaks_are_cut_out(spark):
    docs, items = leaky(random.Random(9), False)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit("x")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.without_spans(df, bench, size=120)
    assert out.columns == df.columns
    want = {(d, t): h for (d, t), (_, _, h, _) in zip(docs, leaks(docs, items), strict=True)}
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple(leak_words(r.text))) for r in out.collect())
    assert got == sorted((d is None, d or 0, tuple(w for i, w in enumerate(leak_words(t)) if i not in set(h))) for d, t in docs for h in [want[d, t]])
    clean = {t for (_, t), h in want.items() if not h}
    assert clean <= {r.text for r in out.collect()}


def test_leaks_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(df, none).collect()] == [(1, 3, 0, 0, EMPTY, False)]
    assert decontaminate.contamination(df.limit(0), none).collect() == []
    bench = spark.createDataFrame([(7, "word " * 12)], "item_id long, text string")
    long = spark.createDataFrame([(1, "word " * 300000), (2, "word " * 9), (3, "x" * 100000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(long, bench).collect()}
    assert got == {1: (300000, 300000, True), 2: (9, 0, False), 3: (1, 0, False)}


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    for top in (1, 3, 40):
        text = np.concatenate([np.r_[rng.integers(1, top + 1, rng.integers(1, 30)), 0] for _ in range(40)])
        zeros = iter(range(-10**6, 0))
        marked = [int(x) if x else next(zeros) for x in text]
        order = decontaminate.sorted_suffixes(text, top)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: marked[i : i + 40])
        tree = decontaminate.Wavelet(text, 6)
        at = rng.integers(0, len(text) + 1, 300)
        value = rng.integers(0, top + 1, 300)
        assert tree.rank(value, at).tolist() == [int((text[:a] == v).sum()) for a, v in zip(at, value, strict=True)]
        inside = rng.integers(0, len(text), 300)
        found, before = tree.access(inside)
        assert found.tolist() == text[inside].tolist() and before.tolist() == [int((text[:a] == text[a]).sum()) for a in inside]
