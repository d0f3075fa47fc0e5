"""Least-cost repair of the turns of conversations.

A conversation is right when its roles' initials are `(s?(ua)+)?`. Edits are K (keep), R (set the
role to user or assistant), D (delete) and I (insert an empty turn). Rows that are blank or were
there before are deleted. Of all cheapest repairs the one with the least audit, the string of its
edits' initials, counts.

1. States. Nothing yet, after system, after user, after assistant. A row is read by one macro
   edit: up to two inserts and the row's own edit. The nine macros' codes (D, ID, IID, IIK, IIR,
   IK, IR, K, R) are prefix-free, so that audits of as many rows compare as their macros do.
2. Ranks. A layer holds, for each state, the least cost and the rank of its audit among the
   layer's four: no audit strings are kept. A state's best step is the least by cost, then rank
   before, then macro; parent pointers give the audit afterwards. Costs are kept less the
   layer's least, and states that can't win any more go, so that few layers exist: a step is
   looked up in a table that fills as it goes.
3. Segments. Rows are dealt by ranges of conversation and turn, and each task cuts what it has of
   a conversation into segments of bounded size. A conversation within one segment is repaired at
   once. A segment of a longer one is summed up as costs and ranks from each state to each;
   these compose like steps, first within a task's part of a conversation, then over its parts,
   of which there are no more than tasks. That tells the states at each segment's ends, and each
   is reconstructed on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, written

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state that an insert or a new role leads to; inserts that a state needs at the end.
FILL, TAIL = (USER, USER, ASSISTANT, USER), (0, 2, 1, 0)
ROLE = {USER: "user", ASSISTANT: "assistant"}
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
LEGAL = {"su", "ua", "au"}
BLANK = " \t\n\v\f\r"
KEEP, BLANKS, DUPLICATE, TRUNCATED = range(4)

#: Rows, and characters of text, of a segment; one row may be longer.
ROWS, CHARACTERS = 1024, 1 << 21

Layer = tuple[tuple[int | None, ...], tuple[int | None, ...]]


def _first(state: int) -> Layer:
    return tuple(0 if x == state else None for x in STATES), tuple(0 if x == state else None for x in STATES)


def _layer(best: list[tuple | None]) -> tuple[int, Layer, tuple]:
    """(least cost, the layer less that, parents) of each state's (cost, rank, step, from).
    From after an assistant, what system rows begin can be had by deleting one (3), and what
    follows a system row at no more cost: dearer states go."""
    if best[ASSISTANT] is not None:
        for x, more in ((START, 3), (SYSTEM, 0)):
            if best[x] is not None and best[x][0] > best[ASSISTANT][0] + more:
                best[x] = None
    low = min(b[0] for b in best if b)
    order = sorted((b[1], b[2], y) for y, b in enumerate(best) if b)
    rank = {y: i for i, (_, _, y) in enumerate(order)}
    return low, (tuple(b and b[0] - low for b in best), tuple(rank.get(y) for y in STATES)), tuple(b and (b[3], b[2]) for b in best)


@lru_cache(maxsize=None)
def _moves(initial: str, fault: int) -> tuple:
    """From each state: (macro, state, cost) of all macros that may read such a row."""
    late, found = int(fault == TRUNCATED), []
    for x in STATES:
        here, at = [], x
        for inserts in range(3):
            code = lambda edit, n=inserts: CODES.index("I" * n + edit)
            here.append((code("D"), at, 2 * inserts + 3))
            if fault in (KEEP, TRUNCATED):
                here.append((code("R"), FILL[at], 2 * inserts + 2 + late))
                if (at, initial) in NEXT:
                    here.append((code("K"), NEXT[at, initial], 2 * inserts + late))
            at = FILL[at]
        found.append(tuple(here))
    return tuple(found)


@lru_cache(maxsize=1 << 16)
def _step(layer: Layer, initial: str, fault: int) -> tuple[int, Layer, tuple]:
    costs, ranks = layer
    best: list[tuple | None] = [None] * 4
    for x, moves in enumerate(_moves(initial, fault)):
        if costs[x] is not None:
            for code, y, cost in moves:
                if best[y] is None or (costs[x] + cost, ranks[x], code) < best[y][:3]:
                    best[y] = (costs[x] + cost, ranks[x], code, x)
    return _layer(best)


def _walk(kinds: list[tuple[str, int]], entry: int) -> tuple[int, Layer, list[tuple]]:
    """(cost, last layer, parents of each row) from a state on."""
    total, layer, parents = 0, _first(entry), []
    for initial, fault in kinds:
        low, layer, parent = _step(layer, initial, fault)
        total += low
        parents.append(parent)
    return total, layer, parents


def _back(parents: list[tuple], state: int) -> list[tuple[int, int]]:
    """(state before, step) of each row, for the walk that ends in a state."""
    found = []
    for parent in reversed(parents):
        state, step = parent[state]
        found.append((state, step))
    return found[::-1]


def _end(layer: Layer) -> int:
    """The state at which the cheapest repair, and of these the least, ends."""
    costs, ranks = layer
    return min((c + 2 * TAIL[x], ranks[x], x) for x, c in enumerate(costs) if c is not None)[2]


Through = list[list[tuple[int, int] | None]]


def _through(kinds: list[tuple[str, int]]) -> Through:
    """From each state to each: (cost, rank among those from the same state)."""
    walks = [_walk(kinds, x) for x in STATES]
    return [[None if c is None else (total + c, r) for c, r in zip(*layer, strict=True)] for total, layer, _ in walks]


def _compose(parts: list[Through], entry: int) -> tuple[int, Layer, list[tuple]]:
    """As _walk, over summed-up segments instead of rows."""
    total, layer, parents = 0, _first(entry), []
    for part in parts:
        best: list[tuple | None] = [None] * 4
        for x, (cost, rank) in enumerate(zip(*layer, strict=True)):
            for y, found in enumerate(part[x]) if cost is not None else ():
                if found and (best[y] is None or (cost + found[0], rank, found[1]) < best[y][:3]):
                    best[y] = (cost + found[0], rank, found[1], x)
        low, layer, parent = _layer(best)
        total += low
        parents.append(parent)
    return total, layer, parents


def _flat(through: Through) -> list[int]:
    return [v for row in through for found in row for v in (found or (-1, -1))]


def _unflat(values) -> Through:
    v = [int(x) for x in values]
    return [[None if v[8 * x + 2 * y] < 0 else (v[8 * x + 2 * y], v[8 * x + 2 * y + 1]) for y in STATES] for x in STATES]


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _faults(roles: list[str], texts: list[str], seen: list[bytes] | None) -> list[int]:
    """Each row's first fault. seen: digests of rows of earlier segments."""
    found, before, known = [], set(), frozenset(seen or ())
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(BLANK)
        if not end:
            found.append(BLANKS)
        elif (role, text) in before or known and _digest(role, text) in known:
            found.append(DUPLICATE)
        else:
            before.add((role, text))
            found.append(KEEP if end[-1] in ".!?" else TRUNCATED)
    return found


def _edits(turns: list, roles: list[str], texts: list[str], faults: list[int], entry: int, leave: int | None, last: bool) -> tuple[int, str, list[tuple]]:
    """(cost, audit, rows (edit, turn, role, text)) of a segment between two states; `leave` is
    None where the conversation ends with the segment."""
    total, layer, parents = _walk([(r[:1], f) for r, f in zip(roles, faults, strict=True)], entry)
    state = _end(layer) if leave is None else leave
    tail = TAIL[state] if last else 0
    rows: list[tuple] = []
    audit = []

    def insert(at: int) -> int:
        rows.append(("I", None, ROLE[FILL[at]], ""))
        return FILL[at]

    for i, (at, code) in enumerate(_back(parents, state)):
        audit.append(CODES[code])
        for _ in CODES[code][:-1]:
            at = insert(at)
        edit = CODES[code][-1]
        rows.append((edit, turns[i], ROLE[FILL[at]] if edit == "R" else roles[i], texts[i]))
    at = state
    for _ in range(tail):
        at = insert(at)
    return total + layer[0][state] + 2 * tail, "".join(audit) + "I" * tail, rows


def segments(convs: DataFrame, size: int = ROWS) -> DataFrame:
    """(conv_id, sid, piece, whole, turns, roles, texts): the rows of each conversation in order,
    in segments of at most `size` rows, written to the shared folder. sid rises with the order; piece is
    the first sid of a task's part of a conversation; `whole` tells that there is no other."""
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # equal rows are any number, and may be dealt out to any number of tasks
    order = ["conv_id", "turn", "role_text", "any"]
    rows = rows.withColumn("role_text", F.xxhash64("role", "text")).withColumn("any", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    fields = [T.StructField("sid", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType()))]
    schema = T.StructType([rows.schema["conv_id"], *fields])
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid = (TaskContext.get().partitionId() << 40) - 1
        key, now, done, room, kind = None, None, [], 0, None

        def close(other: bool) -> None:
            """other: it is known that another conversation follows."""
            nonlocal sid
            sid += 1
            now["piece"] = sid if now["piece"] is None else now["piece"]
            done.append((key, sid, now["piece"], now["alone"] and other, now["turns"], now["roles"], now["texts"]))

        def rows_of() -> pa.RecordBatch:
            out = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), [kind, *kinds], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for b in batches:
            kind = b.schema.types[0]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != key:
                    first = now is None
                    if now is not None:
                        close(True)
                    key, room, now = conv, 0, {"piece": None, "alone": not first, "turns": [], "roles": [], "texts": []}
                elif len(now["turns"]) >= size or room + len(text) > CHARACTERS:
                    now["alone"] = False
                    close(False)
                    room, now = 0, {"piece": now["piece"], "alone": False, "turns": [], "roles": [], "texts": []}
                now["turns"].append(turn)
                now["roles"].append(role)
                now["texts"].append(text)
                room += len(text)
                if len(done) >= 512 or room > CHARACTERS and done:
                    yield rows_of()
        if now is not None:
            close(False)  # the next task may go on with it
        if done:
            yield rows_of()

    return written(rows.mapInArrow(lean(cut), schema), "turn-segments")


def _mapped(df: DataFrame, schema: str | T.StructType, each: Callable[[dict], tuple]) -> DataFrame:
    """A row of `schema` for each row."""
    schema = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = [each(r) for r in b.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names=kinds.names)

    return df.mapInArrow(lean(run), schema)


def _long(parts: DataFrame) -> DataFrame:
    """Segments of conversations that may go on elsewhere, with `seen`, what earlier segments
    have, and the states at their ends: entry, leave, and last (whether the conversation ends)."""
    key = parts.schema["conv_id"]
    first = T.StructType([key, T.StructField("sid", T.LongType()), T.StructField("digests", T.ArrayType(T.BinaryType()))])
    own = _mapped(parts, first, lambda r: (r["conv_id"], r["sid"], list({_digest(a, t) for a, t in zip(r["roles"], r["texts"], strict=True) if t.strip(BLANK)})))
    own = own.select("conv_id", "sid", F.explode("digests").alias("digest"))
    # of each row that several segments have, the first one; a segment has it once
    several = own.groupBy("conv_id", "digest").agg(F.min("sid").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    later = own.join(several, own["conv_id"].eqNullSafe(F.col("c")) & (own["digest"] == F.col("d"))).where("sid > first")
    parts = written(parts.join(later.groupBy("sid").agg(F.collect_list("digest").alias("seen")), "sid", "left"), "turn-parts")

    def summed(r: dict) -> tuple:
        return r["conv_id"], r["sid"], r["piece"], _flat(_through([(a[:1], f) for a, f in zip(r["roles"], _faults(r["roles"], r["texts"], r["seen"]), strict=True)]))

    sums = T.StructType([key, T.StructField("sid", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("through", T.ArrayType(T.IntegerType()))])
    sums = written(_mapped(parts, sums, summed), "turn-sums")

    def piece(group: pd.DataFrame) -> pd.DataFrame:
        mats = [_unflat(v) for v in group.sort_values("sid")["through"]]
        walks = [_compose(mats, x) for x in STATES]
        whole = [[None if c is None else (total + c, r) for c, r in zip(*layer, strict=True)] for total, layer, _ in walks]
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "piece": group["piece"].iloc[:1], "through": [_flat(whole)]})

    pieces = sums.groupBy("piece").applyInPandas(piece, T.StructType([key, sums.schema["piece"], sums.schema["through"]]))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        """The states at the ends of each part of a conversation."""
        group = group.sort_values("piece")
        _, layer, parents = _compose([_unflat(v) for v in group["through"]], START)
        end = _end(layer)
        entries = [x for x, _ in _back(parents, end)]
        return pd.DataFrame({"piece": group["piece"], "entry": entries, "leave": [*entries[1:], end], "last": [False] * (len(entries) - 1) + [True]})

    ends = "piece long, entry int, leave int, last boolean"
    at = pieces.groupBy("conv_id").applyInPandas(chain, ends)

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sid")
        _, _, parents = _compose([_unflat(v) for v in group["through"]], int(group["entry"].iloc[0]))
        leave = int(group["leave"].iloc[0])
        entries = [x for x, _ in _back(parents, leave)]
        last = [False] * (len(entries) - 1) + [bool(group["last"].iloc[0])]
        return pd.DataFrame({"sid": group["sid"], "entry": entries, "leave": [*entries[1:], leave], "last": last})

    states = sums.join(at, "piece").groupBy("piece").applyInPandas(inside, ends.replace("piece", "sid"))
    return parts.join(states, "sid")


EDIT = "array<struct<edit: string, turn: bigint, role: string, text: string>>"


def repair(convs: DataFrame, size: int = ROWS) -> DataFrame:
    """convs (conv_id, turn, role, text) as segments: (conv_id, sid, audit, edits), whose edits are
    the rows in order with K, R, D or I; without those marked D they are the repaired turns. The
    segments of a conversation come by sid.

    Null roles and texts are one space. Rows come by turn, nulls first; rows of one turn by a
    64-bit hash of role and text. Repeated rows are duplicates. Rows without a conv_id are one
    conversation. A role that is empty can't be kept. Other columns are not read; an empty table
    gives no segments.
    """
    parts = segments(convs, size)
    schema = parts.sparkSession.createDataFrame([], f"sid bigint, audit string, edits {EDIT}").schema
    schema = T.StructType([parts.schema["conv_id"], *schema.fields])

    def edited(r: dict) -> tuple:
        whole = r["whole"]
        _, audit, rows = _edits(r["turns"], r["roles"], r["texts"], _faults(r["roles"], r["texts"], None if whole else r["seen"]), START if whole else r["entry"], None if whole else r["leave"], whole or r["last"])
        return r["conv_id"], r["sid"], audit, [dict(zip(("edit", "turn", "role", "text"), e, strict=True)) for e in rows]

    return _mapped(parts.where("whole"), schema, edited).unionByName(_mapped(_long(parts.where("not whole")), schema, edited))


def _told(r: dict, entry: int, leave: int | None, last: bool, seen) -> dict:
    """What a segment adds to its conversation's report."""
    faults = _faults(r["roles"], r["texts"], seen)
    cost, audit, rows = _edits(r["turns"], r["roles"], r["texts"], faults, entry, leave, last)
    initials = [a[:1] for a in r["roles"]]
    turns = [t for t in r["turns"] if t is not None]
    return {
        "blank": faults.count(BLANKS), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": sum(a + b not in LEGAL for a, b in pairwise(initials)),
        "cost": cost, "audit": audit, "ends": [initials[0], initials[-1]], "turns": [turns[0], turns[-1], len(set(turns))] if turns else None, "lines": [f"{role}:{text}" for edit, _, role, text in rows if edit != "D"],
    }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(convs: DataFrame, size: int = ROWS) -> DataFrame:
    """A row for each conversation that has rows: (conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256); see repair for what is defined. An audit and a
    digest are one value for a conversation, so the segments of a long one are read in their
    order by one task, which holds one segment and the audit."""
    parts = segments(convs, size)
    fields = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    schema = T.StructType([parts.schema["conv_id"], *fields])

    def once(r: dict) -> tuple:
        t = _told(r, START, None, True, None)
        gaps = t["turns"][1] - t["turns"][0] + 1 - t["turns"][2] if t["turns"] else 0
        return r["conv_id"], gaps, *(t[c] for c in COUNTS[1:]), t["audit"], hashlib.sha256("\n".join(t["lines"]).encode()).hexdigest()

    told = "sid bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, ends array<string>, turns array<bigint>, lines array<string>"
    told = T.StructType([parts.schema["conv_id"], *parts.sparkSession.createDataFrame([], told).schema.fields])

    def each(r: dict) -> tuple:
        t = _told(r, r["entry"], r["leave"], r["last"], r["seen"])
        return r["conv_id"], r["sid"], *(t[c] for c in told.names[2:])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, kind = None, None, None

        def row() -> pa.RecordBatch:
            n = now["n"]
            n["gaps"] = now["high"] - now["low"] + 1 - now["distinct"] if now["low"] is not None else 0
            values = [key, *(n[c] for c in COUNTS), "".join(now["audit"]), now["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=schema.names)

        for b in batches:
            kind = b.schema.types[0]
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or r["conv_id"] != key:
                    if now is not None:
                        yield row()
                    key, now = r["conv_id"], {"n": dict.fromkeys(COUNTS, 0), "audit": [], "sha": hashlib.sha256(), "any": False, "end": None, "low": None, "high": None, "distinct": 0}
                for c in COUNTS[1:]:
                    now["n"][c] += r[c]
                if now["end"] is not None:
                    now["n"]["illegal"] += now["end"] + r["ends"][0] not in LEGAL
                now["end"] = r["ends"][1]
                if r["turns"]:
                    first, last, distinct = r["turns"]
                    now["distinct"] += distinct - (now["high"] == first)
                    now["low"], now["high"] = first if now["low"] is None else now["low"], last
                now["audit"].append(r["audit"])
                for line in r["lines"]:
                    now["sha"].update(("\n" + line if now["any"] else line).encode())
                    now["any"] = True
        if now is not None:
            yield row()

    long = _mapped(_long(parts.where("not whole")), told, each).repartition("conv_id").sortWithinPartitions("conv_id", "sid")
    return _mapped(parts.where("whole"), schema, once).unionByName(long.mapInArrow(lean(fold), schema))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by a checksum of conv_id and turn: of 20
    parts one is dropped, one emptied, one loses its sentence ends, one comes twice, and one is
    said to be the user's. Nulls are one space."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", told[2].alias("role"), told[3].alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def report_damaged(convs: DataFrame, size: int = ROWS) -> DataFrame:
    """report() of damaged conversations, with a row for each conv_id that was there."""
    found = report(damaged(convs), size)
    ids = convs.select(F.col("conv_id").alias("__id")).distinct()
    empty = {**dict.fromkeys(COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    joined = ids.join(found, ids["__id"].eqNullSafe(found["conv_id"]), "left")
    return joined.select(F.col("__id").alias("conv_id"), *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in empty.items()))
