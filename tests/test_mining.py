"""Transcripts to incidents, on transcripts written here."""

import json

import pytest

from tallyrook import api
from tallyrook.config import MineConfig
from tallyrook.operators import detectors as D
from tallyrook.operators import normalize as N
from tallyrook.sources import sinks
from tallyrook.sources.transcripts import read_transcripts
from tallyrook.streaming.stream import follow

G = "/g/CLAUDE.md"


def rec(session, i, kind, content, tur=None, **more):
    r = {"type": kind, "sessionId": session, "uuid": f"{session}-{i:03d}", "timestamp": f"2026-05-01T10:{i:02d}:00Z", "cwd": "/work/app", "message": {"role": kind, "content": content}}
    return r | ({"toolUseResult": tur} if tur is not None else {}) | more


def use(ident, name="Bash", **args):
    return {"type": "tool_use", "id": ident, "name": name, "input": args}


def result(ident, error=None):
    return {"type": "tool_result", "tool_use_id": ident, "content": "x"} | ({} if error is None else {"is_error": error})


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False), "f.jsonl") for r in rows], "value string, filename string")


def mine(spark, rows, **config):
    c = MineConfig(global_artifact=G, **config)
    return {(r.session_id, r.signal_type, r.incident_id): r for r in D.detect(N.tables(N.records(lines(spark, rows), c), c), c).collect()}


def keys(found, rows=None):
    return sorted((s, k) for s, k, _ in found)


ERRORS = [
    rec("e1", 1, "assistant", [use("a", command="make")]), rec("e1", 2, "user", [result("a", True)]),
    rec("e1", 3, "assistant", [use("b", command="make")]), rec("e1", 4, "user", [result("b", True)]),
]
RETRIES = [
    rec("r1", 1, "assistant", [use("a", command="ls")]), rec("r1", 2, "user", [result("a")]), rec("r1", 3, "assistant", [use("b", command="ls")]), rec("r1", 4, "user", [result("b", False)]),
    rec("r2", 1, "assistant", [use("a", command="ls")]), rec("r2", 2, "user", [result("a", True)]), rec("r2", 3, "assistant", [use("b", command="ls")]), rec("r2", 4, "user", [result("b", True)]),
]
CORRECTIONS = [
    rec("c1", 1, "assistant", [use("a")]), rec("c1", 2, "user", "No, that's wrong"), rec("c1", 3, "assistant", [use("b")]), rec("c1", 4, "user", [{"type": "text", "text": "[Request interrupted by user]"}]),
    rec("c2", 1, "assistant", [use("a")]), rec("c2", 2, "user", "thanks, nothing else is abnormal"),
]


def test_errors_and_retries_have_the_known_ids(spark):
    found = mine(spark, ERRORS)
    assert {(k, i) for _, k, i in found} == {("tool_error", "9ee3d0ca3f0dddb270aa8be6b13dbf64"), ("tool_error", "84c68ad95ff5243a78417fd8a347514c"), ("retry", "eabf0a859bb7ef5517c151f6fb975256")}
    assert [w.turn for w in found["e1", "tool_error", "9ee3d0ca3f0dddb270aa8be6b13dbf64"].window] == [1, 2, 3, 4]
    one = next(iter(found.values()))
    assert one.candidates == [G, "/work/app/CLAUDE.md"] and one.implicated_artifact == "/work/app/CLAUDE.md"


def test_a_successful_rerun_is_no_retry(spark):
    assert keys(mine(spark, RETRIES)) == [("r2", "retry"), ("r2", "tool_error"), ("r2", "tool_error")]


def test_retry_needs_equal_text_of_the_input_within_the_window(spark):
    far = [rec("s", 1, "assistant", [use("a", x=1, y=2)]), rec("s", 2, "user", [result("a", True)]), *(rec("s", i, "user", "hm") for i in range(3, 7)), rec("s", 7, "assistant", [use("b", x=1, y=2)])]
    assert ("s", "retry") not in keys(mine(spark, far))
    assert ("s", "retry") in keys(mine(spark, far, retry_window_turns=6))
    turned = [far[0], far[1], rec("s", 3, "assistant", [use("b", y=2, x=1)])]
    assert ("s", "retry") not in keys(mine(spark, turned))


def test_corrections(spark):
    found = mine(spark, CORRECTIONS)
    assert {i for _, _, i in found} == {"c5d3f88ca15b8a28f7a5987f51872f06", "a9a857843be15385cd512fd6ac559077"}


def test_correction_needs_a_recent_call(spark):
    assert mine(spark, [rec("s", 1, "assistant", [use("a")]), rec("s", 2, "user", "ok"), rec("s", 3, "user", "fine"), rec("s", 4, "user", "no")]) == {}


@pytest.mark.parametrize(("n", "tier"), [(299, None), (300, "low"), (500, "medium"), (1200, "high")])
def test_whole_reads_of_large_files(spark, n, tier):
    rows = [rec("viol-1", 1, "assistant", [use("a", "Read", file_path="/x")]), rec("viol-1", 2, "user", [result("a")], {"file": {"totalLines": n}})]
    found = mine(spark, rows)
    assert [r.confidence for r in found.values()] == ([tier] if tier else [])
    if tier:
        assert next(iter(found.values())).incident_id == "7ff3a83a172fa2c8c0fb642a2c39fa97"
        assert json.loads(next(iter(found.values())).detail) == {"tool": "Read", "file_path": "/x", "total_lines": n}
    ranged = [rec("v", 1, "assistant", [use("a", "Read", file_path="/x", offset=1)]), rows[1] | {"sessionId": "v"}]
    assert mine(spark, ranged) == {}


def test_lines_that_are_no_records_fall_out(spark):
    rows = ["", "{not json", "[1]", '"x"', json.dumps({"type": "user"}), *ERRORS]
    assert keys(mine(spark, rows)) == keys(mine(spark, ERRORS))


def test_string_content_may_begin_with_a_bracket(spark):
    rows = [rec("s", 1, "assistant", [use("a")]), rec("s", 2, "user", '[{"type": "text", "text": "stop"}]')]
    c = MineConfig(global_artifact=G)
    got = N.user_text(N.records(lines(spark, rows), c)).collect()
    assert [r.text for r in got] == ['[{"type": "text", "text": "stop"}]']


def test_text_blocks_join_in_order_without_nulls(spark):
    rows = [rec("s", 1, "user", [{"type": "text", "text": "b"}, {"type": "image"}, {"type": "text"}, {"type": "text", "text": "a"}]), rec("s", 2, "user", [{"type": "text"}])]
    got = {r.turn: r.text for r in N.user_text(N.records(lines(spark, rows), MineConfig())).collect()}
    assert got == {1: "b a", 2: None}


def test_missing_times_come_last_and_missing_folders_mean_the_global_file(spark):
    late = rec("s", 9, "user", "x")
    late["timestamp"] = None
    rows = [late, rec("s", 1, "user", "y")]
    for r in rows:
        r["cwd"] = None
    c = MineConfig(global_artifact=G)
    t = N.records(lines(spark, rows), c)
    assert [(r.turn, r.ts) for r in t.orderBy("turn").collect()] == [(1, "2026-05-01T10:01:00Z"), (2, None)]
    assert N.session_meta(t, c).first().candidates == [G, G]


def test_since_keeps_numbers_unless_compatible(spark):
    since = "2026-05-01T10:03:00Z"
    assert {i for *_, i in mine(spark, ERRORS, since=since)} < {i for *_, i in mine(spark, ERRORS)}
    other = mine(spark, ERRORS, since=since, compat_since=True)
    assert not {i for *_, i in other} & {"84c68ad95ff5243a78417fd8a347514c"}


def test_several_errors_in_a_turn_are_one_incident(spark):
    rows = [rec("s", 1, "assistant", [use("b", "X"), use("a", "Y")]), rec("s", 2, "user", [result("b", True), result("a", True)])]
    found = mine(spark, rows)
    assert len(found) == 1 and [w.turn for w in next(iter(found.values())).window] == [1, 2]


def test_signals_are_chosen_by_name(spark):
    both = ERRORS + CORRECTIONS
    assert {k for _, k, _ in mine(spark, both, signals=("user_correction", ""))} == {"user_correction"}
    with pytest.raises(ValueError, match="nosuch"):
        mine(spark, both, signals=("nosuch",))


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_extract_is_idempotent_and_stamps_the_marker(spark, tmp_path):
    write(tmp_path / "in/p/a.jsonl", ERRORS)
    write(tmp_path / "in/p/deep/b.jsonl", CORRECTIONS)
    out, glob = str(tmp_path / "inc"), f"{tmp_path}/in/**/*.jsonl"
    c = MineConfig(global_artifact=G)
    assert api.extract(spark, glob, out, c, since="") == 5
    assert api.extract(spark, glob, out, c, since="") == 0
    table = sinks.read_incidents(spark, out)
    assert {r.signal_type: r.n for r in api.summary(table).collect()} == {"retry": 1, "tool_error": 2, "user_correction": 2}
    assert sinks.read_marker(spark, f"{out}.last-run").endswith("Z")
    assert api.extract(spark, glob, out, c) == 0
    assert read_transcripts(spark, f"{tmp_path}/in/p/*.jsonl").count() == 4


def test_the_stream_adds_what_is_new(spark, tmp_path):
    write(tmp_path / "in/a.jsonl", ERRORS[:2])
    args = (spark, str(tmp_path / "in"), str(tmp_path / "inc"), str(tmp_path / "cp"), MineConfig(global_artifact=G))
    follow(*args).awaitTermination(120)
    assert sinks.read_incidents(spark, args[2]).count() == 1
    write(tmp_path / "in/b.jsonl", ERRORS[2:])
    follow(*args).awaitTermination(120)
    assert sinks.read_incidents(spark, args[2]).count() == 3
