"""The incident table's commits, mining in batches, and the record store's plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyrook import schemas
from tallyrook.config import MineConfig
from tallyrook.operators import detectors as D
from tallyrook.operators import normalize as N
from tallyrook.sources import sinks, table
from tallyrook.sources.store import stored
from tallyrook.sources.transcripts import read_transcripts
from tallyrook.streaming.stream import follow, mine_batch

CONFIG = MineConfig(global_artifact="/g/CLAUDE.md")


def incident(ident, session, detail="{}"):
    return (ident, session, "/p", "2026-01-01T00:00:00Z", "tool_error", "/p/CLAUDE.md", ["/p/CLAUDE.md"], None, "low", detail)


def rows(spark, *incidents):
    return spark.createDataFrame(list(incidents), schemas.INCIDENT)


def ids(found):
    return sorted((r.incident_id, r.detail) for r in found.collect())


def session_lines(rng, session, turns):
    """A session of calls, failures, repeats, reads of large files and corrections."""
    out = []
    for t in range(turns):
        base = {"sessionId": session, "uuid": f"{session}-{t:03d}", "timestamp": f"2026-05-01T10:{t:02d}:00Z", "cwd": "/work/app"}
        if t % 2 == 0:
            blocks = [{"type": "tool_use", "id": f"{session}{t}{i}", "name": rng.choice(["Bash", "Read"]), "input": {"file_path": rng.choice("ab")}} for i in range(rng.randint(0, 2))]
            out.append(base | {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, *blocks]}})
        else:
            asked = [b["id"] for b in out[-1]["message"]["content"] if b["type"] == "tool_use"]
            blocks = [{"type": "tool_result", "tool_use_id": a, "is_error": rng.random() < 0.5} for a in asked]
            out.append(base | {"type": "user", "message": {"role": "user", "content": [*blocks, {"type": "text", "text": rng.choice(["fine", "No, stop", "go on"])}]}, "toolUseResult": {"file": {"totalLines": rng.choice([10, 400, 2000])}}})
    return out


def whole(spark, lines):
    raw = spark.createDataFrame([(json.dumps(x), "f") for x in lines], "value string, filename string")
    return D.detect(N.tables(N.records(raw, CONFIG), CONFIG), CONFIG)


def content(found):
    return sorted((r.session_id, r.signal_type, r.incident_id, r.detail, [w.turn for w in r.window]) for r in found.collect())


# the table


def test_two_writers_cannot_both_insert(spark, tmp_path, monkeypatch):
    one, two = (sinks.incident_table(spark, f"file://{tmp_path}/t", 4) for _ in range(2))
    fresh = lambda r, there: sinks.new_rows(r, there)
    began = []

    def late(*a, **k):  # the other writer commits between this one's look and its commit
        if not began:
            began.append(two.add(rows(spark, incident("a", "s1"), incident("b", "s2")), fresh))
        return table.LogTable._append(one, *a, **k)

    monkeypatch.setattr(one, "_append", late)
    assert one.add(rows(spark, incident("a", "s1"), incident("c", "s3")), fresh) == 1 and began == [2]
    assert ids(two.read()) == [("a", "{}"), ("b", "{}"), ("c", "{}")]
    assert one.add(rows(spark, incident("a", "s1"), incident("a", "s1")), fresh) == 0
    assert [e.version for e in two.entries()] == [0, 1]


def test_what_a_dead_writer_leaves_is_not_read(spark, tmp_path, monkeypatch):
    t = sinks.incident_table(spark, str(tmp_path / "t"), 4)
    monkeypatch.setattr(t, "_append", lambda entry: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.add(rows(spark, incident("a", "s1")), sinks.new_rows)
    monkeypatch.undo()
    assert list((tmp_path / "t" / "rows").iterdir()) and t.read().count() == 0
    assert sinks.insert_or_ignore(rows(spark, incident("a", "s1")), str(tmp_path / "t")) == 1
    assert t.vacuum(3600) == 0 and t.vacuum(0) == 1 and ids(t.read()) == [("a", "{}")]
    (tmp_path / "t" / "log" / "000000000001.json").write_text("")  # begun, never finished
    monkeypatch.setattr(table, "PATIENCE", 0.3)
    with pytest.raises(TimeoutError, match="000000000001"):
        sinks.incident_table(spark, str(tmp_path / "t")).read()


def test_an_insert_reads_the_parts_of_its_sessions(spark, tmp_path):
    path = str(tmp_path / "t")
    many = rows(spark, *(incident(f"i{i}", f"s{i}") for i in range(60)))
    assert sinks.insert_or_ignore(many, path) == 60
    t = sinks.incident_table(spark, path, 99)  # the log's number counts
    parts = t.parts_of(rows(spark, incident("x", "s7")))
    assert len(parts) == 1
    plan = t.read(parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"part#" in plan.split("PartitionFilters")[1].split("]")[0]
    files = set(t.read().inputFiles())
    folders = {f.split("/part=")[1].split("/")[0] for f in files}
    assert len(folders) > 5
    got = {r.session_id for r in t.read(parts).collect()}
    assert "s7" in got and len(got) < 30


def test_replace_takes_out_and_adds_in_one_commit(spark, tmp_path):
    t = sinks.incident_table(spark, str(tmp_path / "t"), 4)
    sessions = lambda *s: spark.createDataFrame([(x,) for x in s], "session_id string")
    assert t.replace(sessions("s1", "s2"), rows(spark, incident("a", "s1"), incident("b", "s1"), incident("c", "s2"))) == (3, 0)
    assert t.replace(sessions("s1"), rows(spark, incident("a", "s1"), incident("b", "s1", "new"), incident("d", "s1"))) == (2, 1)
    assert ids(t.read()) == [("a", "{}"), ("b", "new"), ("c", "{}"), ("d", "{}")]
    assert t.replace(sessions("s1"), rows(spark)) == (0, 3)
    assert t.replace(sessions("s1"), rows(spark, incident("a", "s1"))) == (1, 0)
    assert ids(t.read()) == [("a", "{}"), ("c", "{}")] and t.version() == 3
    assert t.compact() == 4 and ids(t.read()) == [("a", "{}"), ("c", "{}")] and len(t.entries()) == 1
    assert t.replace(sessions("s1"), rows(spark, incident("a", "s1"))) == (0, 0)
    assert sinks.insert_or_ignore(rows(spark, incident("a", "s1"), incident("e", "s9")), t.path) == 1


def test_marks_stay_after_compaction(spark, tmp_path):
    t = sinks.incident_table(spark, str(tmp_path / "t"), 2)
    assert t.append(rows(spark, incident("a", "s1")), "7") == 1 and t.append(rows(spark, incident("a", "s1")), "7") == 0
    t.compact()
    assert t.append(rows(spark, incident("a", "s1")), "7") == 0 and t.append(rows(spark), "8") == 0 and t.marked("8")
    assert t.read().count() == 1


# mining in batches


def test_batches_with_late_lines_give_what_all_lines_give(spark, tmp_path):
    rng = random.Random(4)
    lines = [x for s in range(6) for x in session_lines(rng, f"s{s}", rng.randint(3, 14))]
    rng.shuffle(lines)  # a session's lines come early and late, and turns are renumbered
    done = []
    for i in range(3):
        part = lines[i * len(lines) // 3 : (i + 1) * len(lines) // 3]
        raw = spark.createDataFrame([(json.dumps(x), "f") for x in part] + [("no json", "f")], "value string, filename string")
        told = mine_batch(raw, str(i), str(tmp_path / "r"), str(tmp_path / "i"), CONFIG, parts=4)
        done += part
        assert told["lines"] == len(part) and told["sessions"] == len({x["sessionId"] for x in part})
        assert content(sinks.read_incidents(spark, str(tmp_path / "i"))) == content(whole(spark, done))
    again = mine_batch(raw, "2", str(tmp_path / "r"), str(tmp_path / "i"), CONFIG, parts=4)  # the batch runs again
    assert (again["added"], again["taken_out"]) == (0, 0)
    assert content(sinks.read_incidents(spark, str(tmp_path / "i"))) == content(whole(spark, done))
    assert mine_batch(spark.createDataFrame([("x", "f")], "value string, filename string"), "9", str(tmp_path / "r"), str(tmp_path / "i"), CONFIG)["lines"] == 0


def test_a_stream_reads_each_file_once(spark, tmp_path):
    rng = random.Random(5)
    sessions = [session_lines(rng, f"s{s}", 9) for s in range(3)]
    (tmp_path / "in").mkdir()
    read = []
    for cut in (4, 9):  # every session goes on in a second file
        new = [x for s in sessions for x in s[cut - 4 if cut == 4 else 4 : cut]]
        (tmp_path / f"in/{cut}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in new))
        q = follow(spark, str(tmp_path / "in"), str(tmp_path / "i"), str(tmp_path / "c"), CONFIG, parts=4)
        q.awaitTermination(200)
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert read == [12, 15]
    assert content(sinks.read_incidents(spark, str(tmp_path / "i"))) == content(whole(spark, [x for s in sessions for x in s]))


# the record store


def test_nothing_moves_between_stored_records(spark, tmp_path):
    rng = random.Random(6)
    lines = [x for s in range(5) for x in session_lines(rng, f"s{s}", 8)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with stored(read_transcripts(spark, f"{tmp_path}/*.jsonl"), CONFIG, buckets=3) as t:
            plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
            events = D.incidents_of(D.call_events(t, CONFIG, D.failures(CONFIG), D.large_reads(CONFIG), D.retries(CONFIG)), t)
            for df in (events, D.user_correction(t, CONFIG), t.sessions, D.attach_window(D.call_events(t, CONFIG, D.retries(CONFIG)), t.turns)):
                assert "Exchange" not in plan(df)
            assert plan(events).count("Bucketed: true") == plan(events).count("FileScan")
            assert plan(D.detect(t, CONFIG)).count("Exchange") <= 1
            assert "blocks" not in plan(events) and "excerpt" not in plan(events) and "texts" not in plan(events)
            assert content(D.detect(t, CONFIG)) == content(whole(spark, lines))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("records_")]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_odd_contents_keep_their_kind(spark):
    kinds = [("[1]", "string"), ("5", "string"), ("true", "string"), ('{"a":1}', "string"), (5, None), (True, None), ({"a": 1}, None), (None, None), ([], "array"), (["x", {"type": "text", "text": "y"}], "array"), ("", "string")]
    lines = [json.dumps({"type": "user", "sessionId": "s", "uuid": f"{i:02d}", "timestamp": "t", "message": {"content": c}}) for i, (c, _) in enumerate(kinds)]
    raw = spark.createDataFrame([(x, "f") for x in lines], "value string, filename string")
    rec = N.records(raw, CONFIG).orderBy("turn").collect()
    assert [r.content_kind for r in rec] == [k for _, k in kinds]
    assert [r.texts for r in rec if r.texts] == [["[1]"], ["5"], ["true"], ['{"a":1}'], ["y"], [""]]
