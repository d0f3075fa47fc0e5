"""Paths, phrases, ranks, trends, steps of one's own, artifacts and files."""

import datetime
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyrook import schemas
from tallyrook.config import CORRECTION_REGEX, ClusterConfig, PlanConfig
from tallyrook.functions import text as X
from tallyrook.operators import cluster as C
from tallyrook.operators import ledger as L
from tallyrook.operators import trend as T
from tallyrook.operators.hook import transform_rows
from tallyrook.operators.paths import resolved, target_facts
from tallyrook.operators.ranking import ranked
from tallyrook.plans import proposals as P
from tallyrook.sources import documents, files, sinks


def clean(path):
    done = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and done and done[-1] != "..":
            done.pop()
        elif part != ".." or not path.startswith("/"):
            done.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(done) or "."


def test_clean_paths(spark):
    rng = random.Random(1)
    paths = ["", ".", "/", "..", "/..", "a/..", "./a", "/a/b/../c.md", "//", "a/", "...", "/..a/..b", "a/./", "é/../語"]
    paths += [rng.choice(["", "/", "//"]) + "/".join(rng.choice(["a", "b", "..", ".", "", "..."]) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.clean_path("p").alias("c"), X.artifact_path(F.concat("p", F.lit("#s/../x"))).alias("a")).collect()
    assert all(r.c == clean(r.p) and r.a == clean(r.p) for r in got)


def test_paths_resolve_as_the_file_system_does(spark, tmp_path):
    base = str(tmp_path.resolve())
    for d in ("real/sub", "real/other"):
        os.makedirs(f"{base}/{d}")
    (tmp_path / "real/sub/a.md").write_text("x")
    os.symlink(f"{base}/real", f"{base}/link")
    os.symlink(f"{base}/real/sub/a.md", f"{base}/file.md")
    os.symlink(f"{base}/nowhere", f"{base}/broken")
    known = {"/"}
    for root, dirs, names in os.walk(base, followlinks=True):
        known |= {root} | {f"{root}/{n}" for n in [*dirs, *names]}
    known |= {os.path.dirname(base)}
    links = [(p, os.path.realpath(p) if os.path.exists(p) else None) for p in known]
    there = [f"{base}/link/sub/a.md", f"{base}/file.md", f"{base}/link/./sub/../sub/a.md", f"{base}/real"]
    new = [f"{base}/link/new/b.md", f"{base}/link/sub/b.md", f"{base}/none/b.md"]
    df = spark.createDataFrame([(p,) for p in [*there, *new, f"{base}/broken", f"{base}/link/sub/a.md", None]], "path string")
    got = {r.path: (r.real_path, r.there) for r in resolved(df, spark.createDataFrame(links, schemas.LINK)).collect()}
    assert got == {p: (os.path.realpath(p), True) for p in there} | {p: (os.path.realpath(p), False) for p in new} | {f"{base}/broken": (None, True)}
    repos = spark.createDataFrame([(f"{base}/real", None, "git@own", "dev"), (f"{base}/real/sub", f"{base}/main", None, None)], schemas.REPO)
    facts = {r.path: r for r in target_facts(df, spark.createDataFrame(links, schemas.LINK), repos).collect()}
    assert facts[there[0]].repo_root == f"{base}/main" and facts[there[0]].exists and facts[there[0]].base == "main"
    assert facts[new[0]].repo_root == f"{base}/real" and not facts[new[0]].exists and facts[new[0]].base == "dev" and facts[new[0]].real_path == f"{base}/real/new/b.md"
    assert facts[new[2]].repo_root == "" and facts[f"{base}/broken"].exists is False


def test_declined_work_is_known_by_any_spelling(spark):
    clusters = spark.createDataFrame([("c1", "/a/c.md", "retry"), ("c2", "/l/d.md", "retry"), ("c3", "/e.md", "retry")], "cluster_id string, artifact string, signal_type string")
    entries = spark.createDataFrame([("/a/b/../c.md#x", "retry", "closed"), ("/real/d.md", "retry", "rejected"), ("/e.md", "other", "closed")], "artifact string, signal_type string, outcome_or_open string")
    links = spark.createDataFrame([("/l", "/real"), ("/l/d.md", "/real/d.md"), ("/real/d.md", "/real/d.md")], schemas.LINK)
    ids = lambda df: [r.cluster_id for r in df.orderBy("cluster_id").collect()]
    assert [ids(x) for x in L.split_declined(clusters, entries)] == [["c2", "c3"], ["c1"]]
    assert [ids(x) for x in L.split_declined(clusters, entries, links)] == [["c3"], ["c1", "c2"]]


def test_the_gate_follows_links(spark):
    p = [("p1", "/l/d.md#S", "retry", "add", ["e"], "d", "c", "high", "r")]
    fact = [("/l/d.md", "/real/d.md", True, "/real", "u", "main")]
    entry = [("/x.md", "old", "/l/d.md#s", "retry", "open", "open", "url", "")]
    links = spark.createDataFrame([("/l", "/real"), ("/l/d.md", "/real/d.md")], schemas.LINK)
    plan = lambda links: P.plan(spark.createDataFrame(p, schemas.PROPOSAL), spark.createDataFrame(fact, schemas.TARGET_FACT), PlanConfig(), None, spark.createDataFrame(entry, schemas.LEDGER), links).first().status
    assert plan(None) == "ready" and plan(links) == "skip-duplicate"


def test_phrases_are_found_as_the_pattern_finds_them(spark):
    rng = random.Random(2)
    parts = ["no", "don", "t", "dont", "'", "actually", "re", "revert", "that's", "wrong", "wrongly", "undo", "nope", "incorrect", "stop", "_", " ", " ", "é", "\n", "—", "x", "1", "s wrong", "that"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 7))),) for _ in range(4000)], "t string").cache()
    for pattern in (CORRECTION_REGEX, r"\bno\b", "x+1|re", r"(a|b)c|\bno\b", r"no\b", r"\bn?o\b", r"st.?p|\bt.*x\b", "^no|x"):
        assert df.where(X.found_in("t", pattern) != F.col("t").rlike(X.ascii_boundaries(pattern))).count() == 0, pattern
    assert df.where(X.found_in("t", r"\bno\b", "don't") != (F.col("t").rlike(X.ascii_boundaries(r"\bno\b")) | F.col("t").contains("don't"))).count() == 0


def test_ranks_of_a_hot_group(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i * 7919 % 1000, None if i % 11 == 0 else i % 4, i) for i in range(1500)], "k string, a int, b int, i int").repartition(7)
    rows = rows.unionByName(spark.createDataFrame([(None, 1, 2, 9001), (None, 1, 1, 9000)], rows.schema))
    order = [F.col("a").desc(), F.col("b").asc_nulls_last(), F.col("i")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(rows, ["k"], order, "n")
        assert "Window" not in got.drop("n")._jdf.queryExecution().optimizedPlan().toString()
        want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked(rows.limit(0), ["k"], order, "n").count() == 0


def test_clusters_without_a_cap_have_bounded_rows(spark):
    found = [(f"i{i:03d}", f"s{i % 9}", "/p", f"t{i:03d}", "retry", "/a", ["/a"], None, "low", "{}") for i in range(200)]
    rows = C.clusters(spark.createDataFrame(found, schemas.INCIDENT), ClusterConfig(min_sessions=1, max_incidents=0, max_incidents_per_cluster=7)).collect()
    assert [(r.total_incidents, len(r.incidents)) for r in rows] == [(200, 7)]


def test_trend_around_merges(spark):
    at = lambda d, h=0: (datetime.datetime(2026, 3, 10) + datetime.timedelta(days=d, hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = [("/a", "retry", at(d)) for d in (-15, -3, -2, -1, 0, 1, 13, 14)] + [("/a", "retry", "no time"), ("/a", "other", at(1)), ("/b", "retry", at(2))]
    incidents = spark.createDataFrame(found, "implicated_artifact string, signal_type string, ts string")
    entries = spark.createDataFrame([("/a#x", "retry", "u1"), ("/b", "retry", "u2"), ("/c", "retry", "u3"), ("/a", "retry", "u4")], "artifact string, signal_type string, pr_url string")
    states = spark.createDataFrame([("u1", "merged", at(0)), ("u2", "MERGED", at(0)), ("u3", "MERGED", at(0)), ("u4", "CLOSED", at(0))], "url string, state string, closed_at string")
    got = {r.url: (r.artifact, r.before, r.after, r.ratio) for r in T.trend(incidents, T.merges(entries, states), 14).collect()}
    assert got == {"u1": ("/a", 3, 3, 1.0), "u2": ("/b", 0, 1, None), "u3": ("/c", 0, 0, None)}
    assert sum(r.incidents for r in T.rates(incidents).collect()) == len(found) - 1


def test_rates_of_a_stream_come_when_a_window_is_over(spark, tmp_path):
    source = tmp_path / "in"
    for i, ts in enumerate(["2026-03-02T01:00:00Z", "2026-03-03T01:00:00Z", "2026-03-20T00:00:00Z", "2026-03-02T09:00:00Z"]):
        spark.createDataFrame([("/a", "retry", ts)], "implicated_artifact string, signal_type string, ts string").coalesce(1).write.mode("append").json(f"{source}/{i}")
        stream = spark.readStream.schema("implicated_artifact string, signal_type string, ts string").option("recursiveFileLookup", True).json(str(source))
        q = T.rates(stream, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((str(r.start), r.incidents) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2026-03-02 00:00:00", 1), ("2026-03-03 00:00:00", 1)]  # what comes late is dropped


def test_steps_are_tried_again_and_failures_are_kept(spark, tmp_path):
    mark = str(tmp_path)

    def step(row):
        with open(f"{mark}/{row['i']}", "a") as f:
            f.write("x")
        if row["i"] == 3 and os.path.getsize(f"{mark}/3") < 2:
            raise RuntimeError("not yet")
        if row["i"] == 4:
            raise KeyError("never")
        return {1: None, 2: [{"n": 20}, {"n": 21}], 5: {"n": "text"}}.get(row["i"], {"n": row["i"], "more": 1})

    rows = spark.createDataFrame([(i, [f"t{i}"]) for i in range(7)], "i long, t array<string>").repartition(3)
    good, dead = transform_rows(rows, step, spark.createDataFrame([], "n long").schema, tries=2, wait=0.0)
    assert sorted(r.n for r in good.collect()) == [0, 3, 6, 20, 21]
    lost = {r.i: r for r in dead.collect()}
    assert set(lost) == {4, 5} and lost[4].error == "KeyError: 'never'" and lost[4].tries == 2 and lost[4].t == ["t4"]
    assert [os.path.getsize(f"{mark}/{i}") for i in range(7)] == [1, 1, 1, 2, 2, 2, 1]  # both results are there, and each row was worked once


def test_artifacts_are_read_by_tasks(spark, tmp_path):
    (tmp_path / "a.md").write_text("é" * 100)
    (tmp_path / "b.md").write_bytes(b"ok\xff")
    paths = [f"{tmp_path}/a.md", f"file://{tmp_path}/a.md", f"{tmp_path}/b.md", f"{tmp_path}/none.md", str(tmp_path), None, f"{tmp_path}/b.md"]
    df = spark.createDataFrame([(p,) for p in paths], "artifact string")
    config = ClusterConfig(max_content_bytes=11, truncation_mark="~")
    got = {r.artifact: r.c for r in documents.read_artifacts(df, 11).select("artifact", X.truncate_bytes("content", config.max_content_bytes, "~").alias("c")).collect()}
    assert got == {f"{tmp_path}/a.md": "é" * 5 + "�~", f"file://{tmp_path}/a.md": "é" * 5 + "�~", f"{tmp_path}/b.md": "ok�"}
    with pytest.raises(Exception, match="nostore|scheme|Unrecognized"):
        documents.read_artifacts(spark.createDataFrame([("nostore://h/x",)], "artifact string"), 5).collect()


def test_files_are_put_in_place_whole(spark, tmp_path):
    path = f"file://{tmp_path}/d/a.txt"
    files.write_text(spark, path, "one")
    files.write_text(spark, path, "two é")
    assert files.read_text(spark, path) == "two é" and files.read_text(spark, path + "x") is None
    assert not files.write_new(spark, path, "three") and files.write_new(spark, path + ".new", "") and files.read_text(spark, path + ".new") == ""
    assert [n.rsplit("/", 1)[1] for n in files.names(spark, f"file://{tmp_path}/d", "")] == ["a.txt", "a.txt.new"]
    found = spark.createDataFrame([("s::a", "s", "a", True, 2, 3, [("i",)]), ("s::b", "s", "b", True, 2, 3, None)], "cluster_id string, signal_type string, artifact string, artifact_exists boolean, distinct_sessions long, total_incidents long, incidents array<struct<incident_id:string>>")
    assert sinks.write_clusters(found, f"file://{tmp_path}/out/index.json") == 2
    before = files.read_text(spark, f"file://{tmp_path}/out/index.json")
    broken = found.withColumn("cluster_id", F.when(F.col("artifact") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("cluster_id")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_clusters(broken, f"file://{tmp_path}/out/index.json")
    assert files.read_text(spark, f"file://{tmp_path}/out/index.json") == before


def test_commands_of_paths_trends_and_streams(spark, tmp_path):
    import json

    from tallyrook.__main__ import parser, run

    call = lambda *args: run(spark, parser().parse_args([str(a) for a in args]))
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and tmp_path / name
    proposal = {"id": "p1", "implicated_artifact": "/l/./d.md#S", "signal_type": "tool_error", "fix_type": "add", "evidence": ["e"], "diagnosis": "d", "proposed_change": "c", "confidence": "high", "reason_log": "r"}
    links, repos = put("links.json", [{"path": "/l", "real_path": "/real"}]), put("repos.json", [{"root": "/real", "origin_url": "u"}])
    assert call("facts", "--proposals", put("all.json", [proposal]), "--links", links, "--repos", repos, "--out", tmp_path / "facts.json") == {"out": str(tmp_path / "facts.json")}
    fact = json.loads((tmp_path / "facts.json").read_text())
    assert fact == [{"path": "/l/./d.md", "real_path": "/real/d.md", "exists": False, "repo_root": "/real", "origin_url": "u", "base": "main"}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.md").write_text("# old\n\n**Artifact:** /real/d.md#S  \n**Signal:** tool_error  \n\n**PR:** url1\n\n<!-- outcome: open -->\n")
    assert call("prepare", "--proposals", tmp_path / "all.json", "--facts", tmp_path / "facts.json", "--out", tmp_path / "plan.json", "--ledger", tmp_path / "log", "--links", links) == {"skip-duplicate": 1}
    lines = [{"type": "assistant", "sessionId": "s", "uuid": "1", "timestamp": "2026-01-03T00:00:00Z", "cwd": "/real", "message": {"content": [{"type": "tool_use", "id": "a", "name": "X", "input": {}}]}}, {"type": "user", "sessionId": "s", "uuid": "2", "timestamp": "2026-01-03T00:01:00Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "a", "is_error": True}]}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert call("follow", "--corpus", tmp_path / "in", "--out", tmp_path / "inc", "--checkpoint", tmp_path / "c") == {"lines": 2}
    (tmp_path / "log/x.md").write_text("# old\n\n**Artifact:** /real/CLAUDE.md  \n**Signal:** tool_error  \n\n**PR:** url1\n")
    states = put("states.json", [{"url": "url1", "state": "MERGED", "closed_at": "2026-01-01T00:00:00Z"}])
    assert call("trend", "--incidents", tmp_path / "inc", "--ledger", tmp_path / "log", "--states", states, "--out", tmp_path / "trend.json") == {"merges": 1}
    assert [(r["before"], r["after"]) for r in json.loads((tmp_path / "trend.json").read_text())] == [(0, 1)]
    assert call("compact", "--incidents", tmp_path / "inc", "--older-than", 0) == {"version": 1, "removed": 1} and call("summary", "--incidents", tmp_path / "inc") == {"tool_error": 1}
