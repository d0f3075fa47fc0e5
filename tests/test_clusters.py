"""Clusters, sampling, the ledger and proposals."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyrook import api, schemas
from tallyrook.config import ClusterConfig, PlanConfig
from tallyrook.functions import text as X
from tallyrook.operators import cluster as C
from tallyrook.operators import ledger as L
from tallyrook.plans import proposals as P
from tallyrook.plans import render as R
from tallyrook.sources import documents, sinks


def incident(i, session, candidates=("/a",), signal="retry", confidence="low", ts="1", window=()):
    return (i, session, "p", ts, signal, candidates[0], list(candidates), [(n, "user", "x" * 10) for n in window], confidence, "{}")


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.INCIDENT)


def test_gate_counts_sessions_and_explodes_candidates(spark):
    rows = [incident("1", "s1", ("/g", "/a")), incident("2", "s2", ("/g", "/b")), incident("3", "s2", ("/g", "/b"))]
    got = C.gate(C.exploded(table(spark, rows)), 2).collect()
    assert [(r.artifact, r.distinct_sessions, r.total_incidents) for r in got] == [("/g", 2, 3)]


def test_worktrees_are_their_repository_and_count_once(spark):
    rows = [incident("1", "s1", ("/r/.worktrees/x/CLAUDE.md", "/r/CLAUDE.md")), incident("2", "s2", ("/r/.worktrees/y/.worktrees/z/f",))]
    got = {(r.incident_id, r.artifact) for r in C.exploded(table(spark, rows)).collect()}
    assert got == {("1", "/r/CLAUDE.md"), ("2", "/r/.worktrees/z/f")}


@pytest.mark.parametrize(("cap", "n"), [(5, 5), (7, 7), (0, 15)])
def test_sampling_takes_sessions_in_turn(spark, cap, n):
    rows = [incident(f"{s}{k}", f"s{s}") for s in range(5) for k in range(3)]
    picked = C.sample(e := C.exploded(table(spark, rows)), C.gate(e, 1), cap).collect()
    per = Counter(r.session_id for r in picked)
    assert len(picked) == n and max(per.values()) - min(per.values()) <= 1
    assert all(r.total_incidents == 15 and r.distinct_sessions == 5 for r in picked)


def test_sampling_is_even_until_sessions_run_out(spark):
    rng = random.Random(4)
    sizes = {f"s{i}": rng.randint(1, 9) for i in range(8)}
    rows = [incident(f"{s}-{k}", s, confidence=rng.choice(["low", "medium", "high"]), ts=str(rng.randint(1, 3))) for s, n in sizes.items() for k in range(n)]
    e = C.exploded(table(spark, rows))
    picked = sorted(C.sample(e, C.gate(e, 1), 0).collect(), key=lambda r: r.pick)
    for n in range(1, len(picked) + 1):
        per = Counter(r.session_id for r in picked[:n])
        rest = [per[s] for s in sizes if per[s] < sizes[s]]
        assert not rest or max(per.values()) - min(rest) <= 1


def test_clusters_nested_caps_and_files(spark, tmp_path):
    rows = [incident(f"{k:02d}", f"s{k}", ("/a",), window=range(1, 9)) for k in range(30)]
    config = ClusterConfig(min_sessions=2, max_incidents=50, max_excerpt_bytes=4, truncation_mark="~")
    found = C.clusters(table(spark, rows), config)
    content = spark.createDataFrame([("/a", "é" * 10)], "artifact string, content string")
    kept, missing = C.with_content(found, content, ClusterConfig(max_content_bytes=3, truncation_mark="~"))
    row = C.capped(kept, config).first()
    assert len(row.incidents) == 25 and [w.turn for w in row.incidents[0].window] == [5, 6, 7, 8] and row.incidents[0].window[0].excerpt == "xxxx~"
    assert row.artifact_content == "é�~" and missing.count() == 0
    assert C.with_content(found, content.where("false"), config)[1].count() == 1
    assert sinks.write_clusters(C.capped(kept, config), f"{tmp_path}/o/clusters.json") == 1
    entry = json.load(open(f"{tmp_path}/o/clusters.json"))[0]
    assert entry["sampled_incidents"] == 25 and entry["total_incidents"] == 30
    assert len(json.load(open(f"{tmp_path}/o/{entry['file']}"))["incidents"]) == 25


def test_top_orders_and_reports_what_is_left_out(spark):
    rows = spark.createDataFrame([("a", 3, 9), ("b", 5, 1), ("c", 5, 7), ("d", 5, 1), ("e", 2, 2)], "cluster_id string, distinct_sessions long, total_incidents long").withColumn("artifact", F.col("cluster_id")).withColumn("signal_type", F.lit("s"))
    best, cut = C.top(rows, 3)
    assert [r.cluster_id for r in best.collect()] == ["c", "b", "d"] and cut == 2
    for n in (0, -1, 5, 9):
        assert C.top(rows, n)[1] == 0 and C.top(rows, n)[0].count() == 5


def entry(i, artifact="/a", signal="retry", outcome="open", pr=""):
    mark = f"<!-- outcome: {outcome} -->\n" if outcome else ""
    return (f"/l/{i}.md", f"# {i}\n\n**Artifact:** {artifact}  \n" + (f"**Signal:** {signal}  \n" if signal else "") + (f"\n**PR:** {pr}\n" if pr else "") + f"\n{mark}")


def entries(spark, *rows):
    return documents.parse_ledger(spark.createDataFrame(list(rows), "path string, content string"))


def test_declined_clusters_stay_away(spark):
    clusters = spark.createDataFrame([("/a", "retry"), ("/a", "tool_error"), ("/b", "retry")], "artifact string, signal_type string")
    known = entries(spark, entry("x", "/a//#Part", "retry", "closed"), entry("y", "/b", "retry", "merged"), entry("z", "/b", "", "rejected"), entry("w", "/b", "retry", ""))
    kept, skipped = L.split_declined(clusters, known)
    assert [tuple(r) for r in skipped.collect()] == [("/a", "retry")] and kept.count() == 2
    by_id = {r.id: r for r in known.collect()}
    assert (by_id["w"].outcome_raw, by_id["w"].outcome_or_open) == ("", "open")


def test_reconcile_twice(spark, tmp_path):
    url = "https://github.com/o/r/pull/"
    for i, (n, o) in enumerate([(1, "open"), (2, "open"), (3, "open"), (4, "")]):
        (tmp_path / f"{i}.md").write_text(entry(f"e{i}", outcome=o, pr=f"{url}{n}")[1])
    states = spark.createDataFrame([(url + "1", "open"), (url + "1", "Merged"), (url + "2", "CLOSED"), (url + "3", "OPEN"), (url + "4", "MERGED")], schemas.PR_STATE).withColumn("ord", F.monotonically_increasing_id())
    assert api.reconcile_ledger(spark, str(tmp_path), states) == 2
    assert api.reconcile_ledger(spark, str(tmp_path), states) == 0
    got = documents.read_ledger(spark, str(tmp_path))
    assert {r.id: r.outcome_raw for r in got.collect()} == {"e0": "merged", "e1": "closed", "e2": "open", "e3": ""}
    assert [r.repo for r in L.entry_repos(got).collect()] == ["o/r"]
    assert documents.read_ledger(spark, str(tmp_path / "none")).count() == 0


def proposal(i="p1", **kw):
    return {"id": i, "implicated_artifact": "/r/CLAUDE.md#Rules", "signal_type": "retry", "fix_type": "strengthen", "evidence": ["e"], "diagnosis": "d\nmore", "proposed_change": "c", "confidence": "high", "reason_log": "why"} | kw


def test_proposals_are_checked_once_and_fences_go(spark, tmp_path):
    files = {"a": json.dumps(proposal()), "b": json.dumps(proposal(diagnosis="second")), "c": "```json\n" + json.dumps(proposal("p0", fix_type="skip", proposed_change="")) + "\n```", "d": "{oops", "e": json.dumps(proposal("p9", confidence="sure"))}
    for k, v in files.items():
        (tmp_path / f"{k}.json").write_text(v)
    good, bad = P.load(documents.read_proposals(spark, str(tmp_path)))
    assert [(r.id, r.diagnosis) for r in good.collect()] == [("p0", "d\nmore"), ("p1", "d\nmore")]
    assert sorted(r.error for r in bad.collect()) == ["invalid confidence", "not a proposal"]
    told = api.assemble(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "log"), "2026-01-01")
    assert told == {"valid": 2, "invalid": 2, "new": 2}
    assert api.assemble(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "log"), "2026-01-01")["new"] == 0
    sinks.link_pr(spark, str(tmp_path / "log"), "p1", "u", PlanConfig().pr_placeholder)
    sinks.link_pr(spark, str(tmp_path / "log"), "p1", "u2", PlanConfig().pr_placeholder)
    assert {r.id: r.pr_url for r in documents.read_ledger(spark, str(tmp_path / "log")).collect()} == {"p0": "", "p1": "u"}
    with pytest.raises(LookupError):
        sinks.link_pr(spark, str(tmp_path / "log"), "none", "u", "x")


@pytest.mark.parametrize(("change", "error"), [({"id": ""}, "missing id"), ({"implicated_artifact": ""}, "missing implicated_artifact"), ({"fix_type": None}, "invalid fix_type"), ({"evidence": []}, "missing evidence"), ({"diagnosis": ""}, "missing diagnosis"), ({"proposed_change": ""}, "missing proposed_change"), ({"reason_log": None}, "missing reason_log")])
def test_error_reasons(spark, change, error):
    row = spark.createDataFrame([tuple((proposal() | change)[k] for k in schemas.PROPOSAL.names)], schemas.PROPOSAL)
    assert row.select(P.error_reason().alias("e")).first().e == error


def plan_of(spark, props, config=None, **kw):
    rows = spark.createDataFrame([tuple(p[k] for k in schemas.PROPOSAL.names) for p in props], schemas.PROPOSAL)
    facts = spark.createDataFrame([("/r/CLAUDE.md", "/r/CLAUDE.md", True, "/r", "git@x:team/r", "main"), ("/r/new.md", "/r/new.md", False, "/r", "", "main"), ("/i", "/nix/store/i", True, "/i", "", "main"), ("/set", "/set", True, "/set", "", "trunk")], schemas.TARGET_FACT)
    return rows, P.plan(rows, facts, config or PlanConfig(settings_repo="/set", owners=(("team", "t"),)), **kw)


def test_plan_statuses_groups_and_gate(spark):
    props = [
        proposal("a"), proposal("b", implicated_artifact="/r/CLAUDE.md"), proposal("c", confidence="low"), proposal("d", fix_type="skip"), proposal("e", fix_type="escalate-out-of-instructions"), proposal("f", implicated_artifact="/gone"),
        proposal("g", implicated_artifact="/r/new.md"), proposal("h", implicated_artifact="/r/new.md", fix_type="add"), proposal("i", implicated_artifact="/i"),
    ]
    _, plan = plan_of(spark, props)
    got = {r.proposal_id: r for r in plan.collect()}
    assert {k: r.status for k, r in got.items()} == dict(a="ready", b="ready", c="skip-low-confidence", d="skip-declined", e="ready", f="skip-unresolved", g="skip-missing-file", h="ready", i="skip-unresolved")
    assert got["a"].group_id == got["b"].group_id == "r-claude-md-" + __import__("hashlib").sha1(b"/r").hexdigest()[:8]
    assert got["a"].branch_name == f"docs/tallyrook-{got['a'].group_id}" and got["e"].branch_name.startswith("chore/") and (got["a"].section, got["a"].owner) == ("Rules", "t")
    assert [r.group_id for r in P.ready_groups(plan).collect()][0] == got["a"].group_id
    _, unrouted = plan_of(spark, props, PlanConfig())
    assert {r.proposal_id: r.status for r in unrouted.collect()}["e"] == "skip-unrouted"
    prs = spark.createDataFrame([(7, "", got["h"].branch_name, "u7"), (3, "", got["h"].branch_name, "u3")], schemas.OPEN_PR)
    prior = entries(spark, entry("old", "/r/CLAUDE.md#rules!", "retry", "open", "u"), entry("b", "/r/CLAUDE.md", "retry", "open", "u"), entry("done", "/r/CLAUDE.md", "retry", "merged", "u"))
    rows, gated = plan_of(spark, props, open_prs=prs, ledger=prior)
    got = {r.proposal_id: (r.status, r.supersedes) for r in gated.collect()}
    assert got["h"] == ("skip-duplicate", "open PR #3 (u3)") and got["a"] == ("skip-duplicate", 'reason-log entry "old" (PR u)') and got["b"] == ("ready", "")
    told = R.overview(gated, rows).collect()
    assert sorted((r.held, r.proposals) for r in told if not r.held) == [(False, 1), (False, 1)] and sum(r.proposals for r in told if r.held) == 7
    text = "".join(R.suggestions(gated, rows))
    assert "* h for open PR #3 (u3)\n" in text and max(text.index(r.key) for r in told if not r.held) < text.index("Held back as ")
    assert "not among the proposals" in "".join(R.suggestions(gated, rows.where("id <> 'b'")))


def test_messages_and_preflight(spark):
    rows, plan = plan_of(spark, [proposal("a"), proposal("b"), proposal("h", implicated_artifact="/r/new.md", fix_type="add")])
    done = spark.createDataFrame([("a", True, ["x"], "did a", ""), ("b", True, ["y", "x"], "", ""), ("h", True, ["z"], "feat(x): new", "")], "id string, applied boolean, files_changed array<string>, summary string, reason string")
    got = {r["items"]: r for r in R.messages(plan, rows, done).collect()}
    assert got[1].title == "feat(x): new" and got[2].title == "docs: apply 2 proposals to CLAUDE.md" and got[2].files_changed == ["x", "y"]
    assert got[2].body.startswith("Changes to CLAUDE.md by a, b.\n") and "\ndid a\n\nWhat is wrong: d\n" in got[2].body
    assert [r["items"] for r in R.messages(plan, rows, done.where("id = 'h'")).collect()] == [1]  # nobody has edited the other group
    for lost in (R.messages(plan, rows, done.where("id <> 'b'")), R.messages(plan, rows.where("id <> 'b'"), done)):
        with pytest.raises(Exception, match="no proposal or no editor's result of b"):
            lost.collect()
    left = done.withColumn("applied", F.col("id") != "b")
    assert [r["items"] for r in R.messages(plan, rows, left).collect()] == [1, 1]
    titles = spark.createDataFrame([("chore: feat(x): y",), ("docs: z",)], "title string")
    assert R.doubled_titles(titles).count() == 1
    f = lambda *x: spark.createDataFrame([(y,) for y in x], "file string")
    assert [r.file for r in R.unreported_files(f("x", "w"), f("x")).collect()] == ["w"]
    assert R.unreported_files(f("w"), f("x").where("false")).count() == 0


@pytest.mark.parametrize(("expr", "value", "want"), [
    (X.slug, "--A b/C!", "a-b-c"), (X.slug, "éé", ""), (X.fnv1a32, "abc", "1a47e90b"), (X.fnv1a32, "", "811c9dc5"), (X.slug_or_hash, "ab", "ab"), (X.first_line, "a\nb", "a"), (X.last_line, " a\n b \n", "b"),
    (X.repo_of_url, "https://github.com/o/r/pull/1", "o/r"), (X.repo_of_url, "https://github.com/o/", "o/"), (X.repo_of_url, "https://github.com/o", ""), (X.artifact_path, "/a//b/./c/#x#y", "/a/b/c"), (X.artifact_section, "/a#x#y", "x#y"),
    (X.strip_fence, " ```json\n{}\n``` ", "{}"), (X.strip_fence, "plain ", "plain "), (X.strip_fence, "```", ""), (X.project_dir, "/a.b/c", "-a-b-c"), (X.canonical_artifact, "/r/.worktrees/n/d/f", "/r/d/f"),
])
def test_text_functions(spark, expr, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(expr("x").alias("y")).first().y == want


def test_ascii_boundaries_see_letters_beyond_ascii_as_edges(spark):
    row = spark.createDataFrame([("éno",), ("ano",)], "x string").select(F.col("x").rlike(X.ascii_boundaries(r"\bno\b")).alias("y"))
    assert [r.y for r in row.collect()] == [True, False]


def test_cutoff_and_folder(spark):
    rows = [incident(f"{a}{s}{i}", f"s{s}", (a,)) for a, n in (("/r/a", 3), ("/r/b", 2), ("/rx/c", 2)) for s in range(n) for i in range(2)] + [incident("x", "s0", ("/r/b",))]
    found = C.clusters(table(spark, rows), ClusterConfig(min_sessions=2))
    best, cut = C.top(found, 2)
    assert cut == 1 and C.cutoff(best) == {"cutoff_sessions": 2, "cutoff_incidents": 5} and C.cutoff(found.where("false")) == {}
    assert sorted(r.artifact for r in C.below(found, "/r/").collect()) == ["/r/a", "/r/b"] == sorted(r.artifact for r in C.below(found, "/r").collect())


def test_command_line(spark, tmp_path):
    """From proposal files to suggestions; the commands report what they did."""
    from tallyrook.__main__ import parser, run

    def call(*args):
        return run(spark, parser().parse_args([str(a) for a in args]))

    d = tmp_path / "proposals"
    d.mkdir()
    for i in ("a", "b"):
        (d / f"{i}.json").write_text(json.dumps(proposal(i)))
    assert call("assemble", "--proposals", d, "--out", tmp_path / "all.json", "--ledger", tmp_path / "log", "--date", "2026-01-01") == {"valid": 2, "invalid": 0, "new": 2}
    (tmp_path / "facts.json").write_text(json.dumps([{"path": "/r/CLAUDE.md", "real_path": "/r/CLAUDE.md", "exists": True, "repo_root": "/r", "origin_url": "", "base": "main"}]))
    assert call("prepare", "--proposals", tmp_path / "all.json", "--facts", tmp_path / "facts.json", "--out", tmp_path / "plan.json", "--ledger", tmp_path / "log", "--no-dedup") == {"ready": 2}
    call("suggest", "--plan", tmp_path / "plan.json", "--proposals", tmp_path / "all.json", "--out", tmp_path / "s.md")
    assert "* a (" in (tmp_path / "s.md").read_text()
    (tmp_path / "states.json").write_text("[]")
    assert call("reconcile", "--ledger", tmp_path / "log", "--states", tmp_path / "states.json") == {"changed": 0}
    sinks.insert_or_ignore(table(spark, [incident(f"i{s}", f"s{s}", (str(d / "a.json"),)) for s in range(3)]), str(tmp_path / "inc"))
    assert call("summary", "--incidents", tmp_path / "inc") == {"retry": 3}
    told = call("cluster", "--incidents", tmp_path / "inc", "--out", tmp_path / "index.json", "--min-sessions", 3, "--repo", tmp_path)
    assert told["written"] == 1 and told["cut"] == 0
    with pytest.raises(SystemExit):
        call("cluster")
