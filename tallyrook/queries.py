"""Named queries: the engine's operators over the driver's tables.

Conversations are written as transcript lines and read by the normaliser; for clusters, events
stand for calls and for what users say (a session for each user, a turn for each event, an
error where the type says so). Orders stand for proposals, suppliers for ledger entries and
pull requests. Each query applies the operator itself; oracles has the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .config import ClusterConfig, MineConfig, PlanConfig
from .functions import text as X
from .operators import cluster as C
from .operators import detectors as D
from .operators import ledger as L
from .operators import normalize as N
from .operators import trend as T
from .operators.hook import transform_rows
from .operators.normalize import Tables, artifacts, number_turns
from .operators.paths import resolved, target_facts
from .operators.windows import attach_window
from .plans import proposals as P
from .plans.render import messages, unreported_files
from .sources import documents, sinks
from .sources.shared import scratch
from .streaming.stream import mine_batch

GLOBAL = "/g/CLAUDE.md"
MINE = MineConfig(global_artifact=GLOBAL, large_file_lines=1000, medium_lines=1500, high_lines=2000)
CLUSTER = ClusterConfig(min_sessions=3, max_incidents=20)
PLAN = PlanConfig(settings_repo="/settings", owners=(("own1", "team-one"), ("own2", "team-two")))

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), "user_id", "event_id", F.col("event_type").alias("type"), ts.alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    rows = number_turns(rows, order=("ts", "event_id"))
    known = (F.col("user_id") % 7 != 0) & (F.col("turn") > 1)
    return rows.withColumn("cwd", F.when(known, _s("/home/p", F.col("user_id") % 12))).withColumn("is_sidechain", F.col("k") == 99)


def event_tables(spark: SparkSession, d: str) -> Tables:
    e = events(spark, d)
    k = F.col("k")
    uses = e.select(
        "session_id", "turn", "ts", F.col("event_id").cast("string").alias("tuid"), F.when(k % 3 == 0, "Read").otherwise(_s("op", k % 10)).alias("tool"), _s("/f/", k).alias("file_path"),
        F.when(k % 4 == 1, "1").alias("rd_offset"), F.lit(None).cast("string").alias("rd_limit"), _s('{"k":', k % 10, "}").alias("input_str"),
    )
    results = e.select("session_id", "turn", "ts", F.col("event_id").cast("string").alias("tuid"), (F.col("type") == "error").alias("is_error"), F.floor(F.col("value") * 10).cast("long").alias("total_lines"))
    turns = e.select("session_id", "turn", "type", F.substring(_s("k", k, " of ", F.col("session_id")), 1, 300).alias("excerpt"))
    meta = e.groupBy("session_id").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("turn"))).alias("cwd"), F.bool_or("is_sidechain").alias("is_subagent"))
    said = e.select("session_id", "turn", "ts", F.when(k % 11 == 5, _s("no, use ", k)).otherwise(_s("fine ", k)).alias("text"))
    return Tables(turns, uses, results, said, artifacts(meta, MINE))


def transcript(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcript lines (value, filename): an assistant's turn has its text and
    a call, a user's later turn the call's result and the lines of the text as blocks."""
    c, t = F.col("conv_id"), F.col("turn")
    ident = lambda turn: _s("c", c, "-", turn)
    block = lambda **f: F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
    listed = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    given = F.struct(_s("/f/", (c + t) % 5).alias("file_path"), F.when(t % 4 == 3, F.lit(1)).alias("offset"))
    call = block(type=F.lit("tool_use"), id=ident(t), name=F.when((c + t) % 3 == 0, "Bash").otherwise("Read"), input=given)
    result = block(type=F.lit("tool_result"), tool_use_id=ident(t - 1), is_error=F.when(c % 5 != 0, (c + t) % 4 == 0))
    words = F.transform(F.split("text", "\n"), lambda x: block(type=F.lit("text"), text=x))
    content = F.when(F.col("role") == "assistant", listed(F.concat(F.array(block(type=F.lit("text"), text=F.col("text"))), F.array(call)))).when(t > 0, listed(F.concat(F.array(result), words)))
    plain = block(s=F.col("text"))  # the string in JSON is what stands behind the name
    content = F.coalesce(content, F.expr("substring(j, 6, length(j) - 6)"))
    message = F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), content, F.lit("}"))
    head = F.to_json(F.struct(
        F.col("role").alias("type"), c.cast("string").alias("sessionId"), ident(t).alias("uuid"), F.lpad(t.cast("string"), 6, "0").alias("timestamp"), F.when((c % 7 != 0) & (t > 0), _s("/home/p", c % 12)).alias("cwd"),
        (c % 9 == 4).alias("isSidechain"), F.struct(F.struct(((c * 7 + t) % 40 * 100).alias("totalLines")).alias("file")).alias("toolUseResult"),
    ))
    line = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"message":'), message, F.lit("}"))
    rows = _table(spark, d, "conversations").withColumn("j", plain).withColumn("h", head).select(line.alias("value"))
    broken = spark.range(3).select(F.element_at(F.array(F.lit("no json"), F.lit('{"type":"user"}'), F.lit("[1]")), (F.col("id") + 1).cast("int")).alias("value"))
    return rows.unionByName(broken).withColumn("filename", F.lit("t.jsonl"))


def read_records(spark: SparkSession, d: str) -> DataFrame:
    return N.records(transcript(spark, d), MINE)


def conversation_tables(spark: SparkSession, d: str) -> Tables:
    c = _table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("turn"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("ts"), F.col("role").alias("type"), "text")
    uses = rows.where("type = 'assistant'").select("session_id", "turn", "ts", F.concat_ws("-", "session_id", "turn").alias("tuid"), F.lit("say").alias("tool"), F.lit(None).cast("string").alias("input_str"))
    results = uses.select("session_id", "turn", "ts", "tuid", F.lit(False).alias("is_error"), F.lit(0).cast("long").alias("total_lines"))
    said = rows.where("type = 'user'").select("session_id", "turn", "ts", "text")
    meta = rows.select("session_id").distinct().withColumn("cwd", F.lit(None).cast("string"))
    return Tables(rows.select("session_id", "turn", "type", F.substring("text", 1, 300).alias("excerpt")), uses, results, said, artifacts(meta, MINE))


def _flat(incidents: DataFrame, *more: str) -> DataFrame:
    return incidents.select("incident_id", "session_id", "project", "ts", "signal_type", "implicated_artifact", F.array_join("candidates", ",").alias("candidates"), "confidence", *more)


def _window(c: str = "window") -> Column:
    return F.array_join(F.transform(c, lambda w: _s(w["turn"], ":", w["type"], ":", w["excerpt"])), "|").alias(c)


def incidents(spark: SparkSession, d: str) -> DataFrame:
    return D.detect(event_tables(spark, d), MINE)


def turn_numbering(spark, d):
    return events(spark, d).select("session_id", "event_id", "turn", "k")


def since_filter(spark, d):
    """Incidents of a later part of the sessions: turns keep their numbers."""
    config = MineConfig(global_artifact=GLOBAL, signals=("tool_error",), since="2024-01-15")
    return _flat(D.detect(event_tables(spark, d), config)).where("signal_type = 'tool_error'")


def transcript_records(spark, d):
    return read_records(spark, d).select("session_id", "turn", "uuid", "ts", "type", "cwd", "is_sidechain", "content_kind", "total_lines")


def excerpt_projection(spark, d):
    return N.tables(read_records(spark, d), MINE).turns


def content_union(spark, d):
    """Users' text, from strings and from blocks."""
    return N.user_text(read_records(spark, d)).select("session_id", "turn", "text")


def block_explode(spark, d):
    return N.tool_uses(read_records(spark, d)).select("session_id", "turn", "tuid", "tool", "file_path", "rd_offset", "rd_limit", "input_str")


def tool_result_blocks(spark, d):
    return N.tool_results(read_records(spark, d)).select("session_id", "turn", "tuid", "is_error", "total_lines")


def string_agg_per_turn(spark, d):
    """The text blocks of a turn joined in their order, without a shuffle."""
    return N.user_text(read_records(spark, d).where("content_kind = 'array'")).select("session_id", "turn", "text")


def transcript_sessions(spark, d):
    return N.session_meta(read_records(spark, d), MINE).select("session_id", "cwd", "is_subagent", "implicated_artifact")


def transcript_incidents(spark, d):
    """From lines to incidents of all signals, with their windows' turns."""
    return _told(D.detect(N.tables(read_records(spark, d), MINE), MINE))


def _told(found: DataFrame) -> DataFrame:
    return _flat(found, F.array_join(F.transform("window", lambda w: _s(w["turn"], ":", w["type"])), "|").alias("turns"))


def extract_files(spark, d):
    """Lines in files, read by the recursive reader, through the bucketed record store into the
    incident table: what the command extract does."""
    from .api import extract

    folder = scratch(spark, "transcripts")
    transcript(spark, d).select("value").write.text(f"{folder}/in/p/deep")
    extract(spark, f"{folder}/in/**/*.txt", f"{folder}/incidents", MINE, since="")
    return _told(sinks.read_incidents(spark, f"{folder}/incidents"))


def incremental_incidents(spark, d):
    """The same from two batches, in which lines come early and late: each batch reads its own
    lines and the records of the sessions that these touch."""
    folder, lines = scratch(spark, "increments"), transcript(spark, d)
    part = F.pmod(F.xxhash64("value"), F.lit(2))
    for i in range(2):
        mine_batch(lines.where(part == i), str(i), f"{folder}/records", f"{folder}/incidents", MINE, parts=4)
    return _told(sinks.read_incidents(spark, f"{folder}/incidents"))


def session_meta(spark, d):
    return event_tables(spark, d).sessions.select("session_id", "cwd", "is_subagent")


def artifact_candidates(spark, d):
    return event_tables(spark, d).sessions.select("session_id", "implicated_artifact", F.array_join("candidates", ",").alias("candidates"))


def _detector(f) -> Query:
    def query(spark, d):
        t = event_tables(spark, d)
        return _flat(D.incidents_of(D.call_events(t, MINE, f(MINE)).distinct(), t), "turn")

    return query


def user_correction(spark, d):
    t = conversation_tables(spark, d)
    return _flat(D.incidents_of(D.user_correction(t, MINE), t), "turn", F.get_json_object("detail", "$.text").alias("text"))


def context_window(spark, d):
    t = event_tables(spark, d)
    return D.incidents_of(attach_window(D.call_events(t, MINE, D.failures(MINE)), t.turns), t).select("incident_id", "turn", _window())


def tool_error_incidents(spark, d):
    """The flagship: errors as incidents, each with its window."""
    t = event_tables(spark, d)
    return D.incidents_of(attach_window(D.call_events(t, MINE, D.failures(MINE)), t.turns), t).select("incident_id", "session_id", "project", "ts", "implicated_artifact", "turn", _window())


def incidents_union(spark, d):
    return _flat(incidents(spark, d), _window())


def insert_ignore(spark, d):
    """What an insert adds to a table that has the incidents of every second session."""
    rows = incidents(spark, d)
    return _flat(sinks.new_rows(rows, rows.where(F.col("session_id").cast("long") % 2 == 0)))


def signal_summary(spark, d):
    from .api import summary

    return summary(incidents(spark, d))


def cluster_gate(spark, d):
    return C.gate(C.exploded(incidents(spark, d)), CLUSTER.min_sessions)


def _sampled(config: ClusterConfig) -> Query:
    def query(spark, d):
        rows = C.exploded(incidents(spark, d))
        return C.sample(rows, C.gate(rows, config.min_sessions), config.max_incidents).select("artifact", "signal_type", "distinct_sessions", "total_incidents", "incident_id", "session_id", "rn_in_session", "pick")

    return query


def cluster_bundle(spark, d):
    ids = F.array_join(F.transform("incidents", lambda i: i["incident_id"]), ",").alias("incidents")
    return C.clusters(incidents(spark, d), CLUSTER).select("cluster_id", "signal_type", "artifact", "distinct_sessions", "total_incidents", ids)


def top_clusters(spark, d):
    return C.top(C.clusters(incidents(spark, d), CLUSTER), 10)[0].select("cluster_id", "distinct_sessions", "total_incidents")


def nested_caps(spark, d):
    config = ClusterConfig(min_sessions=3, max_incidents=20, max_incidents_per_cluster=5)
    rows = C.capped(C.clusters(incidents(spark, d), config), config).select("cluster_id", F.posexplode("incidents").alias("pos", "i"))
    return rows.select("cluster_id", "pos", F.col("i.incident_id").alias("incident_id"), F.col("i.window").alias("window")).withColumn("window", _window())


def cluster_index(spark, d):
    rows = C.clusters(incidents(spark, d), CLUSTER).withColumn("artifact_exists", F.lit(True))
    return C.index(rows).select("cluster_id", "signal_type", "artifact", "distinct_sessions", "total_incidents", "sampled_incidents")


def byte_truncate(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", X.truncate_bytes(_s(F.col("o_orderstatus"), "-", F.col("o_orderpriority")), 6, "[cut]").alias("cut"))


def contents(spark, d) -> DataFrame:
    """Every document as an artifact, of every second folder."""
    return _table(spark, d, "documents").select(_s("/home/p", F.col("doc_id") * 2, "/CLAUDE.md").alias("artifact"), F.col("text").alias("content"))


def artifact_exists(spark, d):
    kept = C.with_content(C.clusters(incidents(spark, d), CLUSTER), contents(spark, d), CLUSTER)[0]
    return kept.select("cluster_id", "artifact", F.md5("artifact_content").alias("digest"), F.length("artifact_content").cast("long").alias("chars"))


def artifact_missing(spark, d):
    return C.with_content(C.clusters(incidents(spark, d), CLUSTER), contents(spark, d), CLUSTER)[1].select("cluster_id", "artifact")


SIGNALS = ["tool_error", "retry", "inefficiency"]


def ledger(spark, d) -> DataFrame:
    """Entries made of suppliers, read as markdown."""
    s = F.col("s_suppkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    outcome = pick(["open", "closed", "rejected", "merged", ""], s % 5)
    home = F.when(s % 4 == 0, _s("/home/./x/../p", s % 12, "//CLAUDE.md")).otherwise(_s("/home/p", s % 12, "/CLAUDE.md"))
    artifact = F.when(s % 2 == 0, home).otherwise(_s("/repo/r", s % 7, F.when(s % 3 == 0, "/src/..").otherwise(""), "/docs/f", (s + 1) % 31, ".md#Section ", s % 4))
    link = F.when(s % 3 == 0, "").otherwise(_s("**PR:** https://github.com/own", s % 4, "/rep", s % 2, "/pull/", s, "\n"))
    mark = F.when(outcome == "", "").otherwise(_s("<!-- outcome: ", outcome, " -->\n"))
    text = _s("# fix-", s % 97, "\n\n**Artifact:** ", artifact, "  \n**Signal:** ", pick(SIGNALS, s % 3), "  \n\n", link, "\n", mark)
    return documents.parse_ledger(_table(spark, d, "supplier").select(_s("/l/", F.lpad(s.cast("string"), 8, "0"), ".md").alias("path"), text.alias("content")))


def ledger_parse(spark, d):
    return ledger(spark, d).select("path", "id", "artifact", "signal_type", "outcome_raw", "outcome_or_open", "pr_url")


def _declined(i: int) -> Query:
    def query(spark, d):
        return L.split_declined(C.clusters(incidents(spark, d), CLUSTER), ledger(spark, d))[i].select("cluster_id")

    return query


def proposal_files(spark, d) -> DataFrame:
    """Proposals made of orders, some of them not valid, and ids that repeat."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    unless = lambda n, x: F.when(o % n == 0, "").otherwise(x)
    artifact = F.when(c % 41 == 0, "").otherwise(_s("/repo/r", c % 7, "/docs/f", c % 31, ".md", F.when(c % 3 == 0, _s("#Section ", c % 4)).otherwise("")))
    p = F.struct(
        _s("fix-", o % 997).alias("id"), artifact.alias("implicated_artifact"), F.col("o_orderstatus").alias("signal_type"),
        pick(["add", "strengthen", "fix-stale", "remove", "escalate-out-of-instructions", "skip", "bogus", "strengthen"], o % 8).alias("fix_type"),
        F.when(o % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("o_orderstatus"))).alias("evidence"), unless(17, _s("d", o)).alias("diagnosis"), unless(5, _s("c", o)).alias("proposed_change"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("unknown").alias("confidence"), unless(19, _s("r", o)).alias("reason_log"),
    )
    return _table(spark, d, "orders").select(_s(F.lpad(o.cast("string"), 12, "0"), ".json").alias("path"), p.alias("proposal"))


def proposal_validate(spark, d):
    return P.load(proposal_files(spark, d))[1]


def proposal_dedup(spark, d):
    return P.load(proposal_files(spark, d))[0].select("id", "implicated_artifact", "fix_type", "confidence", "diagnosis")


def facts(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    root = F.when(c % 7 == 6, "").otherwise(_s("/repo/r", c % 7))
    path = _s("/repo/r", c % 7, "/docs/f", c % 31, ".md")
    url = _s("git@github.com:own", c % 7, "/x.git")
    rows = _table(spark, d, "customer").select(path.alias("path"), path.alias("real_path"), (c % 31 % 5 != 0).alias("exists"), root.alias("repo_root"), url.alias("origin_url"), F.lit("main").alias("base")).distinct()
    own = spark.range(1).select(F.lit("/settings").alias("path"), F.lit("/settings").alias("real_path"), F.lit(True).alias("exists"), F.lit("/settings").alias("repo_root"), F.lit("").alias("origin_url"), F.lit("trunk").alias("base"))
    return rows.unionByName(own)


def open_prs(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    root = _s("/repo/r", s % 7)
    head = _s(F.when(s % 2 == 0, "docs").otherwise("chore"), "/tallyrook-r", s % 7, "-docs-f", s % 31, "-md-", F.substring(F.sha1(root.cast("binary")), 1, 8))
    return _table(spark, d, "supplier").select(s.alias("number"), F.lit("").alias("title"), head.alias("headRefName"), _s("https://github.com/o/r/pull/", s).alias("url"))


def plan_status(spark, d):
    return P.plan(P.load(proposal_files(spark, d))[0], facts(spark, d), PLAN).select("proposal_id", "status", "reason", "repo_root", "file_path", "section", "owner", "base", "group_id", "branch_name")


def plan_groups(spark, d):
    return P.ready_groups(P.plan(P.load(proposal_files(spark, d))[0], facts(spark, d), PLAN))


def dedup_gate(spark, d):
    rows = P.plan(P.load(proposal_files(spark, d))[0], facts(spark, d), PLAN, open_prs(spark, d), ledger(spark, d))
    return rows.where("status in ('ready', 'skip-duplicate')").select("proposal_id", "status", "supersedes")


def pr_messages(spark, d):
    """Pull requests of the groups: some proposals were refused, some results have no summary, and
    a group of which nothing was applied has none."""
    good = P.load(proposal_files(spark, d))[0]
    last = F.substring("id", -1, 1)
    results = good.select("id", (~last.isin("3", "6", "9")).alias("applied"), F.array(F.col("signal_type")).alias("files_changed"), F.when(last.isin("1", "2", "4"), _s("docs: about ", F.col("id"))).otherwise("").alias("summary"), F.lit("").alias("reason"))
    found = messages(P.plan(good, facts(spark, d), PLAN), good, results)
    return found.select("group_id", "items", "title", F.array_join("files_changed", ",").alias("files"), F.md5("body").alias("body"))


def states(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    state = F.when(s % 4 == 0, "MERGED").when(s % 4 == 1, "closed").otherwise("OPEN")
    return _table(spark, d, "supplier").select(_s("https://github.com/own", s % 4, "/rep", s % 2, "/pull/", s).alias("url"), state.alias("state"), s.alias("ord"))


def pr_reconcile(spark, d):
    return L.reconcile(ledger(spark, d), states(spark, d)).select("path", "outcome", X.outcome("content").alias("written"))


def entry_repos(spark, d):
    return L.entry_repos(ledger(spark, d))


def preflight_diff(spark, d):
    o = _table(spark, d, "orders")
    changed = o.select(_s("f", F.col("o_custkey") % 500).alias("file")).distinct()
    allowed = o.where("o_custkey % 500 < 300").select(_s("f", F.col("o_custkey") % 500).alias("file")).distinct()
    return unreported_files(changed, allowed)


def slug_hash(spark, d):
    name = _s("-", F.col("p_name"), " / ", F.col("p_brand"), "!")
    return _table(spark, d, "part").select("p_partkey", X.slug(name).alias("slug"), F.md5(name).alias("md5"), F.substring(F.sha1(name.cast("binary")), 1, 8).alias("sha"))


def fnv_hash(spark, d):
    return _table(spark, d, "part").select("p_partkey", X.fnv1a32("p_name").alias("fnv"))


def project_dirs(spark, d):
    return _table(spark, d, "pages").select("page_id", X.project_dir("url").alias("dir"), X.artifact_path("url").alias("path"))


def artifact_counts(spark, d):
    """Ad-hoc: incidents and sessions of each signal and artifact."""
    return incidents(spark, d).groupBy("signal_type", "implicated_artifact").agg(F.count("*").alias("incidents"), F.count_distinct("session_id").alias("sessions"))


def path_clean(spark, d):
    """Paths spelled in twelve ways, cleaned."""
    k = F.col("p_partkey")
    a, b = _s("a", k % 7), _s("b", k % 5)
    spelled = [_s("/", a, "/", b, "/../c.md"), _s("./", a), _s(a, "/.."), F.lit("/.."), _s("//", a, "///", b, "/"), _s("/", a, "/./", b, "/../../..//c"), _s("../", a, "/../../", b), _s(a, "/", b, "/../.."), F.lit(""), F.lit("/"), _s(a, "//", b, "/./"), _s("/", a, "/../", b, "/c/..")]
    path = F.element_at(F.array(*spelled), (k % 12 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", path.alias("path")).withColumn("clean", X.clean_path("path"))


def links(spark, d) -> DataFrame:
    """Folders and files that exist: /w/l0 to /w/l3 lead to /real, /w/l4 leads nowhere."""
    c = F.col("c_custkey")
    rows = _table(spark, d, "customer")
    folder, real, sub = _s("/w/l", c % 5), F.when(c % 5 < 4, _s("/real/r", c % 5)), F.col("c_custkey") % 2
    tops = rows.select(folder.alias("path"), real.alias("real_path"))
    subs = rows.where("c_custkey % 5 < 4").select(F.concat(folder, F.lit("/d"), sub.cast("string")).alias("path"), F.concat(real, F.lit("/d"), sub.cast("string")).alias("real_path"))
    files = rows.where("c_custkey % 5 < 4 and c_custkey % 2 = 0 and c_custkey % 11 < 6").select(_s(folder, "/d0/n", c % 11, ".md").alias("path"), _s(real, "/d0/n", c % 11, ".md").alias("real_path"))
    base = spark.range(1).select(F.lit("/w").alias("path"), F.lit("/w").alias("real_path"))
    return tops.unionByName(subs).unionByName(files).unionByName(base).distinct()


def path_targets(spark, d) -> DataFrame:
    c = F.col("o_custkey")
    head = F.element_at(F.array(F.lit("/w/"), F.lit("/w/./"), F.lit("/w/x/../"), F.lit("/v/")), (c % 4 + 1).cast("int"))
    return _table(spark, d, "orders").select(_s(head, "l", c % 5, "/d", c % 3, "/n", c % 11, ".md").alias("path"))


def path_resolve(spark, d):
    """Where paths lead, through the deepest folder above them that exists."""
    return resolved(path_targets(spark, d), links(spark, d))


def path_facts(spark, d):
    """Repositories of paths: of the nearest root above the real path, a linked one's main one."""
    c = F.col("c_custkey") % 4
    linked = F.when(c == 3, "/real/r0")
    repos = _table(spark, d, "customer").select(_s("/real/r", c).alias("root"), linked.alias("main_root"), _s("git@h:o/r", c).alias("origin_url"), F.when(c == 1, "trunk").alias("base")).distinct()
    return target_facts(path_targets(spark, d), links(spark, d), repos)


def windowed_rates(spark, d):
    """Incidents in windows of seven days of event time."""
    return T.rates(incidents(spark, d)).select("artifact", "signal_type", F.unix_timestamp("start").alias("start"), "incidents", F.round("per_day", 6).alias("per_day"))


def merge_trend(spark, d):
    """Incidents in the days before and after the merges that the ledger has."""
    merged = states(spark, d).withColumn("closed_at", F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("ord") % 29 * 86400 + F.col("ord") % 24 * 3600), "yyyy-MM-dd HH:mm:ss"))
    found = T.trend(incidents(spark, d), T.merges(ledger(spark, d).withColumn("artifact", X.artifact_path("artifact")), merged), days=9)
    return found.select("artifact", "signal_type", "url", F.unix_timestamp("merged_at").alias("merged_at"), "before", "after", F.round("ratio", 6).alias("ratio"))


def hooked(spark, d):
    """A step of one's own over valid proposals, which fails on some: those come back as such."""

    def step(row: dict) -> dict | None:
        if row["id"].endswith("7"):
            raise ValueError("no answer")
        return None if row["confidence"] == "low" else {"id": row["id"], "words": len(row["diagnosis"])}

    made, dead = transform_rows(P.load(proposal_files(spark, d))[0], step, ST.StructType([ST.StructField("id", ST.StringType()), ST.StructField("words", ST.LongType())]), tries=2, wait=0.0)
    return made.withColumn("error", F.lit(None).cast("string")).unionByName(dead.select("id", F.lit(None).cast("long").alias("words"), "error"))


def rate_trend(spark, d):
    """Incidents of each artifact and signal before and after a date."""
    later = F.col("ts") >= "2024-01-15"
    return incidents(spark, d).groupBy("implicated_artifact", "signal_type").agg(F.count_if(~later).alias("before"), F.count_if(later).alias("after"))


@cache
def registry() -> dict[str, Query]:
    own = [turn_numbering, since_filter, transcript_records, excerpt_projection, content_union, block_explode, tool_result_blocks, string_agg_per_turn, transcript_sessions, transcript_incidents, session_meta, artifact_candidates, user_correction, context_window, incidents_union, insert_ignore, signal_summary]
    own += [cluster_gate, cluster_bundle, top_clusters, nested_caps, cluster_index, byte_truncate, artifact_exists, artifact_missing, ledger_parse, proposal_validate, proposal_dedup, plan_status, plan_groups, dedup_gate, pr_messages]
    own += [pr_reconcile, entry_repos, preflight_diff, slug_hash, fnv_hash, project_dirs, artifact_counts, rate_trend, extract_files, incremental_incidents, path_clean, path_resolve, path_facts, windowed_rates, merge_trend, hooked]
    named = {f.__name__: f for f in own}
    named |= {"tool_error": tool_error_incidents, "tool_error_events": _detector(D.failures), "inefficiency_tiers": _detector(D.large_reads), "retry_after_error": _detector(D.retries)}
    named |= {"stratified_sample": _sampled(CLUSTER), "uncapped_sample": _sampled(ClusterConfig(min_sessions=3, max_incidents=0)), "declined_anti_join": _declined(0), "declined_skipped": _declined(1)}
    return reduce(lambda a, k: a | {k: named[k]}, sorted(named), {})
