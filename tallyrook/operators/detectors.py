"""Detectors: each gives events (session_id, turn, ts, signal_type, confidence, detail)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import INTERRUPTED, MineConfig
from ..functions.text import found_in
from .normalize import Tables
from .windows import attach_window


def _events(rows: DataFrame, signal: str, confidence: Column, detail: Column) -> DataFrame:
    return rows.select("session_id", "turn", "ts", F.lit(signal).alias("signal_type"), confidence.alias("confidence"), detail.alias("detail"))


def incidents_of(events: DataFrame, tables: Tables) -> DataFrame:
    """events with an id each, and what is known of their sessions."""
    sessions = tables.sessions.select("session_id", F.col("cwd").alias("project"), "implicated_artifact", "candidates")
    ident = F.md5(F.concat_ws(":", "session_id", F.col("turn").cast("string"), "signal_type"))
    return events.join(sessions, "session_id").withColumn("incident_id", ident)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def calls(tables: Tables, config: MineConfig) -> DataFrame:
    """tool_uses with `results`, the array of what came back, and `again`: whether the same call
    failed within some turns before. One join and one frame serve all detectors of calls."""
    back = tables.tool_results.groupBy("session_id", "tuid").agg(F.collect_list(F.struct("turn", "ts", "is_error", "total_lines")).alias("results"))
    rows = tables.tool_uses.join(back, ["session_id", "tuid"], "left")
    failed = F.coalesce(F.exists("results", lambda r: F.coalesce(r["is_error"], F.lit(False))), F.lit(False))
    w = Window.partitionBy("session_id", "tool", "input_str").orderBy("turn").rangeBetween(-config.retry_window_turns, -1)
    same = F.col("tool").isNotNull() & F.col("input_str").isNotNull()
    return rows.withColumn("again", same & F.coalesce(F.max(failed).over(w), F.lit(False)))


def _event(turn: Column | str, ts: Column | str, signal: str, confidence: Column, detail: Column) -> Column:
    return F.struct(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in (("turn", turn), ("ts", ts), ("signal_type", F.lit(signal)), ("confidence", confidence), ("detail", detail))))


def large_reads(config: MineConfig) -> Column:
    """Whole files of many lines that were read without a range."""
    n = lambda r: r["total_lines"]
    tier = lambda r: F.when(n(r) >= config.high_lines, "high").when(n(r) >= config.medium_lines, "medium").otherwise("low")
    found = F.transform(F.filter("results", lambda r: n(r) >= config.large_file_lines), lambda r: _event("turn", "ts", "inefficiency", tier(r), _json(tool=F.lit("Read"), file_path=F.col("file_path"), total_lines=n(r))))
    return F.when((F.col("tool") == "Read") & F.col("rd_offset").isNull() & F.col("rd_limit").isNull(), found)


def failures(config: MineConfig) -> Column:
    """Results that tell of an error; one without its call is left out."""
    return F.transform(F.filter("results", lambda r: r["is_error"]), lambda r: _event(r["turn"], r["ts"], "tool_error", F.lit("medium"), _json(tool=F.col("tool"), tuid=F.col("tuid"))))


def retries(config: MineConfig) -> Column:
    """The same call again within some turns after one that failed."""
    return F.when(F.col("again"), F.array(_event("turn", "ts", "retry", F.lit("low"), _json(tool=F.col("tool"), input=F.col("input_str")))))


def call_events(tables: Tables, config: MineConfig, *found: Column) -> DataFrame:
    """The events that arrays over calls() hold."""
    empty = F.array().cast("array<struct<turn:bigint,ts:string,signal_type:string,confidence:string,detail:string>>")
    return calls(tables, config).select("session_id", F.inline(F.concat(*(F.coalesce(x, empty) for x in found))))


def user_correction(tables: Tables, config: MineConfig) -> DataFrame:
    """Words of correction, or an interruption, shortly after a call. The text is searched last."""
    said = tables.user_text.where("text is not null")
    if "after_call" in said.columns:
        said = said.where("after_call")
    else:  # a call at turn t answers for the turns t + 1 to t + lookback: an equality join
        near = tables.tool_uses.select("session_id", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + config.correction_lookback)).alias("turn"))
        said = said.join(near, ["session_id", "turn"], "left_semi")
    rows = said.where(found_in(F.lower("text"), config.correction_regex, INTERRUPTED))
    return _events(rows, "user_correction", F.lit("medium"), _json(text=F.substring("text", 1, 200)))


#: By signal: arrays of events over calls, and detectors with a table of their own.
OF_CALLS: dict[str, tuple[Callable[[MineConfig], Column], ...]] = {"inefficiency": (large_reads,), "tool_error": (failures, retries)}
DETECTORS: dict[str, tuple[Callable[[Tables, MineConfig], DataFrame], ...]] = {"inefficiency": (), "tool_error": (), "user_correction": (user_correction,)}


def detect(tables: Tables, config: MineConfig) -> DataFrame:
    """Incidents of all chosen signals with their windows, each id once."""
    chosen = list(dict.fromkeys(s for s in config.signals if s.strip())) or list(DETECTORS)
    unknown = [s for s in chosen if s not in DETECTORS]
    if unknown:
        raise ValueError(f"unknown signal: {', '.join(unknown)}")
    found = [f(config) for s in chosen for f in OF_CALLS.get(s, ())]
    frames = ([call_events(tables, config, *found)] if found else []) + [f(tables, config) for s in chosen for f in DETECTORS[s]]
    events = reduce(DataFrame.unionByName, frames)
    if config.since and not config.compat_since:
        events = events.where(F.col("ts") >= config.since)
    if tables.buckets:  # a union forgets where its rows lie
        events = events.repartition(tables.buckets, "session_id")
    # an event is one for its turn and signal: the first by detail, then time
    events = events.select("session_id", "turn", "signal_type", "detail", "ts", "confidence")
    found = attach_window(events, tables.turns, config.window_before, config.window_after, unique=("signal_type",))
    return incidents_of(found, tables).select(*schemas.INCIDENT.names)
