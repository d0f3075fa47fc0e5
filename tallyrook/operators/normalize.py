"""Transcript lines to ordered records, and records to tool calls, results and text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..config import MineConfig


def _path(value: str, path: str) -> Column:
    return F.get_json_object(value, path)


def number_turns(rows: DataFrame, session: str = "session_id", order: tuple[str, ...] = ("ts", "uuid")) -> DataFrame:
    """rows with `turn`, from 1 in each session, nulls last in the order."""
    w = Window.partitionBy(session).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return rows.withColumn("turn", F.row_number().over(w).cast("long"))


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _blocks_of(message: str) -> Column:
    """The content blocks of a message, null where its content is no array. All are parsed in
    one pass; a block that is no object would make Spark drop the array, so that such blocks
    are read one by one. The text of a message, which is written without spaces, tells first
    whether there may be an array."""
    listed = lambda kind: F.from_json(message, T.StructType([T.StructField("content", T.ArrayType(kind))]))["content"]
    one_by_one = F.transform(listed(T.StringType()), lambda b: F.from_json(b, schemas.BLOCK))
    return F.when(F.col(message).contains('"content":['), F.coalesce(listed(schemas.BLOCK), one_by_one))


def _is_string(message: str, content: str) -> Column:
    """Whether a content that is no array is a string. What could be another value's text is
    looked at in the message."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(message), "$.content", "variant"))
    return F.col(content).isNotNull() & (~F.col(content).rlike(r"^(?:[\[{]|-?[0-9][0-9.eE+-]*$|true$|false$)") | (kind == "STRING"))


def _use(block: Column) -> Column:
    """A call; its input's fields come from one pass over it."""
    given = F.transform(F.array(block["input"]), lambda i: F.when(i.startswith("{"), F.from_json(i, _strings("file_path", "offset", "limit", "subagent_type"))))[0]
    values = [block["id"], block["name"], given["file_path"], given["offset"], given["limit"], given["subagent_type"], block["input"]]
    return F.struct(*(v.alias(n) for v, n in zip(values, schemas.USE.names, strict=True)))


def parsed(raw: DataFrame, config: MineConfig) -> DataFrame:
    """Lines (value, filename) as schemas.RECORD. Lines that are no JSON object or have no
    sessionId fall out. A line is read in one pass, a message's content in another, and what
    detectors need of its blocks is put into columns of its own, so that they read no other."""
    names = ["type", "session_id", "uuid", "ts", "cwd", "sidechain", "message", "tur"]
    top = raw.select("filename", F.json_tuple("value", "type", "sessionId", "uuid", "timestamp", "cwd", "isSidechain", "message", "toolUseResult").alias(*names)).where("session_id is not null")
    top = top.withColumn("blocks", _blocks_of("message")).withColumn("content", F.when(F.col("blocks").isNull(), _path("message", "$.content")))
    string = F.col("blocks").isNull() & _is_string("message", "content")
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    user = F.col("type") == "user"
    uses = F.when(F.col("type") == "assistant", F.transform(of("tool_use"), _use))
    results = F.when(user, F.transform(of("tool_result"), lambda b: F.struct(b["tool_use_id"].alias("tuid"), (b["is_error"] == "true").alias("is_error"))))
    texts = F.when(user, F.when(string, F.array("content")).otherwise(F.transform(of("text"), lambda b: b["text"])))
    file = F.when(F.col("tur").startswith("{"), F.from_json("tur", T.StructType([T.StructField("file", _strings("totalLines", "numLines"))]))["file"])
    rec = top.select(
        "type", "session_id", "uuid", "ts", "cwd", F.coalesce(F.col("sidechain") == "true", F.lit(False)).alias("is_sidechain"), F.substring("message", 1, config.excerpt_chars).alias("excerpt"),
        F.when(F.col("blocks").isNotNull(), "array").when(string, "string").alias("content_kind"), uses.alias("uses"), results.alias("results"), texts.alias("texts"), file.alias("file"), "filename",
    )
    lines = F.coalesce(F.col("file.totalLines").try_cast("bigint"), F.col("file.numLines").try_cast("bigint"), F.lit(0))
    rec = rec.withColumn("total_lines", lines).select(*schemas.RECORD.names)
    return rec.where(F.col("ts") >= config.since) if config.since and config.compat_since else rec


def numbered(rec: DataFrame, config: MineConfig) -> DataFrame:
    """parsed() lines with `turn`, from 1 in each session, and `after_call`: whether one of the
    turns just before has a call. Both come from one pass over each session."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_last(), F.col("uuid").asc_nulls_last())
    near = F.max(F.coalesce(F.size("uses") > 0, F.lit(False))).over(w.rowsBetween(-config.correction_lookback, -1))
    return rec.select("*", F.row_number().over(w).cast("long").alias("turn"), F.coalesce(near, F.lit(False)).alias("after_call"))


def records(raw: DataFrame, config: MineConfig) -> DataFrame:
    return numbered(parsed(raw, config), config)


def tool_uses(rec: DataFrame) -> DataFrame:
    return rec.where(F.size("uses") > 0).select("session_id", "turn", "ts", F.inline("uses"))


def tool_results(rec: DataFrame) -> DataFrame:
    """is_error stays null where a result does not tell it."""
    return rec.where(F.size("results") > 0).select("session_id", "turn", "ts", "total_lines", F.inline("results"))


def user_text(rec: DataFrame) -> DataFrame:
    """Text of user turns: the text blocks joined by spaces in their order, or the string."""
    some = F.exists("texts", lambda t: t.isNotNull())
    return rec.where(F.size("texts") > 0).select("session_id", "turn", "ts", "after_call", F.when(some, F.array_join("texts", " ")).alias("text"))


def session_meta(rec: DataFrame, config: MineConfig) -> DataFrame:
    """A row a session: its first folder that is known, the artifact it implicates and the
    candidates. One shuffle serves both."""
    meta = rec.groupBy("session_id").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("turn"))).alias("cwd"), F.bool_or("is_sidechain").alias("is_subagent"))
    return artifacts(meta, config)


def artifacts(meta: DataFrame, config: MineConfig) -> DataFrame:
    own = F.coalesce(F.concat("cwd", F.lit("/CLAUDE.md")), F.lit(config.global_artifact))
    return meta.withColumn("implicated_artifact", own).withColumn("candidates", F.array(F.lit(config.global_artifact), own))


@dataclass(frozen=True)
class Tables:
    """What detectors read: turns (session_id, turn, type, excerpt) and the tables above. Where
    user_text has no after_call, corrections look for calls in tool_uses. buckets: all lie by
    session in so many, or, if 0, anyhow."""

    turns: DataFrame
    tool_uses: DataFrame
    tool_results: DataFrame
    user_text: DataFrame
    sessions: DataFrame
    buckets: int = 0


def tables(rec: DataFrame, config: MineConfig, buckets: int = 0) -> Tables:
    turns = rec.select("session_id", "turn", "type", "excerpt")
    return Tables(turns, tool_uses(rec), tool_results(rec), user_text(rec), session_meta(rec, config), buckets)
