"""Sinks: the incident table, the ledger, cluster files, plans and the marker of the last run."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import fnv1a32, slug_or_hash
from .files import names, read_text, write_new, write_text
from .table import PARTS, LogTable


def incident_table(spark: SparkSession, path: str, parts: int = PARTS) -> LogTable:
    return LogTable(spark, path, schemas.INCIDENT, "incident_id", parts)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incident table; empty before the first insert."""
    return incident_table(spark, path).read()


def first_by_id(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of keys (incident_id): the first by detail, then session and time.
    With session_id among the keys, rows that lie by session stay where they are."""
    order = Window.partitionBy(*(keys or ("incident_id",))).orderBy(*(F.col(c).asc_nulls_last() for c in ("detail", "session_id", "ts")))
    return rows.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def new_rows(rows: DataFrame, there: DataFrame, unique: bool = False) -> DataFrame:
    """What insert-or-ignore would add: rows with an incident_id that is not there, each id once.
    unique: it is known that rows have each id once, as detectors' have. An id is of one session,
    so that rows that lie by session are compared where they are."""
    first = rows if unique else first_by_id(rows, "session_id", "incident_id")
    return first.join(there.select("session_id", "incident_id"), ["session_id", "incident_id"], "left_anti").select(rows.columns)


def insert_or_ignore(incidents: DataFrame, path: str, sessions: DataFrame | None = None, placed: bool = False) -> int:
    """Append incidents whose id the table does not have; returns how many. Only the parts of the
    incidents' sessions are read, and of two runs at once no id comes in twice. placed: incidents
    are detectors', unique and lying by session."""
    return incident_table(incidents.sparkSession, path).add(incidents, lambda rows, there: new_rows(rows, there, placed), sessions, placed)


def read_marker(spark: SparkSession, path: str) -> str:
    return (read_text(spark, path) or "").strip()


def write_marker(spark: SparkSession, path: str, at: datetime.datetime) -> None:
    write_text(spark, path, at.astimezone(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") + "\n")


def _json(rows: list) -> str:
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as one indented JSON array (results of bounded size: plans, proposals)."""
    write_text(rows.sparkSession, path, _json([json.loads(r.j) for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]))


def cluster_files(clusters: DataFrame) -> DataFrame:
    """clusters with `file`, the name of each one's own file."""
    return clusters.withColumn("file", F.concat(F.lit("clusters/"), slug_or_hash("cluster_id"), F.lit("-"), fnv1a32("cluster_id"), F.lit(".json")))


def write_clusters(clusters: DataFrame, index_path: str) -> int:
    """A file for each cluster, and an index that lists them; clusters come one at a time, and none
    is kept. The index is put in place last and whole: what fails before leaves the old one."""
    spark, index = clusters.sparkSession, []
    folder = index_path.rsplit("/", 1)[0] if "/" in index_path else "."
    rows = cluster_files(clusters).select("file", F.to_json(F.struct(*clusters.columns), {"ignoreNullFields": "false"}).alias("j"))
    for row in rows.toLocalIterator():
        c = json.loads(row.j)
        write_text(spark, f"{folder}/{row.file}", _json(c))
        index.append({k: c[k] for k in ("cluster_id", "signal_type", "artifact", "artifact_exists", "distinct_sessions", "total_incidents")} | {"sampled_incidents": len(c["incidents"] or []), "file": row.file})
    write_text(spark, index_path, _json(index))
    return len(index)


def ledger_markdown(p: dict, date: str, placeholder: str) -> str:
    """A new ledger entry of a proposal."""
    signal = [f"**Signal:** {p['signal_type']}  "] if p.get("signal_type") else []
    head = [f"# {p['id']}", "", f"**Artifact:** {p['implicated_artifact']}  ", *signal, f"**Fix type:** {p['fix_type']}  **Confidence:** {p['confidence']}  **Date:** {date}"]
    parts = {"Diagnosis": p["diagnosis"], "Evidence": "\n".join(f"- {e}" for e in p["evidence"]), "Proposed change": f"```\n{p['proposed_change'] or ''}\n```", "Expected effect": p["reason_log"]}
    return "\n".join(head) + "\n\n" + "".join(f"## {k}\n\n{v}\n\n" for k, v in parts.items()) + f"{placeholder}\n\n<!-- outcome: open -->\n"


def append_ledger(proposals: DataFrame, folder: str, date: str, placeholder: str) -> int:
    """One new file a proposal; files that exist stay as they are. Returns how many are new."""
    rows = proposals.withColumn("__slug", slug_or_hash("id")).orderBy("id").toLocalIterator()
    return sum(write_new(proposals.sparkSession, f"{folder.rstrip('/')}/{date}-{r['__slug']}.md", ledger_markdown(r.asDict(), date, placeholder)) for r in rows)


def link_pr(spark: SparkSession, folder: str, proposal_id: str, url: str, placeholder: str) -> None:
    """Put a pull request's link into the entry with this heading, once."""
    for path in names(spark, folder, ".md"):
        text = read_text(spark, path) or ""
        if not text.startswith(f"# {proposal_id}\n"):
            continue
        if re.search(r"\*\*PR:\*\* ", text):
            return
        if placeholder not in text:
            raise ValueError(f"{path} has no place for a link")
        write_text(spark, path, text.replace(placeholder, f"**PR:** {url}", 1))
        return
    raise LookupError(f"no ledger entry {proposal_id!r}")


def rewrite(changed: DataFrame) -> int:
    """Write (path, content) rows back to their files."""
    n = 0
    for row in changed.select("path", "content").toLocalIterator():
        write_text(changed.sparkSession, row.path, row.content)
        n += 1
    return n
