"""Incidents to clusters: artifact by signal, gated, sampled in turn over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ClusterConfig
from ..functions.text import canonical_artifact, confidence_rank, truncate_bytes
from .ranking import ranked


def exploded(incidents: DataFrame) -> DataFrame:
    """A row for each incident and artifact, worktree copies as the repository's file."""
    return incidents.withColumn("artifact", F.explode(F.array_distinct(F.transform("candidates", canonical_artifact))))


def gate(rows: DataFrame, min_sessions: int) -> DataFrame:
    found = rows.groupBy("artifact", "signal_type").agg(F.count_distinct("session_id").alias("distinct_sessions"), F.count_distinct("incident_id").alias("total_incidents"))
    return found.where(F.col("distinct_sessions") >= min_sessions)


def sample(rows: DataFrame, gated: DataFrame, cap: int) -> DataFrame:
    """The first `cap` incidents of each cluster (all, if cap is 0 or less) with `pick`, in
    turn over sessions: each session's best before any one's second. Each session is cut
    to `cap` before the cluster's order is made, so a cluster of a third of all rows needs
    its own order only over what can be picked. Without a cap, both orders are made by ranges,
    so that no task orders a whole session or cluster."""
    strength = [confidence_rank("confidence").desc(), F.col("ts").asc_nulls_last(), F.col("incident_id")]
    found = rows.join(gated, ["artifact", "signal_type"])
    if cap <= 0:
        inner = ranked(found, ["artifact", "signal_type", "session_id"], strength, "rn_in_session")
        return ranked(inner, ["artifact", "signal_type"], [F.col("rn_in_session"), *strength], "pick")
    inner = Window.partitionBy("artifact", "signal_type", "session_id").orderBy(*strength)
    best = found.withColumn("rn_in_session", F.row_number().over(inner)).where(F.col("rn_in_session") <= cap)
    outer = Window.partitionBy("artifact", "signal_type").orderBy("rn_in_session", *strength)
    return best.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= cap)


def clusters(incidents: DataFrame, config: ClusterConfig) -> DataFrame:
    """(cluster_id, signal_type, artifact, distinct_sessions, total_incidents, incidents). Without
    a cap on a cluster's sample its row has what its file may have, max_incidents_per_cluster;
    all others can be had from sample(), a row each."""
    rows = exploded(incidents)
    cap = config.max_incidents if config.max_incidents > 0 else config.max_incidents_per_cluster
    picked = sample(rows, gate(rows, config.min_sessions), cap)
    fields = ["incident_id", "session_id", "ts", "confidence", "detail", "window"]
    grouped = picked.groupBy("artifact", "signal_type", "distinct_sessions", "total_incidents").agg(F.array_sort(F.collect_list(F.struct("pick", *fields))).alias("i"))
    listed = F.transform("i", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return grouped.select(F.concat_ws("::", "signal_type", "artifact").alias("cluster_id"), "signal_type", "artifact", "distinct_sessions", "total_incidents", listed.alias("incidents"))


def with_content(found: DataFrame, contents: DataFrame, config: ClusterConfig) -> tuple[DataFrame, DataFrame]:
    """(clusters whose artifact is among contents (artifact, content), with that content;
    the others)."""
    kept = found.join(contents, "artifact").withColumn("artifact_content", truncate_bytes("content", config.max_content_bytes, config.truncation_mark)).withColumn("artifact_exists", F.lit(True)).drop("content")
    return kept, found.join(contents, "artifact", "left_anti")


def capped(found: DataFrame, config: ClusterConfig) -> DataFrame:
    """Nested caps: the first incidents, their last turns, and the excerpts' bytes."""
    n = config.max_window_turns
    turn = lambda t: F.struct(t["turn"].alias("turn"), t["type"].alias("type"), truncate_bytes(t["excerpt"], config.max_excerpt_bytes, config.truncation_mark).alias("excerpt"))
    window = lambda w: F.transform(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), turn)
    cut = F.transform(F.slice("incidents", 1, config.max_incidents_per_cluster), lambda i: i.withField("window", window(i["window"])))
    return found.withColumn("incidents", cut)


def top(found: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(the n strongest clusters, how many are left out); all in their order for n <= 0."""
    many = found.count() if n > 0 else 0
    if n <= 0 or many <= n:
        return found.orderBy(F.desc("distinct_sessions"), "artifact", "signal_type"), 0
    return found.orderBy(F.desc("distinct_sessions"), F.desc("total_incidents"), "cluster_id").limit(n), many - n


def cutoff(best: DataFrame) -> dict[str, int]:
    """Sessions and incidents of the weakest of the clusters that top() kept."""
    last = best.select("distinct_sessions", "total_incidents", "cluster_id").orderBy("distinct_sessions", "total_incidents", F.desc("cluster_id")).first()
    return {"cutoff_sessions": last["distinct_sessions"], "cutoff_incidents": last["total_incidents"]} if last else {}


def below(found: DataFrame, folder: str) -> DataFrame:
    """The clusters whose artifact lies below a folder."""
    return found.where(F.col("artifact").startswith(folder.rstrip("/") + "/"))


def index(found: DataFrame) -> DataFrame:
    return found.select("cluster_id", "signal_type", "artifact", "artifact_exists", "distinct_sessions", "total_incidents", F.size("incidents").alias("sampled_incidents"))
