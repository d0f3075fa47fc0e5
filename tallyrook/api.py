"""The engine's entry points: extract, cluster, assemble, prepare, suggest, reconcile."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ClusterConfig, MineConfig, PlanConfig
from .operators import cluster as C
from .operators import trend as T
from .operators.detectors import detect
from .operators.ledger import reconcile, split_declined
from .operators.paths import target_facts
from .plans import proposals as P
from .plans.render import suggestions
from .sources import documents, sinks
from .sources.files import write_text
from .sources.store import stored
from .sources.transcripts import read_transcripts


def extract(spark: SparkSession, glob: str, out: str, config: MineConfig | None = None, since: str | None = None) -> int:
    """Mine transcripts into the incident table at `out`; returns how many are new. Without
    `since` the marker beside the table counts; it is set to the start of this run at the end."""
    began, marker = datetime.datetime.now(datetime.UTC), f"{out.rstrip('/')}.last-run"
    config = replace(config or MineConfig(), since=sinks.read_marker(spark, marker) if since is None else since)
    with stored(read_transcripts(spark, glob), config) as found:
        n = sinks.insert_or_ignore(detect(found, config), out, found.sessions.select("session_id"), placed=True)
    sinks.write_marker(spark, marker, began)
    return n


def summary(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("signal_type").count().withColumnRenamed("count", "n").orderBy("signal_type")


def cluster(spark: SparkSession, incidents_path: str, index_path: str, ledger_dir: str = "", config: ClusterConfig | None = None, repo: str = "", links: DataFrame | None = None) -> dict[str, int]:
    """Write the clusters' files and index; returns how many were written and left out, and
    where `top` cut, the weakest cluster that stayed. With `repo`, the index has only the
    clusters of artifacts below that folder. `links` (schemas.LINK) tells where paths lead, so
    that declined work is known by any of its paths."""
    config = config or ClusterConfig()
    found = C.clusters(sinks.read_incidents(spark, incidents_path), config).persist()
    try:
        kept, missing = C.with_content(found, documents.read_artifacts(found.select("artifact"), config.max_content_bytes), config)
        skipped = None
        if ledger_dir:
            kept, skipped = split_declined(kept, documents.read_ledger(spark, ledger_dir), links)
        best, cut = C.top(C.capped(kept, config), config.top)
        weakest = C.cutoff(best) if cut else {}
        return weakest | {"written": sinks.write_clusters(C.below(best, repo) if repo else best, index_path), "missing": missing.count(), "declined": skipped.count() if skipped is not None else 0, "cut": cut}
    finally:
        found.unpersist()


def assemble(spark: SparkSession, proposals_dir: str, out: str, ledger_dir: str, date: str | None = None, config: PlanConfig | None = None) -> dict[str, int]:
    good, bad = P.load(documents.read_proposals(spark, proposals_dir))
    good = good.persist()
    sinks.write_rows(good, out)
    new = sinks.append_ledger(good, ledger_dir, date or datetime.date.today().isoformat(), (config or PlanConfig()).pr_placeholder)
    return {"valid": good.count(), "invalid": bad.count(), "new": new}


def facts(proposals: DataFrame, links: DataFrame, repos: DataFrame, out: str, config: PlanConfig | None = None) -> None:
    """Write what is known of the proposals' paths, and of the settings repository: schemas.TARGET_FACT."""
    spark, settings = proposals.sparkSession, (config or PlanConfig()).settings_repo
    paths = proposals.select(F.substring_index("implicated_artifact", "#", 1).alias("path"))
    own = spark.range(1).select(F.lit(settings or None).cast("string").alias("path"))
    sinks.write_rows(target_facts(paths.unionByName(own), links, repos).orderBy("path"), out)


def trend(spark: SparkSession, incidents_path: str, ledger_dir: str, states: DataFrame, out: str, days: int = 14) -> int:
    """Write the incidents in the days before and after each merge that the ledger has, and their
    ratio; states (schemas.PR_CLOSED)."""
    found = T.trend(sinks.read_incidents(spark, incidents_path), T.merges(documents.read_ledger(spark, ledger_dir), states), days).orderBy("merged_at", "url").persist()
    try:
        sinks.write_rows(found, out)
        return found.count()
    finally:
        found.unpersist()


def prepare(proposals: DataFrame, facts: DataFrame, out: str, config: PlanConfig | None = None, open_prs: DataFrame | None = None, ledger: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    plan = P.plan(proposals, facts, config or PlanConfig(), open_prs, ledger, links).persist()
    sinks.write_rows(plan, out)
    return plan


def suggest(plan: DataFrame, proposals: DataFrame, out: str) -> None:
    write_text(plan.sparkSession, out, "".join(suggestions(plan, proposals)))


def reconcile_ledger(spark: SparkSession, ledger_dir: str, states: DataFrame) -> int:
    return sinks.rewrite(reconcile(documents.read_ledger(spark, ledger_dir), states))
