"""The ledger of decisions: what was declined, and what became of pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import artifact_path, repo_of_url, with_outcome
from .paths import with_real


def declined_keys(entries: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(artifact, signal_type) of entries that were closed or rejected."""
    told = entries.where("outcome_or_open in ('closed', 'rejected')").select(artifact_path("artifact").alias("artifact"), "signal_type")
    return with_real(told, "artifact", links, existing_only=True).distinct()


def split_declined(clusters: DataFrame, entries: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters to go on with, clusters that were declined before). With `links`, paths that
    exist are compared by where they lead."""
    keys = declined_keys(entries, links).select(F.col("artifact").alias("__artifact"), F.col("signal_type").alias("__signal"))
    rows = with_real(clusters.withColumn("__is", artifact_path("artifact")), "__is", links, existing_only=True)
    same = (F.col("__is") == F.col("__artifact")) & (F.col("signal_type") == F.col("__signal"))
    return tuple(rows.join(keys, same, how).drop("__is") for how in ("left_anti", "left_semi"))


def outcome_of_state(state: str = "state") -> Column:
    s = F.upper(F.col(state))
    return F.when(s == "MERGED", "merged").when(s == "CLOSED", "closed").otherwise("open")


def reconcile(entries: DataFrame, states: DataFrame) -> DataFrame:
    """Entries whose outcome changes by (url, state) rows, with the new outcome and content.
    The last state of a url counts, by `ord` if there is one. Entries without an outcome
    mark stay out, and so do pull requests that are open."""
    ordered = states if "ord" in states.columns else states.withColumn("ord", F.monotonically_increasing_id())
    last = ordered.groupBy("url").agg(F.max_by("state", "ord").alias("state"))
    joined = entries.join(last, entries["pr_url"] == last["url"]).withColumn("outcome", outcome_of_state())
    changed = joined.where("pr_url <> '' and outcome <> 'open' and outcome_raw <> '' and outcome_raw <> outcome")
    return changed.withColumn("content", with_outcome("content", F.col("outcome"))).drop("url", "state")


def entry_repos(entries: DataFrame) -> DataFrame:
    return entries.select(repo_of_url("pr_url").alias("repo")).where("repo <> ''").distinct()
