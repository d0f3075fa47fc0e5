"""Proposals: checks, dedup, plan, grouping and the gate against pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import PlanConfig
from ..functions.text import artifact_path, artifact_section, commit_type, slug
from ..operators.paths import with_real

# What a proposal may say.
FIX_TYPES = ("add", "strengthen", "fix-stale", "remove", "escalate-out-of-instructions", "skip")
CONFIDENCES = ("high", "medium", "low")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def error_reason() -> Column:
    """The first thing that is wrong with a proposal; null if nothing is."""
    return (
        F.when(_blank("id"), "missing id").when(_blank("implicated_artifact"), "missing implicated_artifact")
        .when(~F.coalesce(F.col("fix_type").isin(*FIX_TYPES), F.lit(False)), "invalid fix_type").when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "invalid confidence")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "missing evidence").when(_blank("diagnosis"), "missing diagnosis")
        .when(_blank("proposed_change") & (F.col("fix_type") != "skip"), "missing proposed_change").when(_blank("reason_log"), "missing reason_log")
    )


def load(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid proposals, each id once: that of the first path; (path, error) of the others)."""
    flat = files.select("path", F.col("proposal").isNull().alias("broken"), "proposal.*")
    checked = flat.withColumn("error", F.when(F.col("broken"), "not a proposal").otherwise(error_reason()))
    w = Window.partitionBy("id").orderBy("path")
    good = checked.where("error is null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*schemas.PROPOSAL.names).orderBy("id")
    return good, checked.where("error is not null").select("path", "error")


def group_slug(root: Column, file: Column) -> Column:
    """Identity of a file in a repository: readable, and told apart by the root's hash."""
    base = F.substring_index(root, "/", -1)
    below = F.when(file.startswith(F.concat(root, F.lit("/"))), F.substring(file, F.length(root) + 2, F.length(file))).otherwise(F.substring_index(file, "/", -1))
    return F.concat(slug(F.concat(base, F.lit("-"), below)), F.lit("-"), F.substring(F.sha1(root.cast("binary")), 1, 8))


def owner(url: Column, config: PlanConfig) -> Column:
    out = F.lit(config.default_owner)
    for part, name in reversed(config.owners):
        out = F.when(url.contains(part), name).otherwise(out)
    return out


def plan(proposals: DataFrame, facts: DataFrame, config: PlanConfig, open_prs: DataFrame | None = None, ledger: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """schemas.PLAN of proposals. `facts` (schemas.TARGET_FACT) says what is known of the
    artifacts' paths, and of the settings repository under its own path; target_facts() makes
    them. `links` (schemas.LINK) tells where the ledger's paths lead. Statuses are one
    CASE over joined facts; a group's branch prefix is a window over its ready members."""
    f = facts.select(F.col("path").alias("__path"), F.struct(*schemas.TARGET_FACT.names[1:]).alias("f"))
    rows = proposals.withColumn("__path", F.when(F.col("fix_type") == "escalate-out-of-instructions", F.lit(config.settings_repo)).otherwise(F.substring_index("implicated_artifact", "#", 1)))
    rows = rows.join(f, "__path", "left")
    escalates, known = F.col("fix_type") == "escalate-out-of-instructions", F.coalesce(F.col("f.repo_root"), F.lit("")) != ""
    immutable = F.coalesce(F.col("f.real_path").startswith(config.immutable_prefix), F.lit(False))
    status = (
        F.when((F.col("confidence") == "low") & F.lit(not config.include_low_confidence), "skip-low-confidence").when(F.col("fix_type") == "skip", "skip-declined")
        .when(escalates & (F.lit(config.settings_repo == "") | ~known), "skip-unrouted").when(escalates, "ready").when(~known | immutable, "skip-unresolved")
        .when(~F.coalesce(F.col("f.exists"), F.lit(False)) & (F.col("fix_type") != "add"), "skip-missing-file").otherwise("ready")
    )
    rows = rows.withColumn("status", status)
    placed = F.col("status").isin("ready", "skip-missing-file")
    of = lambda c: F.when(placed, c).otherwise("")
    reason = F.when(F.col("status") == "skip-unrouted", F.when(F.lit(config.settings_repo == ""), "no settings repository is set").otherwise("the settings repository cannot be resolved")).otherwise("")
    rows = rows.select(
        F.col("id").alias("proposal_id"), "fix_type", of(F.col("f.repo_root")).alias("repo_root"), of(F.coalesce("f.real_path", "__path")).alias("file_path"), of(artifact_section("implicated_artifact")).alias("section"),
        of(owner(F.coalesce("f.origin_url", F.lit("")), config)).alias("owner"), of(F.coalesce("f.base", F.lit("main"))).alias("base"), "status", reason.alias("reason"),
    )
    rows = with_groups(rows, config)
    return gate(rows, open_prs, ledger, links).select(*schemas.PLAN.names).orderBy("proposal_id")


def with_groups(rows: DataFrame, config: PlanConfig) -> DataFrame:
    """group_id and branch_name of ready rows (repo_root, file_path, fix_type, status); they
    are chore branches if any member escalates."""
    ready = F.col("status") == "ready"
    w = Window.partitionBy("repo_root", "file_path", ready)
    group = F.when(ready, group_slug(F.col("repo_root"), F.col("file_path"))).otherwise("")
    prefix = F.when(F.bool_or(commit_type("fix_type") == "chore").over(w), "chore").otherwise("docs")
    return rows.withColumn("group_id", group).withColumn("branch_name", F.when(ready, F.concat(prefix, F.lit(f"/{config.branch_name}-"), F.col("group_id"))).otherwise(""))


def gate(rows: DataFrame, open_prs: DataFrame | None, ledger: DataFrame | None, links: DataFrame | None = None) -> DataFrame:
    """Ready rows that repeat pending work become skip-duplicate with `supersedes`: an open
    pull request of the branch, else an open ledger entry with a link for the same file and
    section but another proposal. The first of several counts: by number, by path."""
    rows = rows.withColumn("__by_pr", F.lit(None).cast("string")).withColumn("__by_entry", F.lit(None).cast("string"))
    if open_prs is not None:
        told = F.concat(F.lit("open PR #"), F.col("number").cast("string"), F.lit(" ("), F.col("url"), F.lit(")"))
        prs = open_prs.groupBy(F.col("headRefName").alias("branch_name")).agg(F.min_by(told, "number").alias("__pr"))
        rows = rows.join(prs, "branch_name", "left").withColumn("__by_pr", F.col("__pr")).drop("__pr")
    if ledger is not None:
        told = F.concat(F.lit('reason-log entry "'), F.col("id"), F.lit('" (PR '), F.col("pr_url"), F.lit(")"))
        prior = ledger.where("pr_url <> '' and outcome_raw = 'open'").select(artifact_path("artifact").alias("__p"), slug(artifact_section("artifact")).alias("__s"), F.col("id").alias("__id"), F.col("path").alias("__at"), told.alias("__told"))
        prior = with_real(prior, "__p", links)
        same = (F.col("file_path") == F.col("__p")) & (slug("section") == F.col("__s")) & (F.col("proposal_id") != F.col("__id"))
        hits = rows.where("status = 'ready'").join(prior, same).groupBy("proposal_id").agg(F.min_by("__told", "__at").alias("__hit"))
        rows = rows.join(hits, "proposal_id", "left").withColumn("__by_entry", F.col("__hit")).drop("__hit")
    found = F.when(F.col("status") == "ready", F.coalesce("__by_pr", "__by_entry"))
    return rows.withColumn("supersedes", F.coalesce(found, F.lit(""))).withColumn("status", F.when(F.col("supersedes") != "", "skip-duplicate").otherwise(F.col("status")))


def ready_groups(rows: DataFrame) -> DataFrame:
    """Groups of ready rows in the order of their first proposal."""
    return rows.where("status = 'ready'").groupBy("group_id").agg(F.min("proposal_id").alias("first"), F.count("*").alias("proposals")).orderBy("first")
