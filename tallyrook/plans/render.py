"""Texts about a plan: suggestions, and titles and bodies of pull requests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOUBLY_TYPED, TYPED_SUBJECT, commit_type, first_line


def title(summary: Column, diagnosis: Column, fix_type: Column) -> Column:
    s = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(first_line(diagnosis))
    return F.when(s.rlike(TYPED_SUBJECT), s).otherwise(F.concat(commit_type(fix_type), F.lit(": "), s))


def _lines(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in parts))


def messages(plan: DataFrame, proposals: DataFrame, results: DataFrame) -> DataFrame:
    """(group_id, branch_name, items, title, body, files_changed) of each ready group, from
    what editors applied (id, applied, files_changed, summary). A group that no editor has
    worked on is left out; one of which only a part has a proposal and an editor's result
    is an error."""
    known = proposals.withColumnRenamed("id", "proposal_id").drop("reason").withColumn("known", F.lit(True))
    edited = results.withColumnRenamed("id", "proposal_id").drop("reason").withColumn("edited", F.lit(True))
    item = plan.where("status = 'ready'").join(known, "proposal_id", "left").join(edited, "proposal_id", "left")
    said = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(first_line("diagnosis"))
    block = _lines("What is wrong: ", F.col("diagnosis"), "\n\nSeen in: ", F.array_join("evidence", "; "), "\n\nWhy this helps: ", F.col("reason_log"), "\n\n(", F.col("proposal_id"), ", ", F.col("fix_type"), ")\n")
    one = F.struct(F.col("proposal_id").alias("id"), block.alias("block"), said.alias("said"), title(F.col("summary"), F.col("diagnosis"), F.col("fix_type")).alias("title"))
    applied = lambda x: F.collect_list(F.when(F.col("applied"), x))
    lost = F.array_sort(F.collect_list(F.when(F.col("known").isNull() | F.col("edited").isNull(), F.col("proposal_id"))))
    g = item.groupBy("group_id", "branch_name", "file_path").agg(F.array_sort(applied(one)).alias("i"), F.array_sort(F.array_distinct(F.flatten(applied(F.col("files_changed"))))).alias("files_changed"), lost.alias("lost"), F.count("edited").alias("n"))
    refused = F.raise_error(F.concat(F.lit("no proposal or no editor's result of "), F.array_join("lost", ", ")))
    g = g.where("n > 0").withColumn("i", F.when(F.size("lost") == 0, F.col("i")).otherwise(refused)).where(F.size("i") > 0)
    name, many = F.substring_index("file_path", "/", -1), F.size("i")
    blocks = F.array_join(F.transform("i", lambda x: _lines("\n", x["said"], "\n\n", x["block"])), "\n")
    group_title = F.concat(F.substring_index("branch_name", "/", 1), F.lit(": apply "), many.cast("string"), F.lit(" proposals to "), name)
    group_body = _lines("Changes to ", name, " by ", F.array_join(F.transform("i", lambda x: x["id"]), ", "), ".\n", blocks)
    return g.select("group_id", "branch_name", many.alias("items"), F.when(many == 1, F.col("i")[0]["title"]).otherwise(group_title).alias("title"), F.when(many == 1, F.col("i")[0]["block"]).otherwise(group_body).alias("body"), "files_changed")


def doubled_titles(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("title").rlike(DOUBLY_TYPED))


def unreported_files(changed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files of a diff that no editor reported; none if nothing was reported at all."""
    left = changed.where("file <> ''").join(allowed, "file", "left_anti")
    return left.join(allowed.limit(1).select(F.lit(1).alias("some")), how="left_semi")


def overview(plan: DataFrame, proposals: DataFrame) -> DataFrame:
    """(held, key, proposals, text): a paragraph for each branch that is ready, with its
    proposals, and one for each other status with those it holds back and why."""
    known = proposals.select(F.col("id").alias("proposal_id"), "fix_type", "confidence", "diagnosis", "proposed_change", F.lit(True).alias("known")).dropDuplicates(["proposal_id"])
    change = F.regexp_replace(F.coalesce("proposed_change", F.lit("")), "(?m)^", "    ")
    told = _lines("* ", F.col("proposal_id"), " (", F.col("fix_type"), ", confidence ", F.col("confidence"), "): ", F.col("diagnosis"), "\n\n", change, "\n")
    told = F.when(F.col("known"), told).otherwise(_lines("* ", F.col("proposal_id"), ": not among the proposals\n"))
    ready = plan.where("status = 'ready'").join(known, "proposal_id", "left").groupBy("branch_name", "repo_root", "file_path", "owner", "base").agg(F.array_sort(F.collect_list(F.struct("proposal_id", told.alias("told")))).alias("p"))
    head = _lines(F.col("branch_name"), " -> ", F.col("base"), "\n", F.col("file_path"), " in ", F.col("repo_root"), ", owned by ", F.col("owner"), "\n\n")
    branches = ready.select(F.lit(False).alias("held"), F.col("branch_name").alias("key"), F.size("p").alias("proposals"), F.concat(head, F.array_join(F.transform("p", lambda x: x["told"]), "\n")).alias("text"))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    why = F.when(~none("supersedes"), _lines(" for ", F.col("supersedes"))).when(~none("reason"), _lines(", ", F.col("reason"))).otherwise("")
    held = plan.where("status <> 'ready'").groupBy("status").agg(F.array_sort(F.collect_list(F.struct("proposal_id", why.alias("why")))).alias("p"))
    listed = F.array_join(F.transform("p", lambda x: _lines("* ", x["proposal_id"], x["why"], "\n")), "")
    return branches.unionByName(held.select(F.lit(True).alias("held"), F.col("status").alias("key"), F.size("p").alias("proposals"), _lines("Held back as ", F.col("status"), "\n\n", listed).alias("text")))


def suggestions(plan: DataFrame, proposals: DataFrame) -> Iterator[str]:
    """The overview as text, a paragraph at a time, what is ready first."""
    for r in overview(plan, proposals).orderBy("held", "key").toLocalIterator():
        yield f"{r['text']}\n"
