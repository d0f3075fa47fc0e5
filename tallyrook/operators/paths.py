"""Paths and what is known of them: links, folders that exist, and repositories.

The file system is a table: `links` (path, real_path) has a row for each path that exists, with
the place it leads to; real_path is null where a link leads nowhere. `repos` (schemas.REPO) has a
row for each checkout. Both are read by the caller, and joined here by equality: a path is looked
up as itself and as each of its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean_path


def ancestors(path: Column) -> Column:
    """(at, rest, depth) of a cleaned path and of each folder above it: `at` joined with `rest` is
    the path. The deepest is the path itself, with an empty rest."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    head = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    at = lambda k: F.when(rooted, F.concat(F.lit("/"), head(k))).otherwise(F.when(k == 0, ".").otherwise(head(k)))
    rest = lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts) - k), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(at(k).alias("at"), rest(k).alias("rest"), k.alias("depth")))


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(rest == "", folder).otherwise(F.concat(F.when(folder == "/", "").otherwise(folder), F.lit("/"), rest))


def resolved(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, real_path, there) for each distinct path: where it leads, if it exists; else where
    the deepest folder above it that exists leads, with the rest behind it. real_path is null
    for a link that leads nowhere, and where no folder above exists."""
    wanted = paths.select("path").where("path is not null").distinct().select("path", F.explode(ancestors(clean_path("path"))).alias("a"))
    known = links.groupBy(clean_path("path").alias("at")).agg(F.max("real_path").alias("real"))
    tried = wanted.select("path", "a.*").withColumn("itself", F.col("rest") == "").join(known.withColumn("known", F.lit(True)), "at", "left")
    usable = F.col("known") & (F.col("itself") | F.col("real").isNotNull())
    best = tried.groupBy("path").agg(F.max_by(F.struct("real", "rest", "itself"), F.when(usable, F.col("depth"))).alias("b"))
    return best.select("path", _joined(F.col("b.real"), F.col("b.rest")).alias("real_path"), F.coalesce(F.col("b.itself"), F.lit(False)).alias("there"))


def with_real(rows: DataFrame, column: str, links: DataFrame | None, existing_only: bool = False) -> DataFrame:
    """rows whose path in a column is replaced by the real one, where it is known; of paths that
    don't exist, only with `existing_only` false. Paths that can't be resolved are cleaned."""
    if links is None:
        return rows.withColumn(column, clean_path(column))
    found = resolved(rows.select(F.col(column).alias("path")), links)
    found = found.where("there") if existing_only else found
    joined = rows.join(found.select(F.col("path").alias("__path"), F.col("real_path").alias("__real")), F.col(column) == F.col("__path"), "left")
    return joined.withColumn(column, F.coalesce("__real", clean_path(column))).drop("__path", "__real")


def target_facts(paths: DataFrame, links: DataFrame, repos: DataFrame) -> DataFrame:
    """schemas.TARGET_FACT of paths: their real path, whether they exist, and the repository whose
    root is the nearest folder above the real path. A linked checkout stands for its main one."""
    found = resolved(paths, links)
    above = found.where("real_path is not null").select("path", F.explode(ancestors(F.col("real_path"))).alias("a")).select("path", "a.at", "a.depth")
    roots = repos.select(F.col("root").alias("at"), F.struct(F.coalesce("main_root", "root").alias("repo_root"), "origin_url", F.coalesce("base", F.lit("main")).alias("base")).alias("repo"))
    nearest = above.join(roots, "at").groupBy("path").agg(F.max_by("repo", "depth").alias("repo"))
    facts = found.join(nearest, "path", "left")
    told = {"path": F.col("path"), "real_path": F.col("real_path"), "exists": F.col("there") & F.col("real_path").isNotNull(), "repo_root": F.coalesce("repo.repo_root", F.lit("")), "origin_url": F.col("repo.origin_url"), "base": F.col("repo.base")}
    return facts.select(*(told[c].alias(c) for c in schemas.TARGET_FACT.names))
