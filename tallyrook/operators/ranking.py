"""Row numbers in groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`, the place from 1 of each in its group by `order`, which must tell all rows
    of a group apart. Rows are dealt out by ranges of keys and order, so that a group of a third
    of all rows is many tasks' work, and written once: the numbers of rows before each task's
    part of a group, one for each such part, are summed up and joined to what was written."""
    plain = rows.columns
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(dealt.select(*plain, F.monotonically_increasing_id().alias("__at")).withColumn("__task", F.shiftright("__at", 33)), "ranked")
    parts = placed.groupBy("__task", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__task", *(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), "__first", before.alias("__before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    joined = placed.withColumnRenamed("__task", "__of").join(parts, (F.col("__of") == F.col("__task")) & same)
    return joined.select(*plain, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int").alias(name))
