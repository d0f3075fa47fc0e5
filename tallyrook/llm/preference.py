"""Preference pairs: the common turns once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template that turns are rendered with.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


def _piece(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(BETWEEN), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def _spans(turns: Column, trained: str) -> Column:
    """[start, end) in characters of the rendered turns, of the texts of the trained role
    and the sign that ends them: where the loss counts. The mask is 0 elsewhere."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        size = F.length(_piece(t))
        head = F.length(F.coalesce(t["role"], F.lit(""))) + len(OPEN + BETWEEN)
        span = F.struct((acc["at"] + head).cast("int").alias("start"), (acc["at"] + size).cast("int").alias("end"))
        return F.struct((acc["at"] + size).cast("int").alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each pair of (pair_id, side, turn, role, text), side being 'chosen' or
    'rejected': pair_id, common_turns, prompt, chosen, rejected, and chosen_spans and
    rejected_spans, where the completions' mask is 1.

    The prompt is the longest common prefix of turns, equal in role and text (null equals
    null). Turns go by their number, then role and text; rows that repeat exactly count
    once, so do they in both sides. A side without turns gives a null completion, and the
    prompt is then empty. Null texts and roles render as empty. Rows with a null pair_id
    or side are left out. A conversation is one value of the result, so its turns come
    together in one task; pairs do not.
    """
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, turn)))
    pairs = turns.where("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    index = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
    differ = F.array_position(F.transform(index, same), False).cast("int")
    pairs = pairs.withColumn("common", F.when(differ > 0, differ - 1).otherwise(least))
    rest = lambda s: F.slice(F.col(s), F.col("common") + 1, F.size(s))
    text = lambda a: F.array_join(F.transform(a, _piece), "")
    done = lambda s, x: F.when(F.size(s) > 0, x)
    return pairs.select(
        "pair_id", F.col("common").cast("long").alias("common_turns"), text(F.slice("c", 1, F.col("common"))).alias("prompt"), done("c", text(rest("c"))).alias("chosen"), done("r", text(rest("r"))).alias("rejected"),
        done("c", _spans(rest("c"), trained)).alias("chosen_spans"), done("r", _spans(rest("r"), trained)).alias("rejected_spans"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected of pair k."""
    even = F.pmod("conv_id", F.lit(2)) == 0
    return conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.when(even, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
