"""Transcript windows around events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_window(events: DataFrame, turns: DataFrame, before: int = 3, after: int = 4, unique: tuple[str, ...] = ()) -> DataFrame:
    """events (session_id, turn, ...) with `window`: the turns from `before` turns earlier to
    `after` turns later, in order, null where there are none. Of a turn's events that are equal
    in the `unique` columns, only the first by the other ones stays.

    A window belongs to a turn, whose events are put together first. Each turn with events then
    goes to the turns it needs, which makes the join one by equality; its events go with its own
    turn only. So events are computed once, only turns near an event are gathered, and where both
    lie by session, as in the record store, no turn is moved."""
    others = [c for c in events.columns if c not in ("session_id", "turn", *unique)]
    listed = F.array_sort(F.collect_list(F.struct(*unique, *others)))
    if unique:
        differs = lambda a, b: ~F.struct(*(a[c] for c in unique)).eqNullSafe(F.struct(*(b[c] for c in unique)))
        listed = F.transform(F.array(listed), lambda e: F.filter(e, lambda x, i: (i == 0) | differs(x, F.get(e, i - 1))))[0]
    by_turn = events.groupBy("session_id", "turn").agg(listed.alias("__events"))
    near = F.transform(F.sequence(F.col("turn") - before, F.col("turn") + after), lambda t: F.struct(t.alias("__near"), F.when(t == F.col("turn"), F.col("__events")).alias("__events")))
    wanted = by_turn.select("session_id", "turn", F.inline(near))
    told = turns.select("session_id", F.col("turn").alias("__near"), F.struct("turn", "type", "excerpt").alias("__told"))
    found = wanted.join(told, ["session_id", "__near"], "left").groupBy("session_id", "turn")
    found = found.agg(F.array_sort(F.array_distinct(F.collect_list("__told"))).alias("window"), F.flatten(F.collect_list("__events")).alias("__events"))
    return found.select("session_id", "turn", F.when(F.size("window") > 0, F.col("window")).alias("window"), F.inline("__events")).select(*events.columns, "window")
