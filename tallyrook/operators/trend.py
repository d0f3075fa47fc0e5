"""How often incidents come: by windows of time, and before and after a change was merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a day.
DAY = 86400


def _time(c: str) -> Column:
    return F.col(c).try_cast("timestamp")


def rates(incidents: DataFrame, width: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(artifact, signal_type, start, end, incidents, per_day) for each window of event time with
    incidents (implicated_artifact, signal_type, ts). In a stream, a window is given out when the
    newest time has passed its end by `delay`, and later rows of it are dropped; rows whose ts is
    no time count nowhere."""
    timed = incidents.select(F.col("implicated_artifact").alias("artifact"), "signal_type", _time("ts").alias("at")).where("at is not null")
    counted = timed.withWatermark("at", delay).groupBy("artifact", "signal_type", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("incidents"))
    days = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / F.lit(DAY)
    return counted.select("artifact", "signal_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "incidents", (F.col("incidents") / days).alias("per_day"))


def merges(entries: DataFrame, states: DataFrame) -> DataFrame:
    """(artifact, signal_type, url, merged_at) of ledger entries whose pull request was merged;
    states (url, state, closed_at)."""
    done = states.where(F.upper("state") == "MERGED").groupBy("url").agg(F.max("closed_at").alias("merged_at"))
    told = entries.where("pr_url <> ''").select(F.substring_index("artifact", "#", 1).alias("artifact"), "signal_type", F.col("pr_url").alias("url")).distinct()
    return told.join(done, "url").select("artifact", "signal_type", "url", _time("merged_at").alias("merged_at")).where("merged_at is not null")


def trend(incidents: DataFrame, merged: DataFrame, days: int = 14) -> DataFrame:
    """(artifact, signal_type, url, merged_at, before, after, ratio): for each merge the incidents of
    its artifact and signal in so many days before it, and from it on, and after / before; null
    where there were none before. An incident counts for each merge that it is near.

    Incidents are summed up by second first, so that what is joined with a hot artifact's merges is
    no more than the seconds that it has incidents in; a key's merges travel as one array, which
    the ledger bounds."""
    timed = incidents.select(F.col("implicated_artifact").alias("artifact"), "signal_type", F.date_trunc("second", _time("ts")).alias("at")).where("at is not null")
    counted = timed.groupBy("artifact", "signal_type", "at").agg(F.count(F.lit(1)).alias("n"))
    known = merged.groupBy("artifact", "signal_type").agg(F.collect_set(F.struct("merged_at", "url")).alias("merges"))
    away = lambda m: F.unix_timestamp(F.col("at")) - F.unix_timestamp(F.date_trunc("second", m["merged_at"]))
    near = F.filter("merges", lambda m: (away(m) >= -days * DAY) & (away(m) < days * DAY))
    found = counted.join(known, ["artifact", "signal_type"]).select("artifact", "signal_type", "n", "at", F.inline(near))
    late = F.col("at") >= F.date_trunc("second", F.col("merged_at"))
    sums = found.groupBy("artifact", "signal_type", "url", "merged_at").agg(F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("a"))
    all_of = merged.select("artifact", "signal_type", "url", "merged_at").distinct().join(sums, ["artifact", "signal_type", "url", "merged_at"], "left")
    before, after = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    return all_of.select("artifact", "signal_type", "url", "merged_at", before.alias("before"), after.alias("after"), F.when(before > 0, after / before).alias("ratio"))
