"""Telemetry: counter deltas, totals, the summary filter and log analytics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEARTBEAT_S = 3600
#: Numbers of seq in a chunk; a group holds the stretches that begin in one chunk.
CHUNK = 20_000


def counter_delta(samples: DataFrame, key: str, order: str, counters: list[str]) -> DataFrame:
    """Adds d_<counter>: growth since the sample before, 0 for the first and where the counter fell."""
    w = W.partitionBy(key).orderBy(order)
    for c in counters:
        samples = samples.withColumn(f"d_{c}", F.greatest(F.col(c) - F.lag(c, 1).over(w), F.lit(0)))
        samples = samples.withColumn(f"d_{c}", F.coalesce(f"d_{c}", F.lit(0)))
    return samples


def totals(ticks: DataFrame, *by: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("kind") == k)
    return ticks.groupBy(*by).agg(
        kind("drain").alias("drains"), kind("poll").alias("polls"), kind("baseline").alias("baselines"), kind("resync").alias("resyncs"), F.sum("records").alias("records"), F.sum("events").alias("events")
    )


def heartbeat(ticks: DataFrame, level: str = "full", gap_s: int = HEARTBEAT_S, chunk: int = CHUNK) -> DataFrame:
    """ticks(root, seq, at_s, kind, events): the lines that a level keeps.

    summary drops drains without events that come within gap_s of the root's last kept line. Informative
    lines are kept whatever came before, so a line depends only on the stretch that the last informative line
    began. That line is found in two passes: the last one of every `chunk` numbers of seq, then the last one
    within the chunk. A group holds the stretches that begin in one chunk, so one root's log is many groups.
    Only a stretch without informative lines is walked by one task, in steps of its kept lines.
    """
    level = (level or "").strip().lower()
    if level == "off":
        return ticks.where("false")
    if level != "summary":
        return ticks
    cut = ticks.withColumn("_sure", (F.col("kind") != "drain") | (F.col("events") > 0)).withColumn("_chunk", F.floor(F.col("seq") / chunk))
    sure = F.when(F.col("_sure"), F.col("seq"))
    ends = cut.groupBy("root", "_chunk").agg(F.max(sure).alias("_end"))
    before = W.partitionBy("root").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("root", "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    within = W.partitionBy("root", "_chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    begun = cut.withColumn("_here", F.last(sure, ignorenulls=True).over(within)).join(ends, ["root", "_chunk"])
    grouped = begun.withColumn("_from", F.coalesce("_here", "_before")).withColumn("_group", F.floor(F.col("_from") / chunk))

    columns = ticks.columns

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        at, begin = pdf["at_s"].to_numpy(), pdf["_from"].fillna(-1).to_numpy()
        cuts = np.flatnonzero(np.append(True, begin[1:] != begin[:-1])).tolist()
        kept = []
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            # the first line is informative, or the first of the root
            while lo < hi:
                kept.append(lo)
                far = np.flatnonzero(at[lo:hi] - at[lo] >= gap_s)
                lo = lo + int(far[0]) if len(far) else hi
        return pdf.iloc[kept][columns]

    return grouped.drop("_sure", "_chunk", "_here", "_before").groupBy("root", "_group").applyInPandas(walk, ticks.schema)


def keep_level(samples: DataFrame, level: str, last_kept=None) -> DataFrame:
    """samples(root, ts, kind, events, ...) of one tick that a level keeps; an unknown level keeps all.

    last_kept (root, at): when each root's last line was written; a root without one keeps its line.
    """
    level = (level or "").strip().lower()
    if level == "off":
        return samples.where("false")
    if level != "summary" or last_kept is None:
        return samples
    old = last_kept.select(F.upper("root").alias("_r"), F.col("at").alias("_at"))
    quiet = (F.col("kind") == "drain") & (F.col("events") == 0) & (F.unix_micros("ts") - F.unix_micros("_at") < HEARTBEAT_S * 1_000_000)
    return samples.join(old, F.upper("root") == F.col("_r"), "left").where(~F.coalesce(quiet, F.lit(False))).drop("_r", "_at")


#: Counters that a line gives as growth over the tick, clamped or not, and those that it gives as they are.
GROWTH, CLAMPED, LEVEL_COUNTERS = ("alloc", "gc0", "gc1", "gc2"), ("ioR", "ioW"), ("ws", "priv", "handles", "threads")


def stats_line(samples: DataFrame) -> DataFrame:
    """(root, month, value): one compact JSON line per unit of work.

    samples: ts, kind, root, elapsed_ms, records, journal_bytes, events, trigger, and the process counters before and after
    as structs. Milliseconds have one digit, half to even; a trigger of 0 is left out, counters that fell count as 0 growth
    where they are input and output.
    """
    rise = lambda c: F.col(f"after.{c}") - F.col(f"before.{c}")
    body = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z")).alias("ts"), "kind", "root", F.bround("elapsed_ms", 1).alias("elapsedMs"), "records",
        F.col("journal_bytes").alias("journalBytes"), "events", F.nullif("trigger", F.lit(0)).alias("trigger"), F.bround(rise("cpuMs"), 1).alias("cpuMs"),
        F.col("after.ws").alias("ws"), F.col("after.priv").alias("priv"), *(rise(c).alias(c) for c in GROWTH), *(F.greatest(rise(c), F.lit(0)).alias(c) for c in CLAMPED),
        F.col("after.handles").alias("handles"), F.col("after.threads").alias("threads"),
    )
    return samples.select("root", F.date_format("ts", "yyyy-MM").alias("month"), F.to_json(body).alias("value"))


def summary_line(ticks: DataFrame, ts: Column, uptime_s: Column, counters: dict[str, Column]) -> DataFrame:
    """The closing line of a run: totals of all its ticks and the process counters as they are."""
    t = totals(ticks)
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    body = F.struct(
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z")).alias("ts"), F.lit("summary").alias("kind"), F.bround(uptime_s, 0).cast("long").alias("uptimeSec"),
        *(number(c).alias(c) for c in ("drains", "polls", "baselines", "resyncs", "records", "events")),
        F.bround(counters["cpuMs"], 1).alias("cpuMs"), *(counters[c].alias(c) for c in LEVEL_COUNTERS),
    )
    return t.select(F.date_format(ts, "yyyy-MM").alias("month"), F.to_json(body).alias("value"))


def drain_totals(ticks: DataFrame, *by: str, header: int = 8, record: int = 100) -> DataFrame:
    """Per group: units of work, records, payload bytes (reads less their header) and events."""
    t = ticks.groupBy(*by).agg(F.count("*").alias("n"), F.sum("records").alias("records"), F.sum("events").alias("events"))
    return t.select(*by, "n", "records", (F.col("records") * record - header * F.col("n")).alias("payload"), "events")


def events_by_type(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by, "type").count().withColumnRenamed("count", "n")


def churn(samples: DataFrame, ring_bytes: Column) -> DataFrame:
    """samples(root, at_s, next_usn): bytes a day, and hours that a ring of ring_bytes holds."""
    g = samples.groupBy("root").agg(F.min("at_s").alias("t0"), F.max("at_s").alias("t1"), F.min("next_usn").alias("u0"), F.max("next_usn").alias("u1"))
    rate = (F.col("u1") - F.col("u0")) * 86400.0 / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
    return g.select("root", rate.alias("bytes_per_day"), (ring_bytes * 24.0 / F.nullif(rate, F.lit(0.0))).alias("ring_hours"))
