"""Interval algebra on caption cues: merging, gaps, point lookups and totals, for many sources at once.

Cues are (source, start_s, end_s) in seconds as doubles. Merged cues of a source are disjoint, so the last one that
begins before a time is the only one that can hold it, and the last end is the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.config import gap_length
from cuelight.operators.blocks import running

PADDING = 0.15
SLACK = 0.05


def merge_cues(cues: DataFrame, slack: float = SLACK) -> DataFrame:
    """source, start_s, end_s, n_cues: cues that overlap or nearly touch become one."""
    rows = cues.select("source", "start_s", "end_s", F.col("cue_id").alias("__id"))
    seen = running(rows, "source", "start_s", ["start_s", "end_s", "__id"], {"__end": ("max", F.col("end_s"))})
    opens = F.col("__end").isNull() | (F.col("start_s") > F.col("__end") + slack)
    marked = seen.withColumn("__opens", opens.cast("long"))
    # an island is named by the number of islands opened so far
    counted = running(marked, "source", "start_s", ["start_s", "end_s", "__id"], {"__n": ("sum", F.col("__opens"))})
    island = (F.coalesce("__n", F.lit(0)) + F.col("__opens")).alias("__island")
    return (
        counted.select("source", "start_s", "end_s", island)
        .groupBy("source", "__island")
        .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_cues"))
        .drop("__island")
    )


def dialogue_gaps(
    merged: DataFrame, start: float, end: float, minimum: float = 0.0, padding: float = PADDING
) -> DataFrame:
    """source, start_s, end_s of the breaks between merged cues within [start, end].

    A break counts if it is at least minimum long before padding; what padding leaves must not be empty. Edges of
    the range aren't padded. A source needs a cue to be known at all.
    """
    if end < start:
        raise ValueError("the end must not lie before the start")
    gap_length(minimum)
    low, high, pad = F.lit(float(start)), F.lit(float(end)), F.lit(float(padding))
    near = merged.where(F.col("start_s") < high + pad).select("source", "start_s", "end_s")
    inner = running(near, "source", "start_s", ["start_s"], {"__prev": ("max", F.col("end_s"))})
    inner = inner.where(F.col("end_s") > low - pad).select("source", F.col("start_s").alias("__next"), "__prev")
    tail = near.groupBy("source").agg(F.max("end_s").alias("__prev"))
    outside = merged.select("source").distinct().join(tail, "source", "left")
    every = inner.unionByName(outside.select("source", F.lit(None).cast("double").alias("__next"), "__prev"))
    raw_start = F.greatest(low, F.coalesce("__prev", low))
    raw_end = F.least(high, F.coalesce("__next", high))
    begins = F.greatest(raw_start, F.coalesce(F.col("__prev") + pad, low))
    ends = F.least(high, F.coalesce(F.col("__next") - pad, high))
    return (
        every.where(raw_end - raw_start >= F.lit(float(minimum)))
        .select("source", begins.alias("start_s"), ends.alias("end_s"))
        .where("end_s > start_s")
    )


def quiet_gap_starts(
    merged: DataFrame, start: float = 0.0, end: float | None = None, minimum: float = 0.4
) -> DataFrame:
    """source, ts: a moment after each merged cue that a long enough pause follows."""
    high = F.lit(end).cast("double")
    after = running(
        merged.select("source", "start_s", "end_s"),
        "source",
        "start_s",
        ["start_s"],
        {"__next": ("min", F.col("start_s"))},
        backwards=True,
    ).withColumn("__next", F.coalesce("__next", high))
    quiet = F.col("__next").isNull() | (F.col("__next") - F.col("end_s") >= F.lit(float(minimum)))
    within = (F.col("end_s") >= F.lit(float(start))) & (high.isNull() | (F.col("end_s") <= high))
    return after.where(quiet & within).select("source", (F.col("end_s") + F.lit(0.05)).alias("ts"))


def as_of(points: DataFrame, spans: DataFrame, key: Column, ident: str) -> DataFrame:
    """points with __span: the last span of the source that begins at or before key, or null.

    One pass over the union of both, ordered by time within blocks of a source; no pairs of points and spans are made.
    """
    left = points.select("source", key.alias("__at"), F.lit(1).alias("__side"), F.struct(*points.columns).alias("__row"))
    right = spans.select(
        "source",
        F.col("start_s").alias("__at"),
        F.lit(0).alias("__side"),
        F.struct("start_s", "end_s").alias("__own"),
    )
    both = left.withColumn("__id", F.col(f"__row.{ident}").cast("long")).unionByName(right, allowMissingColumns=True)
    seen = running(both, "source", "__at", ["__at", "__side", "__id"], {"__span": ("max", F.col("__own"))})
    return seen.where("__side = 1").select("__row.*", "__span")


def dialogue_active(points: DataFrame, merged: DataFrame, ident: str, padding: float = PADDING) -> DataFrame:
    """points(source, ts, ...) with active: whether a padded merged cue holds the time."""
    pad = F.lit(float(padding))
    held = as_of(points, merged, F.col("ts") + pad, ident)
    inside = (F.col("__span.start_s") - pad <= F.col("ts")) & (F.col("ts") <= F.col("__span.end_s") + pad)
    return held.withColumn("active", F.coalesce(inside, F.lit(False))).drop("__span")


def dialogue_free_ratio(times: DataFrame, merged: DataFrame, by: list[str], ident: str) -> DataFrame:
    """The share of an entity's distinct times that no cue holds."""
    own = times.select("source", "ts", *by).distinct().withColumn(ident, F.xxhash64("source", "ts", *by))
    return (
        dialogue_active(own, merged, ident)
        .groupBy(*by)
        .agg(F.avg((~F.col("active")).cast("double")).alias("dialogue_free_ratio"))
    )


def in_gaps(frames: DataFrame, gaps: DataFrame, ident: str = "frame_index") -> DataFrame:
    """The frames within a gap, half open at its end, with gap_start and gap_end."""
    held = as_of(frames, gaps, F.col("ts"), ident)
    return held.where(F.col("ts") < F.col("__span.end_s")).select(
        *frames.columns, F.col("__span.start_s").alias("gap_start"), F.col("__span.end_s").alias("gap_end")
    )


def first_of_short_gaps(held: DataFrame, interval: float, ident: str = "frame_index") -> DataFrame:
    """Of the due frames in a gap shorter than the interval the first one, of other gaps all."""
    first = held.groupBy("source", "gap_start").agg(F.min(F.struct("ts", ident)).alias("__first"))
    length = F.col("gap_end") - F.col("gap_start")
    return (
        held.join(first, ["source", "gap_start"])
        .where((length >= F.lit(float(interval))) | (F.col(ident) == F.col(f"__first.{ident}")))
        .drop("__first")
    )


def gap_midpoints(gaps: DataFrame, guarantee: float) -> DataFrame:
    """source, ts: the middle of each gap that isn't longer than the guaranteed interval."""
    return gaps.where(F.col("end_s") - F.col("start_s") <= F.lit(float(guarantee))).select(
        "source", ((F.col("start_s") + F.col("end_s")) / 2).alias("ts")
    )


def priority_times(start: float, end: float | None, *parts: DataFrame) -> DataFrame:
    """All priority times within the range, as often as they come."""
    every = parts[0].select("source", "ts")
    for p in parts[1:]:
        every = every.unionByName(p.select("source", "ts"))
    return every.where((F.col("ts") >= start) & (F.lit(True) if end is None else F.col("ts") <= end))


def gap_totals(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.count("*").alias("n_gaps"), F.coalesce(F.sum(F.col("end_s") - F.col("start_s")), F.lit(0.0)).alias("seconds")
    )
