"""A whole scan as one function of DataFrames: from frames, cues and recognised text to ranked moments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight import config
from cuelight.functions import text
from cuelight.operators import aggregates, cadence, entities, intervals, scoring
from cuelight.sources import recognition
from cuelight.sources.storage import settled


@dataclass(frozen=True)
class Found:
    """What a scan gives: the frames it takes, the detections it keeps, and the moments, scored and ranked."""

    frames: DataFrame
    detections: DataFrame
    moments: DataFrame


def due_frames(
    frames: DataFrame,
    how: config.Scan,
    merged: DataFrame | None = None,
    cuts: DataFrame | None = None,
    gaps_only: bool = False,
) -> DataFrame:
    """The frames that a scan looks at: by step or by least interval, at priority times, and within gaps if asked.

    Captions (merged cues) slow sampling down while somebody speaks and add the pauses as priority times; gaps_only
    keeps frames in dialogue gaps alone, one of each that is shorter than the interval.
    """
    frames = cadence.in_range(frames, how.start, how.end)
    interval = how.mode.seconds()
    adaptive = how.mode.interval is not None and merged is not None
    times = [cuts.select("source", "ts")] if cuts is not None else []
    gaps = None
    if merged is not None and how.end is not None:
        gaps = settled(intervals.dialogue_gaps(merged, how.start, how.end, how.gap, how.padding))
    if gaps_only and gaps is not None:
        times.append(intervals.gap_midpoints(gaps, config.DIALOGUE_INTERVAL if adaptive else interval))
    if adaptive:
        times.append(intervals.quiet_gap_starts(merged, how.start, how.end))
    rows = frames
    if times:
        rows = settled(cadence.with_priorities(frames, intervals.priority_times(how.start, how.end, *times)))
    if how.mode.step is not None:
        marked = rows if times else rows.withColumn("priority", F.lit(False))
        due = cadence.sampled(marked, how.mode.step)
    elif adaptive:
        active = settled(intervals.dialogue_active(rows, merged, "frame_index", how.padding))
        wait = cadence.adaptive_interval(F.col("active"))
        due = cadence.least_interval(active, wait, config.DIALOGUE_INTERVAL)
    else:
        due = cadence.least_interval(rows, interval, interval)
    due = due.select(*frames.columns)
    if gaps_only and merged is not None:
        if gaps is None:  # an open end has no gaps: all that nobody speaks over
            quiet = intervals.dialogue_active(due, merged, "frame_index", how.padding)
            return quiet.where("not active").drop("active")
        due = intervals.first_of_short_gaps(intervals.in_gaps(settled(due), gaps), interval)
    return due.select(*frames.columns)


def scan(
    frames: DataFrame,
    detections: DataFrame,
    vocab: DataFrame,
    how: config.Scan = config.Scan(),
    cues: DataFrame | None = None,
    cuts: DataFrame | None = None,
    gaps_only: bool = False,
) -> Found:
    """Ranked moments of all sources.

    frames(source, frame_index, ts, ...); detections (entities.DETECTION) are what recognition read on frames: those of
    frames that the scan takes count. cues(source, cue_id, start_s, end_s) and cuts(source, ts) may be missing.
    """
    merged = settled(intervals.merge_cues(cues, how.merge_slack)) if cues is not None else None
    due = settled(due_frames(frames, how, merged, cuts, gaps_only))
    taken = due.select("source", "frame_index").distinct()
    kept = recognition.confident(detections, how.floor).join(taken, ["source", "frame_index"], "left_semi")
    interval = how.mode.seconds()
    tracking = config.Tracking.of_scan(interval, how.mode.interval is not None and merged is not None)
    found = entities.group_moments(entities.track_detections(kept, tracking), interval)
    found = settled(found.withColumn("norm", text.normalised(F.col("text"))))
    ratios = None
    if merged is not None:
        times = found.select("source", "ts", "event_id", F.col("source").alias("__source"))
        ratios = intervals.dialogue_free_ratio(times, merged, ["__source", "event_id"], "point_id")
        ratios = ratios.withColumnRenamed("__source", "source")
    rows = scoring.scored(aggregates.moments(found), vocab, ratios, cuts, how.breadth)
    return Found(due, found, scoring.ranked(rows))
