"""Caption files: finding them beside a video, reading them, and their cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions.text import any_dialogue, caption_time, decoded
from cuelight.operators.intervals import dialogue_gaps, merge_cues
from cuelight.sources.storage import settled

# How SRT and VTT files write times, and the languages looked for.
_TIME = r"(?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{3}"
_TIMING = rf"({_TIME})\s*-->\s*({_TIME})"
LANGUAGES = ("en", "eng", "english", "es", "spa", "spanish")


def read(spark: SparkSession, path: str) -> DataFrame:
    """source (the file's path) and content of SRT and VTT files."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source"), F.col("value").alias("content")
    )
    return files.where(F.lower("source").rlike(r"\.(srt|vtt)$"))


def blocks(files: DataFrame) -> DataFrame:
    """source, cue_id, start_s, end_s, lines of every timed block; heads, notes, styles and regions are none."""
    clean = F.regexp_replace("content", "^﻿", "")
    clean = F.regexp_replace(clean, "\r\n?", "\n")
    parts = files.select("source", F.posexplode(F.split(clean, r"\n\s*\n")).alias("cue_id", "block"))
    parts = parts.select("source", F.col("cue_id").cast("long"), F.split("block", "\n").alias("all"))
    parts = parts.where(~F.upper(F.trim(F.col("all")[0])).rlike("^(NOTE|STYLE|REGION|WEBVTT)"))
    place = F.array_position(F.transform("all", lambda x: x.rlike(_TIMING)), True)
    timed = parts.withColumn("at", place.cast("int")).where("at > 0")
    line = F.get("all", F.col("at") - 1)
    return timed.select(
        "source",
        "cue_id",
        caption_time(F.regexp_extract(line, _TIMING, 1)).alias("start_s"),
        caption_time(F.regexp_extract(line, _TIMING, 2)).alias("end_s"),
        F.slice("all", F.col("at") + 1, F.size("all")).alias("lines"),
    )


def cues(timed: DataFrame) -> DataFrame:
    """The cues in which something is said."""
    rows = timed.where("end_s > start_s").withColumn("__said", decoded(F.col("lines")))
    return rows.where(any_dialogue(F.col("__said"), bare=True)).select("source", "cue_id", "start_s", "end_s")


def statistics(timed: DataFrame) -> DataFrame:
    """How many timed blocks each file has, and how many of those with a length say nothing."""
    rows = timed.withColumn("__said", decoded(F.col("lines")))
    silent = (F.col("end_s") > F.col("start_s")) & ~any_dialogue(F.col("__said"), bare=True)
    return rows.groupBy("source").agg(
        F.count("*").alias("total_cues"), F.count_if(silent).alias("non_dialogue_cues")
    )


def gaps(spark: SparkSession, path: str, start: float, end: float, minimum: float = 1.0) -> DataFrame:
    """The dialogue gaps of caption files: source, start_s, end_s. Every file needs a timed cue."""
    files = read(spark, path)
    require_cues(files)
    timed = blocks(files)
    merged = settled(merge_cues(cues(timed)))
    # a file in which nothing is said is one gap
    silent = timed.select("source").distinct().join(merged.select("source").distinct(), "source", "left_anti")
    whole = silent.select("source", F.lit(float(start)).alias("start_s"), F.lit(float(end)).alias("end_s"))
    long_enough = whole.where(F.col("end_s") - F.col("start_s") >= F.lit(float(minimum))).where("end_s > start_s")
    return dialogue_gaps(merged, start, end, minimum).unionByName(long_enough)


def require_cues(files: DataFrame) -> None:
    """An error if a file has no timed cue; names at most ten."""
    empty = files.select("source").join(blocks(files).select("source").distinct(), "source", "left_anti").limit(10)
    names = [r["source"] for r in empty.collect()]
    if names:
        raise ValueError(f"no timed caption cues in {', '.join(names)}")


def sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """The caption file of each video: videos(video, folder, stem), files(folder, name).

    A file of the video's own stem comes first (SRT before VTT), then files whose stem goes on with a separator:
    those with a language word before others, then by name.
    """
    name = F.lower("name")
    caption = files.where(name.rlike(r"\.(srt|vtt)$")).select(
        "folder", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("__stem"), F.right(name, F.lit(3)).alias("__kind")
    )
    both = videos.join(caption, "folder")
    low, own = F.lower("__stem"), F.lower("stem")
    exact = (F.col("__stem") == F.col("stem")) & F.col("name").rlike(r"\.(srt|vtt)$")
    rest = F.expr("substring(__stem, length(stem) + 1)")
    near = low.startswith(own) & ((rest == "") | rest.rlike(r"^[ ._\-(\[]"))
    tokens = F.split(F.lower(rest), r"[ ._\-()\[\]]+")
    known = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in LANGUAGES]))
    order: Column = F.when(exact & (F.col("__kind") == "srt"), 0).when(exact, 1).when(known, 2).otherwise(3)
    ranked = both.where(exact | near).select("video", F.struct(order.alias("o"), name.alias("n"), F.col("name")).alias("r"))
    return ranked.groupBy("video").agg(F.min("r").alias("r")).select("video", F.col("r.name").alias("caption"))
