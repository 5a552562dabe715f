"""Cues, frames, detections, cuts and words derived from the driver's tables, by arithmetic on ids alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of the table that make one second of a source, and the epoch of the first day.
SHRINK = 10_000.0
EPOCH = 1_704_067_200.0
RANGE_END = 260.0

# What detections read, misread variants among them.
TEXTS = (
    "THE HOTEL AND THAT STREET",
    "John Smith for this",
    "J0hn Smlth for this",
    "que para los",
    "X",
    "www.with.com / from",
    "##@@ ~~",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) - F.lit(EPOCH)) / F.lit(SHRINK)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    start = seconds(F.col("ts"))
    return events.select(
        F.col("user_id").alias("source"),
        F.col("event_id").alias("cue_id"),
        start.alias("start_s"),
        (start + F.col("value") / 10).alias("end_s"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event; frame_index is the event's id, unique within a source."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"),
        F.col("event_id").alias("frame_index"),
        seconds(F.col("ts")).alias("ts"),
        F.lit(1920).alias("width"),
        F.lit(1080).alias("height"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    share = lambda k: (i * k % 1000) / F.lit(1000.0)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"),
        i.alias("ord"),
        seconds(F.col("ts")).alias("ts"),
        F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (i % len(TEXTS) + 1).cast("int")).alias("text"),
        share(7919).alias("confidence"),
        F.when(i % 10 != 0, share(104_729)).alias("detector_confidence"),
        (i * 31 % 1600).cast("double").alias("x"),
        (i * 17 % 900).cast("double").alias("y"),
        (20 + i * 13 % 600).cast("double").alias("w"),
        (10 + i * 7 % 90).cast("double").alias("h"),
        F.lit(1920).alias("frame_width"),
        F.lit(1080).alias("frame_height"),
        i.alias("frame_index"),
    )


def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return events.select(F.col("user_id").alias("source"), seconds(F.col("ts")).alias("ts"))


def cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn and a caption's lines: turns of conversations, some in brackets, sung, dashed or mere labels."""
    turn, text = F.col("turn"), F.col("text")
    line = (
        F.when(turn % 4 == 1, F.concat(F.lit("["), F.replace(text, F.lit("]"), F.lit(" ")), F.lit("]")))
        .when((turn % 4 == 2) & (F.col("conv_id") % 3 == 0), F.concat(F.lit("&#9834; "), text))
        .when(turn % 4 == 2, F.concat(F.lit("♪ "), text))
        .when(turn % 4 == 3, F.concat(F.lit("- "), text))
        .otherwise(text)
    )
    line = F.when(F.col("conv_id") % 5 == 0, "<i>Music playing</i>").otherwise(line)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(line, "\n").alias("lines"))


# ---- the same tables in SQL, for oracles ---------------------------------------------------------------------------

_TEXT_CASES = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TEXTS))
_TIME = f"((epoch_us(ts) / 1e6::DOUBLE - {EPOCH}::DOUBLE) / {SHRINK}::DOUBLE)"

SQL = {
    "cues": (
        f"SELECT user_id AS source, event_id AS cue_id, {_TIME} AS start_s, {_TIME} + value / 10 AS end_s "
        "FROM events WHERE event_type IN ('view', 'click')"
    ),
    "frames": f"SELECT user_id AS source, event_id AS frame_index, {_TIME} AS ts FROM events",
    "detections": (
        f"SELECT user_id AS source, event_id AS ord, {_TIME} AS ts, CASE event_id % {len(TEXTS)} {_TEXT_CASES} END AS text, "
        "(event_id * 7919 % 1000) / 1000::DOUBLE AS confidence, "
        "CASE WHEN event_id % 10 <> 0 THEN (event_id * 104729 % 1000) / 1000::DOUBLE END AS detector_confidence, "
        "(event_id * 31 % 1600)::DOUBLE AS x, (event_id * 17 % 900)::DOUBLE AS y, "
        "(20 + event_id * 13 % 600)::DOUBLE AS w, (10 + event_id * 7 % 90)::DOUBLE AS h, "
        "1920 AS frame_width, 1080 AS frame_height, event_id AS frame_index FROM events"
    ),
    "cuts": f"SELECT user_id AS source, {_TIME} AS ts FROM events WHERE event_type = 'signup'",
}
