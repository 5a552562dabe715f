"""What an event or moment is, from its detections. Rows carry source and event_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.config import BUCKETS
from cuelight.functions.geometry import Box, position, union_box
from cuelight.functions.text import trimmed

KEY = ["source", "event_id"]


def milliseconds(ts: Column) -> Column:
    """A time as whole thousandths, half to even: two detections at one of these count as simultaneous."""
    return F.rint(ts * 1000).cast("long")


def duration_class(duration: Column) -> Column:
    return (
        F.when(duration >= 60, "Likely persistent graphic")
        .when(duration >= 15, "Persistent")
        .when(duration <= 1, "Brief")
        .otherwise("Normal")
    )


def spans(detections: DataFrame) -> DataFrame:
    """start_s, end_s, duration, their class, and how many detections and distinct times an event has."""
    got = detections.groupBy(*KEY).agg(
        F.min("ts").alias("start_s"),
        F.max("ts").alias("end_s"),
        F.count("*").alias("n_detections"),
        F.countDistinct(milliseconds(F.col("ts"))).alias("n_times"),
    )
    duration = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    return got.withColumn("duration", duration).withColumns(
        {"classification": duration_class(F.col("duration")), "persistent": F.col("duration") >= 15}
    )


def confidences(detections: DataFrame) -> DataFrame:
    return detections.groupBy(*KEY).agg(
        F.avg("confidence").alias("average_confidence"),
        F.max("confidence").alias("maximum_confidence"),
        F.max("detector_confidence").alias("maximum_detector_confidence"),
    )


def best_detections(detections: DataFrame) -> DataFrame:
    """The surest detection of each event: by confidence, then text length, then the first."""
    rank = F.struct("confidence", F.length("text"), -F.col("ord"))
    row = F.struct("ord", "frame_index", "ts", "text", "frame_width", "frame_height")
    return detections.groupBy(*KEY).agg(F.max_by(row, rank).alias("best")).select(*KEY, "best.*")


def boxes(detections: DataFrame) -> DataFrame:
    """The hull of an event's boxes, and where it lies in the best detection's frame."""
    hull = detections.groupBy(*KEY).agg(*union_box())
    frames = best_detections(detections).select(*KEY, "frame_width", "frame_height")
    where = position(Box(*[F.col(c) for c in "xywh"]), F.col("frame_width"), F.col("frame_height"))
    return hull.join(frames, KEY).withColumn("position", where)


def representative_texts(detections: DataFrame) -> DataFrame:
    """An event's text: the lines of the time with the most confident characters, top to bottom, each once.

    detections carry norm, the normalised text.
    """
    timed = detections.withColumn("__ms", milliseconds(F.col("ts")))
    weight = F.sum(F.length(trimmed(F.col("text"))) * F.col("confidence"))
    times = timed.groupBy(*KEY, "__ms").agg(weight.alias("__w"), F.min("ord").alias("__first"))
    best = times.groupBy(*KEY).agg(F.max_by("__ms", F.struct("__w", -F.col("__first"))).alias("__ms"))
    return _lines_at(best, timed)


def _lines_at(best: DataFrame, timed: DataFrame) -> DataFrame:
    """best(source, event_id, __ms, ...) with the text that the event shows at that time, in place of __ms."""
    lines = (
        timed.join(best.select(*KEY, "__ms"), [*KEY, "__ms"])
        .where("norm <> ''")
        .groupBy(*KEY, "norm")
        .agg(F.min(F.struct("y", "x", "ord", trimmed(F.col("text")).alias("line"))).alias("__line"))
    )
    texts = lines.groupBy(*KEY).agg(F.array_sort(F.collect_list("__line")).alias("__lines"))
    joined = F.array_join(F.transform("__lines", lambda r: r["line"]), " / ")
    rest = [c for c in best.columns if c != "__ms"]
    return best.drop("__ms").join(texts, KEY, "left").select(*rest, F.coalesce(joined, F.lit("")).alias("text"))


def repeat_counts(texts: DataFrame) -> DataFrame:
    """How many events of the source have the same normalised text (0 for none). texts carry norm."""
    counts = texts.where("norm <> ''").groupBy("source", "norm").agg(F.count("*").alias("repeats"))
    return texts.join(counts, ["source", "norm"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))


def bucket_counts(scored: DataFrame) -> DataFrame:
    """All three buckets with their counts, zero too."""
    order = scored.sparkSession.createDataFrame([(b, k) for k, b in enumerate(BUCKETS)], "bucket string, rank int")
    counts = scored.groupBy("bucket").agg(F.count("*").alias("n"))
    return order.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def moments(detections: DataFrame) -> DataFrame:
    """One row for each event with all that scoring asks for.

    Detections are summed up by time, then times by event, so one pass gives what spans, confidences, boxes and
    best_detections tell, the number of times without a list of them, and the weightiest time; a second pass reads the
    lines of that time.
    """
    timed = detections.withColumn("__ms", milliseconds(F.col("ts")))
    rank = F.struct("confidence", F.length("text"), -F.col("ord"))
    row = F.struct("frame_index", "frame_width", "frame_height")
    times = timed.groupBy(*KEY, "__ms").agg(
        F.min("ts").alias("__from"),
        F.max("ts").alias("__to"),
        F.count("*").alias("__n"),
        F.sum("confidence").alias("__sum"),
        F.count("confidence").alias("__sure"),
        F.max("confidence").alias("__most"),
        F.max("detector_confidence").alias("__detected"),
        F.min("x").alias("__x"),
        F.min("y").alias("__y"),
        F.max(F.col("x") + F.col("w")).alias("__right"),
        F.max(F.col("y") + F.col("h")).alias("__bottom"),
        F.max(F.struct(rank.alias("rank"), row.alias("row"))).alias("__best"),
        F.sum(F.length(trimmed(F.col("text"))) * F.col("confidence")).alias("__w"),
        F.min("ord").alias("__first"),
    )
    whole = times.groupBy(*KEY).agg(
        F.min("__from").alias("start_s"),
        F.max("__to").alias("end_s"),
        F.sum("__n").alias("n_detections"),
        F.count("*").alias("n_times"),
        (F.sum("__sum") / F.sum("__sure")).alias("average_confidence"),
        F.max("__most").alias("maximum_confidence"),
        F.max("__detected").alias("maximum_detector_confidence"),
        F.min("__x").alias("x"),
        F.min("__y").alias("y"),
        (F.max("__right") - F.min("__x")).alias("w"),
        (F.max("__bottom") - F.min("__y")).alias("h"),
        F.max("__best").alias("__best"),
        F.max_by("__ms", F.struct("__w", -F.col("__first"))).alias("__ms"),
    )
    duration = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    told = whole.withColumn("duration", duration).select(
        *KEY,
        *["start_s", "end_s", "n_detections", "n_times", "duration"],
        duration_class(F.col("duration")).alias("classification"),
        (F.col("duration") >= 15).alias("persistent"),
        *["average_confidence", "maximum_confidence", "maximum_detector_confidence", "x", "y", "w", "h"],
        F.col("__best.row.frame_width").alias("frame_width"),
        F.col("__best.row.frame_height").alias("frame_height"),
        F.col("__best.row.frame_index").alias("best_frame"),
        "__ms",
    )
    where = position(Box(*[F.col(c) for c in "xywh"]), F.col("frame_width"), F.col("frame_height"))
    return _lines_at(told.withColumn("position", where), timed)


def frame_counters(frames: DataFrame) -> DataFrame:
    """Processed, analysed and reused frames of each source. frames carry analysed."""
    return frames.groupBy("source").agg(
        F.count("*").alias("processed"),
        F.count_if("analysed").alias("analysed"),
        F.count_if(~F.col("analysed")).alias("reused"),
    )


def emission_order(detections: DataFrame) -> DataFrame:
    """Each event's 0-based detection numbers in order of emission within the source."""
    own = Window.partitionBy("source").orderBy("ts", "text", "ord")
    placed = detections.withColumn("__at", F.row_number().over(own) - 1)
    return placed.groupBy(*KEY).agg(F.array_sort(F.collect_list("__at")).alias("detection_indexes"))
