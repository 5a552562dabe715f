"""Relevance of moments: a sum of terms in a fixed order, reasons, buckets and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.config import BACKGROUND, LIKELY, REVIEW, share
from cuelight.functions.text import count_alphanumeric, is_symbol_heavy, normalised, trimmed, words
from cuelight.operators.aggregates import KEY, repeat_counts
from cuelight.sources.storage import settled

LEAST_ZIPF = 3.0


def vocabulary(docs: DataFrame, languages: tuple[str, ...] = ("en", "es")) -> DataFrame:
    """word, lang, zipf: the logarithm of a word's uses in a thousand million, by language, from texts."""
    uses = docs.where(F.col("lang").isin(*languages)).select(
        "lang", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"(\p{L}{3,})"), F.lit(1)), F.lower)).alias("word")
    )
    counts = uses.groupBy("lang", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select(
        "word", "lang", F.log10(F.lit(1e9) * F.col("n") / F.col("total")).alias("zipf")
    )


def recognised_words(texts: DataFrame, vocab: DataFrame, least: float = LEAST_ZIPF) -> DataFrame:
    """text, n_words: how many distinct words of each distinct text are common in some language."""
    known = vocab.where(F.col("zipf") >= F.lit(float(least))).select("word").distinct()
    uses = texts.select("text").distinct().select("text", F.explode(words(F.col("text"))).alias("word"))
    return uses.join(known, "word").groupBy("text").agg(F.count("*").alias("n_words"))


def near_cuts(moments: DataFrame, cuts: DataFrame, within: float = 1.0) -> DataFrame:
    """Keys of the moments that begin near a scene cut.

    Both sides are cut into cells of that width and joined by source and cell, a cut once for each cell it can reach.
    """
    wide = F.lit(float(within))
    cell = F.floor(F.col("start_s") / wide)
    reached = cuts.select(
        "source",
        F.col("ts").alias("__cut"),
        F.explode(F.sequence(F.floor(F.col("ts") / wide) - 1, F.floor(F.col("ts") / wide) + 1)).alias("__cell"),
    )
    return (
        moments.select(*KEY, "start_s", cell.alias("__cell"))
        .join(reached, ["source", "__cell"])
        .where(F.abs(F.col("start_s") - F.col("__cut")) <= wide)
        .select(*KEY)
        .distinct()
    )


def scored(
    moments: DataFrame,
    vocab: DataFrame,
    ratios: DataFrame | None = None,
    cuts: DataFrame | None = None,
    breadth: float = 0.5,
    ascii_only: bool = False,
) -> DataFrame:
    """moments with score, bucket, reasons, flags and repeats.

    ratios: the dialogue-free share of each moment, None without captions; cuts: scene cuts. Terms are added from left
    to right, as a threshold may hang on the last bit.
    """
    breadth = share(min(1.0, max(0.0, breadth)), "the review breadth")
    # words, repeats and cuts are looked up for the moments, so these are read four times
    rows = settled(moments.withColumn("norm", normalised(F.col("text"), ascii_only)))
    rows = repeat_counts(rows)
    rows = rows.join(recognised_words(rows, vocab), "text", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    if ratios is None:
        rows = rows.withColumn("dialogue_free_ratio", F.lit(None).cast("double"))
    else:
        rows = rows.join(ratios, KEY, "left").withColumn("dialogue_free_ratio", F.coalesce("dialogue_free_ratio", F.lit(0.0)))
    if cuts is None:
        rows = rows.withColumn("near_cut", F.lit(False))
    else:
        near = near_cuts(rows, cuts).withColumn("near_cut", F.lit(True))
        rows = rows.join(near, KEY, "left").withColumn("near_cut", F.coalesce("near_cut", F.lit(False)))
    known_frame = (F.col("frame_width") > 0) & (F.col("frame_height") > 0)
    frame = F.col("frame_width") * F.col("frame_height")
    rows = rows.withColumns(
        {
            "area_ratio": F.when(known_frame, F.try_divide(F.col("w") * F.col("h"), frame)).otherwise(0.0),
            "width_ratio": F.when(known_frame, F.try_divide(F.col("w"), "frame_width")).otherwise(0.0),
            "height_ratio": F.when(known_frame, F.try_divide(F.col("h"), "frame_height")).otherwise(0.0),
            "single_symbol": count_alphanumeric(F.col("text")) <= 1,
            "symbol_heavy": is_symbol_heavy(trimmed(F.col("text"))),
        }
    )
    corner = F.col("position").isin("Upper Left", "Upper Right", "Lower Left", "Lower Right")
    rows = rows.withColumns(
        {
            "title_like": (F.col("position") == "Center")
            & ((F.col("width_ratio") >= 0.22) | (F.col("height_ratio") >= 0.07))
            & ~F.col("single_symbol")
            & (F.col("start_s") <= 900),
            "repeated_graphic": corner
            & (F.col("area_ratio") < 0.012)
            & ((F.col("duration") >= 12) | (F.col("repeats") >= 3)),
        }
    )
    total, reasons = _terms()
    rows = rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
    likely = 0.64 + (breadth - 0.5) * 0.24
    review = 0.36 + (breadth - 0.5) * 0.2
    score = F.col("score")
    bucket = (
        F.when(F.col("repeated_graphic"), BACKGROUND)
        .when((F.col("n_words") > 0) & (score >= likely), LIKELY)
        .when(score >= review, REVIEW)
        .otherwise(BACKGROUND)
    )
    named = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return rows.withColumns({"bucket": bucket, "reasons": named, "credit_sequence": F.lit(False)})


def _terms() -> tuple[Column, list[Column]]:
    """The sum of all terms, in order, and their reasons (null where a term has none)."""
    c, none = F.col, F.lit(0.0)
    of = lambda test, value: F.when(test, F.lit(value)).otherwise(none)
    words_known = ~c("single_symbol")
    no_words = words_known & (c("n_words") == 0)
    terms = [
        F.least(F.lit(0.24), c("maximum_confidence") * 0.24),
        # least() skips nulls, so a missing score is told apart first
        F.when(c("maximum_detector_confidence").isNull(), none).otherwise(
            F.least(F.lit(0.1), c("maximum_detector_confidence") * 0.1)
        ),
        F.when(c("n_times") >= 3, 0.22).when(c("n_times") == 2, 0.14).otherwise(-0.04),
        of((c("n_times") >= 3) & (c("duration") >= 2), 0.05),
        F.when(c("single_symbol"), -0.34)
        .when(c("n_words") >= 4, 0.2)
        .when(c("n_words") >= 2, 0.16)
        .when(c("n_words") == 1, 0.06)
        .otherwise(-0.22),
        of(no_words & c("symbol_heavy"), -0.1),
        F.when(c("area_ratio") < 0.00025, -0.14).when(c("area_ratio") >= 0.002, 0.07).otherwise(none),
        of(c("title_like"), 0.2),
        F.when(c("dialogue_free_ratio") >= 0.75, 0.16).otherwise(none),
        of(c("near_cut"), 0.05),
        of(c("repeated_graphic"), -0.32),
    ]
    total = F.lit(0.12)
    for t in terms:
        total = total + t
    # fixed values: the wording of reasons, in the order in which they are told
    reasons = [
        F.when(c("n_times") >= 3, "confirmed across frames").when(c("n_times") == 2, "seen twice"),
        F.when((c("n_times") >= 3) & (c("duration") >= 2), "held on screen"),
        F.when(c("single_symbol"), "isolated symbol or character")
        .when(c("n_words") >= 4, "several recognizable words")
        .when(c("n_words") >= 2, "recognizable words")
        .when(c("n_words") == 1, "recognizable word")
        .otherwise("no common English/Spanish words recognized"),
        F.when(no_words & c("symbol_heavy"), "symbol-heavy OCR"),
        F.when(c("area_ratio") < 0.00025, "very small on screen"),
        F.when(c("title_like"), "large centered title"),
        F.when(c("dialogue_free_ratio") >= 0.75, "appears in a dialogue gap").when(
            c("dialogue_free_ratio") <= 0.25, "overlaps dialogue"
        ),
        F.when(c("near_cut"), "near a scene change"),
        F.when(c("repeated_graphic"), "persistent or repeated graphic"),
    ]
    return total, reasons


def bucket_rank(bucket: Column) -> Column:
    return F.when(bucket == LIKELY, 0).when(bucket == BACKGROUND, 2).otherwise(1)


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank within the source, from 1: by bucket, falling score, start and event.

    The rank is counted by ordering a source's moments, which are few beside its detections.
    """
    order = Window.partitionBy("source").orderBy(bucket_rank(F.col("bucket")), F.desc("score"), "start_s", "event_id")
    return rows.withColumn("rank", F.row_number().over(order))
