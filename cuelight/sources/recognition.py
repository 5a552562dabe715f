"""The boundary to recognisers: an engine is a callable that runs over batches of frames; results come in many shapes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions.text import trimmed
from cuelight.functions.geometry import Box, box_of_numbers, box_polygon, polygon_box

OBSERVATION = (
    "source long, frame_index long, ts double, frame_width int, frame_height int, text string, confidence double, "
    "detector_confidence double, x double, y double, w double, h double"
)
RESULT = (
    "text string, transcription string, label string, rec_text string, confidence double, score double, "
    "rec_score double, detector_confidence double, det_score double, polygon array<array<double>>, "
    "points array<array<double>>, box array<double>, bbox array<double>"
)


def recognised(frames: DataFrame, engine: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Observations of an engine. engine() is called once in a task and gives a function of batches of frames, so a
    model is loaded once for many frames. Sample frames before this: Python sees what is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = engine()
        for pdf in batches:
            yield work(pdf)

    return frames.mapInPandas(run, OBSERVATION)


def no_engine() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An engine that finds nothing, for dry runs."""
    names = [c.split()[0] for c in OBSERVATION.split(", ")]
    return lambda pdf: pd.DataFrame(columns=names, dtype=object)


def adapted(results: DataFrame, json: str = "result") -> DataFrame:
    """Results as JSON, whatever the engine calls things, as text, confidence, detector_confidence, polygon and box.

    A missing score is 0, a missing detector score null; a missing polygon is the box's, a missing box the polygon's.
    Rows without text are left out.
    """
    r = F.from_json(json, RESULT)
    rows = results.withColumn("__r", r)
    c = lambda *names: F.coalesce(*[F.col(f"__r.{n}") for n in names])
    shape, four = c("polygon", "points"), c("box", "bbox")
    given = F.when(F.size(four) == 4, box_of_numbers(four)).otherwise(polygon_box(shape))
    b = Box(*[F.col(f"__b.{k}") for k in "xywh"])
    out = rows.withColumn("__b", given)
    kept = [F.col(x) for x in results.columns if x != json]
    return out.select(
        *kept,
        c("text", "transcription", "rec_text", "label").alias("text"),
        F.coalesce(c("confidence", "score", "rec_score"), F.lit(0.0)).alias("confidence"),
        c("detector_confidence", "det_score").alias("detector_confidence"),
        F.coalesce(shape, box_polygon(b)).alias("polygon"),
        *[getattr(b, k).alias(k) for k in "xywh"],
    ).where(trimmed(F.col("text")) != "")


def confident(detections: DataFrame, floor: float = 0.0) -> DataFrame:
    """Detections with text and at least the floor's confidence."""
    if not 0 <= floor <= 1:
        raise ValueError("the confidence floor must be between 0 and 1")
    return detections.where((trimmed(F.col("text")) != "") & (F.col("confidence") >= F.lit(float(floor))))


def translated(detections: DataFrame, x: Column, y: Column) -> DataFrame:
    """Detections of a tile with boxes in the frame's own coordinates."""
    return detections.withColumns({"x": F.col("x") + x, "y": F.col("y") + y})
