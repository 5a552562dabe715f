"""Which frames are sampled: every n-th, at priority times, in greedy intervals; reuse of near-equal frames; tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.operators.blocks import running
from cuelight.operators.grouped import labelled

SLACK = 1e-6


def in_range(frames: DataFrame, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Frames of the range; its low side has a slack of a millionth."""
    kept = frames.where(F.col("ts") + F.lit(SLACK) >= F.lit(float(start)))
    return kept if end is None else kept.where(F.col("ts") <= F.lit(float(end)))


def every_nth(frames: DataFrame, step: int) -> DataFrame:
    """Frames whose place within the source, from 0, is a multiple of step."""
    seen = running(frames, "source", "ts", ["ts", "frame_index"], {"__n": ("count", F.lit(1))})
    return seen.where(F.col("__n") % step == 0).drop("__n")


def with_priorities(frames: DataFrame, priorities: DataFrame) -> DataFrame:
    """frames with priority: whether this is the first frame that reaches some priority time."""
    left = frames.select(
        "source",
        (F.col("ts") + F.lit(SLACK)).alias("__at"),
        F.lit(1).alias("__side"),
        F.col("frame_index").alias("__id"),
        F.struct(*frames.columns).alias("__row"),
    )
    right = priorities.select("source", F.col("ts").alias("__at"), F.lit(0).alias("__side"), F.lit(-1).cast("long").alias("__id"))
    both = left.unionByName(right.distinct(), allowMissingColumns=True)
    seen = running(
        both,
        "source",
        "__at",
        ["__at", "__side", "__id"],
        {
            "__last": ("max", F.when(F.col("__side") == 0, F.col("__at"))),
            "__before": ("max", F.when(F.col("__side") == 1, F.col("__at"))),
        },
    )
    reached = F.col("__last").isNotNull() & (F.col("__before").isNull() | (F.col("__last") > F.col("__before")))
    return seen.where("__side = 1").select("__row.*", reached.alias("priority"))


def sampled(marked: DataFrame, step: int) -> DataFrame:
    """Every n-th frame and those that priority times ask for; marked comes from with_priorities."""
    seen = running(marked, "source", "ts", ["ts", "frame_index"], {"__n": ("count", F.lit(1))})
    return seen.where((F.col("__n") % step == 0) | F.col("priority")).drop("__n")


def least_interval(frames: DataFrame, interval: Column | float, longest: float) -> DataFrame:
    """Frames that greedy sampling takes: one is due once its predecessor's interval is over.

    interval: seconds after a frame, a number or a column; longest: the largest it can be. A frame after a pause of
    longest seconds is due whatever was taken before, so a source falls into stretches that are sampled on their own.
    Priority frames, if there is such a column, are taken too but don't put off the next due one.
    """
    asked = F.col("priority") if "priority" in frames.columns else F.lit(False)
    wait = interval if isinstance(interval, Column) else F.lit(float(interval))
    rows = frames.select("*", wait.alias("__wait"), asked.alias("__asked"))
    seen = running(rows, "source", "ts", ["ts", "frame_index"], {"__before": ("max", F.col("ts"))})
    opens = F.col("__before").isNull() | (F.col("ts") + F.lit(SLACK) >= F.col("__before") + F.lit(float(longest)))
    marked = seen.withColumn("__opens", opens.cast("long"))
    named = running(marked, "source", "ts", ["ts", "frame_index"], {"__n": ("sum", F.col("__opens"))})
    named = named.select("*", (F.coalesce("__n", F.lit(0)) + F.col("__opens")).alias("__stretch"))

    def due(own: list[tuple]) -> list[int]:
        taken, after = [], -np.inf
        for ts, wait, asked in own:
            on_time = ts + SLACK >= after
            after = ts + wait if on_time else after
            taken.append(int(on_time or bool(asked)))
        return taken

    slim = named.drop("__before", "__opens", "__n")
    read = ["ts", "__wait", "__asked"]
    marked = labelled(slim, ["source", "__stretch"], ["ts", "frame_index"], read, due, "__taken")
    return marked.where("__taken = 1").select(*frames.columns)


def adaptive_interval(active: Column, quiet: float = 0.5, dialogue: float = 2.0) -> Column:
    return F.when(active, F.lit(dialogue)).otherwise(F.lit(quiet))


# ---- frames that look alike -----------------------------------------------------------------------------------------


def near_identical(
    a: np.ndarray, b: np.ndarray, mean: float = 1.5, tile: int = 32, changed: int = 12, allowed: int = 2
) -> bool:
    """Whether two colour frames of 8 bits and one shape look alike: the widest difference of a pixel's channels is at
    most mean on average, and no square of tile pixels holds more than allowed pixels that differ by changed or more.

    The places of such pixels are listed and counted by square, which is little work as frames that are alike have few.
    """
    for frame in (a, b):
        if frame.dtype != np.uint8 or frame.shape != a.shape or frame.shape[2:] != (3,):
            return False
    widest = (np.maximum(a, b) - np.minimum(a, b)).max(axis=-1, initial=0)
    if widest.sum(dtype=np.int64) > mean * widest.size:
        return False
    y, x = np.nonzero(widest >= changed)
    across = -(-widest.shape[1] // tile)
    return np.bincount(y // tile * across + x // tile, minlength=1).max() <= allowed


def reuse(frames: DataFrame, same, key: str = "source", most: int = 2) -> DataFrame:
    """frames(source, ts, frame_index, signature) with analysed: whether a frame is recognised anew.

    same(a, b) compares a frame's signature with that of the last analysed one. After most reuses in a row a frame
    is analysed anyway. The state runs along a source, so a source is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "frame_index"], kind="stable")
        last, row, out = None, 0, []
        for s in pdf["signature"]:
            again = last is not None and row < most and same(last, s)
            row = row + 1 if again else 0
            last = last if again else s
            out.append(not again)
        return pdf.assign(analysed=out)

    return frames.groupBy(key).applyInPandas(run, f"{_fields(frames)}, analysed boolean")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# ---- tiles -----------------------------------------------------------------------------------------------------------


def tiles(frames: DataFrame, overlap: float = 0.15) -> DataFrame:
    """The whole frame and two by two tiles that overlap: tile, tx, ty, tw, th.

    A tile is half a side, rounded down, and reaches into its neighbours by a share of that, rounded down, too.
    """

    def side(whole: Column) -> tuple[Column, ...]:
        half = F.floor(whole / 2)
        pad = F.floor(half * F.lit(float(overlap)))
        near, far = half - pad, F.least(whole, 2 * half + pad)
        return F.lit(0), F.least(whole, half + pad), near, far - near

    (x0, w0, x1, w1), (y0, h0, y1, h1) = side(F.col("width")), side(F.col("height"))
    zero = F.lit(0)
    places = [(zero, zero, F.col("width"), F.col("height")), (x0, y0, w0, h0), (x1, y0, w1, h0), (x0, y1, w0, h1), (x1, y1, w1, h1)]
    every = [
        F.struct(F.lit(k).alias("tile"), *[c.cast("int").alias(n) for c, n in zip(place, ("tx", "ty", "tw", "th"))])
        for k, place in enumerate(places)
    ]
    return frames.select("*", F.explode(F.array(*every)).alias("__t")).select(*frames.columns, "__t.*")


def suppressed(detections: DataFrame, keys: list[str], most: float = 0.45) -> DataFrame:
    """Detections of a frame without those that overlap a surer one of the same normalised text.

    Order dependent within a frame: by confidence, then by ord. A frame's rows are few, so a frame is a group.
    """

    def run(own: list[tuple]) -> list[int]:
        kept: dict[str, list[tuple]] = {}
        flags = [0] * len(own)
        for i in sorted(range(len(own)), key=lambda i: (-own[i][1], own[i][2])):
            norm, box = own[i][0], own[i][3:]
            if all(overlap(box, k) <= most for k in kept.get(norm, ())):
                kept.setdefault(norm, []).append(box)
                flags[i] = 1
        return flags

    read = ["norm", "confidence", "ord", "x", "y", "w", "h"]
    return labelled(detections, keys, ["ord"], read, run, "__kept").where("__kept = 1").drop("__kept")


def overlap(a: tuple, b: tuple) -> float:
    """Intersection by union of two boxes of numbers."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = max(0.0, a[2]) * max(0.0, a[3]) + max(0.0, b[2]) * max(0.0, b[3]) - both
    return both / union if union else 0.0


def downscaled(longest: int = 1280) -> tuple[Column, Column]:
    """Width and height with the longer side at most longest, rounded, at least one."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1), F.rint(x * scale).cast("int"))
    return side(w).alias("width"), side(h).alias("height")

