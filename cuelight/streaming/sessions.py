"""Sessions and tracking over a stream of events or detections.

A stream has no last row: sessions close when the watermark passes their gap, tracking state when no detection can
continue an event. On a finished input a stream gives what the batch form gives; tests hold them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelight.config import Tracking
from cuelight.operators.entities import COLUMNS, READ, Event, track
from cuelight.sources.storage import fresh_folder

GAP = "6 hours"


def by_session(events: DataFrame, gap: str = GAP) -> DataFrame:
    """A user's sessions: begin, end (a gap after the last event) and number of events. Batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return counted.agg(F.count("*").alias("n")).select(
        "user_id", F.col("s.start").cast("timestamp_ntz").alias("begins"), F.col("s.end").cast("timestamp_ntz").alias("ends"), "n"
    )


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is and read its result from the shared folder."""
    spark = stream.sparkSession
    path = fresh_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep)
    started.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return rows.select(*stream.columns)


def streamed_sessions(spark: SparkSession, path: str, gap: str = GAP) -> DataFrame:
    """The sessions of an events table, read as a stream of files; a pattern may name a single file, a path may not."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return drained(by_session(events, gap), "complete")


STATE = "rows array<struct<" + ",".join(
    f"{c}:{k}"
    for c, k in zip(
        COLUMNS,
        "bigint bigint double string double double double double double double int int bigint".split(),
    )
) + ">>"


def track_stream(detections: DataFrame, how: Tracking = Tracking(), delay: float = 0.0) -> DataFrame:
    """Events of detections(event_time, ...) as they close: source, start_s, end_s, text, n_detections.

    Detections wait until the watermark says that none before them can come, are put in order, and the whole island
    is tracked once max_gap has passed after its last one; event ids need the whole source and are left to the batch.
    """
    names = COLUMNS

    def closed(rows: list[dict]) -> pd.DataFrame:
        rows = sorted(rows, key=lambda r: (r["ts"], r["text"], r["ord"]))
        tuples = [tuple(r[c] for c in READ) for r in rows]
        events: dict[int, tuple[Event, list[float]]] = {}
        for d, k in zip(tuples, track(tuples, how)):
            event, times = events.setdefault(k, (Event(), []))
            event.add(d)
            times.append(d[1])
        out = [(rows[0]["source"], min(t), max(t), e.text(), len(t)) for e, t in events.values()]
        return pd.DataFrame(out, columns=["source", "start_s", "end_s", "text", "n_detections"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [dict(zip(names, r)) for r in state.get[0]] if state.exists else []
        for pdf in batches:
            held += pdf[names].to_dict("records")
        mark = state.getCurrentWatermarkMs() / 1000.0
        held.sort(key=lambda r: (r["ts"], r["text"], r["ord"]))
        # islands that are over: the next one opens more than max_gap later, or the watermark is that far
        cuts = [0, *[i for i in range(1, len(held)) if held[i]["ts"] - held[i - 1]["ts"] > how.max_gap], len(held)]
        done = 0
        for a, b in zip(cuts, cuts[1:]):
            if b > a and mark - held[b - 1]["ts"] > how.max_gap:
                yield closed(held[a:b])
                done = b
        held = held[done:]
        if held:
            state.update(([tuple(r[c] for c in names) for r in held],))
            state.setTimeoutTimestamp(int((max(held[-1]["ts"], mark) + how.max_gap + delay) * 1000) + 1)
        elif state.exists:
            state.remove()

    marked = detections.withWatermark("event_time", f"{int(delay * 1000)} milliseconds")
    return marked.groupBy("source").applyInPandasWithState(
        step,
        "source long, start_s double, end_s double, text string, n_detections long",
        STATE,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
