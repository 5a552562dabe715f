import random

from pyspark.sql import functions as F

from cuelight.config import Tracking
from cuelight.operators import entities
from cuelight.streaming import sessions


def detections(spark):
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(120):
        t += rng.choice([0.1, 0.4, 1.0, 5.0])
        rows.append((i % 2, i, t, rng.choice(["HOTEL", "H0TEL", "EXIT SIGN"]), 0.5 + i % 5 / 10, 0.9, 100.0, 100.0, 200.0, 40.0, 1920, 1080, i))
    return spark.createDataFrame(rows, entities.DETECTION)


def test_tracking_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = detections(spark)
    timed = rows.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    timed.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    late = timed.where("ord < 2").withColumns(
        {"ts": F.lit(9000.0) + F.col("ord"), "ord": F.col("ord") + 1000, "event_time": F.timestamp_seconds(F.lit(9000) + F.col("ord"))}
    )
    late.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    # the watermark moves behind a batch, so one more lets the last islands close
    later = late.withColumns({"ts": F.col("ts") + 100, "ord": F.col("ord") + 1000, "event_time": F.col("event_time") + F.expr("interval 100 seconds")})
    later.coalesce(1).write.parquet(f"{tmp_path}/in/c")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sessions.drained(sessions.track_stream(stream, Tracking()), "append").where("start_s < 9000")
    batch = entities.track_detections(rows, Tracking())
    spans = batch.groupBy("source", "event_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    expected = sorted((r["source"], r["a"], r["b"], r["n"]) for r in spans.collect())
    assert sorted((r["source"], r["start_s"], r["end_s"], r["n_detections"]) for r in got.collect()) == expected


def test_sessions_of_a_stream_equal_the_batch(spark, small):
    path = f"{small}/events.parquet"
    got = sessions.streamed_sessions(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sessions.by_session(spark.read.parquet(path)).collect()))


def test_recognition_boundary(spark):
    import pandas as pd

    from cuelight.sources import recognition

    frames = spark.createDataFrame([(1, 0, 0.5, 1920, 1080)], "source long, frame_index long, ts double, frame_width int, frame_height int")
    assert recognition.recognised(frames, recognition.no_engine).count() == 0

    def engine():
        return lambda pdf: pd.DataFrame([(1, 0, 0.5, 1920, 1080, "HI", 0.9, None, 1.0, 2.0, 3.0, 4.0)], columns=[c.split()[0] for c in recognition.OBSERVATION.split(", ")])

    assert recognition.recognised(frames, engine).first()["text"] == "HI"
    raw = [
        '{"text": "A", "confidence": 0.5, "box": [1, 2, 3, 4]}',
        '{"rec_text": "B", "points": [[0, 0], [4, 0], [4, 2], [0, 2]]}',
        '{"text": " "}',
        "not json",
    ]
    rows = recognition.adapted(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id long, result string")).orderBy("id").collect()
    assert [(r["text"], r["confidence"], r["detector_confidence"], r["x"], r["w"], r["h"]) for r in rows] == [
        ("A", 0.5, None, 1.0, 2.0, 2.0),
        ("B", 0.0, None, 0.0, 4.0, 2.0),
    ]
    some = spark.createDataFrame([("a", 0.49), ("b", 0.5), ("c", 0.92), (" ", 0.99)], "text string, confidence double")
    assert sorted(r["text"] for r in recognition.confident(some, 0.5).collect()) == ["b", "c"]
