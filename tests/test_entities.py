import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight.config import BACKGROUND, LIKELY, REVIEW, Tracking
from cuelight.functions import text
from cuelight.operators import aggregates, cadence, entities, reports, scoring


def detections(spark, rows):
    """rows: (ts, text, confidence, x, y, w, h)"""
    full = [
        (1, i, float(t), s, float(c), 0.9, float(x), float(y), float(w), float(h), 1920, 1080, i)
        for i, (t, s, c, x, y, w, h) in enumerate(rows)
    ]
    return spark.createDataFrame(full, entities.DETECTION)


def events(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["event_id"], set()).add(r["ord"])
    return [groups[k] for k in sorted(groups)]


def test_misread_variants_are_one_event(spark):
    names = ["OLD HARBOUR 51", "0LD HARBOUR 51", "OLD HARB0UR S1", "OLD HARBOUR 5I"]
    rows = [(0.5 * i, n, 0.95, 100, 100, 200, 40) for i, n in enumerate(names)]
    assert events(entities.track_detections(detections(spark, rows), Tracking.of_interval(0.5))) == [{0, 1, 2, 3}]


def test_the_same_word_in_two_places_is_two_events(spark):
    rows = [(0, "EXIT", 0.95, 100, 100, 200, 40), (0.5, "EXIT", 0.95, 1500, 900, 200, 40)]
    assert events(entities.track_detections(detections(spark, rows))) == [{0}, {1}]


def test_a_long_graphic_is_persistent(spark):
    rows = [(5 * i, "LOGO", 0.95, 100, 100, 200, 40) for i in range(20)]
    found = entities.track_detections(detections(spark, rows), Tracking(max_gap=6))
    assert aggregates.spans(found).first()["classification"] == "Likely persistent graphic"


def test_lines_seen_together_are_one_moment(spark):
    rows = [(4, "PARIS", 0.95, 600, 420, 720, 60), (4, "THREE YEARS LATER", 0.95, 600, 500, 720, 60)]
    found = entities.group_moments(entities.track_detections(detections(spark, rows)), 0.5)
    assert events(found) == [{0, 1}]
    got = aggregates.representative_texts(found.withColumn("norm", text.normalised(F.col("text")))).first()
    assert got["text"] == "PARIS / THREE YEARS LATER"
    apart = [(4, "PARIS", 0.95, 600, 420, 720, 60), (5, "LATER", 0.95, 600, 500, 720, 60)]
    assert len(events(entities.group_moments(entities.track_detections(detections(spark, apart)), 0.5))) == 2


def test_islands_give_what_the_whole_gives(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for _ in range(250):
        t += rng.choice([0, 0.1, 0.5, 1.0, 3.0])
        rows.append((t, rng.choice(["HOTEL", "H0TEL", "EXIT SIGN", "PARIS"]), rng.random(), rng.choice([100, 150, 1500]), 100, 200, 40))
    df = detections(spark, rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], i))
    flat = [(i, *rows[i][:3], *map(float, rows[i][3:]), 1920, 1080) for i in order]
    whole = {}
    for d, k in zip(flat, entities.track(flat, Tracking())):
        whole.setdefault(k, []).append(d)
    in_order = sorted(whole, key=lambda k: (min(d[1] for d in whole[k]), k))
    expected = [{d[0] for d in whole[k]} for k in in_order]
    assert events(entities.track_detections(df)) == expected


def test_incremental_text_equals_the_text_from_scratch():
    rng = random.Random(5)
    for _ in range(200):
        e, rows = entities.Event(), []
        for i in range(rng.randint(1, 8)):
            d = (i, rng.choice([0.0, 1.0, 2.0]), rng.choice(["A", "BB", "b b", "", "C!"]), rng.choice([0.1, 0.5, 0.9]), rng.random(), rng.random(), 1.0, 1.0)
            rows.append(d)
            e.add(d)
            groups = {}
            for r in rows:
                groups.setdefault(round(r[1], 3), []).append(r)
            best = max(groups.values(), key=lambda g: sum(len(r[2].strip()) * r[3] for r in g))
            seen, out = set(), []
            for r in sorted(best, key=lambda r: (r[5], r[4])):
                n = entities.normalise(r[2])
                if n and n not in seen:
                    seen.add(n)
                    out.append(r[2].strip())
            assert e.text() == " / ".join(out)


def frames(spark, times):
    return spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(times)], "source long, frame_index long, ts double")


def test_cadence(spark):
    every = cadence.every_nth(frames(spark, [i / 24 for i in range(96)]), 23)
    assert sorted(r["frame_index"] for r in every.collect()) == [0, 23, 46, 69, 92]
    marks = spark.createDataFrame([(1, 0.31), (1, 0.32), (1, 99.0)], "source long, ts double")
    got = cadence.with_priorities(frames(spark, [0, 0.1, 0.4, 0.5]), marks)
    assert sorted(r["frame_index"] for r in got.where("priority").collect()) == [2]
    rng = random.Random(1)
    times, t = [], 0.0
    for _ in range(300):
        t += rng.choice([0.04, 0.3, 1.0, 2.5, 700])
        times.append(t)
    due, after = [], -1e9
    for i, x in enumerate(times):
        if x + 1e-6 >= after:
            due.append(i)
            after = x + 2.0
    got = cadence.least_interval(frames(spark, times), 2.0, 2.0)
    assert sorted(r["frame_index"] for r in got.collect()) == due


def test_near_identical_frames():
    a = np.full((64, 64, 3), 40, np.uint8)
    b = a.copy()
    b[0, 0] = 60
    assert cadence.near_identical(a, b)
    b[10:13, 10:13] = 240
    assert not cadence.near_identical(a, b) and not cadence.near_identical(a, np.zeros((65, 64, 3), np.uint8))


def test_reuse_is_refreshed(spark):
    df = frames(spark, range(7)).withColumn("signature", F.lit(1))
    got = cadence.reuse(df, lambda a, b: a == b).orderBy("ts").collect()
    assert [r["analysed"] for r in got] == [True, False, False, True, False, False, True]


def test_suppression(spark):
    rows = [(1, 0, 0, "A", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, "A", 0.8, 1.0, 0.0, 10.0, 10.0), (1, 0, 2, "B", 0.7, 1.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "source long, frame_index long, ord long, norm string, confidence double, x double, y double, w double, h double")
    assert sorted(r["ord"] for r in cadence.suppressed(df, ["source", "frame_index"]).collect()) == [0, 2]


VOCAB = [("three", "en", 6.0), ("years", "en", 6.0), ("later", "en", 6.0), ("para", "es", 6.0), ("salida", "es", 4.0), ("rare", "en", 2.0)]


def judged(spark, rows, **more):
    found = entities.group_moments(entities.track_detections(detections(spark, rows), Tracking(max_gap=6)), 0.5)
    moments = aggregates.moments(found.withColumn("norm", text.normalised(F.col("text"))))
    vocab = spark.createDataFrame(VOCAB, "word string, lang string, zipf double")
    return scoring.scored(moments, vocab, **more)


@pytest.mark.parametrize(
    "rows, bucket, reason",
    [
        ([(t, "THREE YEARS LATER", 0.95, 600, 500, 720, 80) for t in (1, 2, 3)], LIKELY, "large centered title"),
        ([(1, "X", 0.95, 600, 500, 40, 40)], BACKGROUND, "isolated symbol or character"),
        ([(2 * t, "THREE YEARS", 0.95, 20, 20, 120, 40) for t in range(8)], BACKGROUND, "persistent or repeated graphic"),
        ([(1, "@@##~~ab", 0.45, 600, 500, 300, 40)], BACKGROUND, "symbol-heavy OCR"),
        ([(t, "Zyx Qwv", 0.95, 600, 500, 720, 80) for t in (1, 2, 3)], REVIEW, "no common English/Spanish words recognized"),
    ],
)
def test_buckets(spark, rows, bucket, reason):
    got = judged(spark, rows).first()
    assert got["bucket"] == bucket and reason in got["reasons"]


def test_missing_detector_scores_add_nothing(spark):
    rows = [(1, "SALIDA", 0.5, 600, 500, 300, 40)]
    df = detections(spark, rows).withColumn("detector_confidence", F.lit(None).cast("double")).withColumn("event_id", F.lit(1).cast("long"))
    moments = aggregates.moments(df.withColumn("norm", text.normalised(F.col("text"))))
    vocab = spark.createDataFrame(VOCAB, "word string, lang string, zipf double")
    got = scoring.scored(moments, vocab).first()
    assert abs(got["score"] - (0.12 + 0.12 - 0.04 + 0.06 + 0.07)) < 1e-9 or got["title_like"]
    assert got["dialogue_free_ratio"] is None


def test_reports(spark):
    rows = judged(spark, [(3.5, "=SUM(A1)", 0.95, 600, 500, 720, 80)])
    told = reports.event_rows(rows)
    assert len(told.columns) == 20 and told.first()["Detected Text"] == "=SUM(A1)"
    assert told.first()["Evidence Screenshot"] == "0001_00-00-03-500.jpg"
    counts = {r["bucket"]: r["n"] for r in aggregates.bucket_counts(rows).collect()}
    assert sum(counts.values()) == 1 and len(counts) == 3
    assert reports.searched(told, "sum(").count() == 1 and reports.searched(told, "nothing").count() == 0


def test_groups_that_span_batches(spark):
    """Groups of many sizes, dealt over small batches, are each worked on once and whole."""
    from cuelight.operators.grouped import labelled

    rng = random.Random(8)
    rows = [(g, i, rng.random()) for g in range(60) for i in range(rng.choice([1, 2, 3, 40]))]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = labelled(df, ["g"], ["i"], ["i"], lambda own: [len(own) * 100 + r[0] for r in own], "out").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = {}
    for g, *_ in rows:
        size[g] = size.get(g, 0) + 1
    assert sorted((r["g"], r["i"], r["out"]) for r in got) == [(g, i, size[g] * 100 + i) for g, i, _ in sorted(rows)]
    assert labelled(df.limit(0), ["g"], ["i"], ["i"], lambda own: [], "out").count() == 0


def test_near_identical_against_plain_loops():
    rng = np.random.default_rng(2)
    for _ in range(60):
        h, w = rng.integers(1, 70, 2)
        a = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        b = a.copy()
        for _ in range(rng.integers(0, 5)):
            b[rng.integers(0, h), rng.integers(0, w)] ^= rng.integers(0, 30, dtype=np.uint8)
        worst = [[max(abs(int(p) - int(q)) for p, q in zip(a[y, x], b[y, x])) for x in range(w)] for y in range(h)]
        squares = {}
        for y in range(h):
            for x in range(w):
                squares[y // 32, x // 32] = squares.get((y // 32, x // 32), 0) + (worst[y][x] >= 12)
        alike = sum(map(sum, worst)) / (h * w) <= 1.5 and max(squares.values()) <= 2
        assert cadence.near_identical(a, b) == alike
    assert cadence.near_identical(np.zeros((0, 4, 3), np.uint8), np.zeros((0, 4, 3), np.uint8))


def test_evidence_comes_from_the_first_frame_after(spark):
    shown = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 1, 2, 700])], "source long, frame_index long, ts double")
    targets = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0000005), (1, 3, 2.5), (1, 4, 999.0), (2, 5, 1.0)], "source long, event_id long, ts double")
    got = {r["event_id"]: r["frame_index"] for r in reports.evidence_after(targets, shown).collect()}
    assert got == {1: 0, 2: 1, 3: 3, 4: 3, 5: None}


def test_html_cells_are_escaped_and_numbers_short(spark):
    df = spark.createDataFrame([("<b>&'\"", 1.5, 0.456), (None, 2.0, None), ("x", 1e8, 1.0)], "t string, v double, s double")
    got = reports.html_rows(df, ["t"]).select("html", text.general(F.col("v")).alias("v"), text.percent(F.col("s")).alias("s")).collect()
    assert got[0]["html"] == "<tr><td>&lt;b&gt;&amp;&#x27;&quot;</td></tr>" and got[1]["html"] == "<tr><td></td></tr>"
    assert [r["v"] for r in got] == ["1.5", "2", "1e+08"] and [r["s"] for r in got] == ["46%", "", "100%"]


def test_writers_stems_and_sizes(spark, tmp_path):
    rows = spark.createDataFrame([("b, \"x\"", 2), ("=1+1", 1)], "name string, n long")
    reports.write_csv(rows, f"file://{tmp_path}/csv", ["n"])
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert sorted((r["name"], r["n"]) for r in back.collect()) == [("=1+1", "1"), ('b, "x"', "2")]
    reports.write_json(rows.select(F.to_json(F.struct("n")).alias("json")), f"file://{tmp_path}/json")
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/json").collect()) == ['{"n":1}', '{"n":2}']
    names = spark.createDataFrame([(" a/b:c ",), ("...",), ("é" * 3 + "x",)], "n string")
    assert [r[0] for r in names.select(text.safe_stem(F.col("n"))).collect()] == ["a_b_c", "video", "x"]
    sizes = spark.createDataFrame([(1920, 1080), (100, 4000), (10, 10), (3000, 1)], "width int, height int")
    got = [tuple(r) for r in sizes.select(*cadence.downscaled()).collect()]
    assert got == [(1280, 720), (32, 1280), (10, 10), (1280, 1)]
    kept = reports.evidence_frames(detections(spark, [(0, "A", 1, 1, 1, 1, 1), (1, "B", 1, 1, 1, 1, 1)]))
    assert sorted(r["frame_index"] for r in kept.collect()) == [0, 1]
