import pytest

from cuelight import config
from cuelight.functions import text
from cuelight.operators import intervals
from cuelight.sources import captions
from pyspark.sql import functions as F


def cues(spark, pairs):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "source long, cue_id long, start_s double, end_s double")


def spans(df):
    return sorted((round(r["start_s"], 3), round(r["end_s"], 3)) for r in df.collect())


def test_merge_joins_cues_that_nearly_touch(spark):
    got = intervals.merge_cues(cues(spark, [(1, 2), (2.04, 3), (3.2, 4), (0, 0.5), (1.2, 1.4)]))
    assert spans(got) == [(0, 0.5), (1, 3), (3.2, 4)]


def test_merge_carries_over_blocks(spark):
    got = intervals.merge_cues(cues(spark, [(10, 2500), (700, 800), (2499, 2600), (2700, 2701)]))
    assert spans(got) == [(10, 2600), (2700, 2701)]


@pytest.mark.parametrize(
    "minimum, expected",
    [
        (1.0, [(2.65, 3.35), (4.65, 6.35), (7.15, 8)]),
        (2.0, [(4.65, 6.35)]),
        (0.5, [(1.15, 1.35), (2.65, 3.35), (4.65, 6.35), (7.15, 8)]),
    ],
)
def test_gaps_are_judged_before_padding(spark, minimum, expected):
    rows = intervals.merge_cues(cues(spark, [(0, 1), (1.5, 2.5), (3.5, 4.5), (6.5, 7)]))
    assert spans(intervals.dialogue_gaps(rows, 0, 8, minimum)) == expected


def test_gaps_trim_for_a_cue_just_behind_the_range(spark):
    rows = cues(spark, [(1, 2), (5.1, 6)]).drop("cue_id")
    assert spans(intervals.dialogue_gaps(rows, 0, 5)) == [(0, 0.85), (2.15, 4.95)]


def test_gap_arguments(spark):
    rows = cues(spark, [(0, 1)]).drop("cue_id")
    for bad in (float("nan"), -1, float("inf")):
        with pytest.raises(ValueError):
            intervals.dialogue_gaps(rows, 0, 5, bad)
    with pytest.raises(ValueError):
        intervals.dialogue_gaps(rows, 5, 0)


def test_points_and_quiet_starts(spark):
    rows = cues(spark, [(1, 3), (5, 7)]).drop("cue_id")
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.84, 0.86, 3.1, 3.2, 6.0, 9.0])], "source long, k long, ts double")
    got = {r["k"]: r["active"] for r in intervals.dialogue_active(points, rows, "k").collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False}
    assert sorted(r["ts"] for r in intervals.quiet_gap_starts(rows, 0, None).collect()) == [3.05, 7.05]


SRT = """1
00:00:01,000 --> 00:00:02,000
[Music playing]

2
00:00:03,000 --> 00:00:04,000
♪ la la ♪

3
00:00:05,000 --> 00:00:06,000
(door closes)

4
00:00:07,000 --> 00:00:08,500
- <i>Hello</i> &amp; welcome

NOTE 00:01.000 --> 00:02.000
nothing

5
00:09.000 --> 00:08.000
backwards
"""


def test_files_to_cues(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"\xef\xbb\xbf" + SRT.replace("\n", "\r\n").encode())
    (tmp_path / "b.txt").write_text(SRT)
    files = captions.read(spark, f"file://{tmp_path}")
    timed = captions.blocks(files)
    assert files.count() == 1
    assert [(r["start_s"], r["end_s"]) for r in captions.cues(timed).collect()] == [(7.0, 8.5)]
    assert [(r["start_s"], r["end_s"]) for r in captions.cues(timed).collect()] == [(7.0, 8.5)]
    stats = captions.statistics(timed).first()
    assert (stats["total_cues"], stats["non_dialogue_cues"]) == (5, 3)
    captions.require_cues(files)
    (tmp_path / "c.vtt").write_text("WEBVTT\n\nnothing here")
    with pytest.raises(ValueError):
        captions.require_cues(captions.read(spark, f"file://{tmp_path}"))


def test_sidecars(spark):
    videos = spark.createDataFrame([("v1", "f", "Film"), ("v2", "f", "Other"), ("v3", "g", "Film")], "video string, folder string, stem string")
    files = spark.createDataFrame(
        [("f", "Film.de.srt"), ("f", "film.EN.vtt"), ("f", "Filming.srt"), ("f", "Other.vtt"), ("f", "Other.srt"), ("g", "x.srt")],
        "folder string, name string",
    )
    got = {r["video"]: r["caption"] for r in captions.sidecars(videos, files).collect()}
    assert got == {"v1": "film.EN.vtt", "v2": "Other.srt"}


@pytest.mark.parametrize(
    "line, spoken",
    [
        ("Hello", True), ("- Hello", True), ("Music", False), ("MÚSICA: triste", False), ("sound effects stop", False),
        ("music box", True), ("[sighs] fine", True), ("[sighs]", False), ("(x) applause", False), ("♫ hey", False),
        ("<i></i>", False), ("— Silence", False), ("", False),
    ],
)
def test_dialogue_lines(spark, line, spoken):
    row = spark.createDataFrame([(line,)], "line string").select(text.has_dialogue(F.col("line")).alias("x")).first()
    assert row["x"] is spoken


def test_modes_and_ranges():
    assert config.mode().step == 23 and config.mode("advanced").step == 1 and config.mode("fast").interval == 1.0
    assert config.mode("custom", step=23).seconds(23.0) == 1.0 and config.mode("custom", step=2).seconds() == 0.5
    for bad in ({"step": 0}, {"step": -1}, {"step": 2.5}, {"interval": 0.0}, {}, {"step": 1, "interval": 1.0}):
        with pytest.raises(ValueError):
            config.mode("custom", **bad)
    assert config.scan_range(-1, None, 10) == (0.0, 10) and config.scan_range(1, 20, 10) == (1, 10)
    assert config.scan_range(0, None, 0) == (0.0, None)
    for bad in ((10, None, 10), (5, 4, 10)):
        with pytest.raises(ValueError):
            config.scan_range(*bad)
    assert config.Tracking.of_interval().max_gap == 1.25 and config.Tracking.of_scan(1.0, True).max_gap == 2.8
    assert config.moment_tolerance(1.0) == 0.15 and config.moment_tolerance(0.1) == 0.08
    with pytest.raises(ValueError):
        config.Scan(floor=1.5)


def test_every_entity_is_decoded_after_tags_are_gone(spark):
    lines = [["&#9834; la la &#9834;"], ["&eacute;s &lt;i&gt; ya"], ["<b>[door]</b>"], ["&#x5B;bang&#x5D;"], ["a &amp; b"], ["&amp;#9834;"]]
    df = spark.createDataFrame([(str(i), 0.0, 1.0, x) for i, x in enumerate(lines)], "source string, start_s double, end_s double, lines array<string>")
    assert [r[0] for r in df.select(text.decoded(F.col("lines"))).collect()] == [
        ["♪ la la ♪"], ["és <i> ya"], ["[door]"], ["[bang]"], ["a & b"], ["&#9834;"]
    ]
    said = captions.cues(df.withColumn("cue_id", F.col("source").cast("long")))
    assert sorted(r["source"] for r in said.collect()) == ["1", "4", "5"]
    assert {r["source"]: r["non_dialogue_cues"] for r in captions.statistics(df).collect()} == {"0": 1, "1": 0, "2": 1, "3": 1, "4": 0, "5": 0}


def test_gaps_of_caption_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:03,000\nHello\n\n2\n00:00:05,000 --> 00:00:07,000\nAgain\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500\n♪ la\n")
    got = captions.gaps(spark, f"file://{tmp_path}/*", 0.0, 8.0, 1.0).collect()
    found = sorted((r["source"][-5:], round(r["start_s"], 3), round(r["end_s"], 3)) for r in got)
    assert found == [("a.srt", 0.0, 0.85), ("a.srt", 3.15, 4.85), ("a.srt", 7.15, 8.0), ("b.vtt", 0.0, 8.0)]
    (tmp_path / "c.srt").write_text("nothing timed")
    with pytest.raises(ValueError):
        captions.gaps(spark, f"file://{tmp_path}/*", 0.0, 8.0)
