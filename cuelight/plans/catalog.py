"""Every registered query of the screen-text engine, with its SQL oracle where one exists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight import config
from cuelight.functions import geometry, text
from cuelight.operators import aggregates, cadence, entities, intervals, reports, scoring
from cuelight.plans import scan as scans
from cuelight.plans.oracles import _CAMEL, _NORM, DIALOGUE, STATISTICS, markup, sql, stamp
from cuelight.sources import adapters as src
from cuelight.sources import captions, recognition
from cuelight.sources.storage import settled
from cuelight.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

START, END = 0.0, src.RANGE_END
GAP = 2.8


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


# ---- captions --------------------------------------------------------------------------------------------------------


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cues as a written table: few rows beside the cues, which most queries read several times."""
    return settled(intervals.merge_cues(src.cues(spark, sf_dir)))


def gaps(spark: SparkSession, sf_dir: str, minimum: float = 1.0) -> DataFrame:
    return intervals.dialogue_gaps(merged(spark, sf_dir), START, END, minimum)


def settled_gaps(spark: SparkSession, sf_dir: str, cues: DataFrame | None = None) -> DataFrame:
    return settled(intervals.dialogue_gaps(merged(spark, sf_dir) if cues is None else cues, START, END, 1.0))


@query("SELECT * FROM merged")
def cue_merge(spark, sf_dir):
    return intervals.merge_cues(src.cues(spark, sf_dir))


@query(STATISTICS)
def cue_stats(spark, sf_dir):
    """Each conversation stands for a caption file, each turn for a cue; every seventh one has no length."""
    turns = src.cue_lines(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("source"),
        F.lit(0.0).alias("start_s"),
        F.when(F.col("turn") % 7 == 6, 0.0).otherwise(1.0).alias("end_s"),
        "lines",
    )
    return captions.statistics(turns)


@query("SELECT * FROM gaps")
def dialogue_gaps(spark, sf_dir):
    return gaps(spark, sf_dir)


@query("SELECT * FROM gaps2")
def dialogue_gaps_min2(spark, sf_dir):
    return gaps(spark, sf_dir, 2.0)


@query(
    f"SELECT source, {stamp('start_s')} AS start, {stamp('end_s')} AS \"end\", "
    "printf('%.3f', end_s - start_s) AS duration_seconds FROM gaps"
)
def gap_report_csv(spark, sf_dir):
    return reports.gap_rows(gaps(spark, sf_dir))


@query("SELECT count(*) AS n_gaps, round(coalesce(sum(end_s - start_s), 0), 6) AS seconds FROM gaps")
def gap_totals(spark, sf_dir):
    return intervals.gap_totals(gaps(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query("SELECT * FROM quiet")
def quiet_gap_starts(spark, sf_dir):
    return intervals.quiet_gap_starts(merged(spark, sf_dir), START, END)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = src.frames(spark, sf_dir).select("source", "frame_index", "ts")
    return intervals.dialogue_active(frames, merged(spark, sf_dir), "frame_index")


@query("SELECT source, frame_index, ts, active FROM activity")
def point_in_dialogue(spark, sf_dir):
    return activity(spark, sf_dir)


@query("SELECT source, frame_index, ts FROM activity WHERE NOT active")
def frames_outside_dialogue(spark, sf_dir):
    return activity(spark, sf_dir).where("not active").drop("active")


@query("SELECT source, avg(CASE WHEN active THEN 0::DOUBLE ELSE 1::DOUBLE END) AS dialogue_free_ratio FROM "
       "(SELECT DISTINCT source, ts, active FROM activity) GROUP BY source")
def dialogue_free_ratio(spark, sf_dir):
    frames = src.frames(spark, sf_dir).withColumn("entity", F.col("source"))
    got = intervals.dialogue_free_ratio(frames, merged(spark, sf_dir), ["entity"], "point_id")
    return got.withColumnRenamed("entity", "source")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = src.frames(spark, sf_dir).select("source", "frame_index", "ts")
    return intervals.in_gaps(frames, settled_gaps(spark, sf_dir))


@query("SELECT * FROM held")
def frames_in_gaps(spark, sf_dir):
    return held(spark, sf_dir)


@query("SELECT * FROM held QUALIFY gap_end - gap_start >= 2.0::DOUBLE OR "
       "row_number() OVER (PARTITION BY source, gap_start ORDER BY ts, frame_index) = 1")
def first_sample_short_gap(spark, sf_dir):
    return intervals.first_of_short_gaps(held(spark, sf_dir), 2.0)


@query("SELECT * FROM midpoints")
def gap_midpoints(spark, sf_dir):
    return intervals.gap_midpoints(gaps(spark, sf_dir), 2.0)


def priorities(spark: SparkSession, sf_dir: str, cues: DataFrame | None = None) -> DataFrame:
    cues = merged(spark, sf_dir) if cues is None else cues
    return intervals.priority_times(
        START,
        END,
        src.scene_cuts(spark, sf_dir),
        intervals.gap_midpoints(settled_gaps(spark, sf_dir, cues), 2.0),
        intervals.quiet_gap_starts(cues, START, END),
    )


@query("SELECT * FROM priorities")
def priority_times(spark, sf_dir):
    return priorities(spark, sf_dir)


@query(DIALOGUE)
def cue_is_dialogue(spark, sf_dir):
    return src.cue_lines(spark, sf_dir).groupBy("conv_id", "turn").agg(
        F.max(text.any_dialogue(text.decoded(F.col("lines")), bare=True)).alias("dialogue")
    )


@query("SELECT page_id, md5(line) AS digest FROM (SELECT page_id, " + markup("html") + " AS line FROM pages)")
def strip_markup(spark, sf_dir):
    """Pages stand for very long caption lines."""
    return src.table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("digest"))


# ---- sampling --------------------------------------------------------------------------------------------------------


def slim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.frames(spark, sf_dir).select("source", "frame_index", "ts")


@query("SELECT * FROM frames QUALIFY (row_number() OVER (PARTITION BY source ORDER BY ts, frame_index) - 1) % 23 = 0")
def sample_every_23(spark, sf_dir):
    return cadence.every_nth(slim_frames(spark, sf_dir), config.DEFAULT_STEP)


@query("SELECT * FROM frames WHERE ts + 1e-6 >= 30::DOUBLE AND ts <= 120::DOUBLE")
def sample_range(spark, sf_dir):
    return cadence.in_range(slim_frames(spark, sf_dir), 30.0, 120.0)


@query("""
SELECT source, frame_index, ts, coalesce(n > coalesce(b, 0), false) AS priority FROM (
  SELECT *, lag(n) OVER (PARTITION BY source ORDER BY ts, frame_index) AS b,
    row_number() OVER (PARTITION BY source ORDER BY ts, frame_index) - 1 AS i FROM (
    SELECT f.*, (SELECT count(*) FROM priorities p WHERE p.source = f.source AND p.ts <= f.ts + 1e-6) AS n FROM frames f))
WHERE i % 23 = 0 OR n > coalesce(b, 0)""")
def sample_with_priority(spark, sf_dir):
    marked = settled(cadence.with_priorities(slim_frames(spark, sf_dir), priorities(spark, sf_dir)))
    return cadence.sampled(marked, config.DEFAULT_STEP)


@query("""
SELECT f.source, f.frame_index, f.ts FROM frames f JOIN (
  WITH RECURSIVE after AS MATERIALIZED (
    SELECT a.source, a.frame_index, arg_min(b.frame_index, b.ts) AS following
    FROM frames a JOIN frames b ON a.source = b.source AND b.ts + 1e-6::DOUBLE >= a.ts + 2.0::DOUBLE GROUP BY ALL),
  walk AS (
    SELECT source, arg_min(frame_index, ts) AS frame_index FROM frames GROUP BY source
    UNION ALL SELECT w.source, n.following FROM walk w JOIN after n ON n.source = w.source AND n.frame_index = w.frame_index)
  SELECT * FROM walk) w ON w.source = f.source AND w.frame_index = f.frame_index""")
def sample_min_interval(spark, sf_dir):
    return cadence.least_interval(slim_frames(spark, sf_dir), 2.0, 2.0)


@query()
def sample_adaptive(spark, sf_dir):
    cues = merged(spark, sf_dir)
    marked = settled(cadence.with_priorities(slim_frames(spark, sf_dir), priorities(spark, sf_dir, cues)))
    active = settled(intervals.dialogue_active(marked, cues, "frame_index"))
    return cadence.least_interval(active, cadence.adaptive_interval(F.col("active")), config.DIALOGUE_INTERVAL)


@query()
def reuse_counts(spark, sf_dir):
    """Embeddings stand in for pixels; they are near-identical if no value is far from the other's."""
    frames = src.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("source"),
        F.col("vec_id").alias("frame_index"),
        F.col("vec_id").cast("double").alias("ts"),
        F.col("embedding").alias("signature"),
    )
    same = lambda a, b: len(a) == len(b) and bool(np.abs(np.subtract(a, b)).max(initial=0) <= 0.35)
    return aggregates.frame_counters(cadence.reuse(frames, same))


@query("""
SELECT source, frame_index, tile, CASE WHEN tile IN (2, 4) THEN hw - pw ELSE 0 END AS tx,
  CASE WHEN tile >= 3 THEN hh - ph ELSE 0 END AS ty,
  CASE WHEN tile = 0 THEN w WHEN tile IN (1, 3) THEN hw + pw ELSE least(w, 2 * hw + pw) - hw + pw END AS tw,
  CASE WHEN tile = 0 THEN h WHEN tile IN (1, 2) THEN hh + ph ELSE least(h, 2 * hh + ph) - hh + ph END AS th
FROM (SELECT *, floor((w // 2) * 0.15::DOUBLE)::INT AS pw, floor((h // 2) * 0.15::DOUBLE)::INT AS ph, (w // 2)::INT AS hw,
    (h // 2)::INT AS hh
  FROM (SELECT source, frame_index, (1 + frame_index * 7 % 1921)::INT AS w, (719 + frame_index % 5)::INT AS h, unnest([0, 1, 2, 3, 4]) AS tile
    FROM frames))""")
def tile_scan(spark, sf_dir):
    """Frames of all widths from 1 to 1921."""
    sized = src.frames(spark, sf_dir).withColumns(
        {"width": (1 + F.col("frame_index") * 7 % 1921).cast("int"), "height": (719 + F.col("frame_index") % 5).cast("int")}
    )
    return cadence.tiles(sized).select("source", "frame_index", "tile", "tx", "ty", "tw", "th")


# ---- detections -------------------------------------------------------------------------------------------------------


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = src.detections(spark, sf_dir)
    return found.withColumn("norm", text.normalised(F.col("text"), ascii_only=True))


@query("SELECT source, ord, confidence FROM detections WHERE trim(text) <> '' AND ord % 5 <> 0 AND confidence >= 0.5::DOUBLE")
def confidence_filter(spark, sf_dir):
    """Every third text ends in, and every fifth is nothing but, white space of other kinds than the blank."""
    i = F.col("ord")
    spaced = F.when(i % 5 == 0, "\t \u2003").when(i % 3 == 0, F.concat("text", F.lit("\t"))).otherwise(F.col("text"))
    rows = src.detections(spark, sf_dir).withColumn("text", spaced)
    return recognition.confident(rows, 0.5).select("source", "ord", "confidence")


@query("""
SELECT source, frame_index, ord, norm, confidence, x, y, w, h FROM (
  SELECT a.*, EXISTS (SELECT 1 FROM both_ b WHERE b.source = a.source AND b.frame_index = a.frame_index AND b.norm = a.norm
    AND (b.confidence > a.confidence OR b.confidence = a.confidence AND b.ord < a.ord)
    AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
      > 0.45::DOUBLE * (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
        * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))) AS hidden
  FROM both_ a) WHERE NOT hidden""".replace("both_", "(SELECT source, frame_index, ord, norm, confidence, x, y, w, h FROM normed "
    "UNION ALL SELECT source, frame_index, -ord - 1, norm, confidence * 0.9::DOUBLE, x + 2, y, w, h FROM normed)"))
def nms_tiles(spark, sf_dir):
    """Detections with a slightly moved copy, as overlapping tiles give them; a frame keeps the surer of each two."""
    own = normed(spark, sf_dir).select("source", "frame_index", "ord", "norm", "confidence", "x", "y", "w", "h")
    moved = own.withColumns({"ord": -F.col("ord") - 1, "x": F.col("x") + 2, "confidence": F.col("confidence") * 0.9})
    return cadence.suppressed(own.unionByName(moved), ["source", "frame_index"])


PAIRS = "FROM detections a JOIN detections b ON b.ord = a.ord + 1"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.detections(spark, sf_dir).select("ord", "x", "y", "w", "h", "frame_width", "frame_height")
    after = rows.select((F.col("ord") - 1).alias("ord"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    return rows.join(after, "ord")


@query(f"""
SELECT ord, CASE WHEN u = 0 THEN 0 ELSE i / u END AS iou FROM (
  SELECT ord, i, wa * ha + wb * hb - i AS u FROM (
    SELECT a.ord, a.w AS wa, a.h AS ha, b.w AS wb, b.h AS hb,
      greatest(0::DOUBLE, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
        * greatest(0::DOUBLE, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i {PAIRS}))""")
def box_iou_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", geometry.iou(geometry.box(), geometry.box("b")).alias("iou"))


@query(f"""
SELECT a.ord, round(sqrt(power((a.x + a.w / 2) - (b.x + b.w / 2), 2) + power((a.y + a.h / 2) - (b.y + b.h / 2), 2))
  / sqrt(1920 * 1920 + 1080 * 1080), 9) AS apart {PAIRS}""")
def center_distance_pairs(spark, sf_dir):
    apart = geometry.centre_ratio(geometry.box(), geometry.box("b"), F.col("frame_width"), F.col("frame_height"))
    return pairs(spark, sf_dir).select("ord", F.round(apart, 9).alias("apart"))


@query("SELECT ord, x, y, w, h, position FROM (SELECT ord, x, y, w, h, CASE WHEN w / 1920 > 0.65 OR h / 1080 > 0.45 "
       "THEN 'Multiple / Large Area' WHEN cx = 'Center' AND cy = 'Center' THEN 'Center' ELSE cy || ' ' || cx END AS position "
       "FROM (SELECT *, CASE WHEN (x + w / 2) / 1920 < 1::DOUBLE / 3 THEN 'Left' WHEN (x + w / 2) / 1920 > 2 * (1::DOUBLE / 3) "
       "THEN 'Right' ELSE 'Center' END AS cx, CASE WHEN (y + h / 2) / 1080 < 1::DOUBLE / 3 THEN 'Upper' "
       "WHEN (y + h / 2) / 1080 > 2 * (1::DOUBLE / 3) THEN 'Lower' ELSE 'Center' END AS cy FROM detections))")
def position_class(spark, sf_dir):
    where = geometry.position(geometry.box(), F.col("frame_width"), F.col("frame_height"))
    return src.detections(spark, sf_dir).select("ord", "x", "y", "w", "h", where.alias("position"))


@query("SELECT ord, x, y, (x + w) - x AS w, (y + h) - y AS h FROM detections")
def polygon_box(spark, sf_dir):
    rows = src.detections(spark, sf_dir).select("ord", geometry.box_polygon(geometry.box()).alias("polygon"))
    return rows.select("ord", geometry.polygon_box(F.col("polygon")).alias("b")).select("ord", "b.*")


# ---- text ---------------------------------------------------------------------------------------------------------------


@query()
def normalize_text(spark, sf_dir):
    """The whole text of every document; SQL has no NFKC, so pytest holds it against Python."""
    rows = src.table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.normalised(F.col("text")).alias("norm"))


@query("SELECT c_custkey, " + _NORM.format("'(' || c_name || ') ~'") + " AS norm FROM customer")
def normalize_names(spark, sf_dir):
    """Every customer's name, between signs; all names are ASCII, so that SQL can follow."""
    around = F.concat(F.lit("("), "c_name", F.lit(") ~"))
    return src.table(spark, sf_dir, "customer").select("c_custkey", text.normalised(around).alias("norm"))


@query("SELECT doc_id, count(DISTINCT w) FILTER (WHERE w NOT IN ('com', 'http', 'https', 'net', 'org', 'www')) AS n_words "
       "FROM (SELECT doc_id, lower(unnest(regexp_extract_all(" + _CAMEL.format("text") + ", '\\p{L}{3,}'))) AS w FROM documents) "
       "GROUP BY doc_id HAVING n_words > 0")
def word_extract(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents")
    found = rows.select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))
    return found.where("n_words > 0")


@query("SELECT word, lang, round(zipf, 6) AS zipf FROM vocab")
def vocab_zipf(spark, sf_dir):
    return scoring.vocabulary(src.table(spark, sf_dir, "documents")).withColumn("zipf", F.round("zipf", 6))


@query("SELECT text, n_words FROM known")
def recognizable_words(spark, sf_dir):
    vocab = scoring.vocabulary(src.table(spark, sf_dir, "documents"))
    return scoring.recognised_words(src.detections(spark, sf_dir), vocab)


@query("SELECT p_partkey, " + _CAMEL.format("replace(p_name, ' ', '') || 'AndMPEGFile'") + " AS name FROM part")
def camel_split(spark, sf_dir):
    joined = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("AndMPEGFile"))
    return src.table(spark, sf_dir, "part").select("p_partkey", text.split_camel(joined).alias("name"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n FROM documents")
def alnum_count(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.count_alphanumeric(F.col("text")).cast("long").alias("n"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) > length(text) * 0.2::DOUBLE AS heavy FROM documents")
def symbol_heavy(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select("doc_id", text.is_symbol_heavy(F.col("text")).alias("heavy"))


def whole_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the whole texts of all benchmark items; the pairs of an item are in one task."""
    items = src.table(spark, sf_dir, "benchmark")
    rows = items.repartition("item_id").select("item_id", text.normalised(F.col("text")).alias("norm"))
    other = items.select(F.col("item_id").alias("other_id"), text.normalised(F.col("text")).alias("other"))
    return rows.join(other, F.col("item_id") < F.col("other_id"))


@query()
def text_similarity_pairs(spark, sf_dir):
    return whole_pairs(spark, sf_dir).select(
        "item_id", "other_id", F.round(text.similarity("norm", "other"), 9).alias("similarity")
    )


@query()
def text_prefilter_pairs(spark, sf_dir):
    """The distance of whole texts, and whether the bounds leave a similarity of 86 possible."""
    may_be = text.may_be_similar(F.col("norm"), F.col("other"))
    return whole_pairs(spark, sf_dir).select(
        "item_id", "other_id", F.levenshtein("norm", "other").cast("long").alias("distance"), may_be.alias("may_be_similar")
    )


@query("SELECT a.n_nationkey AS item_id, b.n_nationkey AS other_id, levenshtein(" + _NORM.format("a.n_name") + ", "
       + _NORM.format("b.n_name") + ") AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def name_distances(spark, sf_dir):
    """Distances of all pairs of nations' names, a table of fixed size; all names are ASCII, so that SQL can follow."""
    rows = src.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("item_id"), text.normalised(F.col("n_name")).alias("norm")
    )
    other = rows.select(F.col("item_id").alias("other_id"), F.col("norm").alias("other"))
    return rows.join(other, F.col("item_id") < F.col("other_id")).select(
        "item_id", "other_id", F.levenshtein("norm", "other").cast("long").alias("distance")
    )


# ---- events and moments ----------------------------------------------------------------------------------------------------


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.text_sessions(normed(spark, sf_dir), GAP)


@query("SELECT source, event_id, ord FROM tracked")
def track_sessions(spark, sf_dir):
    return sessions_of(spark, sf_dir).select("source", "event_id", "ord")


@query("SELECT * FROM spans")
def event_spans(spark, sf_dir):
    return aggregates.spans(sessions_of(spark, sf_dir))


@query("SELECT source, event_id, round(average_confidence, 6) AS average_confidence, maximum_confidence, "
       "maximum_detector_confidence FROM sure")
def event_confidence(spark, sf_dir):
    got = aggregates.confidences(sessions_of(spark, sf_dir))
    return got.withColumn("average_confidence", F.round("average_confidence", 6))


@query("SELECT * FROM best")
def event_best_detection(spark, sf_dir):
    return aggregates.best_detections(sessions_of(spark, sf_dir))


@query("SELECT * FROM boxes")
def event_union_box(spark, sf_dir):
    return aggregates.boxes(sessions_of(spark, sf_dir))


@query("SELECT * FROM texts")
def event_representative_text(spark, sf_dir):
    return aggregates.representative_texts(sessions_of(spark, sf_dir))


@query("SELECT source, event_id, classification, persistent FROM spans")
def event_duration_class(spark, sf_dir):
    return aggregates.spans(sessions_of(spark, sf_dir)).select("source", "event_id", "classification", "persistent")


@query("SELECT source, event_id, CASE WHEN n = '' THEN 0 ELSE count(*) OVER (PARTITION BY source, n) END AS repeats FROM "
       "(SELECT source, event_id, " + _NORM.format("text") + " AS n FROM texts)")
def event_repeat_count(spark, sf_dir):
    texts = aggregates.representative_texts(sessions_of(spark, sf_dir))
    rows = texts.withColumn("norm", text.normalised(F.col("text"), ascii_only=True))
    return aggregates.repeat_counts(rows).select("source", "event_id", "repeats")


@query("SELECT source, event_id FROM near")
def scene_proximity(spark, sf_dir):
    return scoring.near_cuts(aggregates.spans(sessions_of(spark, sf_dir)), src.scene_cuts(spark, sf_dir))


@query()
def track_detections(spark, sf_dir):
    found = entities.track_detections(src.detections(spark, sf_dir), config.Tracking(max_gap=GAP))
    return found.select("source", "event_id", "ord")


@query()
def screen_moments(spark, sf_dir):
    found = entities.track_detections(src.detections(spark, sf_dir), config.Tracking(max_gap=GAP))
    return entities.group_moments(found, config.mode("adaptive").seconds()).select("source", "event_id", "ord")


def scored_of(spark: SparkSession, sf_dir: str, found: DataFrame, ascii_only: bool = True) -> DataFrame:
    """All terms for detections with events: captions, cuts and words come from the same tables."""
    found = settled(found)  # six aggregates read it
    ratios = intervals.dialogue_free_ratio(
        found.select("source", "ts", "event_id", F.col("source").alias("__source")),
        merged(spark, sf_dir),
        ["__source", "event_id"],
        "point_id",
    ).withColumnRenamed("__source", "source")
    vocab = scoring.vocabulary(src.table(spark, sf_dir, "documents"))
    return scoring.scored(
        aggregates.moments(found), vocab, ratios, src.scene_cuts(spark, sf_dir), ascii_only=ascii_only
    )


@query("SELECT source, event_id, text, score, n_words, repeats, dialogue_free_ratio, near_cut, title_like, "
       "repeated_graphic, reasons FROM scored")
def score_moments(spark, sf_dir):
    rows = scored_of(spark, sf_dir, sessions_of(spark, sf_dir))
    return rows.select(
        "source", "event_id", "text", "score", "n_words", "repeats", "dialogue_free_ratio", "near_cut", "title_like",
        "repeated_graphic", F.array_join("reasons", "; ").alias("reasons"),
    )


@query("SELECT source, event_id, bucket FROM scored")
def bucket_moments(spark, sf_dir):
    return scored_of(spark, sf_dir, sessions_of(spark, sf_dir)).select("source", "event_id", "bucket")


@query("SELECT source, event_id, row_number() OVER (PARTITION BY source ORDER BY CASE bucket WHEN 'Likely Forced Text' "
       "THEN 0 WHEN 'Less Likely' THEN 2 ELSE 1 END, score DESC, start_s, event_id) AS rank, bucket, score, text FROM scored")
def rank_moments(spark, sf_dir):
    rows = scoring.ranked(scored_of(spark, sf_dir, sessions_of(spark, sf_dir)))
    return rows.select("source", "event_id", "rank", "bucket", "score", "text")


@query("SELECT b.bucket, count(s.bucket) AS n FROM (SELECT unnest(['Likely Forced Text', 'Needs Review', 'Less Likely']) "
       "AS bucket) b LEFT JOIN scored s ON s.bucket = b.bucket GROUP BY b.bucket")
def bucket_counts(spark, sf_dir):
    return aggregates.bucket_counts(scored_of(spark, sf_dir, sessions_of(spark, sf_dir)))


@query()
def ranked_tracked_moments(spark, sf_dir):
    """The whole scan: fuzzy tracking, moments, scores and ranks."""
    found = entities.track_detections(src.detections(spark, sf_dir), config.Tracking(max_gap=GAP))
    found = entities.group_moments(found, config.mode("adaptive").seconds())
    found = found.withColumn("norm", text.normalised(F.col("text")))
    rows = scoring.ranked(scored_of(spark, sf_dir, found, ascii_only=False))
    return rows.select("source", "event_id", "rank", "bucket", "score", "text")


# ---- reports and streams --------------------------------------------------------------------------------------------------


@query()
def event_report_rows(spark, sf_dir):
    return reports.event_rows(scored_of(spark, sf_dir, sessions_of(spark, sf_dir)))


@query("SELECT bucket, score, text, " + stamp("start_s") + " AS start, " + stamp("end_s") + " AS \"end\", duration, reasons AS why, "
       "round(average_confidence, 6) AS average_confidence, maximum_confidence, maximum_detector_confidence, dialogue_free_ratio, "
       "position, n_detections, classification, source, event_id FROM scored")
def review_sheet(spark, sf_dir):
    rows = reports.review_rows(scored_of(spark, sf_dir, sessions_of(spark, sf_dir)))
    return rows.withColumn("average_confidence", F.round("average_confidence", 6))


@query()
def audit_json(spark, sf_dir):
    found = sessions_of(spark, sf_dir)
    return reports.audit(scored_of(spark, sf_dir, found), found)


@query()
def audit_lines(spark, sf_dir):
    """The whole audit of all sources, a JSON line for each part."""
    found = settled(sessions_of(spark, sf_dir))
    return reports.audit_lines(scored_of(spark, sf_dir, found), found, scan={"mode": "adaptive", "end_seconds": END})


@query()
def html_report(spark, sf_dir):
    return reports.html_report(scoring.ranked(scored_of(spark, sf_dir, sessions_of(spark, sf_dir))))


@query("""
SELECT t.source, t.event_id, t.ts, coalesce(f.frame_index, l.frame_index) AS frame_index, coalesce(f.ts, l.ts) AS frame_ts
FROM (SELECT source, event_id, start_s + 0.01::DOUBLE AS ts, start_s + 0.01::DOUBLE - 1e-6 AS key FROM spans) t
ASOF LEFT JOIN (SELECT source, ts, min(frame_index) AS frame_index FROM frames GROUP BY ALL) f ON f.source = t.source AND t.key <= f.ts
JOIN (SELECT source, max(ts) AS ts, arg_max(frame_index, ts) AS frame_index FROM frames GROUP BY source) l ON l.source = t.source""")
def evidence_after(spark, sf_dir):
    """The first frame at or after a moment's start, a hundredth later, as none is there."""
    spans = aggregates.spans(sessions_of(spark, sf_dir))
    targets = settled(spans.select("source", "event_id", (F.col("start_s") + F.lit(0.01)).alias("ts")))
    return reports.evidence_after(targets, slim_frames(spark, sf_dir))


def default_scan(spark: SparkSession, sf_dir: str, gaps_only: bool = False) -> scans.Found:
    how = config.Scan(config.mode("adaptive"), start=START, end=END)
    vocab = scoring.vocabulary(src.table(spark, sf_dir, "documents"))
    return scans.scan(
        slim_frames(spark, sf_dir),
        src.detections(spark, sf_dir),
        vocab,
        how,
        src.cues(spark, sf_dir),
        src.scene_cuts(spark, sf_dir),
        gaps_only,
    )


@query()
def scan_sources(spark, sf_dir):
    """A whole scan in one call: sampled frames, kept detections, tracked, scored and ranked moments."""
    return default_scan(spark, sf_dir).moments.select("source", "event_id", "rank", "bucket", "score", "text")


@query()
def scan_gaps_only(spark, sf_dir):
    return default_scan(spark, sf_dir, gaps_only=True).frames


@query("SELECT b.source, b.event_id, b.frame_index, 1920 AS width, 1080 AS height FROM best b")
def event_evidence(spark, sf_dir):
    best = aggregates.best_detections(sessions_of(spark, sf_dir))
    return reports.evidence(best, src.frames(spark, sf_dir)).drop("file")


@query("SELECT source, list_sort(list(place)) AS detection_indexes, event_id FROM (SELECT t.source, t.event_id, "
       "row_number() OVER (PARTITION BY source ORDER BY ts, text, ord) - 1 AS place FROM tracked t) GROUP BY source, event_id")
def event_detection_indexes(spark, sf_dir):
    return aggregates.emission_order(sessions_of(spark, sf_dir))


@query("SELECT source, start, \"end\", duration_seconds FROM (SELECT source, " + stamp("start_s") + " AS start, "
       + stamp("end_s") + " AS \"end\", printf('%.3f', end_s - start_s) AS duration_seconds FROM gaps) "
       "WHERE contains(lower(source || ' ' || start || ' ' || \"end\" || ' ' || duration_seconds), '00:01:')")
def report_search(spark, sf_dir):
    return reports.searched(reports.gap_rows(gaps(spark, sf_dir)), "00:01:")


@query("""
SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n FROM (
  SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o
    FROM events)) GROUP BY user_id, s""")
def session_stream_batch_equiv(spark, sf_dir):
    return sessions.streamed_sessions(spark, f"{sf_dir}/events.parquet")

