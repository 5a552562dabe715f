"""What a scan tells: event rows, an audit in JSON, gap rows and evidence, as DataFrames; writers where Spark has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions.text import escaped, fixed, percent, time_stamp
from cuelight.operators.aggregates import KEY, emission_order
from cuelight.operators.blocks import running

SCHEMA_VERSION = 3


def _yes(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def event_rows(scored: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The twenty text columns of the event report. names(source, source_filename) defaults to the source itself."""
    rows = scored
    if names is None:
        rows = rows.withColumn("source_filename", F.col("source").cast("string"))
    else:
        rows = rows.join(names, "source", "left")
    c = F.col
    shot = evidence_name(c("event_id"), c("start_s"))
    box = F.concat_ws(",", *[fixed(c(k), 1) for k in "xywh"])
    # fixed values: the report's column names
    return rows.select(
        c("event_id").cast("string").alias("Event ID"),
        time_stamp(c("start_s")).alias("Start Time"),
        time_stamp(c("end_s")).alias("End Time"),
        time_stamp(c("duration")).alias("Duration"),
        c("text").alias("Detected Text"),
        fixed(c("average_confidence"), 3).alias("Average Confidence"),
        fixed(c("maximum_confidence"), 3).alias("Maximum Confidence"),
        fixed(c("maximum_detector_confidence"), 3).alias("Detector Confidence"),
        fixed(c("score"), 3).alias("Relevance Score"),
        c("bucket").alias("Review Bucket"),
        F.array_join("reasons", "; ").alias("Why Flagged"),
        fixed(c("dialogue_free_ratio"), 3).alias("Dialogue-Free Ratio"),
        c("position").alias("Position"),
        box.alias("Bounding Box"),
        c("n_detections").cast("string").alias("Detection Count"),
        _yes(c("persistent")).alias("Persistent"),
        c("classification").alias("Classification"),
        shot.alias("Evidence Screenshot"),
        F.lit("").alias("Annotated Screenshot"),
        c("source_filename").alias("Source Filename"),
    )


def evidence_name(event_id: Column, seconds: Column) -> Column:
    number = event_id.cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(padded, F.lit("_"), F.regexp_replace(time_stamp(seconds), "[:.]", "-"), F.lit(".jpg"))


def review_rows(scored: DataFrame) -> DataFrame:
    """The review sheet: numbers stay numbers, the verdict comes first."""
    return scored.select(
        "bucket",
        "score",
        "text",
        time_stamp(F.col("start_s")).alias("start"),
        time_stamp(F.col("end_s")).alias("end"),
        "duration",
        F.array_join("reasons", "; ").alias("why"),
        "average_confidence",
        "maximum_confidence",
        "maximum_detector_confidence",
        "dialogue_free_ratio",
        "position",
        "n_detections",
        "classification",
        "source",
        "event_id",
    )


def evidence(best: DataFrame, frames: DataFrame) -> DataFrame:
    """Each event's frame, by the index of its best detection; null sizes where the frame isn't kept."""
    kept = frames.select("source", "frame_index", "width", "height")
    return best.join(kept, ["source", "frame_index"], "left").select(
        *KEY, "frame_index", "width", "height", evidence_name(F.col("event_id"), F.col("ts")).alias("file")
    )


def evidence_frames(detections: DataFrame) -> DataFrame:
    """The frames that keep at least one detection."""
    return detections.select("source", "frame_index").distinct()


def evidence_after(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """source, event_id, ts and the frame that shows it: the first one at or after the time, with a slack of a
    millionth; the source's last frame where none comes after.

    targets(source, event_id, ts). One pass over the union of both, from the end, makes no pairs.
    """
    marks = targets.select(
        "source", (F.col("ts") - F.lit(1e-6)).alias("__at"), F.lit(0).alias("__side"), F.col("event_id").alias("__id"),
        F.struct("event_id", "ts").alias("__target"),
    )
    shown = frames.select(
        "source", F.col("ts").alias("__at"), F.lit(1).alias("__side"), F.col("frame_index").alias("__id"),
        F.struct(F.col("ts").alias("frame_ts"), "frame_index").alias("__frame"),
    )
    both = marks.unionByName(shown, allowMissingColumns=True)
    seen = running(both, "source", "__at", ["__at", "__side", "__id"], {"__next": ("min", F.col("__frame"))}, backwards=True)
    last = frames.groupBy("source").agg(F.max(F.struct(F.col("ts").alias("frame_ts"), "frame_index")).alias("__last"))
    found = seen.where("__side = 0").join(last, "source", "left")
    return found.select("source", "__target.*", F.coalesce("__next", "__last").alias("__f")).select(
        "source", "event_id", "ts", "__f.frame_index", "__f.frame_ts"
    )


def _event_json(scored: DataFrame) -> DataFrame:
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "source",
        "event_id",
        F.bround("start_s", 3).alias("start_seconds"),
        F.bround("end_s", 3).alias("end_seconds"),
        "text",
        "classification",
        F.bround("score", 3).alias("relevance_score"),
        F.col("bucket").alias("review_bucket"),
        F.col("reasons").alias("relevance_reasons"),
        F.bround("dialogue_free_ratio", 3).alias("dialogue_free_ratio"),
        F.col("near_cut").alias("near_scene_change"),
        "title_like",
        "credit_sequence",
        "repeated_graphic",
        "detection_indexes",
    )
    return scored.select(*KEY, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def audit(scored: DataFrame, detections: DataFrame) -> DataFrame:
    """One JSON text for each event, with the places of its detections in order of emission."""
    return _event_json(scored.join(emission_order(detections), KEY))


def audit_lines(scored: DataFrame, detections: DataFrame, sources: DataFrame | None = None, scan: dict | None = None) -> DataFrame:
    """The whole audit as JSON lines: source, part ("source", "scan", "event" or "detection"), place and json.

    sources: (source, ...) with what is known of each; scan: the settings. A line a row keeps a source of any length
    writable; detections come in order of emission, to which events refer.
    """
    line = lambda rows, part, place: rows.select(
        "source", F.lit(part).alias("part"), place.cast("long").alias("place"), "json"
    )
    keep = {"ignoreNullFields": "false"}
    known = detections.select("source").distinct() if sources is None else sources
    heads = known.withColumn("json", F.to_json(F.struct(*known.columns), keep))
    settings = F.create_map(*[F.lit(str(x)) for pair in (scan or {}).items() for x in pair]) if scan else F.create_map()
    scans = known.select("source", F.to_json(settings).alias("json"))
    own = Window.partitionBy("source").orderBy("ts", "text", "ord")
    shown = ["ts", "text", "confidence", "detector_confidence", "x", "y", "w", "h", "frame_index"]
    placed = detections.withColumn("__at", F.row_number().over(own) - 1)
    marks = placed.select("source", "__at", F.to_json(F.struct(*shown), keep).alias("json"))
    events = audit(scored, detections)
    parts = [
        line(heads, "source", F.lit(0)),
        line(scans, "scan", F.lit(0)),
        line(events, "event", F.col("event_id")),
        line(marks, "detection", F.col("__at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with html: a table row of the columns' values, escaped."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.withColumn("html", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))


def html_report(scored: DataFrame) -> DataFrame:
    """One page part for each bucket, the fullest of a source's report: source, bucket, n and html. A bucket's rows are
    in rank order; a source's moments are few beside its detections."""
    shown = ["rank", "start", "end", "text", "share", "why"]
    cells = scored.select(
        "source", "bucket", "rank", time_stamp(F.col("start_s")).alias("start"), time_stamp(F.col("end_s")).alias("end"), "text",
        percent(F.col("score")).alias("share"), F.array_join("reasons", "; ").alias("why"),
    )
    listed = html_rows(cells, shown).groupBy("source", "bucket").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "html"))).alias("__rows")
    )
    head = F.lit("".join(f"<th>{c}</th>" for c in shown))
    body = F.array_join(F.transform("__rows", lambda r: r["html"]), "")
    title = F.concat(escaped(F.col("bucket")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    page = F.concat(F.lit("<section><h2>"), title, F.lit("</h2><table><tr>"), head, F.lit("</tr>"), body, F.lit("</table></section>"))
    return listed.select("source", "bucket", "n", page.alias("html"))


def gap_rows(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        "source",
        time_stamp(F.col("start_s")).alias("start"),
        time_stamp(F.col("end_s")).alias("end"),
        fixed(F.col("end_s") - F.col("start_s"), 3).alias("duration_seconds"),
    )


def searched(rows: DataFrame, words: str) -> DataFrame:
    """Report rows whose text, in any column, contains the words, whatever their case."""
    line = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in rows.columns]))
    return rows.where(line.contains(words.lower()))


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Sorted CSV part files with a header; ranges of rows keep the order across files."""
    rows.orderBy(*order).write.option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.text(path)
