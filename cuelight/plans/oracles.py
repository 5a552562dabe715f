"""The registered queries in plain SQL. Each starts from the derived tables that it needs."""

from __future__ import annotations

from cuelight.functions.text import SOUND
from cuelight.sources.adapters import RANGE_END, SQL

E = f"{RANGE_END}::DOUBLE"
D = "::DOUBLE"

_NORM = (
    "regexp_replace(regexp_replace(translate(upper(trim({0})), '015|', 'OISI'), '\\s+', ' ', 'g'), "
    "'^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')"
)
_CAMEL = "regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
_STAMP = (
    "printf('%02d:%02d:%02d.%03d', greatest(0, {0}) // 3600000, greatest(0, {0}) // 60000 % 60, "
    "greatest(0, {0}) // 1000 % 60, greatest(0, {0}) % 1000)"
)


def stamp(seconds: str) -> str:
    return _STAMP.format(f"round_even(({seconds}) * 1000, 0)::BIGINT")


TABLES = dict(SQL)
TABLES["merged"] = f"""
SELECT source, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_cues FROM (
  SELECT *, sum(CASE WHEN m IS NULL OR start_s > m + 0.05{D} THEN 1 ELSE 0 END)
    OVER (PARTITION BY source ORDER BY start_s, end_s, cue_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(end_s) OVER (PARTITION BY source ORDER BY start_s, end_s, cue_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cues))
GROUP BY source, island"""


def _gaps(minimum: float) -> str:
    return f"""
SELECT source, a AS start_s, b AS end_s FROM (
  SELECT source, greatest(greatest(0{D}, coalesce(p, 0{D})), coalesce(p + 0.15{D}, 0{D})) AS a,
    least({E}, coalesce(n - 0.15{D}, {E})) AS b,
    least({E}, coalesce(n, {E})) - greatest(0{D}, coalesce(p, 0{D})) AS raw
  FROM (
    SELECT source, start_s AS n, lag(end_s) OVER (PARTITION BY source ORDER BY start_s) AS p, end_s
    FROM merged WHERE start_s < {E} + 0.15{D}
    UNION ALL
    SELECT s.source, NULL, max(m.end_s), NULL FROM (SELECT DISTINCT source FROM merged) s
      LEFT JOIN merged m ON m.source = s.source AND m.start_s < {E} + 0.15{D} GROUP BY s.source)
  WHERE n IS NULL OR end_s > 0{D} - 0.15{D})
WHERE raw >= {minimum}{D} AND b > a"""


TABLES["gaps"] = _gaps(1.0)
TABLES["gaps2"] = _gaps(2.0)
TABLES["quiet"] = f"""
SELECT source, end_s + 0.05{D} AS ts FROM (
  SELECT *, coalesce(lead(start_s) OVER (PARTITION BY source ORDER BY start_s), {E}) AS n FROM merged)
WHERE n - end_s >= 0.4{D} AND end_s >= 0 AND end_s <= {E}"""
TABLES["midpoints"] = f"SELECT source, (start_s + end_s) / 2 AS ts FROM gaps WHERE end_s - start_s <= 2.0{D}"
TABLES["priorities"] = f"""
SELECT * FROM (SELECT source, ts FROM cuts UNION ALL SELECT * FROM midpoints UNION ALL SELECT * FROM quiet)
WHERE ts >= 0 AND ts <= {E}"""
TABLES["activity"] = f"""
SELECT f.*, EXISTS (SELECT 1 FROM merged m WHERE m.source = f.source AND m.start_s <= f.ts + 0.15{D}
  AND m.start_s - 0.15{D} <= f.ts AND f.ts <= m.end_s + 0.15{D}) AS active FROM frames f"""
TABLES["held"] = """
SELECT f.*, g.start_s AS gap_start, g.end_s AS gap_end FROM frames f JOIN gaps g
ON g.source = f.source AND g.start_s <= f.ts AND f.ts < g.end_s"""
TABLES["normed"] = f"SELECT *, {_NORM.format('text')} AS norm FROM detections"
TABLES["sessions"] = f"""
SELECT *, sum(opens) OVER (PARTITION BY source, norm ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN p IS NULL OR ts - p > 2.8{D} THEN 1 ELSE 0 END AS opens FROM (
    SELECT *, lag(ts) OVER (PARTITION BY source, norm ORDER BY ts, ord) AS p FROM normed))"""
TABLES["tracked"] = """
SELECT s.*, f.event_id FROM sessions s JOIN (
  SELECT source, norm, session, row_number() OVER (PARTITION BY source ORDER BY min(ts), norm, session) AS event_id
  FROM sessions GROUP BY source, norm, session) f USING (source, norm, session)"""
TABLES["spans"] = """
SELECT *, CASE WHEN duration >= 60 THEN 'Likely persistent graphic' WHEN duration >= 15 THEN 'Persistent'
  WHEN duration <= 1 THEN 'Brief' ELSE 'Normal' END AS classification, duration >= 15 AS persistent FROM (
  SELECT source, event_id, min(ts) AS start_s, max(ts) AS end_s, count(*) AS n_detections,
    count(DISTINCT round_even(ts * 1000, 0)::BIGINT) AS n_times, greatest(0, max(ts) - min(ts)) AS duration
  FROM tracked GROUP BY source, event_id)"""
TABLES["sure"] = """
SELECT source, event_id, avg(confidence) AS average_confidence, max(confidence) AS maximum_confidence,
  max(detector_confidence) AS maximum_detector_confidence FROM tracked GROUP BY source, event_id"""
TABLES["best"] = """
SELECT source, event_id, ord, frame_index, ts, text, frame_width, frame_height FROM tracked
QUALIFY row_number() OVER (PARTITION BY source, event_id ORDER BY confidence DESC, length(text) DESC, ord) = 1"""
_POSITION = f"""CASE WHEN fw <= 0 OR fh <= 0 THEN 'Unknown'
  WHEN w / fw > 0.65{D} OR h / fh > 0.45{D} THEN 'Multiple / Large Area'
  WHEN cx = 'Center' AND cy = 'Center' THEN 'Center' ELSE cy || ' ' || cx END"""
_THIRDS = f"""CASE WHEN (x + w / 2) / fw < 1{D} / 3 THEN 'Left' WHEN (x + w / 2) / fw > 2 * (1{D} / 3) THEN 'Right'
    ELSE 'Center' END AS cx,
  CASE WHEN (y + h / 2) / fh < 1{D} / 3 THEN 'Upper' WHEN (y + h / 2) / fh > 2 * (1{D} / 3) THEN 'Lower'
    ELSE 'Center' END AS cy"""
TABLES["boxes"] = f"""
SELECT source, event_id, x, y, w, h, fw AS frame_width, fh AS frame_height, {_POSITION} AS position FROM (
  SELECT *, {_THIRDS} FROM (
    SELECT t.source, t.event_id, min(t.x) AS x, min(t.y) AS y, max(t.x + t.w) - min(t.x) AS w,
      max(t.y + t.h) - min(t.y) AS h, min(b.frame_width) AS fw, min(b.frame_height) AS fh
    FROM tracked t JOIN best b USING (source, event_id) GROUP BY t.source, t.event_id))"""
TABLES["texts"] = """
SELECT source, event_id, coalesce(string_agg(line, ' / ' ORDER BY y, x, ord) FILTER (WHERE norm <> ''), '') AS text FROM (
  SELECT t.source, t.event_id, t.norm, t.y, t.x, t.ord, trim(t.text) AS line FROM tracked t JOIN (
    SELECT source, event_id, ms FROM (
      SELECT source, event_id, round_even(ts * 1000, 0)::BIGINT AS ms, sum(length(trim(text)) * confidence) AS w,
        min(ord) AS o FROM tracked GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY source, event_id ORDER BY w DESC, o) = 1) k
  ON k.source = t.source AND k.event_id = t.event_id AND k.ms = round_even(t.ts * 1000, 0)::BIGINT
  QUALIFY row_number() OVER (PARTITION BY t.source, t.event_id, t.norm ORDER BY t.y, t.x, t.ord) = 1)
GROUP BY source, event_id"""
TABLES["counts"] = """
SELECT lang, lower(unnest(regexp_extract_all(text, '\\p{L}{3,}'))) AS word FROM documents WHERE lang IN ('en', 'es')"""
TABLES["vocab"] = f"""
SELECT word, lang, log10(1e9{D} * n / sum(n) OVER (PARTITION BY lang)) AS zipf FROM (
  SELECT lang, word, count(*) AS n FROM counts GROUP BY lang, word)"""
TABLES["known"] = f"""
SELECT t AS text, count(DISTINCT w) AS n_words FROM (
  SELECT text AS t, lower(unnest(regexp_extract_all({_CAMEL.format('text')}, '\\p{{L}}{{3,}}'))) AS w
  FROM (SELECT DISTINCT text FROM texts))
WHERE w IN (SELECT word FROM vocab WHERE zipf >= 3.0{D})
  AND w NOT IN ('com', 'http', 'https', 'net', 'org', 'www') GROUP BY t"""
TABLES["ratios"] = f"""
SELECT source, event_id, avg(CASE WHEN active THEN 0{D} ELSE 1{D} END) AS dialogue_free_ratio FROM (
  SELECT t.*, EXISTS (SELECT 1 FROM merged m WHERE m.source = t.source AND m.start_s <= t.ts + 0.15{D}
    AND m.start_s - 0.15{D} <= t.ts AND t.ts <= m.end_s + 0.15{D}) AS active
  FROM (SELECT DISTINCT source, event_id, ts FROM tracked) t)
GROUP BY source, event_id"""
TABLES["near"] = f"""
SELECT DISTINCT s.source, s.event_id FROM spans s JOIN cuts c ON c.source = s.source AND abs(s.start_s - c.ts) <= 1{D}"""
TABLES["features"] = f"""
SELECT *, position = 'Center' AND (width_ratio >= 0.22{D} OR height_ratio >= 0.07{D}) AND NOT single_symbol
    AND start_s <= 900 AS title_like,
  position IN ('Upper Left', 'Upper Right', 'Lower Left', 'Lower Right') AND area_ratio < 0.012{D}
    AND (duration >= 12 OR repeats >= 3) AS repeated_graphic FROM (
  SELECT s.*, u.* EXCLUDE (source, event_id), b.* EXCLUDE (source, event_id), t.text,
    coalesce(k.n_words, 0) AS n_words, coalesce(r.dialogue_free_ratio, 0{D}) AS dialogue_free_ratio,
    n.event_id IS NOT NULL AS near_cut,
    CASE WHEN {_NORM.format('t.text')} = '' THEN 0
      ELSE count(*) OVER (PARTITION BY s.source, {_NORM.format('t.text')}) END AS repeats,
    w * h / (frame_width * frame_height) AS area_ratio, w / frame_width AS width_ratio,
    h / frame_height AS height_ratio,
    length(regexp_replace(t.text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 1 AS single_symbol,
    length(regexp_replace(t.text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) > length(t.text) * 0.2{D} AS symbol_heavy
  FROM spans s JOIN sure u USING (source, event_id) JOIN boxes b USING (source, event_id)
    JOIN texts t USING (source, event_id) LEFT JOIN known k ON k.text = t.text
    LEFT JOIN ratios r USING (source, event_id) LEFT JOIN near n USING (source, event_id))"""
_SUM = f"""0.12{D} + least(0.24{D}, maximum_confidence * 0.24{D})
  + coalesce(CASE WHEN maximum_detector_confidence IS NOT NULL THEN least(0.1{D}, maximum_detector_confidence * 0.1{D}) END, 0{D})
  + CASE WHEN n_times >= 3 THEN 0.22{D} WHEN n_times = 2 THEN 0.14{D} ELSE -0.04{D} END
  + CASE WHEN n_times >= 3 AND duration >= 2 THEN 0.05{D} ELSE 0{D} END
  + CASE WHEN single_symbol THEN -0.34{D} WHEN n_words >= 4 THEN 0.2{D} WHEN n_words >= 2 THEN 0.16{D}
      WHEN n_words = 1 THEN 0.06{D} ELSE -0.22{D} END
  + CASE WHEN NOT single_symbol AND n_words = 0 AND symbol_heavy THEN -0.1{D} ELSE 0{D} END
  + CASE WHEN area_ratio < 0.00025{D} THEN -0.14{D} WHEN area_ratio >= 0.002{D} THEN 0.07{D} ELSE 0{D} END
  + CASE WHEN title_like THEN 0.2{D} ELSE 0{D} END
  + CASE WHEN dialogue_free_ratio >= 0.75{D} THEN 0.16{D} ELSE 0{D} END
  + CASE WHEN near_cut THEN 0.05{D} ELSE 0{D} END
  + CASE WHEN repeated_graphic THEN -0.32{D} ELSE 0{D} END"""
_REASONS = """concat_ws('; ',
  CASE WHEN n_times >= 3 THEN 'confirmed across frames' WHEN n_times = 2 THEN 'seen twice' END,
  CASE WHEN n_times >= 3 AND duration >= 2 THEN 'held on screen' END,
  CASE WHEN single_symbol THEN 'isolated symbol or character' WHEN n_words >= 4 THEN 'several recognizable words'
    WHEN n_words >= 2 THEN 'recognizable words' WHEN n_words = 1 THEN 'recognizable word'
    ELSE 'no common English/Spanish words recognized' END,
  CASE WHEN NOT single_symbol AND n_words = 0 AND symbol_heavy THEN 'symbol-heavy OCR' END,
  CASE WHEN area_ratio < 0.00025 THEN 'very small on screen' END,
  CASE WHEN title_like THEN 'large centered title' END,
  CASE WHEN dialogue_free_ratio >= 0.75 THEN 'appears in a dialogue gap'
    WHEN dialogue_free_ratio <= 0.25 THEN 'overlaps dialogue' END,
  CASE WHEN near_cut THEN 'near a scene change' END,
  CASE WHEN repeated_graphic THEN 'persistent or repeated graphic' END)"""
TABLES["scored"] = f"""
SELECT *, CASE WHEN repeated_graphic THEN 'Less Likely' WHEN n_words > 0 AND score >= 0.64{D} THEN 'Likely Forced Text'
  WHEN score >= 0.36{D} THEN 'Needs Review' ELSE 'Less Likely' END AS bucket FROM (
  SELECT *, least(1{D}, greatest(0{D}, {_SUM})) AS score, {_REASONS} AS reasons FROM features)"""


def sql(body: str) -> str:
    """body after the derived tables that it names, and those that these name, in order."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(TABLES[name])
                needed.append(name)

    need(body)
    ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in needed)
    return f"WITH {ctes}\n{body}" if needed else body


_MARKUP = "regexp_replace({0}, '<[^>]+>', '', 'g')"
_DECODED = (
    "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
    "'&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
)
_SPACES = r"[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]"
_TRIM = "regexp_replace({0}, '^" + _SPACES + "+|" + _SPACES + "+$', '', 'g')"
_LINE = "CASE WHEN conv_id % 5 = 0 THEN '<i>Music playing</i>' WHEN turn % 4 = 1 THEN '[' || replace(text, ']', ' ') || ']' WHEN turn % 4 = 2 THEN '♪ ' || text WHEN turn % 4 = 3 THEN '- ' || text ELSE text END"
_SAID = f"regexp_replace({_TRIM.format(_DECODED.format(_MARKUP.format('line')))}, '^[-–—]\\s*', '')"
_REST = "regexp_replace(regexp_replace(said, '\\[[^\\]]+\\]|\\([^)]*\\)', '', 'g'), '^[ \\-–—:\\t]+|[ \\-–—:\\t]+$', '', 'g')"

_LINES = f"SELECT conv_id, turn, unnest(string_split({_LINE}, chr(10))) AS line FROM conversations"
_DIALOGUE = f"""
SELECT conv_id, turn, bool_or(coalesce(said <> '' AND NOT regexp_matches(said, '[♪♫♬]')
  AND NOT regexp_matches(said, '(?i)^(?:{SOUND})$') AND rest <> '' AND NOT regexp_matches(rest, '(?i)^(?:{SOUND})$'), false))
  AS dialogue FROM (SELECT *, {_REST} AS rest FROM (SELECT *, {_SAID} AS said FROM ({_LINES})))
GROUP BY conv_id, turn"""
DIALOGUE = _DIALOGUE


def markup(line: str) -> str:
    """A line without markup, with the basic entities decoded, trimmed."""
    return _TRIM.format(_DECODED.format(_MARKUP.format(line)))


STATISTICS = f"""
SELECT conv_id::VARCHAR AS source, count(*) AS total_cues, sum((turn % 7 <> 6 AND NOT dialogue)::INT)::BIGINT AS non_dialogue_cues
FROM ({_DIALOGUE}) GROUP BY conv_id"""
