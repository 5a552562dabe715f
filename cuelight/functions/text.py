"""Scalar text functions: caption content, normalisation, similarity, words and time stamps.

All are column expressions but three that Spark has no form for: compatibility normalisation, HTML entities beyond the
basic ones and the similarity by longest common subsequence. Those are Arrow functions, called for rows that need them.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Labels of sounds, and what may follow one.
SOUND_LABELS = (
    "music|musica|música|sfx|sound effects?|sonidos?|applause|aplausos|laughter|risas|laughing|cheering|silence|"
    "silencio|instrumental"
)
SOUND_VERBS = "plays?|playing|continues?|fades?|starts?|stops?|suena|continúa"
SOUND = rf"(?:{SOUND_LABELS})(?:\s*[:\-]\s*.*|\s+(?:{SOUND_VERBS}))?"
NOTES = "[♪♫♬]"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
WEB_WORDS = ("com", "http", "https", "net", "org", "www")
# Characters that are taken for one another, and what they count as.
CONFUSED, MEANT = "015|", "OISI"


# ---- captions --------------------------------------------------------------------------------------------------------


def without_tags(line: Column) -> Column:
    return F.regexp_replace(line, "<[^>]+>", "")


def strip_markup(line: Column) -> Column:
    """Without tags, with the basic entities decoded, trimmed. decoded() is for lines with other entities."""
    out = without_tags(line)
    for entity, meant in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(meant))
    return trimmed(out)


def decoded(lines: Column) -> Column:
    """An array of lines without tags and with every HTML entity decoded. Python sees only what holds entities other
    than the basic ones."""
    basic = "|".join(e.strip("&;") for e, _ in ENTITIES)
    joined = plain = without_tags(F.array_join(lines, "\n"))
    for entity, meant in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(meant))
    other = joined.rlike(rf"&(?!(?:{basic});)[#0-9A-Za-z]")
    return F.split(F.when(other, unescape(F.when(other, joined))).otherwise(plain), "\n")


@F.pandas_udf(StringType())
def unescape(lines: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return lines.map(html.unescape, na_action="ignore")


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def without_dash(line: Column) -> Column:
    return F.regexp_replace(line, r"^[-–—](?U)\s*", "")


def is_sound_label(line: Column) -> Column:
    return line.rlike(rf"(?iu)^(?:{SOUND})$")


def without_directions(line: Column) -> Column:
    bare = F.regexp_replace(line, r"\[[^\]]+\]|\([^)]*\)", "")
    return F.regexp_replace(bare, "^[ \\-–—:\t]+|[ \\-–—:\t]+$", "")


def has_dialogue(line: Column, bare: bool = False) -> Column:
    """Whether something is spoken: neither notes, nor a sound label, nor stage directions alone. bare lines have no
    markup left."""
    said = without_dash(trimmed(line) if bare else strip_markup(line))
    rest = without_directions(said)
    return (
        (said != "") & ~said.rlike(NOTES) & ~is_sound_label(said) & (rest != "") & ~is_sound_label(rest)
    )


def any_dialogue(lines: Column, bare: bool = False) -> Column:
    return F.coalesce(F.exists(lines, lambda line: has_dialogue(line, bare)), F.lit(False))


# ---- normalised text and similarity ----------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(text: Column, ascii_only: bool = False) -> Column:
    """Upper case, look-alikes unified, single spaces, no punctuation around; null gives the empty string.

    ascii_only says that no row needs compatibility normalisation, so that no Python runs.
    """
    text = F.coalesce(text, F.lit(""))
    if not ascii_only:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), _compatible(text)).otherwise(text)
    out = F.translate(F.upper(trimmed(text)), CONFUSED, MEANT)
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.regexp_replace(out, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 if either is empty, else the share of both that the longest common subsequence covers."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """ratio of two normalised columns."""
    return pd.Series([ratio(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


def may_be_similar(a: Column, b: Column, least: float = 86.0) -> Column:
    """A cheap test that every pair of at least that similarity passes: a pair's indel distance isn't below its
    Levenshtein distance, and its lengths bound the common subsequence."""
    total = F.length(a) + F.length(b)
    short = 200 * F.least(F.length(a), F.length(b)) >= least * total
    return short & (F.levenshtein(a, b) <= (1 - least / 100) * total + 1e-9)


# ---- words -----------------------------------------------------------------------------------------------------------


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def words(text: Column) -> Column:
    """The distinct words of three letters or more, in lower case, without web words."""
    runs = F.regexp_extract_all(split_camel(text), F.lit(r"(\p{L}{3,})"), F.lit(1))
    return F.array_except(
        F.array_distinct(F.transform(runs, F.lower)), F.array(*[F.lit(w) for w in WEB_WORDS])
    )


def count_alphanumeric(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_symbol_heavy(text: Column) -> Column:
    """More than a fifth of the text is neither a letter, a digit nor a space."""
    return F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", "")) > F.length(text) * F.lit(0.2)


# ---- time stamps -----------------------------------------------------------------------------------------------------


def time_stamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; thousandths are rounded half to even; null and negative times are zero."""
    ms = F.greatest(F.lit(0), F.rint(F.coalesce(seconds, F.lit(0.0)) * 1000).cast("long"))
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000).cast("long")
    shown = F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string"))
    minutes, secs = F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60
    return F.concat(shown, F.lit(":"), part(minutes, 2), F.lit(":"), part(secs, 2), F.lit("."), part(ms % 1000, 3))


def parse_time_stamp(value: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS with a fraction; null where the text is none of these."""
    raw = trimmed(value)
    plain = F.when(raw.rlike(r"^[+]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), raw.try_cast("double"))
    shape = r"^(?:(\d+):)?(\d+):(\d+)(?:\.(\d+))?$"
    part = lambda n: F.regexp_extract(raw, shape, n)
    whole = lambda n: F.when(part(n) == "", F.lit(0)).otherwise(part(n).try_cast("long"))
    fraction = F.when(part(4) == "", F.lit(0.0)).otherwise(F.concat(F.lit("0."), part(4)).try_cast("double"))
    timed = F.when(
        raw.rlike(shape) & (whole(2) < 60) & (whole(3) < 60), whole(1) * 3600 + whole(2) * 60 + whole(3) + fraction
    )
    return F.when(raw.contains(":"), timed).otherwise(plain)


def caption_time(value: Column) -> Column:
    """Seconds of [H:]MM:SS.mmm, where a comma is a point."""
    parts = F.split(F.replace(value, F.lit(","), F.lit(".")), ":")
    hours = F.when(F.size(parts) == 3, parts[0].cast("int")).otherwise(0)
    return hours * 3600 + F.element_at(parts, -2).cast("int") * 60 + F.element_at(parts, -1).cast("double")


def fixed(value: Column, digits: int) -> Column:
    """The number with so many decimals, rounded from its binary value; null gives the empty string."""
    return F.coalesce(F.replace(F.format_number(value, digits), F.lit(","), F.lit("")), F.lit(""))


def escaped(value: Column) -> Column:
    """Text for HTML: the ampersand, angle brackets and both quotes as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def percent(share: Column) -> Column:
    """A share in whole per cent; null gives the empty string."""
    whole = F.format_string("%.0f%%", F.bround(share * 100, 0))
    return F.when(share.isNull(), F.lit("")).otherwise(whole)


def general(value: Column) -> Column:
    """A number with six significant digits, without zeros at its end: 1.50 is 1.5, 2.0 is 2."""
    short = F.format_string("%.6g", value)
    bare = F.when(short.contains("."), F.regexp_replace(short, r"\.?0+(?=$|e)", "")).otherwise(short)
    return F.when(value.isNull(), F.lit("")).otherwise(bare)


def safe_stem(name: Column) -> Column:
    """A file stem of at most 120 harmless characters."""
    clean = F.regexp_replace(trimmed(name), r"[^A-Za-z0-9._ -]+", "_")
    clean = F.regexp_replace(clean, r"^[. _]+|[. _]+$", "")
    return F.when(clean == "", "video").otherwise(F.substring(clean, 1, 120))
