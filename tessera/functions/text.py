"""Text functions as column expressions; code points, Unicode-aware, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: Unicode white space and the four information separators.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def collapsed(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def stripped(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, rf"^{WHITE}|{WHITE[4:]}$", "")


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is there; null is blank."""
    return F.coalesce(text.rlike(r"(?U)^[\s\x1c-\x1f]*\z"), F.lit(True))


def strip_punctuation(text: Column) -> Column:
    """Punctuation and symbols become spaces, runs of white space one space; combining marks stay. Null stays null."""
    return collapsed(F.regexp_replace(text, r"[\p{P}\p{S}]", " "))


def words(text: Column) -> Column:
    """Words between single spaces, or between any white space where text is not collapsed."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def artifact_flags(candidate: Column, asr: Column, n_headings: Column) -> Column:
    """Flags of a candidate text, in their fixed order."""
    # Names of the flags.
    rules = [
        ("empty_candidate", is_blank(candidate)),
        ("empty_asr", is_blank(asr)),
        ("parentheses", candidate.rlike(r"[()\[\]{}]")),
        ("digits_or_latin", candidate.rlike("[0-9A-Za-z]")),
        ("repeated_word", strip_punctuation(candidate).rlike(r"(?:^| )(\S+) \1 \1(?: |$)")),
        ("contains_heading", n_headings > 0),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate: edits over the reference's length in code points; null for an empty reference."""
    return F.try_divide(F.levenshtein(reference, hypothesis), F.char_length(reference))


def speaking_rate(candidate: Column, duration: Column) -> Column:
    """Characters a second, without punctuation and spaces; 0 where there is no duration."""
    marks = F.char_length(F.replace(strip_punctuation(candidate), F.lit(" "), F.lit("")))
    return F.when(duration > 0, marks / duration).otherwise(0.0)


def number(text: Column) -> Column:
    """A decimal number in a text, with white space around and underscores between digits; null for anything else."""
    plain = F.regexp_replace(stripped(text), r"(?<=[0-9])_(?=[0-9])", "")
    word = F.lower(F.regexp_replace(plain, "^[+-]", ""))
    value = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), plain.try_cast("double"))
    sign = F.when(plain.startswith("-"), -1.0).otherwise(1.0)
    return F.when(word == "nan", float("nan")).when(word.isin("inf", "infinity"), sign * float("inf")).otherwise(value)


def media_kind(url: Column, content_type: Column) -> Column:
    """direct-mp3, stream-manifest, direct-audio or other; the first that holds. Only an MP3's ending is looked for in the URL's path."""
    # Content types and endings.
    mp3, streams = ("audio/mpeg", "audio/mp3", "audio/mpeg3"), ("application/dash+xml", "application/vnd.apple.mpegurl", "application/x-mpegurl")
    kind, whole = bare_type(content_type), F.lower(url)
    path = F.regexp_extract(whole, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, ";[^/]*$", "")
    return (
        F.when(kind.isin(*mp3) | path.endswith(".mp3"), "direct-mp3")
        .when(kind.isin(*streams) | whole.endswith(".m3u8") | whole.endswith(".mpd"), "stream-manifest")
        .when(kind.startswith("audio/"), "direct-audio")
        .otherwise("other")
    )


def bare_type(content_type: Column) -> Column:
    """A content type without its parameters, in lower case; null is empty."""
    return F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))


def relative_path(path: Column, root: str) -> Column:
    """A path with forward slashes, relative to root where it lies under it; `.` and doubled slashes go, `name/..` too."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(?:\./|/)+", "/")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(?:\./)+", ""), r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    top = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(plain.startswith(top), F.substring(plain, len(top) + 1, 1 << 30)).otherwise(plain)


def class_suffixes(classes: Column) -> Column:
    """What follows the last `__` of each class name."""
    return F.transform(words(F.coalesce(classes, F.lit(""))), lambda c: F.substring_index(c, "__", -1))


def is_reviewer(name: Column) -> Column:
    """A pseudonym: a letter and 1 to 19 letters, digits, _ or -, white space around ignored."""
    return F.coalesce(stripped(name).rlike(r"^[A-Za-z][A-Za-z0-9_-]{1,19}\z"), F.lit(False))


def is_speaker(name: Column, prefix: str = "VH_S") -> Column:
    """A pseudonym of at least three digits after the prefix, or unknown; one newline at the end is let through."""
    return F.coalesce(name.rlike(rf"^({prefix}[0-9]{{3,}}|unknown)\n?\z"), F.lit(False))
