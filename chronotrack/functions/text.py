"""Text helpers, strict parsing, labels and evidence lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotrack.functions.numeric import c, is_finite

# Fixed words of the voice commands.
SHOOT, RECORD, CLEAR = ("shoot",), ("record", "cheese", "smile"), ("clear", "reset", "restart")
#: Recorder files, fixed pattern.
RECORDING = r"^recording-[0-9]+\.mp4$"


def base_name(path) -> Column:
    return F.substring_index(c(path), "/", -1)


def compact(text, limit: int = 180) -> Column:
    """Runs of white space as one space, trimmed, first ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(c(text), r"[ \t\r\n]+", " ")), 1, limit)


def log_token(text) -> Column:
    """Anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(c(text), r"[^A-Za-z0-9._-]", "_")


def is_command(text, commands: tuple[str, ...] = SHOOT) -> Column:
    """Whether any word of the text is a command."""
    return F.arrays_overlap(F.split(F.lower(c(text)), "[^a-z]+"), F.array(*[F.lit(x) for x in commands]))


def recording_name(path, pattern: str = RECORDING) -> Column:
    name = base_name(path)
    return F.when(name.rlike(pattern), name).otherwise("n/a")


def positive_feet(text) -> Column:
    """A positive finite number of feet, or null."""
    v = _try_double(F.trim(c(text)))
    return F.when(is_finite(v) & (v > 0), v)


def _try_double(x: Column) -> Column:
    return x.try_cast("double")


def strict_long(text) -> Column:
    """Digits with an optional sign, else null."""
    return F.when(c(text).rlike(r"^[+-]?[0-9]+$"), c(text).try_cast("bigint"))


def strict_double(text) -> Column:
    v = _try_double(c(text))
    return F.when(is_finite(v), v)


def scheme(uri) -> Column:
    return F.regexp_extract(c(uri), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def content_reason(uri, user_selected, retained, persistable) -> Column:
    """Why a content reference isn't usable, null if it is."""
    return F.when(~c(user_selected), "NOT_USER_SELECTED").when(scheme(uri) != "content", "UNSUPPORTED_URI").when(c(retained) & ~c(persistable), "GRANT_NOT_PERSISTABLE")


def key_value_lines(pairs: list[tuple[str, Column]]) -> Column:
    """key=value lines; a pair without a value has no line."""
    return F.concat_ws("\n", F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in pairs])))


def one_decimal(x) -> Column:
    """Number with one decimal; nan, inf and -inf by these names, null for null."""
    return F.when(is_finite(x), F.format_string("%.1f", c(x))).otherwise(F.replace(F.lower(c(x).cast("string")), F.lit("infinity"), F.lit("inf")))


def merge_distinct(a, b) -> Column:
    """Values of both lists in first-seen order."""
    return F.array_distinct(F.concat(c(a), c(b)))


def mentions(values, word: str) -> Column:
    """Whether any of the strings has the word, whatever its case."""
    return F.exists(c(values), lambda v: F.lower(v).contains(word.lower()))


def format_label(code, labels: dict[int, str], other: str) -> Column:
    """Name of a code."""
    out = F.lit(other)
    for k, v in labels.items():
        out = F.when(c(code) == k, v).otherwise(out)
    return out
