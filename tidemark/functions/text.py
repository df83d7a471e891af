"""Text, time and handle expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans.model import SCHEME

# Scrubbed Unicode categories, and what a percent-encoded key keeps.
SCRUBBED = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Co}\p{Cs}]"
SPACES = r"[\s\p{Z}]+"
KEPT_IN_KEYS = {"%2F": "/", "%7C": "|", "%7E": "~", "+": "%20", "*": "%2A"}


def one_line(x: Column) -> Column:
    """Control and format characters to spaces, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, SCRUBBED, " "), SPACES, " "))


def quoted(x: Column, cap: int) -> Column:
    """A value on one line in double quotes: scrubbed, capped, then escaped; null as the word null."""
    flat = one_line(x)
    cut = F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)
    escaped = F.replace(F.replace(cut, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(x.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def python_text(x: Column, dtype: str) -> Column:
    """The text form rules compare: True/False for booleans, ISO text for dates and times, digits for numbers, 10000000.0 and nan for floats."""
    if dtype in ("double", "float"):
        from tidemark.functions.udfs import float_text  # the only form that needs Python

        return float_text(x.cast("double"))
    if dtype == "boolean":
        return F.when(x, F.lit("True")).when(~x, F.lit("False"))
    if dtype.startswith("timestamp"):
        return iso(x)
    if dtype == "binary":
        return F.concat(F.lit("<"), F.octet_length(x).cast("string"), F.lit(" bytes sha256:"), F.substring(F.sha2(x, 256), 1, 12), F.lit(">"))
    return x.cast("string")


def visible(x: Column) -> Column:
    """Characters that a page would not show (controls, formats, private ones, blanks but the space) as their numbers in hexadecimal, backslashes doubled."""
    each = F.split(F.replace(x, F.lit("\\"), F.lit("\\\\")), "")
    shown = lambda c: F.when(c.rlike(r"^(?! )[\p{C}\p{Z}]$"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.encode(c, "UTF-32"))), F.lit("}"))).otherwise(c)
    return F.array_join(F.transform(each, shown), "")


def log_line(x: Column) -> Column:
    """Control characters and line ends as single spaces."""
    return F.trim(F.regexp_replace(x, "[\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]+", " "))


def percent(x: Column) -> Column:
    """A share as whole percent, half up; a dash for null."""
    return F.coalesce(F.concat(F.format_number(F.round(x * 100), 0), F.lit("%")), F.lit("-"))


def thousands(x: Column) -> Column:
    return F.coalesce(F.format_number(x, 0), F.lit("-"))


def money(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(x, 3)), F.lit("-"))


def tokens(x: Column) -> Column:
    """ceil(length / 3.5) in whole numbers."""
    return F.floor((F.length(x) * F.lit(2) + F.lit(6)) / F.lit(7)).cast("long")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'")


def age(seconds: Column) -> Column:
    """Whole seconds below a minute, minutes below an hour, hours below two days, else days."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, part(1, "s")).when(s < 3600, part(60, "m")).when(s < 48 * 3600, part(3600, "h")).otherwise(part(86400, "d"))


def schedule_seconds(text: Column) -> Column:
    """Seconds of "every <n><s|m|h|d>", null if it is none or below 10 seconds."""
    rx = r"^every ([1-9][0-9]*)(s|m|h|d)$"
    n = F.when(text.rlike(rx), F.regexp_extract(text, rx, 1).try_cast("long"))
    unit = F.regexp_extract(text, rx, 2)
    out = n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(out >= 10, out)


def event_handle(seq: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://evt/"), seq.cast("string"))


def encoded_key(key: Column) -> Column:
    out = F.url_encode(key)
    for a, b in KEPT_IN_KEYS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def record_handle(source: Column, key: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://rec/"), source, F.lit("/"), encoded_key(key))


def batch_handle(lo: Column, hi: Column, source: Column | None = None, after: Column | None = None) -> Column:
    """Range handle; a null source or after leaves its parameter out."""
    parts = [F.concat(F.lit("source="), F.lit(None).cast("string") if source is None else source), F.concat(F.lit("after="), (F.lit(None) if after is None else after).cast("string"))]
    query = F.concat_ws("&", *parts)
    return F.concat(F.lit(f"{SCHEME}://batch/"), lo.cast("string"), F.lit("-"), hi.cast("string"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def reference(kind: Column, ref: Column) -> Column:
    """Graded references: the only run of digits, else (system) words joined by dashes in upper case."""
    digits = F.regexp_extract(ref, r"^\D*?(\d+)\D*$", 1)
    words = F.upper(F.regexp_replace(F.trim(ref), r"[\s_-]+", "-"))
    return F.when(F.lower(kind) == "system", words).when(digits != "", digits).otherwise(F.trim(ref))
