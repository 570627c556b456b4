"""Scalar expressions over text, times and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Locator schemes that are never redacted.
OPEN_SCHEMES = ["artifact:", "memory:", "knowledge:"]


def _zoned(text: Column) -> Column:
    """ISO-8601 text with a zone: UTC where it names none."""
    text = F.trim(text)
    return F.when(text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d[T ]\d"), text).when(text.rlike(r"\d[T ]\d"), F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("T00:00:00Z")))


def parse_time(text: Column) -> Column:
    """ISO-8601 text as a timestamp; a time without zone is UTC, whatever the session's zone. Bad text is an error."""
    return F.to_timestamp(_zoned(text))


def try_parse_time(text: Column) -> Column:
    """``parse_time``, with null for bad text."""
    return F.try_to_timestamp(_zoned(text))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end; null if either is."""
    return F.timestamp_diff("MILLISECOND", start, end)


def duration_millis(start: Column, end: Column) -> Column:
    """``millis_between``, at least 0. A null end must stay null, which ``greatest`` alone would turn into 0."""
    ms = millis_between(start, end)
    return F.when(ms.isNotNull(), F.greatest(ms, F.lit(0)))


def redact(value: Column, kind: Column | str) -> Column:
    """``redacted:<kind>:<12 digits of sha-256>``; a null value gives an empty text."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("redacted:"), kind, F.lit(":"), F.substring(F.sha2(F.encode(value, "utf-8"), 256), 1, 12)))


def redact_locator(locator: Column) -> Column:
    """Locators of an open scheme stay; others keep what stands before the first colon."""
    cut = F.instr(locator, ":")
    opened = F.lit(False)
    for scheme in OPEN_SCHEMES:
        opened = opened | locator.startswith(scheme)
    tail = redact(F.substring(locator, cut + 1, F.length(locator)), "locator")
    return F.when(locator.isNull() | opened, locator).when(cut > 0, F.concat(F.substring(locator, F.lit(1), cut), tail)).otherwise(redact(locator, "locator"))


def normalized(text: Column) -> Column:
    """Lower case with single spaces; null for blank text."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(""))


def slug(text: Column) -> Column:
    """Runs of letters and digits in lower case, joined by underscores."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def first_text(*columns: Column, limit: int = 300) -> Column:
    """The first of several texts that is not blank, cut to ``limit`` characters."""
    return F.left(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns]), F.lit(limit))


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def prompt_tokens(text: Column) -> Column:
    """The estimate of a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))


def without_origins(text: Column, origins: Column) -> Column:
    """Every origin in the text gives way to a marker, the longest origin first."""
    longest = F.array_sort(origins, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, o: F.replace(t, o, F.lit("<runtime-origin>")))


def prometheus_sample(name: Column, labels: Column, value: Column) -> Column:
    """A line of the text exposition format, from a map of labels; label values are escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    inner = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return F.concat(name, inner, F.lit(" "), value.cast("string"))


def ordered_case(rules: list[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    """The value of the first rule that holds; a null condition does not."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default) if out is not None else F.lit(default)


def limited_output(out: Column, err: Column, limit: int) -> Column:
    """A struct of stdout, stderr and truncated from two binary outputs: together they keep ``limit`` bytes, the first one first; what is no UTF-8 then gives way to U+FFFD."""
    most = max(limit, 0)
    first, second = F.coalesce(out, F.lit(b"")), F.coalesce(err, F.lit(b""))
    decoded = lambda raw: F.make_valid_utf8(raw.cast("string"))
    left = F.greatest(F.lit(most) - F.octet_length(first), F.lit(0))
    return F.struct(decoded(F.substring(first, F.lit(1), F.lit(most))).alias("stdout"), decoded(F.substring(second, F.lit(1), left)).alias("stderr"), (F.octet_length(first) + F.octet_length(second) > most).alias("truncated"))
