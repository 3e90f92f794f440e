"""Column expressions for byte strings, previews, ids and ratios; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(raw, at: int, n: int, width: int | None = None) -> Column:
    """A big-endian whole number of n bytes at offset `at`."""
    return F.conv(F.hex(F.substring(raw, at + 1, n)), 16, 10).cast("long")


def base64(raw) -> Column:
    """Base64 without the line breaks that Spark inserts."""
    return F.translate(F.base64(raw), "\r\n", "")


def latin1(raw) -> Column:
    """One character for each byte, so that byte regular expressions work on text functions."""
    return F.decode(raw, "ISO-8859-1")


def hex_text(raw) -> Column:
    """Lower-case pairs with blanks between."""
    return F.regexp_replace(F.lower(F.hex(raw)), "(..)(?!$)", "$1 ")


def safe_text(raw) -> Column:
    """Printable bytes, CR, LF and TAB; a dot for each other byte."""
    return F.regexp_replace(latin1(raw), "[^\\n\\r\\t\\x20-\\x7e]", ".")


def lossy(raw) -> Column:
    return latin1(raw).rlike("[^\\n\\r\\t\\x20-\\x7e]")


def preview(raw) -> Column:
    """Text with CR, LF and TAB escaped and a dot for each other unprintable byte."""
    text = F.replace(F.replace(F.replace(latin1(raw), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(text, "[^\\x20-\\x7e]", ".")


def class_counts(raw, limit: int = 4096) -> dict[str, Column]:
    """Bytes of the first `limit` by class; bytes from 0x80 on count as printable."""
    text = latin1(F.substring(raw, 1, limit))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return {
        "sampled": F.length(text).cast("long"), "nulls": count("\\x00"), "whitespace": count("[\\t\\r\\n ]"),
        "control": count("[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"), "printable": count("[\\x21-\\x7e\\x80-\\xff]"),
    }


def content_kind(c: dict[str, Column]) -> Column:
    """unknown, binary, text or mixed of class counts."""
    n = F.greatest(c["sampled"], F.lit(1))
    percent = lambda x: F.floor(x * 100 / n)
    return (
        F.when(c["sampled"] == 0, "unknown").when((c["nulls"] > 0) | (percent(c["control"]) > 5), "binary")
        .when(percent(c["whitespace"] + c["printable"]) >= 90, "text").otherwise("mixed")
    )


def combine_kinds(a: Column, b: Column) -> Column:
    return F.when(a == "unknown", b).when(b == "unknown", a).when(a == b, a).otherwise("mixed")


def milli(top: Column, bottom: Column) -> Column:
    """top * 1000 / bottom, truncated; null where bottom is 0."""
    return F.when(bottom != 0, F.floor(top * 1000 / bottom)).cast("long")


def token(x) -> Column:
    """Names as they are compared: trimmed, lower case, underscores."""
    return F.lower(F.translate(F.trim(x), "- ", "__"))


def endpoint(address, port) -> Column:
    return F.format_string("%s:%d", address, port)


def first_when(rules: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first rule that holds."""
    out = F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules]) if rules else F.lit(None)
    return F.coalesce(out, F.lit(otherwise)) if otherwise is not None else out
