"""Text, lines and offsets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n"))


def column_at(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    return (F.length(F.element_at(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n"), F.lit(-1))) + 1).cast("int")


def lines(text: Column) -> Column:
    """The lines of a text, whichever line ends it has."""
    return F.split(text, "\r?\n")


def indent_width(line: Column) -> Column:
    """Width of the leading white space, a tab counting four."""
    return F.length(F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))


def normal_line(line: Column) -> Column:
    """A line as duplication compares it: white space folded, literals blanked."""
    folded = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(folded, r"\"[^\"]*\"|'[^']*'", "\"\""), r"\b[0-9]+(?:\.[0-9]+)?\b", "0")


def redacted(value: Column) -> Column:
    """A short prefix, then stars: at least four, never the whole value."""
    return F.concat(F.substring(value, F.lit(1), F.least(F.lit(4), F.floor(F.length(value) / 4).cast("int"))), F.repeat(F.lit("*"), F.greatest(F.lit(4), F.least(F.lit(16), F.length(value) - 4))))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return F.coalesce(
        F.aggregate(
            F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n),
            F.lit(0.0),
            lambda acc, p: acc - p * F.log2(p),
        ),
        F.lit(0.0),
    )


def visible_words(text: Column) -> Column:
    """Number of words longer than a character."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 1))


def strip_tags(html: Column) -> Column:
    """Readable text of markup: scripts, styles, comments and tags become spaces."""
    bare = html
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KiB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024.0 * 1024.0)), F.lit(" MiB")))
    )


def half_up(x: Column) -> Column:
    """Rounding with halves upwards, also below zero."""
    return F.floor(x + 0.5)


def complexity(body: Column) -> Column:
    """1 + decision points of a function body."""
    return 1 + F.regexp_count(body, F.lit(r"\b(?:if|elif|elsif|for|foreach|while|case|when|catch|except|rescue)\b|&&|\|\||\?\?|\s\?\s|\band\b|\bor\b"))


def interpolate(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def invalid_yaml_escape(line: Column) -> Column:
    """Does a double-quoted scalar of a line hold an escape that YAML doesn't know?"""
    scalars = F.regexp_extract_all(line, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.exists(scalars, lambda s: F.exists(F.regexp_extract_all(s, F.lit(r"\\(.)"), F.lit(1)), lambda e: ~e.rlike(r'[0abt\tnvfre "/\\N_LPxuU]')))


def duration(seconds: Column) -> Column:
    """A time span in words, in its largest unit: ``3 days``; under a minute it is ``now``."""
    out = F.when(seconds < 60, F.lit("now"))
    for low, unit in ((3600, 60), (86_400, 3600), (604_800, 86_400), (2_592_000, 604_800), (31_536_000, 2_592_000)):
        name = {60: "minute", 3600: "hour", 86_400: "day", 604_800: "week", 2_592_000: "month"}[unit]
        n = F.floor(seconds / unit)
        out = out.when(seconds < low, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s")))
    n = F.floor(seconds / 31_536_000)
    return out.when(seconds.isNotNull(), F.concat(n.cast("string"), F.lit(" year"), F.when(n == 1, "").otherwise("s")))
