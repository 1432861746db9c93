"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def middle_truncate(c: Column, most: int = 44) -> Column:
    """Both ends of a long value around an ellipsis, ``most`` characters in all."""
    head = most // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(most - head - 1))))


def blurb(c: Column, most: int = 160) -> Column:
    """Plain words of Markdown, cut at ``most`` characters; null if nothing is left."""
    plain = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[`*_#>|]", ""), r"\s+", " "))
    return F.nullif(F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 1), F.lit("…"))), F.lit(""))


def leading_summary(markdown: Column) -> Column:
    """The first paragraph that is no heading."""
    return F.nullif(F.trim(F.regexp_extract(F.concat(F.lit("\n\n"), markdown), r"\n\s*\n(?!\s*#)([^\n]+(?:\n[^\n]+)*)", 1)), F.lit(""))


def outline(markdown: Column) -> Column:
    """Headings of Markdown in order: array of (level, text)."""
    lines = F.filter(F.split(markdown, r"\n"), lambda x: x.rlike(r"^#{1,6} +\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+ +", "")).alias("text")))


def abbreviations(c: Column) -> Column:
    """Different words of two to six capitals, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])([A-Z]{2,6})(?![A-Za-z0-9_])"), F.lit(1))))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def repo_name(c: Column) -> Column:
    """host/path of a repository address, however it is spelled: without scheme, user, port, closing slashes and ``.git``."""
    bare = F.regexp_replace(F.trim(c), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^@/]+@)?", "")
    hosted = F.regexp_replace(bare, r"^([^/:]+):(?:\d+/)?(?!/)", "$1/")
    return F.lower(F.regexp_replace(hosted, r"/*$|(?:\.git)/*$", ""))


def source_line(c: Column) -> Column:
    """``path:line`` as (path, line); no line, null."""
    line = F.regexp_extract(c, r"^(.*):(\d+)$", 2)
    return F.struct(F.when(line == "", c).otherwise(F.regexp_extract(c, r"^(.*):(\d+)$", 1)).alias("path"), F.nullif(line, F.lit("")).cast("int").alias("line"))


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where CSV needs it."""
    safe = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(safe.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(safe, F.lit("")))


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def relative_time(then: Column, now: Column) -> Column:
    """Age in the largest fitting unit."""
    s = F.timestamp_diff("SECOND", then, now)
    out = F.when(s < 60, F.lit("just now"))
    for unit, size, most in (("minute", 60, 3600), ("hour", 3600, 86400), ("day", 86400, 30 * 86400), ("month", 30 * 86400, 365 * 86400)):
        out = out.when(s < most, F.concat(plural(F.floor(s / size), unit), F.lit(" ago")))
    return out.otherwise(F.concat(plural(F.floor(s / (365 * 86400)), "year"), F.lit(" ago")))


def milliseconds(start_ns: Column, end_ns: Column) -> Column:
    return F.greatest(F.lit(0.0), (end_ns - start_ns) / 1e6)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s")))


def issue_keys(c: Column, projects: list[str]) -> Column:
    """Different tracker keys such as ABC-12 of the given projects, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"\b((?:{'|'.join(projects)})-\d+)\b"), F.lit(1)))
