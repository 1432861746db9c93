"""Ownership files and commit logs as rows, and what they say of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.functions.text import issue_keys


def owner_rules(files: DataFrame, text: str) -> DataFrame:
    """Rules of ownership files in order: file columns, ``rule`` (line), ``section``, ``pattern``, ``owners``, ``exclude``.

    ``[Name][2] @default`` opens a section with owners for its rules that name none; ``#`` starts a comment; ``!pattern`` excludes.
    """
    lines = files.select(*[c for c in files.columns if c != text], F.posexplode(F.split(text, r"\r?\n")).alias("rule", "_line"))
    line = F.trim(F.regexp_replace("_line", r"(^|\s)#.*$", ""))
    head = line.rlike(r"^\^?\[[^\]]+\]")
    kept = [c for c in files.columns if c != text]
    w = Window.partitionBy(*kept).orderBy("rule").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    opened = lines.withColumn("_l", line).withColumn("_head", head).withColumn("section", F.last(F.when(F.col("_head"), F.regexp_extract("_l", r"^\^?\[([^\]]+)\]", 1)), ignorenulls=True).over(w))
    opened = opened.withColumn("_default", F.last(F.when(F.col("_head"), words(F.regexp_replace("_l", r"^\^?\[[^\]]+\](?:\[\d+\])?", ""))), ignorenulls=True).over(w))
    parts = words(F.col("_l"))
    own = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    rules = opened.where("not _head and _l <> ''").select(*kept, "rule", F.coalesce("section", F.lit("")).alias("section"), F.regexp_replace(F.get(parts, F.lit(0)), r"^!", "").alias("pattern"), F.when(F.size(own) > 0, own).otherwise(F.coalesce("_default", own)).alias("owners"), F.get(parts, F.lit(0)).startswith("!").alias("exclude"))
    return rules


def rooted(pattern: Column, floating: bool = False) -> Column:
    """Does a pattern hold from the top only? With a slash in front; without ``floating``, with one inside too."""
    return pattern.startswith("/") if floating else F.regexp_replace(pattern, "/$", "").contains("/")


def glob_regex(pattern: Column, floating: bool = False) -> Column:
    """The pattern as a regular expression over paths that start with a slash.

    A pattern that isn't rooted matches at any depth; ``*`` stays in a folder, ``**`` does not; ``[...]`` is one of some characters; a trailing slash, or no
    star at the end, takes in all below.
    """
    anchored = F.when(rooted(pattern, floating), F.regexp_replace(pattern, "^/?", "/")).otherwise(F.concat(F.lit("/**/"), pattern))
    safe = F.regexp_replace(F.regexp_replace(anchored, r"([.+${}()|\\])", r"\\$1"), r"(?<!\[)\^", r"\\^")
    deep = F.regexp_replace(F.regexp_replace(safe, r"/\*\*/", "/\u0001"), r"\*\*", "\u0002")
    shallow = F.regexp_replace(F.regexp_replace(deep, r"\*", "[^/]*"), r"\?", "[^/]")
    body = F.replace(F.replace(shallow, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(body, "/$", ""), F.when(pattern.endswith("/"), F.lit("/.*$")).when(pattern.rlike(r"[^*]\*$"), F.lit("$")).otherwise(F.lit("(?:/.*)?$")))


def owners_of(paths: DataFrame, path: str, rules: DataFrame, sections: bool = False) -> DataFrame:
    """Owners of each path: the last matching rule wins; with ``sections``, the last of each section, all together, and an exclusion silences its section.

    With ``sections``, patterns with a slash inside float as well, unless they are rooted. Each rule is looked up under the first folder that it names, if it is rooted and names one
    plainly, so most paths meet few rules.
    """
    p = F.regexp_replace(F.col(path), "^/?", "/")
    scope = [path, "section"] if sections else [path]
    first = F.split(F.regexp_replace("pattern", "^/", ""), "/")[0]
    keyed = rules.withColumn("_re", glob_regex(F.col("pattern"), sections)).withColumn("_top", F.when(rooted(F.col("pattern"), sections) & ~first.rlike(r"[*?\[]") & (first != ""), first).otherwise(""))
    asked = paths.select(path).distinct().withColumn("_top", F.explode(F.array_distinct(F.array(F.lit(""), F.split(p, "/")[1]))))
    hits = asked.join(keyed, "_top").where(F.regexp_like(p, F.col("_re")))
    last = hits.groupBy(*scope).agg(F.max_by("owners", "rule").alias("owners"), F.bool_or("exclude").alias("_out")).where("not _out")
    if sections:
        last = last.groupBy(path).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "owners"))), lambda x: x["owners"]))).alias("owners"))
    return paths.join(last.select(path, "owners"), path, "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


def parse_log(lines: DataFrame, line: str, order: list[str], log: list[str] | None = None) -> DataFrame:
    """``hash|iso date|subject`` heads followed by changed paths: commit, date, subject, path, and the columns of ``log``.

    ``log``: what tells one log from another (a repository, a file); each log is one sequence of lines.
    """
    log = log or []
    head = F.col(line).rlike(r"^[0-9a-f]{7,40}\|")
    w = Window.partitionBy(*(log or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_h", F.last(F.when(head, F.col(line)), ignorenulls=True).over(w)).where(~head & (F.trim(F.col(line)) != ""))
    parts = F.split("_h", r"\|", 3)
    return marked.select(*log, parts[0].alias("commit"), F.try_to_timestamp(parts[1]).alias("date"), parts[2].alias("subject"), F.trim(F.col(line)).alias("path"))


def work_items(log: DataFrame, projects: list[str]) -> DataFrame:
    """Issue keys of commit subjects with the paths they touched: key, path, commits, last date.

    A commit is counted at the first of its rows in their order: a distinct count keeps a table of nearly all rows beside the sort that ``parse_log`` ends with.
    """
    keyed = log.withColumn("key", F.explode(issue_keys(F.col("subject"), projects)))
    w = Window.partitionBy("commit", "path", "key").orderBy("commit")
    marked = keyed.withColumn("_first", F.lag(F.lit(1)).over(w).isNull() & F.col("commit").isNotNull())
    return marked.groupBy("key", "path").agg(F.count_if("_first").alias("commits"), F.max("date").alias("last"))
