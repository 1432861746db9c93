"""Search over one table of resources, and their one-hop relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 50


def resources(*parts: tuple[DataFrame, str, str, str, list[str]]) -> DataFrame:
    """(table, kind, id column, name column, searched columns) as one table: kind, id, name, haystack (lower case)."""
    out = None
    for df, kind, ident, name, searched in parts:
        text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in searched]))
        one = df.select(F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), F.col(name).cast("string").alias("name"), text.alias("haystack"))
        out = one if out is None else out.unionByName(one)
    return out


def parse_query(raw: str, kinds: list[str]) -> tuple[str | None, str]:
    """``kind:text`` with a known kind narrows to it."""
    kind, mark, text = raw.partition(":")
    return (kind.strip(), text.strip()) if mark and kind.strip() in kinds else (None, raw.strip())


def search(found: DataFrame, raw: str, kinds: list[str], limit: int = MOST) -> DataFrame:
    """Resources that hold the text, by kind and id; the limit is the page of a report, at most 50."""
    kind, text = parse_query(raw, kinds)
    hits = found.where(F.contains("haystack", F.lit(text.lower())))
    if kind:
        hits = hits.where(F.col("kind") == kind)
    return hits.select("kind", "id", "name").orderBy("kind", "id").limit(min(limit, MOST))


def match_rank(term: str, name: Column, group: Column, *texts: Column) -> Column:
    """0 the name itself, 1 in the name, 2 in the group, 3 in a text; null: no match."""
    t = F.lit(term.lower())
    inside = lambda c: F.coalesce(F.contains(F.lower(c), t), F.lit(False))
    any_text = F.lit(False)
    for c in texts:
        any_text = any_text | inside(c)
    return F.when(F.lower(name) == t, 0).when(inside(name), 1).when(inside(group), 2).when(any_text, 3)


def resolved(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Any ids (``id``) as the resources that bear them: id, kind, name; of several kinds, the first by kind; none, null."""
    one = found.groupBy("id").agg(F.min_by("kind", F.struct("kind", "name")).alias("kind"), F.min_by("name", F.struct("kind", "name")).alias("name"))
    return ids.select("id").distinct().join(one, "id", "left")


def around(relations: DataFrame, ident: str) -> DataFrame:
    """What one resource is related to (``source``, ``relation``, ``target``), by relation and target; filtered at the scan."""
    return relations.where(F.col("source") == ident).select("relation", "target").distinct()
