"""A table engine: typed sorting, inferred types, facets, groups, cross tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.plans.checkpoints import checkpoint

#: What counts as a number, a version and a date in a text column, and as a version to be ordered.
NUMBER, VERSION, DATE = r"^-?\d+(\.\d+)?$", r"^v?\d+(\.\d+)*$", r"^\d{4}-\d{2}-\d{2}([T ][\d:.]+(Z|[+-]\d{2}:?\d{2})?)?$"
ORDERED = r"^[vV]?(\d+(?:\.\d+)*)(?:-([^+]*))?(?:\+.*)?$"


def version_key(c: Column) -> Column:
    """Sort key of a version: its numbers, however many (missing ones are 0), release after pre-release, numeric parts before text; null if it can't be read; build data is ignored."""
    core, pre = F.regexp_replace(F.regexp_extract(c, ORDERED, 1), r"(\.0+)+$", ""), F.regexp_extract(c, ORDERED, 2)
    numbers = F.transform(F.split(core, "\\."), lambda x: x.cast("decimal(38,0)"))
    parts = F.transform(F.split(pre, "\\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.when(core != "", F.struct(numbers.alias("core"), (pre == "").alias("release"), parts.alias("pre")))


def sort_keys(name: str, kind: str, descending: bool = False, ranks: tuple[str, ...] = ()) -> list[Column]:
    """Order of a column by its kind (text, number, count, version, date, status, kind); unreadable and null values come last either way."""
    c = F.col(name)
    key = {
        "number": lambda: c.cast("string").try_cast("double"),
        "count": lambda: c.cast("string").try_cast("double"),
        "version": lambda: version_key(c.cast("string")),
        "date": lambda: F.try_to_timestamp(c.cast("string")),
        "status": lambda: F.array_position(F.lit(list(ranks)), c) if ranks else c,
        "kind": lambda: F.array_position(F.lit(list(ranks)), c) if ranks else c,
    }.get(kind, lambda: F.lower(c))()
    ways = [key, c.cast("string")]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in ways]


def sorted_by(df: DataFrame, spec: str, kinds: dict[str, str]) -> DataFrame:
    """Order by ``"col.asc,col.desc"``; unknown columns, bad directions and repeated columns are left out."""
    keys, seen = [], set()
    for part in filter(None, (spec or "").split(",")):
        name, _, way = part.rpartition(".")
        if name in kinds and way in ("asc", "desc") and name not in seen:
            seen.add(name)
            keys += sort_keys(name, kinds[name], way == "desc")
    return df.orderBy(*keys) if keys else df


def numbered(df: DataFrame, keys: list[Column], place: str = "place") -> DataFrame:
    """Rows of the whole table numbered from 1 in the order of ``keys``, which no two rows may share, without one task that holds them all.

    Rows are dealt by ranges of the keys and numbered in their part; the sizes of the parts before it, one row a part, are added.
    """
    order = [c.alias(f"_k{i}") for i, c in enumerate(keys)]
    dealt = checkpoint(df.select("*", *order).repartitionByRange(*[f"_k{i}" for i in range(len(keys))]).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn(place, F.row_number().over(Window.partitionBy("_part").orderBy(*[f"_k{i}" for i in range(len(keys))])).cast("long"))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(place, F.col(place) + F.col("_before")).select(*df.columns, place)


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type) of text columns in one pass: number, version, date or text over the cells that aren't blank. A date must be a day of the calendar."""
    trimmed = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns}
    aggs = [f for c in columns for f in (F.count(trimmed[c]).alias(f"{c}_n"), *(F.bool_and(trimmed[c].rlike(p) & (F.lit(True) if k != "date" else F.substring(trimmed[c], 1, 10).try_cast("date").isNotNull())).alias(f"{c}_{k}") for k, p in (("number", NUMBER), ("version", VERSION), ("date", DATE))))]
    one = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.when(F.col(f"{c}_n") == 0, "text").when(F.col(f"{c}_number"), "number").when(F.col(f"{c}_version"), "version").when(F.col(f"{c}_date"), "date").otherwise("text").alias("type")) for c in columns]
    return one.select(F.inline(F.array(*cells)))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, rows) of several columns in one pass; blanks don't count, and a facet of fewer than two values is hidden."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_c")).select("_c.*")
    counts = cells.where("trim(value) <> ''").groupBy("facet", "value").agg(F.count("*").alias("rows"))
    return counts.withColumn("_n", F.count("*").over(Window.partitionBy("facet"))).where("_n >= 2").drop("_n")


def stripes(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Alternating 0 and 1 inside each group."""
    return df.withColumn("stripe", ((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) % 2).cast("long"))


def access_matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Cross table: the sorted different values of each cell, joined with ``+``; empty where there are none."""
    out = df.groupBy(row).pivot(column, columns).agg(F.array_join(F.array_sort(F.collect_set(value)), "+"))
    return out.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def status_counts(df: DataFrame, key: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def health(df: DataFrame, key: list[str], status: str, hop: Column) -> DataFrame:
    """unresolved if any step is; verified if all hops are and there is one; else declared."""
    s = F.col(status)
    return df.groupBy(*key).agg(
        F.when(F.bool_or(s == "unresolved"), "unresolved").when(F.coalesce(F.bool_and(F.when(hop, s == "verified")), F.lit(False)), "verified").otherwise("declared").alias("health")
    )


def grouped_warnings(df: DataFrame, key: list[str], severity: str, message: str) -> DataFrame:
    return df.groupBy(*key, severity).agg(F.count("*").alias("rows"), F.min(message).alias("example"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
