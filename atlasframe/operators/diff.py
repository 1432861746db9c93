"""Differences of two snapshots, with a severity for each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.merge import STATUSES, rank_of

#: Severities in the order in which they are told.
SEVERITIES = ("breaking", "addition", "change")


def keyed_diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str], entity: str, removed: str = "breaking", changed: str | dict[str, Column | str] = "change") -> DataFrame:
    """Added, removed and changed rows: entity, where, kind, field, before, after, severity.

    ``changed`` may name a severity by field; a Column over ``before_F`` and ``after_F`` decides row by row.
    """
    a = before.select(*key, *[F.col(f).alias(f"before_{f}") for f in fields]).withColumn("_in_a", F.lit(True))
    b = after.select(*key, *[F.col(f).alias(f"after_{f}") for f in fields]).withColumn("_in_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def change(kind: str, field: Column, old: Column, new: Column, severity: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), field.alias("field"), old.alias("before"), new.alias("after"), severity.alias("severity"))

    whole = [
        F.when(F.col("_in_b").isNull(), change("removed", none, none, none, F.lit(removed))),
        F.when(F.col("_in_a").isNull(), change("added", none, none, none, F.lit("addition"))),
    ]
    parts = []
    for f in fields:
        s = changed.get(f, "change") if isinstance(changed, dict) else changed
        s = s if isinstance(s, Column) else F.lit(s)
        differs = F.col("_in_a") & F.col("_in_b") & ~F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}"))
        parts.append(F.when(differs, change("changed", F.lit(f), text(f"before_{f}"), text(f"after_{f}"), s)))
    rows = both.select(F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("where"), F.explode(F.array_compact(F.array(*whole, *parts))).alias("_c"))
    return rows.select(F.lit(entity).alias("entity"), "where", "_c.*")


def status_severity(before: Column, after: Column) -> Column:
    """A drop in rank breaks; any other move is a change."""
    return F.when(rank_of(after, STATUSES) > rank_of(before, STATUSES), "breaking").otherwise("change")


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy(rank_of(F.col("severity"), SEVERITIES), "where", "kind", "field")


def against_main(key: list[str], base: DataFrame, branch: DataFrame, main: DataFrame, value: str) -> DataFrame:
    """Three-way state of each key that the branch touched: added, removed, changed, or conflict if main moved too."""
    named = [df.select(*key, F.col(value).alias(n)).withColumn(f"_{n}", F.lit(True)) for n, df in (("base", base), ("branch", branch), ("main", main))]
    j = named[0].join(named[1], key, "full_outer").join(named[2], key, "full_outer")
    moved = ~(F.col("base").eqNullSafe(F.col("main")) & F.col("_base").eqNullSafe(F.col("_main")))
    same = F.col("branch").eqNullSafe(F.col("main")) & F.col("_branch").eqNullSafe(F.col("_main"))
    touched = ~(F.col("base").eqNullSafe(F.col("branch")) & F.col("_base").eqNullSafe(F.col("_branch")))
    state = F.when(moved & ~same, "conflict").when(F.col("_base").isNull(), "added").when(F.col("_branch").isNull(), "removed").otherwise("changed")
    return j.where(touched).select(*key, state.alias("state"))


def version_changes(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each version against the one before it: a row per field that changed."""
    w = Window.partitionBy(*key).orderBy(*order)
    seen = df.withColumn("_n", F.row_number().over(w))
    for f in fields:
        seen = seen.withColumn(f"_was_{f}", F.lag(f).over(w))
    cells = F.array_compact(F.array(*[F.when((F.col("_n") > 1) & ~F.col(f).eqNullSafe(F.col(f"_was_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"_was_{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after"))) for f in fields]))
    return seen.select(*key, *order, F.explode(cells).alias("_c")).select(*key, *order, "_c.*")
