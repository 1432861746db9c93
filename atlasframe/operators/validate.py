"""Integrity rules as rows: every violation, not the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("rule", "subject", "detail")


def violation(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def orphans(df: DataFrame, ref: str, targets: DataFrame, key: str, rule: str) -> DataFrame:
    """References to rows that aren't there; null references are none. They are counted before they meet the targets, so that a task sorts each only once; Spark would move an anti join back below the count."""
    known = targets.select(F.col(key).alias(ref), F.lit(True).alias("_known"))
    lost = df.where(F.col(ref).isNotNull()).groupBy(ref).count().join(known.hint("merge"), ref, "left").where("_known is null")
    return violation(lost, rule, F.col(ref), F.concat(F.col("count").cast("string"), F.lit(" references")))


def duplicates(df: DataFrame, scope: list[str], rule: str) -> DataFrame:
    """Keys that several rows have."""
    return violation(df.groupBy(*scope).count().where("count > 1"), rule, F.concat_ws("/", *[F.col(c).cast("string") for c in scope]), F.concat(F.col("count").cast("string"), F.lit(" rows")))


def failing(df: DataFrame, holds: Column, rule: str, subject: Column, detail: Column) -> DataFrame:
    """Rows for which ``holds`` isn't true (null counts as failing)."""
    return violation(df.where(~F.coalesce(holds, F.lit(False))), rule, subject, detail)


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
