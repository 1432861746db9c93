"""References of specifications: tokens in backticks that name something, and what they name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of references in the order in which they are tried.
ORDER = ("url", "requirement", "task", "typed-slug", "catalog-id", "source")


def references(texts: DataFrame, items: DataFrame, ids: DataFrame, slugs: DataFrame, paths: DataFrame) -> DataFrame:
    """spec, raw, kind, status, target; each (kind, raw) of a specification once; prose that names nothing is left out.

    ``texts``: spec, text; ``items``: spec, kind (requirement or task), id; ``ids``: id of anything in the catalog; ``slugs``: kind,
    slug, id (a slug that several have resolves to nothing); ``paths``: spec, path.
    """
    raw = texts.select("spec", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\n]+)`"), F.lit(1))).alias("raw")).where("raw = trim(raw) and raw <> ''").distinct()
    path = F.regexp_replace(F.regexp_replace("raw", r":\d+$", ""), r"^\./", "")
    one = slugs.groupBy("kind", "slug").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_slug_id")).where("_n = 1").select(F.concat("kind", F.lit(":"), "slug").alias("raw"), "_slug_id")
    item = items.groupBy("spec", F.col("id").alias("raw")).agg(F.min_by("kind", F.when(F.col("kind") == "requirement", 0).otherwise(1)).alias("_item"))
    kinds = reduce(lambda a, b: a | b, [F.col("raw").startswith(k) for k in ("service:", "context:", "flow:", "event:", "aggregate:", "store:")])
    j = raw.join(item, ["spec", "raw"], "left").join(one, "raw", "left").join(ids.select(F.col("id").alias("raw")).distinct().withColumn("_known", F.lit(True)), "raw", "left")
    j = j.withColumn("_path", path).join(paths.select("spec", F.regexp_replace("path", r"^\./", "").alias("_path")).distinct().withColumn("_there", F.lit(True)), ["spec", "_path"], "left")
    looks = F.col("_path").rlike(r"^[\w.@-]+(/[\w.@-]+)+$|^[\w-]+\.(md|ya?ml|json|go|ts|py|sql|proto)$")
    dotted = F.col("raw").rlike(r"^[a-z][\w-]*(\.[\w-]+)+$")
    kind = (
        F.when(F.col("raw").rlike(r"^https?://\S+$"), "url").when(F.col("_item").isNotNull(), F.col("_item")).when(kinds, "typed-slug").when(F.col("_known"), "catalog-id").when(looks, "source").when(dotted, "catalog-id")
    )
    found = F.when(kind == "url", F.col("raw")).when(F.col("_item").isNotNull(), F.col("raw")).when(kind == "typed-slug", F.col("_slug_id")).when(F.col("_known"), F.col("raw")).when((kind == "source") & F.col("_there"), F.col("_path"))
    return j.select("spec", "raw", kind.alias("kind"), F.when(found.isNotNull(), "resolved").otherwise("unresolved").alias("status"), found.alias("target")).where("kind is not null")


def unresolved(found: DataFrame) -> DataFrame:
    return found.where("status = 'unresolved'")


def activity(*parts: tuple[DataFrame, str, str, str, str]) -> DataFrame:
    """One timeline of several tables: (table, kind, time column, subject column, text column) -> at, kind, subject, text, newest first."""
    rows = [df.select(F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.col(text).alias("text")) for df, kind, at, subject, text in parts]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc_nulls_last("at"), "kind", "subject")
