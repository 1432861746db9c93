"""Joins that resolve a reference only where the evidence is unambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_candidate_join(left: DataFrame, right: DataFrame, on: list[str], take: list[str], prefix: str = "") -> DataFrame:
    """Left rows with ``take`` of the one right row that has their key; null, and ``candidates``, where none or several have it."""
    found = right.groupBy(*on).agg(F.count("*").alias("candidates"), *[F.first(c).alias(f"{prefix}{c}") for c in take])
    out = left.join(found, on, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    for c in take:
        out = out.withColumn(f"{prefix}{c}", F.when(F.col("candidates") == 1, F.col(f"{prefix}{c}")))
    return out


def staged_resolution(left: DataFrame, ident: list[str], stages: list[tuple[str, DataFrame, list[str]]], target: str) -> DataFrame:
    """Try stages in order; the first in which exactly one target fits decides.

    A stage is (name, table with the key columns and ``target``, key columns). Adds ``target`` and ``basis`` (``unresolved``).
    """
    out = left
    for i, (_, table, on) in enumerate(stages):
        found = table.groupBy(*on).agg(F.count_distinct(target).alias(f"_n{i}"), F.min(target).alias(f"_t{i}")).where(f"_n{i} = 1").drop(f"_n{i}")
        out = out.join(found, on, "left")
    picked = F.coalesce(*[F.col(f"_t{i}") for i in range(len(stages))])
    basis = F.when(F.lit(False), F.lit(""))
    for i, (name, _, _) in enumerate(stages):
        basis = basis.when(F.col(f"_t{i}").isNotNull(), F.lit(name))
    return out.withColumn(target, picked).withColumn("basis", basis.otherwise("unresolved")).drop(*[f"_t{i}" for i in range(len(stages))])


def prefixes(path: Column, separator: str = "/") -> Column:
    """All leading parts of a path, the whole one too."""
    parts = F.split(path, separator.replace(".", "\\."))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix_join(left: DataFrame, ident: list[str], path: str, owners: DataFrame, prefix: str, owner: str, separator: str = "/") -> DataFrame:
    """The owner of the longest registered prefix of each path; equal longest prefixes of different owners resolve to none.

    An equi-join on exploded prefixes, not a range join. Adds ``owner``, ``prefix`` and ``matched`` (resolved, ambiguous, none).
    """
    steps = left.select(*ident, F.explode(prefixes(F.col(path), separator)).alias(prefix))
    hits = steps.join(owners.select(prefix, owner).distinct(), prefix)
    best = hits.groupBy(*ident).agg(F.max(F.length(prefix)).alias("_len"))
    final = hits.join(best, ident).where(F.length(prefix) == F.col("_len")).groupBy(*ident).agg(
        F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner), F.min(prefix).alias(prefix)
    )
    return left.join(final, ident, "left").withColumn("matched", F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")).withColumn(owner, F.when(F.col("_n") == 1, F.col(owner))).drop("_n")


def route_shape(path: Column) -> Column:
    """A path without query, fragment and empty segments; parameters (``%s``, ``{x}``, ``:x``) become ``{}``."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    segments = F.filter(F.split(bare, "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda x: F.when(x.rlike(r"^(%[sdv]|\{[^/]*\}|:[^/]+)$"), F.lit("{}")).otherwise(x)), "/"))


def suffixes_of(path: Column) -> Column:
    """All trailing runs of segments of a shaped path, each with a leading slash."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, n, F.size(parts)), "/")))


def wildcard_host_join(left: DataFrame, host: str, right: DataFrame, pattern: str) -> DataFrame:
    """Hosts against patterns, of which ``*.x`` stands for hosts below ``x``; an equi-join on the exploded parent domains."""
    labels = F.split(F.lower(F.col(host)), "\\.")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda n: F.concat(F.lit("*."), F.array_join(F.slice(labels, n, F.size(labels)), ".")))
    able = left.withColumn("_key", F.explode(F.array_union(F.array(F.lower(F.col(host))), F.when(F.size(labels) > 1, parents).otherwise(F.array().cast("array<string>")))))
    return able.join(right.withColumn("_key", F.lower(F.col(pattern))), "_key").drop("_key")


def resolve_http_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Unresolved HTTP calls against provided routes.

    ``calls``: call_id, service, verb (null: unknown), path, host (null: unknown), status; ``routes``: provider, ref, verb, path, hosts
    (array). A provider is not the caller. An equal shape beats a suffix; one candidate wins; of several, the one that
    answers on the call's host. Adds ref, provider, basis; the status becomes ``declared`` where one was found.
    """
    open_calls = calls.where("status = 'unresolved'").withColumn("_shape", route_shape(F.col("path")))
    served = routes.withColumn("_full", route_shape(F.col("path"))).select("provider", "ref", F.col("verb").alias("_verb"), "_full", "hosts", F.explode(F.array_distinct(suffixes_of(route_shape(F.col("path"))))).alias("_shape"))
    found = open_calls.join(served, "_shape").where("provider <> service and (verb is null or _verb is null or verb = _verb)")
    found = found.withColumn("_exact", F.col("_full") == F.col("_shape")).dropDuplicates(["call_id", "provider", "ref"])
    w = Window.partitionBy("call_id")
    best = found.withColumn("_best", F.max("_exact").over(w)).where("_exact = _best")
    answers = F.exists("hosts", lambda h: (h == F.col("host")) | (h.startswith("*.") & F.col("host").endswith(F.substring(h, 2, 1000))))
    counted = best.withColumn("_n", F.count("*").over(w)).withColumn("_hit", F.coalesce(answers, F.lit(False)).cast("int")).withColumn("_hits", F.sum("_hit").over(w))
    one = counted.where("_n = 1 or (_hits = 1 and _hit = 1)").select(
        "call_id", "ref", "provider", F.when(F.col("_n") > 1, "host").when(F.col("_exact"), "exact-route").otherwise("unique-suffix").alias("basis")
    )
    return calls.join(one, "call_id", "left").withColumn("status", F.when(F.col("ref").isNotNull(), "declared").otherwise(F.col("status")))
