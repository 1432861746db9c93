"""Relationship queries over the merged catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.resolve import prefixes


def links(t: dict[str, DataFrame]) -> DataFrame:
    """All typed links of the catalog: kind, source, target, status, label. What links here is a filter on ``target``."""
    none = F.lit(None).cast("string")

    def one(df: DataFrame, kind: str, source: Column, target: Column, status: Column = none, label: Column = none) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), status.alias("status"), label.alias("label")).where("source is not null and target is not null")

    c = F.col
    parts = [
        one(t["calls"], "call", c("service"), c("peer"), c("status"), c("id")),
        one(t["consumers"], "consumer", c("consumer"), c("event"), c("status"), c("note")),
        one(t["events"], "event", c("service"), c("id"), label=c("name")),
        one(t["flow_nodes"].where("type = 'step'").groupBy("flow_id", "ref").agg(F.min_by("status", "ord").alias("status"), F.min_by("node_id", "ord").alias("step")), "flow", c("flow_id"), c("ref"), c("status"), c("step")),
        one(t["participants"], "lane", c("flow"), c("id"), label=c("kind")),
        one(t["relations"], "persists", c("id"), c("persists.aggregate")),
        one(t["relations"].select("id", F.explode("reads").alias("_r")), "reads", c("id"), c("_r")),
        one(t["columns"].where("fk is not null"), "foreign-key", F.concat("relation", F.lit("."), "name"), F.concat("fk.table", F.lit("."), "fk.column")),
        one(t["columns"].select("relation", "name", F.explode("from").alias("_f")), "lineage", F.concat("relation", F.lit("."), "name"), c("_f")),
        one(t["services"].select("id", F.explode("stores").alias("_s")), "store", c("id"), c("_s")),
        one(t["services"].select("id", F.explode("dependsOn").alias("_d")), "depends", c("id"), c("_d")),
        one(t["adrs"], "decision", c("id"), F.coalesce("scope.context", "scope.service"), label=c("title")),
        one(t["rfcs"], "proposal", c("id"), F.coalesce("scope.context", "scope.service"), label=c("title")),
        one(t["decision_links"], "relates", c("id"), c("ref"), label=c("kind")),
        one(t["modules"].select("id", F.explode("deps").alias("_d")), "module", c("id"), c("_d")),
        one(t["deployments"], "deployment", c("id"), c("service"), label=c("environment")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def backlinks(t: dict[str, DataFrame], target: str) -> DataFrame:
    return links(t).where(F.col("target") == target).orderBy("kind", "source")


def messaging_claims(t: dict[str, DataFrame]) -> DataFrame:
    """Each service's claim on each message of each channel, and what is wrong with it.

    Publishers come from channels and from events' wires; more than one: ``multiple publishers``; received by a service, but sent by none:
    ``no publisher``; a channel without messages: ``no operation``.
    """
    m = t["channel_messages"].select("address", F.col("name").alias("message"), "service", "direction")
    wires = t["events"].where("wire.channel is not null").select(F.col("wire.channel").alias("address"), F.col("wire.name").alias("message"), "service", F.lit("send").alias("direction"))
    claims = m.unionByName(wires).distinct()
    senders = claims.where("direction = 'send'").groupBy("address", "message").agg(F.count_distinct("service").alias("publishers"))
    silent = t["channels"].select("address", "service").join(claims.select("address", "service"), ["address", "service"], "left_anti").select("address", F.lit(None).cast("string").alias("message"), "service", F.lit("none").alias("direction"))
    j = claims.unionByName(silent).join(senders, ["address", "message"], "left").withColumn("publishers", F.coalesce("publishers", F.lit(0)))
    return j.withColumn("issue", F.when(F.col("direction") == "none", "no operation").when(F.col("publishers") > 1, "multiple publishers").when((F.col("direction") == "receive") & (F.col("publishers") == 0), "no publisher"))


def credited_access(t: dict[str, DataFrame]) -> DataFrame:
    """Accesses of relations, credited to the service with the longest unique path before the source in the owner's repository, else to the owner."""
    repo = t["services"].select(F.col("id").alias("owner"), F.col("repo").alias("_repo"))
    candidates = t["services"].where("path <> ''").select(F.col("id").alias("_service"), F.col("repo").alias("_repo"), F.col("path").alias("_prefix"))
    a = t["accesses"].join(repo, "owner", "left")
    steps = a.select("relation", "owner", "operation", "source", "_repo", F.explode(prefixes(F.regexp_replace("source", r":\d+$", ""))).alias("_prefix"))
    hits = steps.join(candidates, ["_repo", "_prefix"]).withColumn("_len", F.length("_prefix"))
    w = Window.partitionBy("relation", "owner", "operation", "source")
    best = hits.withColumn("_most", F.max("_len").over(w)).where("_len = _most").groupBy("relation", "owner", "operation", "source").agg(F.count_distinct("_service").alias("_n"), F.min("_service").alias("_s"))
    out = a.join(best, ["relation", "owner", "operation", "source"], "left")
    return out.select("store", "relation", "owner", "operation", "source", F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.col("owner")).alias("service"))


def store_matrix(access: DataFrame) -> DataFrame:
    """Relations by service: relation, service, operations; and how shared the relation is (2 several writers, 1 several services, 0)."""
    cells = access.groupBy("store", "relation", "service").agg(F.array_join(F.array_sort(F.collect_set("operation")), "+").alias("operations"))
    rank = access.groupBy("relation").agg(F.count_distinct(F.when(F.col("operation") != "read", F.col("service"))).alias("_w"), F.count_distinct("service").alias("_s"))
    return cells.join(rank, "relation").select("store", "relation", "service", "operations", F.when(F.col("_w") > 1, 2).when(F.col("_s") > 1, 1).otherwise(0).alias("shared"))


def cross_store_references(t: dict[str, DataFrame]) -> DataFrame:
    """Foreign keys and copies between stores: column, target, kind, and both stores."""
    home = t["relations"].select(F.col("id").alias("_rel"), F.col("store").alias("other_store")).distinct()
    fk = t["columns"].where("fk is not null").select(F.concat("relation", F.lit("."), "name").alias("column"), "store", F.concat("fk.table", F.lit("."), "fk.column").alias("target"), F.col("fk.table").alias("_rel"), F.lit("fk").alias("kind"))
    copy = t["columns"].select(F.concat("relation", F.lit("."), "name").alias("column"), "store", F.explode("from").alias("target")).withColumn("_rel", F.regexp_replace("target", r"\.[^.]*$", "")).withColumn("kind", F.lit("copy"))
    return fk.unionByName(copy).join(home, "_rel").where("other_store <> store").select("kind", "column", "target", "store", "other_store")


def term_bindings(t: dict[str, DataFrame]) -> DataFrame:
    """Glossary terms and the model elements of their context with the same slug."""
    parts = [
        t["aggregates"].select("context", "slug", F.lit("aggregate").alias("kind"), "id"), t["blocks"].select("context", "slug", F.lit("block").alias("kind"), "id"),
        t["events"].select("context", "slug", F.lit("event").alias("kind"), "id"), t["services"].select("context", "slug", F.lit("service").alias("kind"), "id"),
    ]
    elements = parts[0]
    for p in parts[1:]:
        elements = elements.unionByName(p)
    return t["terms"].select(F.col("id").alias("term"), "context", "slug").join(elements, ["context", "slug"])


def unexposed_operations(t: dict[str, DataFrame]) -> DataFrame:
    """Operations that no interface method exposes."""
    return t["operations"].where(F.size(F.coalesce("exposedBy", F.array().cast("array<string>"))) == 0).select("service", "aggregate", "id", "kind")


def context_stats(t: dict[str, DataFrame]) -> DataFrame:
    n = lambda df, name: df.groupBy("context").agg(F.count("*").alias(name))
    out = t["contexts"].select(F.col("id").alias("context"))
    unresolved = t["calls"].select("context", "status").unionByName(t["consumers"].select("context", "status")).where("status = 'unresolved'")
    for df, name in ((t["services"], "services"), (t["aggregates"], "aggregates"), (t["events"], "events"), (unresolved, "unresolved")):
        out = out.join(n(df, name), "context", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def narrowed(t: dict[str, DataFrame], environments: list[str]) -> dict[str, DataFrame]:
    """The catalog without services that no deployment of these environments runs, and without contexts that are then empty."""
    kept = t["deployments"].where(F.col("environment").isin(environments)).select(F.col("service").alias("id")).distinct()
    services = t["services"].join(kept, "id", "left_semi")
    ids = services.select(F.col("id").alias("service"))
    out = dict(t) | {"services": services, "contexts": t["contexts"].join(services.select(F.col("context").alias("id")), "id", "left_semi")}
    for name in ("calls", "interfaces", "methods", "channels", "channel_messages", "aggregates", "events", "operations", "consumers"):
        out[name] = t[name].join(ids, "service", "left_semi")
    return out


def declared_edges(t: dict[str, DataFrame]) -> DataFrame:
    """Edges that flows show and no fragment declares: kind, service, target, status, flow_id, step_id.

    An event step of a known event to another lane is a consumer; an rpc step of a known service to a lane that provides its ref is a call.
    """
    s = t["flow_nodes"].where("type = 'step' and ref is not null and `from` <> `to`")
    lanes = t["participants"].select(F.col("flow").alias("flow_id"), F.col("id").alias("to"), F.col("kind").alias("_lane"))
    s = s.join(lanes, ["flow_id", "to"], "left")
    services = t["services"].select(F.col("id").alias("to")).withColumn("_real", F.lit(True))
    heard = s.where("kind = 'event' and _lane not in ('broker', 'store', 'actor')").join(t["events"].select(F.col("id").alias("ref")), "ref", "left_semi").join(services, "to", "left")
    heard = heard.select(F.lit("consumer").alias("kind"), F.col("to").alias("service"), F.col("ref").alias("target"), F.when(F.col("_real"), F.col("status")).otherwise("unresolved").alias("status"), "flow_id", F.col("node_id").alias("step_id"), "ord")
    heard = heard.join(t["consumers"].select(F.col("consumer").alias("service"), F.col("event").alias("target")), ["service", "target"], "left_anti")
    provided = t["methods"].select(F.col("service").alias("to"), F.concat("interface", F.lit("/"), "name").alias("ref")).distinct().withColumn("_serves", F.lit(True))
    called = s.where("kind = 'rpc'").join(t["services"].select(F.col("id").alias("from")), "from", "left_semi").join(provided, ["to", "ref"])
    called = called.select(F.lit("call").alias("kind"), F.col("from").alias("service"), F.col("ref").alias("target"), "status", "flow_id", F.col("node_id").alias("step_id"), "ord")
    called = called.join(t["calls"].select("service", F.col("id").alias("target")), ["service", "target"], "left_anti")
    both = heard.unionByName(called)
    return both.groupBy("kind", "service", "target").agg(*[F.min_by(c, F.struct("flow_id", "ord")).alias(c) for c in ("status", "flow_id", "step_id")])
