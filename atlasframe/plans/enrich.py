"""Enrichment of merged tables: references that only several sources together can resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators import compose, estate
from atlasframe.operators.relations import declared_edges
from atlasframe.plans import links
from atlasframe.plans.checkpoints import checkpoint


def wire_names(t: dict[str, DataFrame]) -> DataFrame:
    """``flow_nodes`` in which unresolved event steps without ref have found their event by its full wire name, else by a unique last segment."""
    wires = t["events"].where("wire.name <> ''").select(F.col("wire.name").alias("label"), F.col("id").alias("_event"))
    full = wires.groupBy("label").agg(F.min("_event").alias("_full"))
    last = wires.withColumn("_last", F.substring_index("label", ".", -1)).groupBy("_last").agg(F.count_distinct("_event").alias("_n"), F.min("_event").alias("_unique")).where("_n = 1").drop("_n")
    open_ = (F.col("type") == "step") & (F.col("kind") == "event") & F.col("ref").isNull() & (F.col("status") == "unresolved")
    j = t["flow_nodes"].join(full, "label", "left").withColumn("_last", F.substring_index("label", ".", -1)).join(last, "_last", "left")
    found = F.coalesce("_full", "_unique")
    return j.withColumn("_hit", open_ & found.isNotNull()).withColumn("ref", F.when(F.col("_hit"), found).otherwise(F.col("ref"))).withColumn("status", F.when(F.col("_hit"), "declared").otherwise(F.col("status"))).select(*t["flow_nodes"].columns)


def foreign_keys(t: dict[str, DataFrame]) -> DataFrame:
    """``columns`` in which foreign keys into bare table names have found the table: the only one of that name, else the only one in the own store, else the only one
    in stores of near services (of one context, callers and callees)."""
    tables = t["relations"].select(F.col("id").alias("_id"), F.col("name").alias("_table"), F.col("store").alias("_store"), F.col("owner").alias("_owner")).distinct()
    bare = t["columns"].where("fk is not null and not contains(fk.table, '.')").select("relation", "name", "store", "owner", F.col("fk.table").alias("_table"))
    only = lambda df, n: df.groupBy("relation", "name").agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias(n)).where("_n = 1").drop("_n")
    all_ = bare.join(tables, "_table")
    context = t["services"].select(F.col("id").alias("_s"), "context")
    mates = context.join(context.withColumnRenamed("_s", "_o"), "context").select("_s", "_o")
    calls = t["calls"].select(F.col("service").alias("_s"), F.col("peer").alias("_o"))
    near = mates.unionByName(calls).unionByName(calls.select(F.col("_o").alias("_s"), F.col("_s").alias("_o"))).distinct()
    near = all_.join(near.select(F.col("_s").alias("owner"), F.col("_o").alias("_owner")), ["owner", "_owner"], "left_semi")
    j = t["columns"].join(only(all_, "_a"), ["relation", "name"], "left").join(only(all_.where("store = _store"), "_b"), ["relation", "name"], "left").join(only(near, "_c"), ["relation", "name"], "left")
    target = F.coalesce("_a", "_b", "_c")
    fk = F.when(F.col("fk").isNotNull() & target.isNotNull(), F.col("fk").withField("table", target)).otherwise(F.col("fk"))
    return j.withColumn("fk", fk).select(*t["columns"].columns)


def flow_summaries(t: dict[str, DataFrame]) -> DataFrame:
    """``flows`` in which blank summaries hold the first paragraph of the opening rpc's documentation."""
    docs = t["methods"].where("doc <> ''").groupBy(F.concat("interface", F.lit("/"), "name").alias("ref")).agg(F.min("doc").alias("_doc"))
    first = t["flow_nodes"].where("type = 'step'").groupBy(F.col("flow_id").alias("id")).agg(F.min_by(F.struct("kind", "ref"), "ord").alias("_o")).where("_o.kind = 'rpc'").select("id", F.col("_o.ref").alias("ref"))
    j = t["flows"].join(first.join(docs, "ref").drop("ref"), "id", "left")
    return j.withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), F.trim(F.get(F.split("_doc", r"\n\s*\n"), F.lit(0))), F.lit(""))).select(*t["flows"].columns)


def executions(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``flows``, ``flow_nodes`` and ``participants`` with what flows lead on to put in (see ``operators.compose``), and ``composition``, the seams. Lanes of entered flows come behind a flow's own."""
    columns = ["interface", "name", "response", "streaming"]
    methods = t["methods"].select(*columns).unionByName(t["external_methods"].select(*columns)).withColumn("id", F.concat("interface", F.lit("/"), "name"))
    flows, nodes, entries = compose.composed(t["flows"], t["flow_nodes"], estate.responses(methods).withColumnRenamed("id", "ref"))
    lanes = t["participants"].join(flows.select(F.col("id").alias("flow")), "flow", "left_semi")
    slugs = t["flows"].select(F.col("slug").alias("flow"), F.col("id").alias("_id"))
    more = entries.select("flow_id", "flow").distinct().join(slugs, "flow").select("flow_id", F.col("_id").alias("flow")).join(t["participants"], "flow").withColumn("flow", F.col("flow_id")).drop("flow_id")
    more = more.join(lanes.select("flow", "id"), ["flow", "id"], "left_anti").dropDuplicates(["flow", "id"])
    last = lanes.groupBy("flow").agg(F.max("place").alias("_last"))
    more = more.join(last, "flow", "left").withColumn("place", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("flow").orderBy("id"))).cast("int")).drop("_last")
    return {"flows": flows, "flow_nodes": nodes, "participants": lanes.unionByName(more), "composition": entries}


def enrich(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All of it; edges that only flows show join the declared ones, with the flow and step that show them in their note."""
    out = dict(t)
    out |= links.configured_channels(out)
    out |= {name: checkpoint(df) for name, df in links.http_calls({**out, "flow_nodes": checkpoint(out["flow_nodes"])}).items()}
    out["flow_nodes"] = links.served_methods(out)
    out["flow_nodes"] = checkpoint(wire_names(out))
    out["flows"] = flow_summaries(out)
    out |= executions(out)
    out["flow_nodes"] = checkpoint(links.store_accesses(out))
    out["participants"] = links.linked_lanes(out)
    out["columns"] = foreign_keys(out)
    seen = declared_edges(out).withColumn("note", F.concat(F.lit("seen in "), "flow_id", F.lit(" at "), "step_id"))
    context = out["services"].select(F.col("id").alias("service"), "context")
    peers = out["methods"].groupBy(F.concat("interface", F.lit("/"), "name").alias("target")).agg(F.min("service").alias("peer"))
    calls = seen.where("kind = 'call'").join(context, "service").join(peers, "target").select("context", "service", F.col("target").alias("id"), "peer", "status", "note")
    out["calls"] = out["calls"].unionByName(calls, allowMissingColumns=True)
    events = out["events"].select(F.col("id").alias("target"), "context", F.col("service").alias("_owner"), "aggregate")
    consumers = seen.where("kind = 'consumer'").join(events, "target").select("context", F.col("_owner").alias("service"), "aggregate", F.col("target").alias("event"), F.col("service").alias("consumer"), "status", "note")
    out["consumers"] = out["consumers"].unionByName(consumers, allowMissingColumns=True)
    return out
