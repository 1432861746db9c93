"""Traces held against declared flows: what of a flow recordings show, what they show besides, and what no flow declares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.traces import sequence
from atlasframe.plans.checkpoints import checkpoint

SCOPE = ["trace_id", "scope"]


def intervals(spans: DataFrame) -> DataFrame:
    """Spans (``trace_id``, ``span_id``, ``parent_id``, ``start``) with ``root``, ``ord`` and ``last``: the places of a depth-first walk at which a span is entered and left.

    One span is below another just if its ``ord`` is behind the other's and not behind the other's ``last``, so that ancestry is a range test in a join instead of a walk.
    """
    walked = checkpoint(sequence(spans))
    ends = walked.select("trace_id", "ord", F.explode("path.span_id").alias("span_id")).groupBy("trace_id", "span_id").agg(F.max("ord").alias("last"))
    return walked.join(ends, ["trace_id", "span_id"]).withColumn("root", F.get("path", F.lit(0))["span_id"]).drop("path")


def scopes(walked: DataFrame) -> DataFrame:
    """Hops by the execution that they belong to: ``scope`` (``ord`` of the hop that opens it), ``nth`` (1, 2, ... in it), ``opened`` and ``begun`` (``opening`` and ``key`` of that hop), ``whole`` (is it its root's?).

    ``walked``: what ``sequence`` gives, with ``above`` of the received messages; spans without ``key`` are no hops. The hops of a root are one execution, but what lies below a
    message that was received on the way is the receiver's: the receipt closes its part of the sender's execution and opens its own. The first hop of a root opens the root's,
    whatever it is. All of it are windows inside of traces, in the order of the walk as far as it goes, so that hops are dealt once and sorted anew once.
    """
    walk = Window.partitionBy("trace_id").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hop = F.col("key").isNotNull()
    seen = walked.withColumn("_seen", F.count("key").over(walk))
    seen = seen.withColumn("_before", F.last(F.when(F.col("depth") == 0, F.col("_seen") - hop.cast("long")), ignorenulls=True).over(walk))
    seen = seen.withColumn("_first", F.last(F.when(hop & (F.col("_seen") == F.col("_before") + 1), F.struct("ord", "path")), ignorenulls=True).over(walk))
    above = F.when(F.col("above") > 0, F.slice("path", F.lit(1), F.col("above")))
    own = F.when(above != F.col("_first.path"), above)
    opens = F.col("consume") & (F.col("ord") > F.col("_first.ord"))
    inside = seen.where(hop).select("trace_id", F.col("_first.ord").alias("_begin"), "ord", "key", "opening", "entry", "consume", "call", F.explode(F.when(opens, F.array(own, F.col("path"))).otherwise(F.array(own))).alias("_in"))
    w = Window.partitionBy("trace_id", "_begin", "_in").orderBy("ord")
    named = {"scope": "ord", "opened": "opening", "begun": "key"}
    every = inside.withColumns({**{name: F.first(c).over(w) for name, c in named.items()}, "nth": F.row_number().over(w)})
    return every.withColumn("whole", F.col("scope") == F.col("_begin")).drop("_in", "_begin")


def held_against(spans: DataFrame, openings: DataFrame, declared: DataFrame) -> dict[str, DataFrame]:
    """What recordings say of declared flows.

    ``spans``: trace_id, span_id, parent_id, start, ``key`` (what the hop is; null: no hop), ``opening`` (what it may open; null: nothing), ``entry``, ``consume``, ``call`` (booleans: a request
    comes in, a message comes in, a call that flows don't declare, such as one of a database). ``openings``: opening, flow_id; one that several flows have opens none.
    ``declared``: flow_id, key, step_id; of several steps with one key of a flow, the last by ``ord`` is meant.

    Returns ``flows`` (flow_id, traces: executions), ``steps`` (flow_id, step_id, key, traces: executions that show it), ``routes`` (flow_id, anchor, route, traces: the undeclared
    hops behind a declared step up to the next one, empty where there are none; calls, and what only tells that something came in, are left out), ``observed`` (opening, route,
    traces: executions of whole roots that no flow declares). No group is collected but the hops of one execution between two declared steps, or of one undeclared execution.
    """
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("entry", "consume", "call")}
    known = spans.select("trace_id", "span_id", "parent_id", "start", "key", "opening", *[x.alias(c) for c, x in flags.items()]).withColumn("_cut", F.col("consume") & F.col("key").isNotNull())
    told = checkpoint(scopes(sequence(known, "_cut")))
    only = openings.groupBy("opening").agg(F.min("flow_id").alias("flow_id"), F.count_distinct("flow_id").alias("_n")).where("_n = 1").select(F.col("opening").alias("opened"), "flow_id")
    matched = told.join(only, "opened")
    meant = declared.groupBy("flow_id", "key").agg(F.max_by("step_id", "ord").alias("step_id"))
    shown = matched.join(meant, ["flow_id", "key"], "left")
    counts = shown.where("step_id is not null").select(*SCOPE, "flow_id", "key", "step_id").distinct().groupBy("flow_id", "step_id", "key").agg(F.count("*").alias("traces"))
    anchor = F.last("step_id", ignorenulls=True).over(Window.partitionBy(*SCOPE).orderBy("nth"))
    behind = shown.withColumn("anchor", anchor).where("anchor is not null")
    extra = F.col("step_id").isNull() & ~F.col("call") & ~((F.col("nth") > 1) & (F.col("entry") | F.col("consume")))
    listed = F.array_sort(F.collect_list(F.when(extra, F.struct("nth", "key"))))
    per = behind.groupBy(*SCOPE, "flow_id", "anchor").agg(F.transform(listed, lambda x: x["key"]).alias("route"))
    unknown = told.where("whole").join(only, "opened", "left_anti")
    lone = unknown.groupBy(*SCOPE, F.coalesce("opened", "begun").alias("_opening")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "key"))), lambda x: x["key"]).alias("route"))
    return {
        "flows": matched.where("nth = 1").groupBy("flow_id").agg(F.count("*").alias("traces")),
        "steps": counts,
        "routes": per.groupBy("flow_id", "anchor", "route").agg(F.count("*").alias("traces")),
        "observed": lone.groupBy(F.col("_opening").alias("opening"), "route").agg(F.count("*").alias("traces")),
    }


def recorded(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes of flows as their recordings tell them, to be laid over the declared ones (``flow_trees.overlay``): steps that were seen are ``verified`` and say in how many executions; flows without any are left out."""
    seen = steps.groupBy("flow_id", F.col("step_id").alias("node_id")).agg(F.max("traces").alias("_traces"))
    out = nodes.join(seen.select("flow_id").distinct(), "flow_id", "left_semi").join(seen, ["flow_id", "node_id"], "left")
    known = F.col("_traces").isNotNull()
    return out.withColumn("status", F.when(known, "verified").otherwise(F.col("status"))).withColumn("seen", F.when(known, F.struct(F.col("_traces").alias("traces"))).otherwise(F.col("seen"))).select(*nodes.columns)
