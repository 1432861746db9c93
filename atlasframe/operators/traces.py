"""Trace reconstruction: span trees, ordered hops, and folding of routes that share ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.plans.checkpoints import checkpoint


def roots(spans: DataFrame) -> DataFrame:
    """Spans without a parent, or whose parent isn't in the trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    return spans.join(parents, ["trace_id", "parent_id"], "left_anti").select(*spans.columns)


def sequence(spans: DataFrame, mark: str | None = None) -> DataFrame:
    """Spans of each trace in depth-first order, children by (start, span_id): adds ``depth`` and ``ord``.

    Every level joins the children to the last level and extends a sortable path, until no children are left, however deep a trace is; the
    paths' order is the order of a depth-first walk. Spans in a ring of parents belong to no root and are left out. With ``mark``, a boolean column, adds ``above``: how
    many places of ``path`` lead to the nearest marked span that a span lies below, 0 if there is none. ``spans`` is worked out once.
    """
    spans = checkpoint(spans)
    step = F.struct(F.col("start"), F.col("span_id"))
    level = roots(spans).withColumn("path", F.array(step)).withColumn("depth", F.lit(0))
    level = checkpoint(level if mark is None else level.withColumn("above", F.lit(0)))
    carried = [] if mark is None else [F.when(F.col(mark), F.size("path")).otherwise(F.col("above")).alias("above")]
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        up = level.select("trace_id", F.col("span_id").alias("parent_id"), F.col("path").alias("_up"), *carried)
        below = spans.join(up, ["trace_id", "parent_id"]).where(~F.array_contains("_up", step))  # a repeated span may close a ring
        level = checkpoint(below.withColumn("path", F.concat("_up", F.array(step))).drop("_up").withColumn("depth", F.lit(depth)))
        out = out.unionByName(level)
        if depth % 16 == 0:  # the plan of a deep trace stays short
            out = checkpoint(out)
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("trace_id").orderBy("path")).cast("long"))


def hop_kind(kind: Column, attributes: Column) -> Column:
    """What a span says of a hop: rpc, http, db, send, receive; null where it says nothing."""
    a = lambda name: attributes[name]
    return (
        F.when(a("rpc.service").isNotNull() & kind.isin(2, 3), "rpc")
        .when(a("db.system.name").isNotNull() & (kind == 3), "db")
        .when((kind == 4) | (a("messaging.operation.type") == "send"), "send")
        .when((kind == 5) | a("messaging.operation.type").isin("receive", "process"), "receive")
        .when(a("http.request.method").isNotNull() & kind.isin(2, 3), "http")
    )


def routes(hops: DataFrame, trace: str, order: list[str], key: str) -> DataFrame:
    """The keys of each trace in order, and how many traces have the same: ``opening``, ``route``, ``traces``."""
    per = hops.groupBy(trace).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, key))), lambda x: x[key]).alias("route"))
    return per.groupBy(F.col("route")[0].alias("opening"), "route").agg(F.count("*").alias("traces"), F.min(trace).alias("first_trace"))


def in_common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(same == 0, F.size(a)).otherwise(same - 1).cast("int")


def fold(found: DataFrame) -> DataFrame:
    """Routes of one opening laid over each other: what all show first, the alternatives where they part, and what all show again at the end.

    Each alternative is folded likewise, so no step of any route is lost. Alternatives go by their first key, in the order in which traces first
    show them; the one that shows nothing is ``otherwise``. ``found`` is what ``routes`` gives. Returns ``opening``, ``node`` (the alternative that a
    row belongs to, as its place at each parting; empty for the whole), ``at`` (order by it to read the fold), ``part`` (start, branch, end), ``key``
    (of a branch: its name), ``traces``.

    All nodes of a level are folded at once: routes share what the least and the greatest of them share, so sums by node are
    enough and no node is held in one task.
    """
    by = ["opening", "node"]
    state = checkpoint(found.select("opening", F.array().cast("array<int>").alias("node"), "route", "traces", "first_trace"))
    out = None
    while not state.isEmpty():
        ends = state.groupBy(*by).agg(F.min("route").alias("_lo"), F.max("route").alias("_hi"), F.sum("traces").alias("total"))
        start = ends.select(*by, "total", F.slice("_lo", F.lit(1), in_common(F.col("_lo"), F.col("_hi"))).alias("_start"))
        rest = checkpoint(state.join(start, by).withColumn("route", F.slice("route", F.size("_start") + 1, F.greatest(F.size("route"), F.lit(1)))))
        back = F.reverse("route")
        tails = rest.groupBy(*by).agg(F.min(back).alias("_lo"), F.max(back).alias("_hi"), F.max(F.size("route")).alias("_most"), F.first("_start").alias("_start"), F.first("total").alias("total"))
        tails = checkpoint(tails.select(*by, "total", "_start", F.when(F.col("_most") > 0, F.reverse(F.slice("_lo", F.lit(1), in_common(F.col("_lo"), F.col("_hi"))))).otherwise(F.array().cast("array<string>")).alias("_end"), "_most"))
        middle = rest.select(*by, "route", "traces", "first_trace").join(tails.where("_most > 0").select(*by, "_end"), by).withColumn("route", F.slice("route", F.lit(1), F.size("route") - F.size("_end")))
        groups = middle.groupBy(*by, F.get("route", F.lit(0)).alias("_key")).agg(F.sum("traces").alias("traces"), F.min("first_trace").alias("first_trace"))
        w = Window.partitionBy(*by).orderBy("first_trace", F.col("_key").asc_nulls_last())
        groups = checkpoint(groups.withColumn("_child", F.concat("node", F.array(F.lit(1), F.row_number().over(w)))))
        rows = [
            tails.select(*by, F.posexplode("_start").alias("_k", "key"), F.lit(0).alias("_side"), "total").select(*by, F.concat("node", F.array("_side", "_k")).alias("at"), F.lit("start").alias("part"), "key", F.col("total").alias("traces")),
            groups.select("opening", F.col("_child").alias("node"), F.col("_child").alias("at"), F.lit("branch").alias("part"), F.coalesce("_key", F.lit("otherwise")).alias("key"), "traces"),
            tails.select(*by, F.posexplode("_end").alias("_k", "key"), F.lit(2).alias("_side"), "total").select(*by, F.concat("node", F.array("_side", "_k")).alias("at"), F.lit("end").alias("part"), "key", F.col("total").alias("traces")),
        ]
        for part in rows:
            out = part if out is None else out.unionByName(part)
        out = checkpoint(out)
        named = groups.where("_key is not null").select(*by, "_key", "_child")
        state = checkpoint(middle.withColumn("_key", F.get("route", F.lit(0))).join(named, [*by, "_key"]).select("opening", F.col("_child").alias("node"), "route", "traces", "first_trace"))
    return out if out is not None else state.select("opening", "node", F.col("node").alias("at"), F.lit("").alias("part"), F.lit("").alias("key"), "traces")


def unfold(folded: DataFrame) -> DataFrame:
    """The routes that a fold was made of: ``opening``, ``route``, ``traces``. Each alternative that parts no further is the end of one route."""
    nodes = folded.where("part = 'branch'").select("opening", "node", "traces").unionByName(folded.where("part <> 'branch' and size(node) = 0").groupBy("opening", "node").agg(F.max("traces").alias("traces")))
    nodes = nodes.unionByName(folded.where("part = 'branch' and size(node) = 2").groupBy("opening").agg(F.sum("traces").alias("traces")).select("opening", F.array().cast("array<int>").alias("node"), "traces")).groupBy("opening", "node").agg(F.max("traces").alias("traces"))
    above = folded.where("part = 'branch'").select("opening", F.slice("node", F.lit(1), F.size("node") - 2).alias("node")).distinct()
    leaves = nodes.join(above, ["opening", "node"], "left_anti").select("opening", F.col("node").alias("_leaf"), "traces")
    ways = leaves.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size("_leaf"), F.lit(2)), lambda n: F.slice("_leaf", F.lit(1), n))).alias("node"))
    steps = folded.where("part <> 'branch'").select("opening", "node", "at", "key")
    per = ways.join(steps, ["opening", "node"]).groupBy("opening", "_leaf", "traces").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("_s"))
    return per.select("opening", F.transform("_s", lambda x: x["key"]).alias("route"), "traces")


def pick_examples(examples: DataFrame, key: list[str], size: str, start: str, ident: str, k: int = 3) -> DataFrame:
    """The k traces of each key with most steps, then the earliest, then the smallest id."""
    w = Window.partitionBy(*key).orderBy(F.desc(size), F.asc(start), F.asc(ident))
    return examples.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def match_steps(hops: DataFrame, steps: DataFrame, trace: str, order: str, key: str) -> DataFrame:
    """Hops that a declared step explains, by key, and for the others the last step before them (``anchor``)."""
    known = steps.groupBy(key).agg(F.min("step_id").alias("step_id"))
    out = hops.join(known, key, "left")
    w = Window.partitionBy(trace).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("anchor", F.last("step_id", ignorenulls=True).over(w))


def seen_counts(matched: DataFrame, trace: str) -> DataFrame:
    """How many traces show each declared step."""
    return matched.where("step_id is not null").groupBy("step_id").agg(F.count_distinct(trace).alias("seen"))
