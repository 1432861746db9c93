"""Flow trees as tables of nodes: overlay of two tellings of a flow, replies at exits, and nesting back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators import merge
from atlasframe.plans.checkpoints import checkpoint, kept


def list_of(path: Column) -> Column:
    """The list that a node stands in: the frames and branches around it."""
    return F.array_join(F.transform(path, lambda x: F.regexp_replace(x, ":end$", "")), "\0")


def loud(nodes: DataFrame) -> Column:
    """Was a node itself not only seen in recordings? A step is seen if it says so; an ``alt`` if each of its branches is counted; other frames never are."""
    uncounted = F.exists(F.coalesce("branches", F.array().cast(nodes.schema["branches"].dataType)), lambda b: b["seen"].isNull())
    return F.when(F.col("type") == "step", F.col("seen").isNull()).when(F.col("type") == "alt", uncounted).otherwise(True)


def overlay(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A second telling of flows laid over the first: (nodes of the flows that agree, ``flow_id`` of those that don't).

    Both are tables of nodes (see ``sources.fragments.flow_nodes``), of flows that both have; a flow without nodes has no row here. The second agrees if, list by list, it has all
    nodes of the first in their order, alike in type, ends, kind, reference, titles and number of branches, and if the others were only seen in recordings.
    Nodes are the first's at the places of the second; a declared step becomes ``verified`` where the second says so and takes its note if it has none; ``seen`` is
    the second's where it has one. The nodes only seen come with them. Both trees go to the tasks of their flows once, and all else is done there: nodes of a flow, list and id
    meet in their order. One disagreement refuses the whole flow.
    """
    names = [c for c in mine.columns if c not in ("flow_id", "node_id")]
    flow, own = ["flow_id", "_theirs"], mine.select(*names).schema
    both = mine.select("flow_id", F.lit(False).alias("_theirs"), "node_id", *names).unionByName(theirs.select("flow_id", F.lit(True).alias("_theirs"), "node_id", *names))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    titles = F.to_json(F.transform("branches", lambda x: F.coalesce(x["title"], F.lit(""))))
    is_ = lambda kind: F.col("type") == kind
    alike = F.when(is_("step"), F.to_json(F.array(*map(text, ("from", "to", "kind", "ref"))))).when(is_("alt"), F.coalesce(titles, F.lit(""))).when(is_("parallel"), F.coalesce(F.size("branches"), F.lit(-1)).cast("string")).otherwise(text("title"))
    marks = ["flow_id", "_theirs", "node_id", "ord", "last", list_of(F.col("path")).alias("_list"), loud(mine).alias("_loud"), F.coalesce(is_("step"), F.lit(False)).alias("_step")]
    both = both.select(*marks, F.to_json(F.array(text("type"), alike)).alias("_alike"), F.to_json(F.struct(*names)).alias("_node"))  # a node is one text on its way: most of its columns are empty
    both = both.repartition(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")), "flow_id")  # said, as rows packed small are sorted at their whole size
    behind = Window.partitionBy(*flow).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    below = lambda which: F.coalesce(F.min(F.when(F.col(which), F.col("ord"))).over(behind) <= F.col("last"), F.lit(False))  # noqa: E731  what is below a node stands right behind it, up to ``last``
    both = both.withColumns({"_loud_inside": below("_loud"), "_step_inside": below("_step")})
    both = both.withColumn("_seen_only", ~F.col("_loud") & ~F.col("_loud_inside") & (F.col("_step") | F.col("_step_inside"))).drop("_loud", "_step", "_loud_inside", "_step_inside")
    both = both.withColumn("_nth", F.row_number().over(Window.partitionBy(*flow, "_list", "node_id").orderBy("ord")))
    alone = F.when(F.col("node_id").isNull() | F.col("_list").isNull(), F.col("_theirs"))  # what has no id meets nothing
    side = lambda of: F.any_value(F.when(F.col("_theirs") == of, F.struct("ord", "last", "_alike", "_seen_only", "_node")), ignoreNulls=True)
    both = both.groupBy("flow_id", "_list", "node_id", "_nth", alone.alias("_alone")).agg(side(False).alias("_a"), side(True).alias("_b")).drop("_nth", "_alone")
    has, added = F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_a").isNull()
    before = Window.partitionBy("flow_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(added, F.col("_b.last"))).over(before) >= F.col("_at"), F.lit(False))  # of a frame that was added too
    both = both.withColumns({"_has": has, "_at": F.col("_b.ord"), "_from": F.col("_a.ord")}).withColumn("_inside", inside)
    passed = F.max("_from").over(Window.partitionBy("flow_id", "_list", "_has").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))  # the order of both is the same if none stands behind a later one
    wrong = F.when(F.col("_b").isNull(), True).when(added, ~F.col("_inside") & ~F.col("_b._seen_only")).otherwise((F.col("_a._alike") != F.col("_b._alike")) | F.coalesce(F.col("_passed") > F.col("_from"), F.lit(False)))
    both = both.withColumn("_passed", passed).withColumn("_refused", F.bool_or(wrong).over(Window.partitionBy("flow_id")))
    both = both.select("flow_id", "node_id", "_refused", "_has", F.from_json("_a._node", own).alias("a"), F.from_json("_b._node", own).alias("b"))
    verified = F.coalesce((F.col("b.status") == "verified") & (F.col("a.status") == "declared"), F.lit(False))
    said = {"ord": F.col("b.ord"), "last": F.col("b.last"), "seen": F.coalesce("b.seen", "a.seen"), "status": F.when(verified, "verified").otherwise(F.col("a.status"))}
    said["note"] = F.when(verified, F.coalesce(F.nullif("a.note", F.lit("")), "b.note")).otherwise(F.col("a.note"))
    pick = lambda c: F.col("node_id") if c == "node_id" else F.when(F.col("_has"), said.get(c, F.col(f"a.{c}"))).otherwise(F.col(f"b.{c}")).alias(c)
    laid = kept(both.select("flow_id", "_refused", *[pick(c) for c in mine.columns if c != "flow_id"]))
    return laid.where("not _refused").drop("_refused"), laid.where("_refused").select("flow_id").distinct()


def overlay_sources(t: dict[str, DataFrame], order: list[str]) -> dict[str, DataFrame]:
    """``flows``, ``flow_nodes``, ``participants`` and ``flow_examples`` of all sources as one telling of each flow, and ``refused`` (flow and source, by whom the flow is held).

    The first source by ``order`` holds a flow. The others are laid over it one after the other, the second of all flows at once, then the third, and so on; one is
    refused where its nodes don't agree or its lanes don't begin with the first's. Lanes behind those, and examples with new ids, are added. The number of rounds
    is the number of sources of the flow that most have.
    """
    place = F.dense_rank().over(Window.partitionBy("id").orderBy(*order))
    ranked = checkpoint(t["flows"].select("id", *order).distinct().withColumn("_place", place))
    flows, lost = merge.claim(t["flows"], ["id"], order)
    first = ranked.where("_place = 1").drop("_place")
    held = lambda name, flow: t[name].join(first.withColumnRenamed("id", flow), [flow, *order], "left_semi")
    nodes, lanes, examples = held("flow_nodes", "flow_id"), with_places(held("participants", "flow")), held("flow_examples", "flow")
    refused = []
    for k in range(2, (ranked.agg(F.max("_place")).first()[0] or 1) + 1):
        now = ranked.where(F.col("_place") == k).select("id", *order)
        of = lambda name, flow: t[name].join(now.withColumnRenamed("id", flow), [flow, *order], "left_semi")
        theirs, their_lanes = of("flow_nodes", "flow_id"), with_places(of("participants", "flow"))
        told = now.select(F.col("id").alias("flow_id"))
        laid, unlike = overlay(nodes.join(told, "flow_id", "left_semi"), theirs)  # nodes of a flow that only one of them has any of find no partner
        meet = lanes.select("flow", "_at", F.col("id").alias("_mine")).join(now.select(F.col("id").alias("flow")), "flow", "left_semi").join(their_lanes.select("flow", "_at", "id"), ["flow", "_at"], "left")
        unlike = unlike.unionByName(meet.where("id is null or id <> _mine").select(F.col("flow").alias("flow_id")))
        unlike = checkpoint(unlike.distinct())
        taken = checkpoint(told.join(unlike, "flow_id", "left_anti"))
        refused.append(now.join(unlike.withColumnRenamed("flow_id", "id"), "id", "left_semi"))
        nodes = checkpoint(nodes.join(taken, "flow_id", "left_anti").unionByName(laid.join(taken, "flow_id", "left_semi")))
        of_taken = taken.withColumnRenamed("flow_id", "flow")
        more = their_lanes.join(of_taken, "flow", "left_semi").join(lanes.select("flow", "_at"), ["flow", "_at"], "left_anti")
        lanes = checkpoint(lanes.unionByName(more))
        new = of("flow_examples", "flow").join(of_taken, "flow", "left_semi").join(examples.select("flow", "id"), ["flow", "id"], "left_anti")
        examples = checkpoint(examples.unionByName(new))
    out = lost.limit(0)
    for r in refused:
        out = out.unionByName(lost.join(r, ["id", *order], "left_semi"))
    return {"flows": flows, "flow_nodes": nodes, "participants": lanes.drop("_at"), "flow_examples": examples, "refused": out.withColumnRenamed("id", "flow")}


def with_places(lanes: DataFrame) -> DataFrame:
    """Lanes with their place in the flow."""
    return lanes.withColumn("_at", F.row_number().over(Window.partitionBy("flow", "_src_path").orderBy("place")))


def replies_at_exits(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """The replies of flows that answer (``flow_id``, ``label``): flow_id, label, parent_id, branch (null: the flow's own list), after (the ``ord`` behind which it stands), exit (1, 2, ... in order of places).

    A reply stands at the end of the flow's own list and of each terminal branch, at any depth, unless that list has a choice all of whose branches are terminal, so that
    nothing goes on behind it. Branches without nodes have their reply behind the branch before, or the frame.
    """
    nodes = checkpoint(nodes.select("flow_id", "node_id", "parent_id", "branch", "type", "branches", "ord", "last", F.size("path").alias("_depth")))
    closed = nodes.where("type = 'alt'").where((F.size("branches") > 0) & F.forall("branches", lambda b: F.coalesce(b["terminal"], F.lit(False)))).select("flow_id", "parent_id", "branch").distinct()
    alts = nodes.where("type = 'alt'").select("flow_id", "node_id", "ord", "_depth", F.posexplode("branches").alias("_k", "_b"))
    ends = nodes.where("parent_id is not null").groupBy("flow_id", F.col("parent_id").alias("node_id"), F.col("branch").alias("_k")).agg(F.max("last").alias("_end"))
    branches = alts.join(ends, ["flow_id", "node_id", "_k"], "left")
    behind = F.max("_end").over(Window.partitionBy("flow_id", "node_id").orderBy("_k"))
    branches = branches.withColumn("after", F.coalesce(behind, "ord")).where("_b.terminal").select("flow_id", F.col("node_id").alias("parent_id"), F.col("_k").cast("long").alias("branch"), "after", (F.col("_depth") + 1).alias("_depth"), F.col("_k").alias("_k"))
    roots = answers.select("flow_id").distinct().join(nodes.groupBy("flow_id").agg(F.max("last").alias("after")), "flow_id", "left")
    none = F.lit(None)
    roots = roots.select("flow_id", none.cast("string").alias("parent_id"), none.cast("long").alias("branch"), F.coalesce("after", F.lit(0)).alias("after"), F.lit(0).alias("_depth"), F.lit(0).alias("_k"))
    shut = closed.select("flow_id", F.col("parent_id").alias("_p"), F.col("branch").alias("_c"))
    exits = branches.unionByName(roots).alias("e").join(shut.alias("s"), (F.col("e.flow_id") == F.col("s.flow_id")) & F.col("e.parent_id").eqNullSafe(F.col("s._p")) & F.col("e.branch").eqNullSafe(F.col("s._c")), "left_anti")
    order = Window.partitionBy("flow_id").orderBy("after", F.desc("_depth"), "_k")
    return exits.join(answers, "flow_id").withColumn("exit", F.row_number().over(order)).select("flow_id", "label", "parent_id", "branch", "after", "exit")


#: A node's columns that are written, as they are named in the format.
WRITTEN = ["from", "to", "kind", "ref", "label", "status", "note", "replyTo", "continuesAt", "reaches", "handoff", "storeAccess", "seen"]


def joined_objects(a: Column, b: Column) -> Column:
    """Two JSON objects as one; both are texts."""
    return F.when(a == "{}", b).when(F.coalesce(b, F.lit("{}")) == "{}", a).otherwise(F.concat(a.substr(F.lit(1), F.length(a) - 1), F.lit(", "), b.substr(F.lit(2), F.length(b))))


def nested(nodes: DataFrame) -> DataFrame:
    """Tables of nodes as trees again: flow_id, steps (JSON text), the inverse of ``sources.fragments.flow_nodes``.

    The deepest lists are joined to texts first and put into their frames, then the next ones: as many rounds as the deepest nesting. Flows without nodes have no row.
    """
    steps = F.to_json(F.struct(F.col("type"), F.col("node_id").alias("id"), *[F.col(c) for c in WRITTEN], F.when(F.col("type") != "alt", F.col("title")).alias("title")))
    held = nodes.select("flow_id", "node_id", "parent_id", "branch", "ord", "type", "branches", F.size("path").alias("_depth"), joined_objects(steps, F.col("rest")).alias("_json"))
    held = kept(held)
    deepest = held.agg(F.max("_depth")).first()[0] or 0
    items = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(c), lambda x: x["_json"]), ", "), F.lit("]"))
    below = None
    for depth in range(deepest, -1, -1):
        level = held.where(F.col("_depth") == depth)
        lists = F.transform(F.coalesce("branches", F.array(F.lit(None).cast(nodes.schema["branches"].dataType.elementType))), lambda b, k: F.coalesce(F.try_element_at("_lists", k.cast("long")), F.lit("[]")))
        level = level.join(below, ["flow_id", "node_id"], "left") if below is not None else level.withColumn("_lists", F.lit(None).cast("map<bigint,string>"))
        branches = F.concat(F.lit("["), F.array_join(F.when(F.col("type") == "alt", F.zip_with(lists, F.col("branches"), lambda x, b: joined_objects(F.to_json(b), F.concat(F.lit('{"steps": '), x, F.lit("}"))))).otherwise(lists), ", "), F.lit("]"))
        frame = F.when(F.col("type") == "loop", F.concat(F.lit('{"steps": '), F.get(lists, F.lit(0)), F.lit("}"))).when(F.col("type").isin("alt", "parallel"), F.concat(F.lit('{"branches": '), branches, F.lit("}"))).otherwise("{}")
        level = level.select("flow_id", "parent_id", "branch", F.struct("ord", joined_objects(F.col("_json"), frame).alias("_json")).alias("_item"))
        if depth == 0:
            return level.groupBy("flow_id").agg(items(F.collect_list("_item")).alias("steps"))
        lists_of = level.groupBy("flow_id", F.col("parent_id").alias("node_id"), "branch").agg(items(F.collect_list("_item")).alias("_list"))
        below = kept(lists_of.groupBy("flow_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("branch", "_list"))).alias("_lists")))
