"""Executions composed of several flows: each step that surely leads on to another flow has that flow's nodes put in behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.estate import handoff_key
from atlasframe.operators.flow_trees import replies_at_exits
from atlasframe.plans.checkpoints import kept

#: Fixed value: what the summary of a composed flow says at its end.
COMPOSED = " Source-backed cross-protocol continuations are included."


def unique_or_none(df: DataFrame, key: str, value: Column) -> DataFrame:
    """``key`` and ``_to``: the value of the only row of that key; null where several rows have it."""
    return df.groupBy(key).agg(F.when(F.count("*") == 1, F.min(value)).alias("_to"))


def doors(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Steps and the flows they lead on to: flow_id, node_id, nth, next_flow, opens (the ``ord`` at which it is entered), kind, target, basis, synchronous.

    A step that continues at, or reaches, a source function leads to the only flow of its owner that this function opens. A sent message leads to the only receive among the
    top-level steps of all flows that has its kind, transport, channel and message; if none has that message, to the only one of the channel that names no message.
    Several candidates open nothing. A step leads to a flow once: of two ways the synchronous one counts. ``flows``: id, slug, owner, entrypoint.
    """
    owner = flows.select(F.col("id").alias("flow_id"), F.coalesce("owner", F.lit("")).alias("_owner"))
    steps = nodes.where("type = 'step'")
    entries = unique_or_none(flows.where("entrypoint <> ''").select("id", F.col("entrypoint").alias("target")), "target", F.col("id"))
    named = F.concat(F.array_compact(F.array("continuesAt")), F.coalesce("reaches", F.array().cast("array<string>")))
    led = steps.select("flow_id", "node_id", "continuesAt", F.posexplode(named).alias("nth", "target")).where("target <> ''").join(entries.where("_to is not null"), "target")
    led = led.join(owner, "flow_id").join(owner.withColumnsRenamed({"flow_id": "_to", "_owner": "_theirs"}), "_to").where("_owner = _theirs")
    direct = F.col("continuesAt").eqNullSafe(F.col("target"))
    called = led.select("flow_id", "node_id", "nth", F.col("_to").alias("next_flow"), F.lit(1).cast("long").alias("opens"), F.when(direct, "entrypoint").otherwise("reachability").alias("kind"), "target", F.when(direct, "exact source entrypoint").otherwise("source reachability").alias("basis"), F.lit(True).alias("synchronous"))
    key = handoff_key(*[F.col(f"handoff.{c}") for c in ("kind", "transport", "channel", "message")])
    topic = handoff_key(*[F.col(f"handoff.{c}") for c in ("kind", "transport", "channel")], F.lit(None))
    received = steps.where("parent_id is null and handoff.direction = 'receive'").select(key.alias("_key"), F.struct(F.col("flow_id").alias("flow"), "ord").alias("_at"))
    held = unique_or_none(received, "_key", F.col("_at")).withColumn("_known", F.lit(True))
    sent = steps.where("handoff.direction = 'send'").select("flow_id", "node_id", "handoff", key.alias("_exact"), topic.alias("_topic"))
    sent = sent.join(held.withColumnsRenamed({"_key": "_exact", "_to": "_a", "_known": "_has"}), "_exact", "left").join(held.select(F.col("_key").alias("_topic"), F.col("_to").alias("_b")), "_topic", "left")
    wide = F.col("_has").isNull() & (F.col("_topic") != F.col("_exact"))
    to = F.when(wide, F.col("_b")).otherwise(F.col("_a"))
    target = F.concat_ws(":", "handoff.transport", "handoff.channel", F.nullif("handoff.message", F.lit("")))
    handed = sent.withColumn("_at", to).where("_at is not null").select(
        "flow_id", "node_id", F.lit(1 << 30).alias("nth"), F.col("_at.flow").alias("next_flow"), F.col("_at.ord").alias("opens"), F.lit("handoff").alias("kind"), target.alias("target"),
        F.when(wide, "unique topic-level asynchronous handoff").otherwise("exact asynchronous handoff").alias("basis"), F.lit(False).alias("synchronous"),
    )
    each = ["flow_id", "node_id", "next_flow"]
    every = called.unionByName(handed).withColumn("_best", F.row_number().over(Window.partitionBy(*each).orderBy(F.desc("synchronous"), F.desc("nth")))).withColumn("nth", F.min("nth").over(Window.partitionBy(*each)))
    return every.where("_best = 1").drop("_best")


def expanded(nodes: DataFrame, flows: DataFrame, ways: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes of every flow with those it leads on to, the entries: root, place, prefix, step, and the door's columns).

    All roots grow at once, a level of entered flows a round, until none is left: a flow is not entered again on its own way, nor where the flow that leads to it includes it
    already; ``depth`` bounds the levels where given. The result's ``place`` (an array, whose order is the order of the nodes) and ``prefix`` (of ids) tell each copy of a node from the others.

    Rounds carry entries only; nodes meet them once, behind the last. Many entries lead to few flows, so they are the left side of each join: Spark holds the rows that a key has on the right.
    """
    named = flows.select(F.col("id").alias("flow_id"), "slug", F.coalesce("includes", F.array().cast("array<string>")).alias("_includes"))
    of = kept(nodes.join(named, "flow_id"))
    next_slug = named.select(F.col("flow_id").alias("next_flow"), F.col("slug").alias("_next_slug"))
    leads = of.where("type = 'step'").select("flow_id", "node_id", "ord", "slug", "_includes", "parent_id", "branch", "path").join(ways, ["flow_id", "node_id"]).join(next_slug, "next_flow")
    leads = kept(leads.where(~F.array_contains("_includes", F.col("_next_slug"))).drop("_includes"))  # read by each round
    up = ["_p", "_b", "_path"]

    def inside(entries: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of rows that entered flows have, each at its place in the whole tree."""
        at = entries.select("root", F.concat("place", F.array(F.col("nth").cast("long"))).alias("_inside"), F.col("_entered").alias("prefix"), "_way", *[F.col(c).alias(f"_up{c}") for c in up], F.col("next_flow").alias("flow_id"), F.col("opens").alias("_opens"))
        frames = F.transform("path", lambda x: F.concat(F.regexp_extract(x, "^[^:]*:", 0), F.col("prefix"), F.regexp_replace(x, "^[^:]*:", "")))
        top = F.col("parent_id").isNull()
        return at.join(found, "flow_id").where("ord >= _opens").select(
            "root", F.concat("_inside", F.array("ord")).alias("place"), "prefix", F.concat("_way", F.array("slug")).alias("_way"),
            F.when(top, F.col("_up_p")).otherwise(F.concat("prefix", "parent_id")).alias("_p"), F.when(top, F.col("_up_b")).otherwise(F.col("branch")).alias("_b"), F.concat("_up_path", frames).alias("_path"), *columns,
        )

    own = [F.col("flow_id").alias("root"), F.array("ord").alias("place"), F.lit("").alias("prefix"), F.array("slug").alias("_way"), F.col("parent_id").alias("_p"), F.col("branch").alias("_b"), F.col("path").alias("_path")]
    led = ["flow_id", "node_id", *[c for c in ways.columns if c not in ("flow_id", "node_id")], "_next_slug"]
    every, entered, k, found = of.select(*own, *of.columns), None, 0, leads.select(*own, *led)
    while depth is None or k < depth:
        k += 1
        found = found.where(~F.array_contains("_way", F.col("_next_slug")))
        found = kept(found.withColumn("_entered", F.concat("prefix", F.lit("continuation-"), "_next_slug", F.lit("-"), "node_id", F.lit("-"))))
        if found.isEmpty():
            break
        entered = found if entered is None else entered.unionByName(found)
        found = inside(found, leads, led)
    return every if entered is None else every.unionByName(inside(entered, of, of.columns)), entered


def placed(every: DataFrame) -> DataFrame:
    """Expanded nodes as one tree for each root: ``flow_id`` (the root), ``ord``, ``last``, ids with their prefixes, ``parent_id``, ``branch`` and ``path`` in the whole tree.

    The nodes at the top of an entered flow stand in the list of the step that leads there.
    """
    drop = ["root", "prefix", "_way", "_p", "_b", "_path", "slug", "_includes", "flow_id", "node_id", "parent_id", "branch", "path", "ord", "last", "replyTo"]
    rows = every.select(
        F.col("root").alias("flow_id"), F.concat("prefix", "node_id").alias("node_id"), F.col("_p").alias("parent_id"), F.col("_b").alias("branch"), F.col("_path").alias("path"), F.when(F.col("replyTo").isNotNull(), F.concat("prefix", "replyTo")).alias("replyTo"),
        F.row_number().over(Window.partitionBy("root").orderBy("place")).cast("long").alias("ord"), F.col("flow_id").alias("_own_flow"), F.col("node_id").alias("_own_id"), "prefix", *[c for c in every.columns if c not in drop],
    )
    return with_last(kept(rows))


def with_last(rows: DataFrame) -> DataFrame:
    """Nodes with ``last``, the greatest ``ord`` at or below them. Steps have nothing below and go nowhere. ``rows`` are read several times."""
    step = F.coalesce(F.col("type") == "step", F.lit(False))
    inside = rows.select("flow_id", F.col("ord").alias("_o"), F.explode("path").alias("_frame")).groupBy("flow_id", F.regexp_extract("_frame", r"^[^:]*:(.*):\d+(?::end)?$", 1).alias("node_id")).agg(F.max("_o").alias("_last"))
    frames = rows.where(~step).join(inside, ["flow_id", "node_id"], "left").withColumn("last", F.coalesce("_last", "ord")).drop("_last")
    return rows.where(step).withColumn("last", F.col("ord")).unionByName(frames)


def reply_rows(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of replies, to be put in behind ``after``. ``asked``: root, place (of the step that is answered; null: the whole flow is its answer), node_id, prefix and _own_id (its parts), from, to, status, parent_id, branch, path, label, note.

    The nodes behind a step that leads on are taken as a flow of their own; see ``flow_trees.replies_at_exits``.
    """
    keyed = asked.withColumn("_id", F.concat_ws("\0", "root", "node_id"))
    under = tree.withColumnRenamed("flow_id", "root").join(keyed.select("root", F.col("place").alias("_place"), F.col("parent_id").alias("_up"), F.col("branch").alias("_up_branch"), "_id"), "root")
    under = under.where(F.col("_place").isNull() | (F.slice("place", F.lit(1), F.size("_place")).eqNullSafe(F.col("_place")) & (F.size("place") > F.size("_place"))))
    top = F.col("parent_id").eqNullSafe(F.col("_up")) & F.col("branch").eqNullSafe(F.col("_up_branch"))
    flat = under.select(F.col("_id").alias("flow_id"), "node_id", F.when(~top, F.col("parent_id")).alias("parent_id"), F.when(~top, F.col("branch")).alias("branch"), "type", "branches", "ord", "last", F.col("path"))
    exits = replies_at_exits(flat, keyed.select(F.col("_id").alias("flow_id"), "label"))
    frames = tree.select(F.col("flow_id").alias("root"), F.col("node_id").alias("_frame"), F.col("path").alias("_frame_path"), "branches")
    out = exits.join(keyed.select(F.col("_id").alias("flow_id"), "root", "place", "node_id", "prefix", "_own_id", "from", "to", "status", "note", F.col("parent_id").alias("_up"), F.col("branch").alias("_up_branch"), F.col("path").alias("_up_path")), "flow_id")
    out = out.join(frames.withColumnRenamed("_frame", "parent_id"), ["root", "parent_id"], "left")
    inner = F.concat("_frame_path", F.array(F.concat(F.lit("alt:"), "parent_id", F.lit(":"), F.col("branch").cast("string"), F.lit(":end"))))
    ident = F.concat("prefix", F.lit("response-"), "_own_id", F.when(F.col("exit") > 1, F.concat(F.lit("-exit-"), F.col("exit").cast("string"))).otherwise(""))
    return out.select(
        F.col("root").alias("flow_id"), ident.alias("node_id"), F.coalesce("parent_id", "_up").alias("parent_id"), F.coalesce("branch", "_up_branch").alias("branch"), F.when(F.col("parent_id").isNotNull(), inner).otherwise(F.col("_up_path")).alias("path"),
        F.lit("step").alias("type"), F.col("to").alias("from"), F.col("from").alias("to"), F.lit("response").alias("kind"), "label", "status", "note", F.col("node_id").alias("replyTo"), "after", F.coalesce(F.size("place"), F.lit(0)).alias("_deep"), "exit",
    )


def composed(flows: DataFrame, nodes: DataFrame, answers: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, nodes, entries: flow_id, step, flow, kind, target, basis) of an estate whose executions are told from end to end.

    ``answers``: ref, response, of methods that answer at once (see ``estate.responses``). Behind a step come the flows that it leads on to, with theirs, see ``doors`` and
    ``expanded``; ids get the prefix ``continuation-<slug>-<step>-``. A called rpc that is answered at once gets its reply at each exit of what came behind it, and a flow that an HTTP
    request opens at its own exits, unless a reply stands there already. A flow that was entered, has an entrypoint and no trigger of its own is told there
    and stands alone no more. Flows without any of this stay as they are. ``includes`` and ``summary`` say what has been put in.
    """
    nodes = kept(nodes)
    ways = doors(nodes, flows)
    every, entered = expanded(nodes, flows, ways, depth)
    into = flows.select(F.col("id").alias("next_flow"), F.col("slug").alias("_slug"), F.coalesce("includes", F.array().cast("array<string>")).alias("_more"), "entrypoint", F.coalesce("trigger.kind", F.lit("unproven")).alias("_trigger"))
    if entered is not None:
        consumed = kept(entered.select("next_flow").distinct().join(into, "next_flow").where("entrypoint <> '' and _trigger = 'unproven'").select(F.col("next_flow").alias("id")).distinct())
        every = every.join(consumed.withColumnRenamed("id", "root"), "root", "left_anti")
    tree = placed(every)
    replied = nodes.where("kind = 'response' and replyTo is not null").select(F.col("flow_id").alias("_own_flow"), F.col("replyTo").alias("_own_id")).distinct()
    label = kept(answers.select("ref", F.col("response").alias("_answer")))  # these two are often small, and known to be so once they are written
    http = kept(flows.where("trigger.kind = 'http'").select(F.col("id").alias("flow_id")))
    calls = tree.where("type = 'step' and kind = 'rpc'")
    opening = tree.where("type = 'step'").join(http, "flow_id", "left_semi").groupBy("flow_id").agg(F.min("ord").alias("ord"))
    whole = calls.join(http, "flow_id").join(opening, ["flow_id", "ord"]).join(tree.where("kind = 'response'").select("flow_id", F.col("replyTo").alias("node_id")).distinct(), ["flow_id", "node_id"], "left_anti").join(label, "ref", "left")
    columns = [F.col("flow_id").alias("root"), "place", "node_id", "prefix", "_own_id", "from", "to", "status", "parent_id", "branch", "path"]
    none = F.lit(None)
    asked = whole.select(*columns, F.coalesce(F.nullif("_answer", F.lit("")), F.lit("HTTP response")).alias("label"), F.lit("Synthesized from the proven synchronous HTTP handler return.").alias("note"))
    asked = asked.withColumns({"place": none.cast("array<bigint>"), "parent_id": none.cast("string"), "branch": none.cast("bigint"), "path": F.array().cast("array<string>")})
    if entered is not None:
        at_once = entered.where("synchronous").select(F.col("root").alias("flow_id"), "place").distinct()
        inner = calls.join(label.where("_answer <> ''"), "ref").join(at_once, ["flow_id", "place"]).join(replied, ["_own_flow", "_own_id"], "left_anti")
        asked = asked.unionByName(inner.select(*columns, F.col("_answer").alias("label"), F.lit("Synthesized from the proven synchronous unary gRPC return.").alias("note")))
    replies = reply_rows(tree, kept(asked))
    told_once = tree.withColumns({"after": F.col("ord"), "_deep": none.cast("int"), "exit": F.lit(0)})
    joined = told_once.unionByName(replies.withColumns({"rest": F.lit("{}"), "_src_path": none.cast("string")}), allowMissingColumns=True)
    order = Window.partitionBy("flow_id").orderBy("after", F.when(F.col("_deep").isNull(), 0).otherwise(1), F.desc("_deep"), "exit")
    joined = kept(joined.drop("last").withColumn("ord", F.row_number().over(order).cast("long")))
    source = nodes.select("flow_id", "_src_path").distinct().withColumnRenamed("_src_path", "_src")
    unsaid = joined.where("_src_path is null").join(source, "flow_id", "left").withColumn("_src_path", F.col("_src")).drop("_src")
    joined = with_last(joined.where("_src_path is not null").unionByName(unsaid)).select(*nodes.columns)
    if entered is None:
        return flows, joined, nodes.select("flow_id", F.col("node_id").alias("step"), F.col("flow_id").alias("flow"), *[F.lit("").alias(c) for c in ("kind", "target", "basis")]).limit(0)
    told = entered.join(into, "next_flow")
    listed = told.groupBy(F.col("root").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.concat("place", F.array(F.col("nth").cast("long"))).alias("p"), F.concat(F.array("_slug"), "_more").alias("s")))).alias("_l"))
    listed = listed.select("id", F.flatten(F.transform("_l", lambda x: x["s"])).alias("_put_in"))
    out = flows.join(listed, "id", "left").join(consumed, "id", "left_anti")
    more = F.col("_put_in").isNotNull()
    out = out.withColumn("includes", F.when(more, F.array_distinct(F.concat(F.coalesce("includes", F.array().cast("array<string>")), "_put_in"))).otherwise(F.col("includes")))
    out = out.withColumn("summary", F.when(more, F.concat(F.rtrim(F.coalesce("summary", F.lit(""))), F.lit(COMPOSED))).otherwise(F.col("summary")))
    entries = told.select(F.col("root").alias("flow_id"), F.concat("prefix", "node_id").alias("step"), F.col("_slug").alias("flow"), "kind", "target", "basis").distinct()
    return out.select(*flows.columns), joined, entries.join(consumed.withColumnRenamed("id", "flow_id"), "flow_id", "left_anti")
