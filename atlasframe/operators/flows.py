"""Queries over flow trees flattened in pre-order (see ``sources.fragments.flow_nodes``)."""

from __future__ import annotations

from itertools import count, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.plans.checkpoints import checkpoint

#: How many ways through a flow are told, how deep a chain goes and how many nodes it may have.
MAX_PATHS, CHAIN_DEPTH, CHAIN_NODES = 64, 4, 200


def steps(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'step'")


def conditions(path: Column) -> Column:
    """The alternatives among a step's frames."""
    return F.filter(path, lambda x: x.startswith("alt:"))


def flow_contexts(participants: DataFrame) -> DataFrame:
    """Different contexts of each flow's lanes, and how many."""
    return participants.where("context is not null").groupBy("flow").agg(F.array_sort(F.collect_set("context")).alias("contexts")).withColumn("reach", F.size("contexts"))


def with_lane_contexts(nodes: DataFrame, participants: DataFrame) -> DataFrame:
    """Steps with the context of either lane and whether they cross from one context to another."""
    lanes = participants.select(F.col("flow").alias("flow_id"), F.col("id").alias("_lane"), F.col("context").alias("_ctx"))
    a, b = lanes.withColumnsRenamed({"_lane": "from", "_ctx": "from_context"}), lanes.withColumnsRenamed({"_lane": "to", "_ctx": "to_context"})
    out = steps(nodes).join(a, ["flow_id", "from"], "left").join(b, ["flow_id", "to"], "left")
    return out.withColumn("crosses", F.coalesce(F.col("from_context") != F.col("to_context"), F.lit(False)))


def chapters(nodes: DataFrame) -> DataFrame:
    """Runs of top-level nodes: each frame is a chapter, and so is each run of steps between frames.

    flow_id, chapter (from 1), kind, first and last step by ``ord``, and steps by status.
    """
    top = F.when(F.size("path") > 0, F.element_at(F.split(F.col("path")[0], ":"), 2))
    kind = F.when(F.size("path") > 0, F.element_at(F.split(F.col("path")[0], ":"), 1)).otherwise("steps")
    w = Window.partitionBy("flow_id").orderBy("ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = ("verified", "declared", "unresolved")
    sums = {"steps": F.count("*").over(so_far)} | {s: F.count_if(F.col("status") == s).over(so_far) for s in states}
    marked = steps(nodes).select("flow_id", "ord", "status", F.coalesce(top, F.lit("")).alias("_key"), kind.alias("kind"))
    other = lambda at: F.coalesce((F.col("_key") != at("_key").over(w)) | (F.col("kind") != at("kind").over(w)), F.lit(True))
    marked = marked.withColumns({"_opens": other(F.lag), "_ends": other(F.lead)} | sums)
    # where a chapter ends, the sums so far less those at the end before it are its own: nothing is held but the rows in their order
    first = F.max(F.when(F.col("_opens"), F.col("ord"))).over(so_far)
    ends = marked.withColumn("first", first).where("_ends")
    own = [(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in ("steps", *states)]
    return ends.select("flow_id", F.row_number().over(w).cast("long").alias("chapter"), "kind", "first", F.col("ord").alias("last"), *own)


def paths(nodes: DataFrame) -> DataFrame:
    """Ways through each flow: flow_id, way (from 1), steps, truncated.

    A loop is taken once, parallel branches follow one another, each alternative is a way, a terminal branch ends
    it; beyond MAX_PATHS the rest is left out and ``truncated`` says so. A flow's nodes are few, so each is one group.
    """

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict[str | None, list] = {}
        for r in pdf.sort_values("ord").itertuples(index=False):
            kids.setdefault(r.parent_id if isinstance(r.parent_id, str) else None, []).append(r)

        def through(rows: list) -> list[tuple[list[str], bool]]:
            found: list[tuple[list[str], bool]] = [([], False)]
            for r in rows:
                if r.type == "step":
                    options = [([r.node_id], False)]
                else:
                    own = kids.get(r.node_id, [])
                    by: dict[int, list] = {}
                    for k in own:
                        by.setdefault(int(k.branch), []).append(k)
                    parts = {b: through(x) for b, x in sorted(by.items())}
                    if r.type == "alt":
                        options = []
                        for b, x in parts.items():
                            end = by[b][0].path[-1].endswith(":end")
                            options += [(s, stop or end) for s, stop in x]
                        options = options or [([], False)]
                    else:
                        options = [([s for way, _ in combo for s in way], any(stop for _, stop in combo)) for combo in product(*parts.values())]
                open_, shut = [f for f in found if not f[1]], [f for f in found if f[1]]
                found = shut + [(a + b, stop) for a, _ in open_ for b, stop in options]
                found = found[: MAX_PATHS + 1]
            return found

        found = through(kids.get(None, []))
        cut = len(found) > MAX_PATHS
        return pd.DataFrame([(pdf["flow_id"].iloc[0], i + 1, s, cut) for i, (s, _) in enumerate(found[:MAX_PATHS])], columns=["flow_id", "way", "steps", "truncated"])

    return nodes.groupBy("flow_id").applyInPandas(ways, "flow_id string, way long, steps array<string>, truncated boolean")


def same_side(earlier: Column, later: Column) -> Column:
    """May a step with frames ``later`` follow one with frames ``earlier``? In each alternative of the earlier one the later one
    is in the same branch, or outside that alternative if the branch doesn't end the flow."""
    key = lambda x: F.substring_index(x, ":", 2)
    arm = lambda x: F.regexp_replace(x, ":end$", "")
    inside = lambda a: F.exists(conditions(later), lambda b: key(b) == key(a))
    same = lambda a: F.exists(conditions(later), lambda b: arm(b) == arm(a))
    return F.forall(conditions(earlier), lambda a: same(a) | (~inside(a) & ~a.endswith(":end")))


def event_hops(nodes: DataFrame, publishers: DataFrame) -> DataFrame:
    """Event -> event: a flow shows a service receive one and publish another later on a branch that fits.

    ``publishers``: event, service. Returns event, service, published, flow_id, step_id (of the first such publication).
    """
    s = steps(nodes).where("kind = 'event' and ref is not null")
    received = s.select("flow_id", F.col("to").alias("service"), F.col("ref").alias("event"), F.col("ord").alias("_r"), F.col("path").alias("_rp"))
    sent = s.where("`from` <> `to`").select("flow_id", F.col("from").alias("service"), F.col("ref").alias("published"), F.col("ord").alias("_s"), F.col("path").alias("_sp"), F.col("node_id").alias("step_id"))
    known = publishers.select(F.col("event").alias("published"), "service")
    pairs = received.join(sent, ["flow_id", "service"]).where((F.col("_s") > F.col("_r")) & same_side(F.col("_rp"), F.col("_sp"))).join(known, ["published", "service"])
    return pairs.groupBy("event", "service", "published").agg(F.min_by("flow_id", F.struct("flow_id", "_s")).alias("flow_id"), F.min_by("step_id", F.struct("flow_id", "_s")).alias("step_id"))


def event_chain(hops: DataFrame, consumers: DataFrame, event: str, depth: int = CHAIN_DEPTH, nodes: int = CHAIN_NODES) -> DataFrame:
    """What an event sets off: level, event, consumer, status, published, cut.

    Level by level: consumers of the events of a level, then what they publish. An event is opened once; where it comes
    again the chain is cut as ``seen`` (or ``cycle`` if it is the root). ``depth`` and ``nodes`` bound a report about one event; what they leave out is cut
    as ``depth`` or ``budget``.
    """
    spark = hops.sparkSession
    opened, level, out, used = {event}, [event], [], 1
    for k in range(1, depth + 1):
        front = spark.createDataFrame([(e,) for e in level], "event string")
        rows = consumers.join(front, "event").join(hops.withColumnRenamed("service", "consumer"), ["event", "consumer"], "left").select("event", "consumer", "status", "published").orderBy("event", "consumer", "published").limit(nodes + 1).collect()
        following = []
        for r in rows:
            if used >= nodes:
                out.append((k, r.event, None, None, None, "budget"))
                break
            used += 1
            cut = None
            if r.published is not None:
                cut = "cycle" if r.published == event else "seen" if r.published in opened else "depth" if k == depth else None
                if cut is None:
                    opened.add(r.published)
                    following.append(r.published)
            out.append((k, r.event, r.consumer, r.status, r.published, cut))
        level = following
        if not level:
            break
    return spark.createDataFrame(out, "level long, event string, consumer string, status string, published string, cut string")


def continuations(nodes: DataFrame, flows: DataFrame, participants: DataFrame | None = None, handoffs: DataFrame | None = None) -> DataFrame:
    """Flows that a step leads on to: by entrypoint first, then by what is handed over, then by the rpc contract that it calls, then by the same event.

    ``flows``: id, entrypoint. The opening of a flow is its first step. A called flow must open at the service that is called; with ``participants`` (flow, id, kind), its
    caller must be an actor. ``handoffs`` (flow_id, step_id, direction, kind, transport, channel, message): a sent message opens the flow whose first step receives the same. Never the
    flow itself; a step's best kind counts.
    """
    first = steps(nodes).groupBy("flow_id").agg(F.min_by(F.struct("kind", "ref", "to", "from", "node_id"), "ord").alias("o"))
    opens = first.select(F.col("flow_id").alias("next_flow"), F.col("o.kind").alias("_k"), F.col("o.ref").alias("ref"), F.col("o.to").alias("_to"), F.col("o.from").alias("_from"), F.col("o.node_id").alias("_node"))
    if participants is not None:
        actors = participants.where("kind = 'actor'").select(F.col("flow").alias("next_flow"), F.col("id").alias("_from"), F.lit(True).alias("_actor")).distinct()
        opens = opens.join(actors, ["next_flow", "_from"], "left").withColumn("_actor", F.coalesce("_actor", F.lit(False)))
    else:
        opens = opens.withColumn("_actor", F.lit(True))
    s = steps(nodes).where("ref is not null").select("flow_id", F.col("node_id").alias("step_id"), "ref", "kind", "to")
    entry = flows.where("entrypoint <> ''").select(F.col("id").alias("next_flow"), F.col("entrypoint").alias("ref"), F.lit(True).alias("_entry"))
    doors = opens.where("ref is not null and _k in ('rpc', 'event')").select("next_flow", "ref", "_k", "_to", "_actor", F.lit(False).alias("_entry")).unionByName(entry, allowMissingColumns=True)
    served = (F.col("kind") == "rpc") & (F.col("_k") == "rpc") & (F.col("to") == F.col("_to")) & F.col("_actor")
    shared = (F.col("kind") == "event") & (F.col("_k") == "event")
    met = s.join(doors, "ref").where(F.col("_entry") | served | shared)  # steps are shuffled once for both
    all_ = met.select("flow_id", "step_id", "next_flow", F.when(F.col("_entry"), 1).when(served, 3).otherwise(4).alias("rank"))
    if handoffs is not None:
        what = ["kind", "transport", "channel", "message"]
        given = handoffs.withColumn("message", F.coalesce("message", F.lit("")))
        opened = given.where("direction = 'receive'").join(opens.select(F.col("next_flow").alias("flow_id"), F.col("_node").alias("step_id")), ["flow_id", "step_id"]).select(F.col("flow_id").alias("next_flow"), *what)
        all_ = all_.unionByName(given.where("direction = 'send'").join(opened, what).select("flow_id", "step_id", "next_flow", F.lit(2).alias("rank")))
    all_ = all_.where("flow_id <> next_flow")
    w = Window.partitionBy("flow_id", "step_id")
    basis = F.when(F.col("rank") == 1, "entrypoint").when(F.col("rank") == 2, "handoff").when(F.col("rank") == 3, "contract").otherwise("event")
    return all_.withColumn("_best", F.min("rank").over(w)).where("rank = _best").select("flow_id", "step_id", "next_flow", basis.alias("basis")).distinct()


def align(base: DataFrame, branch: DataFrame, key: list[str]) -> DataFrame:
    """Steps of two versions of a flow in one order: flow_id, ord, base_id, branch_id; the longest common run of signatures is matched."""
    sign = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in key])
    sides = [steps(df).groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", sign.alias("sign")))), lambda x: F.struct(x["node_id"].alias("id"), x["sign"].alias("sign"))).alias(n)) for df, n in ((base, "a"), (branch, "b"))]

    def lcs(pdfs):
        for pdf in pdfs:
            out = []
            for flow, a, b in zip(pdf["flow_id"], pdf["a"], pdf["b"]):
                a, b = list(a) if a is not None else [], list(b) if b is not None else []
                best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for i in reversed(range(len(a))):
                    for j in reversed(range(len(b))):
                        best[i][j] = best[i + 1][j + 1] + 1 if a[i]["sign"] == b[j]["sign"] else max(best[i + 1][j], best[i][j + 1])
                i = j = n = 0
                while i < len(a) or j < len(b):
                    n += 1
                    if i < len(a) and j < len(b) and a[i]["sign"] == b[j]["sign"]:
                        out.append((flow, n, a[i]["id"], b[j]["id"]))
                        i, j = i + 1, j + 1
                    elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
                        out.append((flow, n, a[i]["id"], None))
                        i += 1
                    else:
                        out.append((flow, n, None, b[j]["id"]))
                        j += 1
            yield pd.DataFrame(out, columns=["flow_id", "ord", "base_id", "branch_id"])

    return sides[0].join(sides[1], "flow_id", "full_outer").mapInPandas(lcs, "flow_id string, ord long, base_id string, branch_id string")


def spliced(nodes: DataFrame, next_flows: DataFrame, opened: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """Flows with the flows that their steps lead on to put in after those steps, as one ordered list for each root.

    ``next_flows``: flow_id, step_id, next_flow (see ``continuations``); ``opened``, with the columns step_id and next_flow,
    says which of them to go into (all, without it: a composed flow; with it: a reader's journey). A flow on the way is not
    entered again; levels end where nothing new is entered, or after ``depth`` of them where that is given. Adds root, place (an array: its order is the list's), level and way.
    """
    doors = next_flows.select("flow_id", F.col("step_id").alias("node_id"), "next_flow").distinct()
    if opened is not None:
        doors = doors.join(opened.select(F.col("step_id").alias("node_id"), "next_flow"), ["node_id", "next_flow"], "left_semi")
    level = nodes.select(F.col("flow_id").alias("root"), F.array("ord").alias("place"), F.lit(0).alias("level"), F.array("flow_id").alias("way"), *nodes.columns)
    out = level
    for k in count(1) if depth is None else range(1, depth + 1):
        entered = level.select("root", "place", "way", "flow_id", "node_id").join(doors, ["flow_id", "node_id"]).where(~F.array_contains("way", F.col("next_flow")))
        entered = checkpoint(entered.select("root", F.col("place").alias("_place"), F.col("way").alias("_way"), F.col("next_flow").alias("flow_id")))
        if entered.isEmpty():
            break
        level = nodes.join(entered, "flow_id").select("root", F.concat("_place", F.array("ord")).alias("place"), F.lit(k).alias("level"), F.concat("_way", F.array("flow_id")).alias("way"), *nodes.columns)
        out = out.unionByName(level)
        if k % 8 == 0:  # the plan of a long journey stays short
            level, out = checkpoint(level), checkpoint(out)
    return out


def journey_reach(journey: DataFrame, next_flows: DataFrame) -> DataFrame:
    """By root: doors, open doors, steps and different lanes of a journey."""
    doors = next_flows.groupBy("flow_id", F.col("step_id").alias("node_id")).agg(F.count_distinct("next_flow").alias("_doors"))
    opened = journey.where("level > 0").groupBy("root").agg(F.count_distinct(F.slice("place", 1, F.size("place") - 1), F.element_at("way", -1)).alias("open_doors"))
    s = journey.where("type = 'step'").join(doors, ["flow_id", "node_id"], "left")
    return s.groupBy("root").agg(F.coalesce(F.sum("_doors"), F.lit(0)).alias("doors"), F.count("*").alias("steps"), F.size(F.array_distinct(F.concat(F.collect_set("from"), F.collect_set("to")))).alias("lanes")).join(opened, "root", "left").withColumn("open_doors", F.coalesce("open_doors", F.lit(0)))
