"""Graph queries over edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.merge import STATUSES, rank_of
from atlasframe.plans.checkpoints import checkpoint


def worst(status: Column) -> Column:
    """Aggregate: the weakest status."""
    return F.max_by(status, rank_of(status, STATUSES))


def bundles(edges: DataFrame, source: str, target: str, status: str, label: str) -> DataFrame:
    """Edges by (source, target): how many, their labels, the worst status, and whether a bundle goes back. Self-loops are left out."""
    b = edges.where(F.col(source) != F.col(target)).groupBy(source, target).agg(
        F.count("*").alias("edges"), F.array_sort(F.collect_set(label)).alias("labels"), worst(F.col(status)).alias("status")
    )
    back = b.select(F.col(target).alias(source), F.col(source).alias(target), F.lit(True).alias("back"))
    return b.join(back, [source, target], "left").withColumn("back", F.coalesce("back", F.lit(False)))


def event_graph(publications: DataFrame, consumers: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of publisher -> event -> consumer.

    ``publications``: event, service; ``consumers``: event, service, status; ``services``: service, context. Consumers that no
    service row describes are ghosts. Nodes carry how many events they publish and how many different ones they consume.
    """
    edges = publications.withColumnRenamed("service", "publisher").join(consumers.withColumnRenamed("service", "consumer"), "event")
    publishes = publications.groupBy("service").agg(F.count("*").alias("publishes"))
    consumes = consumers.groupBy("service").agg(F.count_distinct("event").alias("consumes"))
    nodes = publishes.join(consumes, "service", "full_outer").join(services.select("service", "context").withColumn("_real", F.lit(True)), "service", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("service", "context", F.col("_real").isNull().alias("ghost"), zero("publishes"), zero("consumes")), edges


def filter_event_graph(edges: DataFrame, contexts: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Edges (publisher_context, consumer_context, status, ...) that a filter keeps; no list, no filter. A side in a kept context anchors an edge."""
    if statuses:
        edges = edges.where(F.col("status").isin(statuses))
    if contexts:
        edges = edges.where(F.col("publisher_context").isin(contexts) | F.col("consumer_context").isin(contexts))
    return edges


def context_map(contexts: DataFrame, links: DataFrame, order: str, kernel: DataFrame | None = None) -> DataFrame:
    """All pairs of contexts with the links either way, and their relation.

    ``contexts``: context and ``order``; ``links``: upstream, downstream (contexts). A short list of contexts is paired with itself;
    the links themselves are joined by key. ``kernel`` (left, right, def; see ``usages.shared_kernel``, in the order of the pairs): adds ``shared``, how many types both name; a pair
    that only shares types is a ``shared-kernel``.
    """
    a = contexts.select(F.col("context").alias("left"), F.col(order).alias("_i"))
    b = contexts.select(F.col("context").alias("right"), F.col(order).alias("_j"))
    n = links.where("upstream <> downstream").groupBy("upstream", "downstream").agg(F.count("*").alias("n"))
    down = n.select(F.col("upstream").alias("left"), F.col("downstream").alias("right"), F.col("n").alias("to_right"))
    up = n.select(F.col("downstream").alias("left"), F.col("upstream").alias("right"), F.col("n").alias("to_left"))
    pairs = a.join(b, F.col("_i") < F.col("_j")).join(down, ["left", "right"], "left").join(up, ["left", "right"], "left")
    right, left = F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0))
    pattern = F.when((right == 0) & (left == 0), "separate-ways").when((right > 0) & (left > 0), "partnership").otherwise("customer-supplier")
    found = pairs.select("left", "right", right.alias("to_right"), left.alias("to_left"), (right + left).alias("weight"), pattern.alias("pattern"))
    if kernel is None:
        return found
    n = kernel.groupBy("left", "right").agg(F.count_distinct("def").alias("shared"))
    out = found.join(n, ["left", "right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.withColumn("pattern", F.when((F.col("weight") == 0) & (F.col("shared") > 0), "shared-kernel").otherwise(F.col("pattern")))


def bridges(scores: DataFrame, least: float = 0.0) -> DataFrame:
    """Nodes that lie between others (``betweenness`` over ``least``), with their share of all betweenness and their place, the busiest first."""
    on = scores.where(F.col("betweenness") > least)
    total = on.agg(F.sum("betweenness")).first()[0]
    share = F.col("betweenness") / F.lit(float(total)) if total else F.lit(0.0)  # nothing lies between others where no edge is
    w = Window.orderBy(F.desc("betweenness"), "node")  # nodes of an estate, not its edges
    return on.select("node", "betweenness", share.alias("share"), F.row_number().over(w).cast("long").alias("place"))


def closure(edges: DataFrame, source: str, target: str, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """All (root, node, depth) that paths of ``edges`` reach, each with its least depth; cycles end where nothing new is found.

    ``seeds`` has the column ``root``; without it every source is a root. Each step joins only what the last one found. Paths are followed to their
    ends, or for ``max_depth`` steps if that is given. The joins are hinted to merge: broadcasts of each step's rows, small as each may be, would add up on the driver.
    """
    e = checkpoint(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct())
    seeds = e.select(F.col("_s").alias("root")).distinct() if seeds is None else seeds.select("root").distinct()
    front = checkpoint(seeds.select("root", F.col("root").alias("node")))
    seen = front.withColumn("depth", F.lit(0))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        found = front.hint("merge").join(e, front.node == e["_s"]).select("root", F.col("_t").alias("node")).distinct()
        front = checkpoint(found.join(seen.hint("merge"), ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front.withColumn("depth", F.lit(depth)))) if depth % 8 == 0 else seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def lineage_chain(edges: DataFrame, source: str, target: str, ident) -> DataFrame:
    """What feeds one node and what it feeds: node, direction, depth."""
    seed = edges.sparkSession.createDataFrame([(ident,)], ["root"])
    down = closure(edges, source, target, seed).select("node", F.lit("downstream").alias("direction"), "depth")
    up = closure(edges, target, source, seed).select("node", F.lit("upstream").alias("direction"), "depth")
    return down.unionByName(up)


def lifecycle_columns(transitions: DataFrame, states: DataFrame, initial: str) -> DataFrame:
    """The least number of steps from the first state; states out of reach share one last column; ``terminal``: no step to another state."""
    seed = states.where(F.col("state") == initial).select(F.col("state").alias("root"))
    reach = closure(transitions, "source", "target", seed).select(F.col("node").alias("state"), "depth")
    last = F.max("depth").over(Window.partitionBy()) + 1
    going = transitions.where("source <> target").select(F.col("source").alias("state")).distinct().withColumn("_goes", F.lit(True))
    placed = states.select("state").join(reach, "state", "left").withColumn("depth", F.when(F.col("state") == initial, 0).otherwise(F.col("depth")))
    return placed.withColumn("column", F.coalesce("depth", last)).join(going, "state", "left").select("state", "column", F.col("_goes").isNull().alias("terminal"))


def undirected(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Different pairs (a, b) with a < b."""
    return edges.where(F.col(source) != F.col(target)).select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).distinct()


def betweenness(pairs: DataFrame) -> DataFrame:
    """Normalised betweenness of the nodes of a simple undirected graph (``a``, ``b``), by Brandes' sums level by level.

    Breadth-first from all nodes at once: each level joins the frontier with the edges and adds up path counts;
    then dependencies flow back from the deepest level. Returns ``node``, ``betweenness``; 0 with fewer than 3 nodes.
    """
    e = checkpoint(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    nodes = e.select(F.col("a").alias("node")).distinct()
    levels = [checkpoint(nodes.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("root", "node")
    while True:
        step = levels[-1].join(e, F.col("node") == F.col("a")).groupBy("root", F.col("b").alias("_to")).agg(F.sum("paths").alias("paths")).withColumnRenamed("_to", "node")
        step = checkpoint(step.join(seen, ["root", "node"], "left_anti"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = seen.unionByName(step.select("root", "node"))
        if len(levels) % 16 == 0:
            seen = checkpoint(seen)
    total = None
    below = None
    for level in reversed(levels[1:]):
        own = level if below is None else level.join(below, ["root", "node"], "left")
        own = checkpoint(own.withColumn("dep", F.lit(0.0) if below is None else F.coalesce("dep", F.lit(0.0))))
        part = own.groupBy("node").agg(F.sum("dep").alias("dep"))
        total = part if total is None else total.unionByName(part)
        k = levels.index(level)
        up = levels[k - 1].withColumnRenamed("node", "_up").withColumnRenamed("paths", "_up_paths")
        flow = own.join(e, F.col("node") == F.col("a")).withColumnRenamed("b", "_up").join(up, ["root", "_up"])
        below = flow.groupBy("root", F.col("_up").alias("_n")).agg(F.sum(F.col("_up_paths") / F.col("paths") * (1 + F.col("dep"))).alias("dep")).withColumnRenamed("_n", "node")
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if total is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    return nodes.join(total.groupBy("node").agg(F.sum("dep").alias("dep")), "node", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def context_traffic(pairs: DataFrame, contexts: DataFrame, roots_at_once: int = 500) -> DataFrame:
    """How much of the traffic between each two contexts a node carries: node, left, right (contexts, the smaller name first), carried, total, share.

    ``pairs``: a, b (undirected, see ``undirected``); ``contexts``: node, context, of every node. ``carried`` sums, over the pairs of other nodes with one end in either context, the
    share of their shortest paths that pass the node; ``total`` is the number of such pairs that reach one another. Rows with nothing carried are left out.

    Brandes' dependencies are kept as sparse vectors, a row for each root, node and context of the targets, so one pass gives all pairs of contexts. Roots go in blocks of ``roots_at_once``: a block's
    rows are bounded by it times the nodes times the contexts that lie behind them, and only the sums over a block are kept.
    """
    e = checkpoint(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = checkpoint(e.select(F.col("a").alias("node")).distinct().join(contexts.select("node", "context"), "node", "left"))
    blocks = -(-nodes.count() // roots_at_once)
    of = lambda name, to: nodes.select(F.col("node").alias(name), F.col("context").alias(to))
    carried, reached = None, None
    for block in range(blocks):
        roots = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        levels = [checkpoint(roots.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("paths")))]
        seen = levels[0].select("root", "node")
        while not levels[-1].isEmpty():
            step = levels[-1].join(e, F.col("node") == F.col("a")).groupBy("root", F.col("b").alias("_to")).agg(F.sum("paths").alias("paths")).withColumnRenamed("_to", "node")
            levels.append(checkpoint(step.join(seen, ["root", "node"], "left_anti")))
            seen = seen.unionByName(levels[-1].select("root", "node"))
            if len(levels) % 16 == 0:
                seen = checkpoint(seen)
        below, sums = None, None
        for k in range(len(levels) - 2, 0, -1):
            own = levels[k].join(of("node", "to"), "node").withColumn("dep", F.lit(1.0))
            if below is not None:
                part = below.groupBy("root", "node", "to").agg(F.sum("dep").alias("dep"))
                sums = part if sums is None else sums.unionByName(part)
                own = own.unionByName(levels[k].join(part, ["root", "node"]))
            up = levels[k - 1].select("root", F.col("node").alias("_up"), F.col("paths").alias("_up_paths"))
            flow = own.join(e, F.col("node") == F.col("a")).withColumnRenamed("b", "_up").join(up, ["root", "_up"])
            below = checkpoint(flow.groupBy("root", F.col("_up").alias("node"), "to").agg(F.sum(F.col("_up_paths") / F.col("paths") * F.col("dep")).alias("dep")))
        met = seen.where("root <> node").join(of("root", "from"), "root").join(of("node", "to"), "node").groupBy("root", "from", "to").agg(F.count("*").alias("n"))
        reached = checkpoint(met if reached is None else reached.unionByName(met))
        if sums is not None:
            ends = sums.join(of("root", "from"), "root").groupBy("node", F.least("from", "to").alias("left"), F.greatest("from", "to").alias("right")).agg(F.sum("dep").alias("dep"))
            carried = checkpoint(ends if carried is None else carried.unionByName(ends))
    if carried is None:
        return nodes.select("node", F.col("context").alias("left"), F.col("context").alias("right"), *[F.lit(0.0).alias(c) for c in ("carried", "total", "share")]).limit(0)
    sums = carried.groupBy("node", "left", "right").agg((F.sum("dep") / 2).alias("carried"))
    half = F.when(F.col("from") == F.col("to"), F.col("n") / 2).otherwise(F.col("n").cast("double"))
    every = reached.where(F.col("from") <= F.col("to")).groupBy(F.col("from").alias("left"), F.col("to").alias("right")).agg(F.sum(half).alias("_all"))
    own = reached.select(F.col("root").alias("node"), F.least("from", "to").alias("left"), F.greatest("from", "to").alias("right"), F.col("n").alias("_own"))
    out = sums.join(every, ["left", "right"]).join(own, ["node", "left", "right"], "left")
    total = F.col("_all") - F.coalesce("_own", F.lit(0))
    return out.select("node", "left", "right", "carried", total.alias("total"), F.when(total > 0, F.col("carried") / total).otherwise(0.0).alias("share")).where("carried > 0")


def main_roads(traffic: DataFrame, least: float = 0.5) -> DataFrame:
    """Nodes that carry more than ``least`` of the traffic between two different contexts: the rows of ``context_traffic`` with ``place``, the largest share of a node first."""
    found = traffic.where((F.col("left") != F.col("right")) & (F.col("share") > least))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("share"), "left", "right")).cast("long"))


def published_after(receipts: DataFrame, publications: DataFrame, key: list[str], order: str) -> DataFrame:
    """For each receipt, the first publication of each event later in the same ``key``.

    Both are laid in one order; each receipt looks at the rows behind it once for each kind of event its key has, so a busy key costs no pairs of its rows.
    """
    kinds = publications.select(*key, F.col("event").alias("published")).distinct()
    r = receipts.select(*key, F.col(order).alias("_at"), F.col("event").alias("received")).join(kinds, key).withColumn("_p", F.lit(None).cast(publications.schema[order].dataType))
    p = publications.select(*key, F.col(order).alias("_at"), F.lit(None).cast("string").alias("received"), F.col("event").alias("published"), F.col(order).alias("_p"))
    w = Window.partitionBy(*key, "published").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    found = r.unionByName(p).withColumn("_first", F.min("_p").over(w)).where("received is not null and _first is not null")
    return found.select(*key, F.col("_at").alias(order), "received", "published", F.col("_first").alias(f"published_{order}")).distinct()


def related(*edges: tuple[DataFrame, str, str, str, str]) -> DataFrame:
    """One-hop relations both ways: (table, source column, target column, name, inverse name) -> source, relation, target."""
    out = None
    for df, s, t, name, inverse in edges:
        pair = df.select(F.col(s).alias("source"), F.col(t).alias("target")).where("source is not null and target is not null")
        both = pair.select("source", F.lit(name).alias("relation"), "target").unionByName(pair.select(F.col("target").alias("source"), F.lit(inverse).alias("relation"), F.col("source").alias("target")))
        out = both if out is None else out.unionByName(both)
    return out.distinct()
