"""What a plan has in hand on its way, and graphs without edges: steps whose rows grew faster than their input."""

from pyspark.sql import functions as F

from atlasframe import usage_queries
from atlasframe.operators import blocks, compose, estate, flow_trees, graph, reference_sites, usages, verify
from atlasframe.plans import problem_flows
from atlasframe.sources import owners
from atlasframe.sources.fragments import flow_nodes


def widest(df):
    """The most rows that any operator of ``df`` gave out; ``df`` is run."""
    df.collect()

    def rows(node):
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        below = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(rows, below)])

    return rows(df._jdf.queryExecution().executedPlan())


def test_lanes_meet_owners_not_their_stores(spark):
    """300 lanes beside a service with 300 stores, and one beside a service with one."""
    lanes = spark.range(301).selectExpr("id as flow", "'l' as lane")
    stores = spark.range(301).selectExpr("concat('s', id) as store", "if(id < 300, 0, 1) as owner")
    beside = spark.range(301).selectExpr("id as flow", "'l' as lane", "if(id < 300, 0, 1) as service")
    found = estate.link_lanes(lanes, lanes.selectExpr("flow", "lane", "'x' as store").limit(0), stores, beside)
    assert widest(found) <= 301
    assert [tuple(r) for r in found.where("store is not null").collect()] == [(300, "l", "s300", "neighbour")]


def test_bridges_of_no_edges(spark):
    """no edge, and edges that no path passes through."""
    for pairs in ([], [(1, 2)], [(1, 2), (3, 4)]):
        scores = graph.betweenness(spark.createDataFrame(pairs, "a int, b int"))
        assert graph.bridges(scores).collect() == []
        assert all(r.share == 0 for r in graph.bridges(scores, -1.0).collect())


def counted(df):
    """``df``, and how many of its rows have been made so far."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def tick(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(tick, df.schema), made


def trees(spark, source, *steps):
    return spark.createDataFrame([(f"f{i}", source, s) for i, s in enumerate(steps)], "id string, _src_path string, steps string")


ONE = '[{"type": "step", "id": "s", "kind": "rpc", "from": "a", "to": "b", "continuesAt": "fn%d"}]'


def test_trees_are_read_once(spark):
    """laying over and asking for replies read each tree once, and give what they gave."""
    choice = '[{"type": "alt", "id": "c", "branches": [{"title": "x", "terminal": true, "steps": [{"type": "step", "id": "i"}]}, {"title": "y", "steps": []}]}]'
    flows, made = counted(trees(spark, "x", choice, choice))
    answers = spark.createDataFrame([("f0", "ok")], "flow_id string, label string")
    got = flow_trees.replies_at_exits(flow_nodes(flows), answers).orderBy("exit").collect()
    assert [tuple(r) for r in got] == [("f0", "ok", "c", 0, 2, 1), ("f0", "ok", None, None, 2, 2)]
    assert made.value == 2
    mine, of_mine = counted(trees(spark, "x", '[{"type": "step", "id": "a"}]', '[{"type": "step", "id": "a"}]'))
    seen = '[{"type": "step", "id": "a"}, {"type": "alt", "id": "p", "branches": [{"title": "1", "seen": {"traces": 1}, "steps": [{"type": "step", "id": "q"%s}]}]}]'
    theirs, of_theirs = counted(trees(spark, "y", seen % ', "seen": {"traces": 1}', seen % ""))
    nodes, refused = flow_trees.overlay(flow_nodes(mine), flow_nodes(theirs))
    assert [tuple(r) for r in nodes.orderBy("ord").select("flow_id", "node_id").collect()] == [("f0", "a"), ("f0", "p"), ("f0", "q")]
    assert [r.flow_id for r in refused.collect()] == ["f1"]
    assert (of_mine.value, of_theirs.value) == (2, 2)


def test_composition_reads_flows_once(spark):
    """a chain of five flows, each leading on to the next."""
    flows = spark.range(5).selectExpr("concat('f', id) as id", "concat('f', id) as slug", "'o' as owner", "concat('fn', id) as entrypoint", "'' as summary", "cast(null as array<string>) as includes", "cast(null as struct<kind: string>) as trigger")
    told, made = counted(trees(spark, "x", *[ONE % (i + 1) for i in range(5)]))
    _, nodes, _ = compose.composed(flows, flow_nodes(told), spark.createDataFrame([], "ref string, response string"))
    assert nodes.where("flow_id = 'f0'").count() == 5
    assert made.value == 5


def test_closure_broadcasts_nothing(spark, monkeypatch):
    """each step's rows stay on the executors."""
    plans, write = [], graph.checkpoint

    def told(df):
        out = write(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "checkpoint", told)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long")
    found = graph.lineage_chain(edges, "source", "target", 1)
    assert sorted(tuple(r) for r in found.collect()) == [(2, "downstream", 1), (2, "upstream", 2), (3, "downstream", 2), (3, "upstream", 1)]
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_counts_of_users_move_no_ways(spark):
    """the ways of nested types stay behind where only depths are asked for."""
    sites = spark.createDataFrame([("o", s, "", "", "p", "", t) for s, t in [("1", "a"), ("2", "a"), ("2", "b")]], ", ".join(f"{c} string" for c in reference_sites.SITE))
    nesting = spark.createDataFrame([("p", "", "a", "f", "p", "", "c"), ("p", "", "b", "g", "p", "", "c")], "kind string, module string, target string, field string, in_kind string, in_module string, in_target string")
    found = reference_sites.users_of(reference_sites.closed(sites, reference_sites.nested(nesting, list(reference_sites.TYPE))), "p")
    assert sorted(tuple(r) for r in found.collect()) == [("", "a", 2, 2, "1"), ("", "b", 1, 1, "2"), ("", "c", 2, 0, "1")]
    steps = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("way" in x for x in steps if "Aggregate [" in x or "Join " in x or "Union" in x)


def test_commits_are_counted_without_a_table_of_them(spark):
    """no hash table holds commits; one of two logs, or with a path twice, counts once."""
    rows = [("x", "a1", "2024-01-01", "AB-1 AB-1", "p"), ("x", "a1", "2024-01-01", "AB-1 AB-1", "p"), ("y", "a1", "2024-01-03", "AB-1", "p"), ("x", "b2", "2024-01-02", "AB-1, AB-2", "p"), ("x", "b2", "2024-01-02", "AB-1, AB-2", "q"), ("x", None, "2024-01-04", "AB-2", "q"), ("x", "c3", None, "none", "q")]
    log = spark.createDataFrame(rows, "log string, commit string, date string, subject string, path string")
    found = owners.work_items(log, ["AB"])
    assert sorted(tuple(r) for r in found.collect()) == [("AB-1", "p", 2, "2024-01-03"), ("AB-1", "q", 1, "2024-01-02"), ("AB-2", "p", 1, "2024-01-02"), ("AB-2", "q", 1, "2024-01-04")]
    steps = found.select("key", "path", "commits")._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("commit#" in x.split("functions=")[0] for x in steps if "HashAggregate(keys=" in x)


def test_accesses_are_not_made_distinct(spark):
    """alike rows are one access, a null is an identity like others, and no hash table holds identities."""
    rows = [("a", "r.get", "read", "k", 1), ("a", "r.get", "read", "k", 1), ("b", "r.get", "read", "k", 1), ("b", "r.get", "read", "k", 2), ("c", "r.get", "read", "k", None), ("c", "r.get", "read", "k", None), ("d", "r.get", "read", "k", None), ("d", "r.get", "read", "k", 1), ("e", "r.get", "read", "k", 1), ("e", "s/get", "read", "k", 1), ("f", "r.get", None, "k", 1)]
    accesses = spark.createDataFrame(rows, "store string, method string, operation string, keyspace string, id long")
    steps = spark.createDataFrame([(x, "S.get") for x in "abcdefg"], "store string, method string")
    found = estate.resolve_accesses(steps, accesses, "id")
    assert sorted((r.store, r.operation, r.keyspace) for r in found.collect()) == [("a", "read", "k"), ("b", None, None), ("c", "read", "k"), ("d", None, None), ("e", None, None), ("f", None, "k"), ("g", None, None)]
    whole = estate.resolve_accesses(steps, accesses.where("id = 1").drop("id"))
    assert sorted(r.store for r in whole.where("keyspace is not null").collect()) == ["b", "d", "f"]
    lines = usage_queries.enrich_store_accesses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    held = [x.split("functions=")[0] for x in lines if "Aggregate(keys=" in x]
    assert held and not any("l_partkey" in x for x in held)


def test_spans_are_read_once(spark):
    """a trace of five levels is walked without working out its spans for each, and receipts below one another open executions of their own."""
    none = [(f"s{i}", f"s{i - 1}" if i else None, i, None if i == 0 else f"k{i}", i in (2, 3)) for i in range(5)] + [("x", "s0", 9, "kx", False)]
    spans = spark.createDataFrame([("t", *r) for r in none], "trace_id string, span_id string, parent_id string, start long, key string, consume boolean")
    told, made = counted(spans.selectExpr("*", "key as opening", "false as entry", "false as call"))
    flows = spark.createDataFrame([("k2", "f"), ("k3", "g")], "opening string, flow_id string")
    got = verify.held_against(told, flows, spark.createDataFrame([("f", "k3", "s", 1)], "flow_id string, key string, step_id string, ord long"))
    assert [tuple(r) for r in got["observed"].collect()] == [("k1", ["k1", "k2", "kx"], 1)]
    assert sorted(tuple(r) for r in got["flows"].collect()) == [("f", 1), ("g", 1)]
    assert [tuple(r) for r in got["steps"].collect()] == [("f", "s", "k3", 1)]
    assert made.value == 6


def dealt(df):
    """How many tasks gave out rows of ``df``, and how many rows it has."""
    tasks = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    return len(tasks), sum(r["count"] for r in tasks)


def test_pairs_of_a_key_go_to_many_tasks(spark):
    """a key's pairs are dealt to blocks; keys of one row, without partner and null stay as they are, alike rows are kept."""
    left = spark.range(300).selectExpr("if(id < 200, 1, id) as k", "if(id < 100, 0, id) as a").unionByName(spark.createDataFrame([(None, 7)], "k int, a long"))
    right = spark.range(150).selectExpr("if(id < 100, 1, id + 100) as k", "id % 50 as b")
    found = blocks.join_in_blocks(left, right, ["k"], side=16)
    assert sorted(map(tuple, found.select("k", "a", "b").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert dealt(found)[0] == 4
    assert blocks.join_in_blocks(left.limit(0), right, ["k"]).count() == 0


def test_decisions_of_many_services_are_not_grouped(spark):
    """the pairs of a context are told once without a table of them, by whatever ways a record and a service meet."""
    services = spark.createDataFrame([(i, "a") for i in range(1, 41)] + [(41, "a"), (41, "b"), (42, "b"), (42, "b"), (43, None), (44, "c")], "service long, context string")
    rows = [(1, "context", "a", None, [3, 41, 99]), (1, "context", "b", None, None), (2, "service", "a", 5, [5]), (2, "context", "a", None, None), (3, "org", "a", 7, [7]), (4, None, None, None, [43, 43]), (5, "service", None, 99, None), (None, "context", "a", None, [2]), (6, "context", "z", None, None)]
    records = spark.createDataFrame(rows, "id long, kind string, context string, service long, services array<long>").selectExpr("id", "struct(kind, context, service) as scope", "struct(services) as relates")
    found = usages.concerning(records, services)
    want = {}
    for id_, kind, context, service, names in rows:
        for s, c in services.collect() if kind != "org" else []:
            by = "name" if s in (names or []) else "scope" if (kind, service) == ("service", s) or kind == "context" and c == context else None
            if by:
                want[s, id_] = min(by, want.get((s, id_), by))
    assert sorted(((r.service, r.id, r.by) for r in found.collect()), key=str) == sorted([(*k, v) for k, v in want.items()] + [(None, 3, "org")], key=str)
    many = spark.range(2000).selectExpr("id + 10 as id", "struct('context' as kind, 'a' as context, cast(null as long) as service) as scope", "struct(cast(null as array<long>) as services) as relates")
    assert widest_shuffle(usages.concerning(many, services)) < 41 * 2000 / 4


def widest_shuffle(df):
    """The most rows that any exchange of ``df`` moved; ``df`` is run."""
    df.collect()

    def rows(node):
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        below = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("shuffleRecordsWritten")
        return max([own.get().value() if own.isDefined() else 0, *map(rows, below)])

    return rows(df._jdf.queryExecution().executedPlan())


def test_trees_are_laid_over_in_one_shuffle(spark, monkeypatch):
    """the nodes of both tellings are moved once, whatever they are held against; a node without an id meets none."""
    plans, write = [], flow_trees.kept

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(flow_trees, "kept", told)
    step = '{"type": "step", "id": "%s", "to": "%s", "status": "%s"%s}'
    one, same = step % ("a", "b", "declared", ""), step % ("a", "b", "verified", ', "note": "n"')
    fresh = '{"type": "alt", "id": "p", "branches": [{"title": "1", "seen": {"traces": 2}, "steps": [%s]}]}' % (step % ("q", "c", "verified", ', "seen": {"traces": 2}'))
    mine = trees(spark, "x", *[f"[{x}]" for x in (one, one, one, '{"type": "step"}', one + ", " + step % ("z", "b", "declared", ""))])
    theirs = trees(spark, "y", *[f"[{x}]" for x in (f"{fresh}, {same}", same + ", " + step % ("k", "b", "verified", ""), step % ("a", "d", "verified", ""), '{"type": "step"}', step % ("z", "b", "declared", "") + ", " + one)])
    nodes, refused = flow_trees.overlay(flow_nodes(mine), flow_nodes(theirs))
    assert [(r.flow_id, r.ord, r.last, r.node_id, r.to, r.status, r.note, r.seen and r.seen.traces) for r in nodes.orderBy("ord").collect()] == [("f0", 1, 2, "p", None, None, None, None), ("f0", 2, 2, "q", "c", "verified", None, 2), ("f0", 3, 3, "a", "b", "verified", "n", None)]
    assert sorted(r.flow_id for r in refused.collect()) == ["f1", "f2", "f3", "f4"]
    assert plans[0].count("Exchange ") == 1


def test_fields_of_a_name_meet_its_enums_in_many_tasks(spark):
    """the pairs of a name that many fields and enums have are no single task's work; ids, alike enums and nulls count as before."""
    enums = spark.createDataFrame([(i, 1, "E") for i in range(10)] + [(10, 1, "E"), (10, 1, "E"), (11, 2, "E"), (12, None, "E")], "id long, scope int, name string")
    odd = spark.createDataFrame([("x", 11, 1, "E", "f"), ("y", None, 2, "E", "g"), ("z", 99, 1, "none", "h"), ("v", 99, None, "E", "i"), ("w", 10, 9, "E", "j")], "owner string, ref long, scope int, type string, field string")
    fields = spark.range(5000).selectExpr("concat('o', id) as owner", "-1L as ref", "1 as scope", "'E' as type", "'k' as field").unionByName(odd).coalesce(1)
    found = usages.named_links(fields, enums, ["scope"])
    rest = [tuple(r) for r in found.where("field <> 'k'").collect()]
    assert sorted(rest) == [(10, "w", "j", False), (11, "x", "f", False), (11, "y", "g", True)]
    assert found.where("field = 'k' and by_name").groupBy("id").count().where("count = if(id = 10, 10000, 5000)").count() == 11
    assert dealt(found.where("by_name"))[0] > 1


def test_problems_of_a_store_meet_its_flows_in_many_tasks(spark):
    """the pairs of a store that many problems and flows have are no single task's work."""
    problems = spark.range(60).selectExpr("'table' as over", "concat('s.t', id) as id", "'' as service").unionByName(spark.createDataFrame([("event", "e", "svc"), ("event", "known", "svc"), ("call", "c", "")], "over string, id string, service string"))
    index = spark.range(5000).selectExpr("'store' as facet", "'s' as key", "concat('f', id) as flow_id", "'a' as step_id", "id as number").unionByName(spark.createDataFrame([("lane", "svc", "g", None, None), ("ref", "c", "h", "b", 2)], "facet string, key string, flow_id string, step_id string, number long")).coalesce(1)
    found = problem_flows.flows_of_problems(problems, index, spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("known",)], "id string"))
    assert sorted(map(tuple, found.where("over <> 'table'").collect())) == [("call", "c", "", "h", "b", 2), ("event", "e", "svc", "g", None, None)]
    assert found.where("over = 'table'").distinct().count() == 300_000
    assert dealt(found.where("over = 'table'"))[0] > 1


def test_rounds_of_a_composition_carry_no_nodes(spark, monkeypatch):
    """flows of three steps in a chain of six; nodes meet the entries once, behind the last round, and are no right side that Spark holds for a key."""
    tables, write = [], compose.kept

    def told(df):
        out = write(df)
        tables.append((out.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(compose, "kept", told)
    flows = spark.range(6).selectExpr("concat('f', id) as id", "concat('f', id) as slug", "'o' as owner", "concat('fn', id) as entrypoint", "'' as summary", "if(id = 1, array('f4'), null) as includes", "named_struct('kind', 'event') as trigger")
    frame = '[{"type": "step", "id": "a", "kind": "x", "from": "a", "to": "b"}, {"type": "loop", "id": "l", "title": "t", "steps": %s}, {"type": "step", "id": "z", "kind": "x", "from": "a", "to": "b"}]'
    _, nodes, entries = compose.composed(flows, flow_nodes(trees(spark, "x", *[frame % (ONE % ((i + 1) % 6)) for i in range(6)])), spark.createDataFrame([], "ref string, response string"))
    assert sum("storeAccess" in columns for columns, _ in tables) == 4  # nodes, those with their flows, placed, and with their replies
    rounds = [plan for columns, plan in tables if "_entered" in columns]
    assert len(rounds) == 6
    got = nodes.where("flow_id = 'f4'").orderBy("ord").collect()
    assert len(got) == 24 and got[2].node_id == "s" and got[3].node_id == "continuation-f5-s-a" and got[3].path == ["loop:l:0"] and got[4].path == ["loop:l:0"] and got[4].last == 22 and got[-1].node_id == "z"
    assert got[5].path == ["loop:l:0", "loop:continuation-f5-s-l:0"] and got[5].parent_id == "continuation-f5-s-l"
    assert entries.where("flow_id = 'f4'").count() == 5


def test_users_through_nested_types_equal_those_of_all_sites(spark, monkeypatch):
    """sites of one, several and very many types over rings and shared types, with lists cut; no table of all sites with all that they use is shuffled."""
    columns = "kind string, module string, target string, field string, in_kind string, in_module string, in_target string"
    named = [("p", "", str(i), f, "p" if j else "q", "", str(j)) for i in range(1, 60) for f, j in (("a", i // 2), ("b", i // 3))] + [("p", "", "1", "back", "p", "", "4"), ("q", "", "0", "x", "q", "", "0")]
    nesting = spark.createDataFrame(named, columns)
    rows = [("o", str(s), "", None if s % 4 else "v", "p", "", str(t)) for s in range(40) for t in {(s * 7 + k * 5) % 63 for k in range(s % 6 + 1)}] + [("m", "1", x, "v", "q", "", "0") for x in "xy"] + [("m", "2", "", "v", "z", "n", "9")]
    sites = spark.createDataFrame(rows + rows[:5], ", ".join(f"{c} string" for c in reference_sites.SITE))
    whole = reference_sites.closed(sites, reference_sites.nested(nesting, list(reference_sites.TYPE)))
    for types, length in ((64, 4096), (3, 2), (1, 4096)):
        monkeypatch.setattr(reference_sites, "_TYPES", types)
        monkeypatch.setattr(reference_sites, "_LIST", length)
        for kind in "pqz":
            want = sorted(map(tuple, reference_sites.users_of(whole, kind).collect()))
            assert want and sorted(map(tuple, reference_sites.users_through(sites, nesting, kind).collect())) == want
    monkeypatch.undo()
    many = spark.range(400).selectExpr("'o' as site_kind", "cast(id as string) as site", "'' as part", "'' as service", "'p' as kind", "'' as module", "explode(array('59', '58')) as target")
    chain = spark.range(1, 59).selectExpr("'p' as kind", "'' as module", "cast(id + 1 as string) as target", "'f' as field", "'p' as in_kind", "'' as in_module", "cast(id as string) as in_target")
    assert widest_shuffle(reference_sites.users_through(many, chain, "p")) < 4000 < 400 * 59
