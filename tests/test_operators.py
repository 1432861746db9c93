"""Operators that SQL can't express, and odd inputs of the others."""

import random

import pytest
from pyspark.sql import functions as F

from atlasframe.operators import diff, graph, resolve, tables, traces
from atlasframe.plans import rules


def brandes(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, before, todo = {s: 0}, {s: 1.0}, {}, [s]
        for v in todo:
            for w in sorted(near[v]):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
                    before.setdefault(w, []).append(v)
        dep = dict.fromkeys(near, 0.0)
        for w in reversed(todo):
            for v in before.get(w, []):
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                total[w] += dep[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_equals_the_textbook(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(16)})
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == pytest.approx(brandes(pairs))


def test_closure_of_a_ring_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "s long, t long")
    got = {(r.root, r.node, r.depth) for r in graph.closure(edges, "s", "t").collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 1, 2), (2, 4, 2), (3, 1, 1), (3, 4, 1), (3, 2, 2)}


def test_lifecycle_columns(spark):
    states = spark.createDataFrame([(s,) for s in ("new", "paid", "sent", "lost")], "state string")
    steps = spark.createDataFrame([("new", "paid"), ("paid", "sent"), ("paid", "paid"), ("sent", "sent")], "source string, target string")
    got = {r.state: (r.column, r.terminal) for r in graph.lifecycle_columns(steps, states, "new").collect()}
    assert got == {"new": (0, False), "paid": (1, False), "sent": (2, True), "lost": (3, True)}


def test_http_calls_need_unambiguous_evidence(spark):
    routes = spark.createDataFrame([
        ("pay", "pay/Charge", "POST", "/api/v1/charges/{id}", ["pay.example"]), ("old", "old/Charge", "POST", "/legacy/charges/{id}", ["*.old.example"]), ("cat", "cat/List", "GET", "/items", []),
    ], "provider string, ref string, verb string, path string, hosts array<string>")
    calls = spark.createDataFrame([
        ("c1", "web", "POST", "/api/v1/charges/%s", None, "unresolved"), ("c2", "web", "POST", "/charges/:id?x=1", None, "unresolved"), ("c3", "web", "POST", "/charges/{n}", "a.old.example", "unresolved"),
        ("c4", "cat", "GET", "/items", None, "unresolved"), ("c5", "web", None, "items", None, "unresolved"), ("c6", "web", "GET", "/items", None, "declared"), ("c7", "web", "PUT", "/items", None, "unresolved"),
    ], "call_id string, service string, verb string, path string, host string, status string")
    got = {r.call_id: (r.ref, r.basis, r.status) for r in resolve.resolve_http_calls(calls, routes).collect()}
    assert got == {
        "c1": ("pay/Charge", "exact-route", "declared"), "c2": (None, None, "unresolved"), "c3": ("old/Charge", "host", "declared"), "c4": (None, None, "unresolved"),
        "c5": ("cat/List", "exact-route", "declared"), "c6": (None, None, "declared"), "c7": (None, None, "unresolved"),
    }


def plain_fold(routes, node=()):
    """The recursion on lists of (keys, traces, first trace): rows (node, at, part, key, traces)."""
    n = sum(w for _, w, _ in routes)
    p = 0
    while all(len(r) > p for r, _, _ in routes) and len({r[p] for r, _, _ in routes}) == 1:
        p += 1
    rows = [(node, (*node, 0, k), "start", routes[0][0][k], n) for k in range(p)]
    rest = [(r[p:], w, t) for r, w, t in routes]
    if not any(r for r, _, _ in rest):
        return rows
    s = 0
    while all(len(r) > s for r, _, _ in rest) and len({r[-1 - s] for r, _, _ in rest}) == 1:
        s += 1
    groups = {}
    for r, w, t in sorted(rest, key=lambda x: x[2]):
        middle = r[: len(r) - s]
        groups.setdefault(middle[0] if middle else None, []).append((middle, w, t))
    for k, (key, own) in enumerate(groups.items(), 1):
        rows.append(((*node, 1, k), (*node, 1, k), "branch", key or "otherwise", sum(w for _, w, _ in own)))
        rows += plain_fold(own, (*node, 1, k)) if key else []
    return rows + [(node, (*node, 2, k), "end", rest[0][0][len(rest[0][0]) - s + k], n) for k in range(s)]


def test_fold_of_routes(spark):
    rng = random.Random(4)
    shown = ["a b x c", "a b x y c", "a b z c", "a b c", "q", "a x p c", "a x q c", "a z c", "a", "c c", "c", "c c c"] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    rows = [(f"t{i:03}", k) for i, k in enumerate(shown)]
    hops = spark.createDataFrame([(t, i, k) for t, ks in rows for i, k in enumerate(ks.split())], "trace string, i long, key string")
    folded = traces.fold(traces.routes(hops, "trace", ["i"], "key"))
    by = {}
    for t, ks in rows:
        by.setdefault(tuple(ks.split()), []).append(t)
    want = {(o, *row) for o in "abcq" for row in plain_fold([(list(r), len(t), min(t)) for r, t in by.items() if r[0] == o])}
    assert {(r.opening, tuple(r.node), tuple(r.at), r.part, r.key, r.traces) for r in folded.collect()} == want
    assert {(tuple(r.route), r.traces) for r in traces.unfold(folded).collect()} == {(r, len(t)) for r, t in by.items()}
    assert traces.fold(traces.routes(hops.limit(0), "trace", ["i"], "key")).count() == 0


def test_depth_has_no_limit(spark):
    spans = spark.createDataFrame([("t", i, i - 1 if i else None, i) for i in range(90)], "trace_id string, span_id long, parent_id long, start long")
    assert {r.span_id: (r.depth, r.ord) for r in traces.sequence(spans).collect()} == {i: (i, i + 1) for i in range(90)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "s long, t long")
    seed = spark.createDataFrame([(0,)], "root long")
    assert graph.closure(chain, "s", "t", seed).agg({"depth": "max"}).first()[0] == 70
    assert graph.closure(chain, "s", "t", seed, max_depth=5).count() == 5


def test_why(spark):
    rows = [(1, "x1", 0, True, ["p", "q"]), (2, "x1", 5, False, ["p"]), (3, "", 5, True, []), (4, "y", 0, False, ["p", "p2", "q"])]
    df = spark.createDataFrame(rows, "id long, a string, n int, ok boolean, tags array<string>")
    got = lambda source: {(r.id, r.field): (r.matched, r.decisive, r["items"], r.joint) for r in rules.why(df, source, "id").collect()}
    starts = got('a.startsWith("x") && n < 3')
    assert starts[1, "a"] == (True, True, [], False) and starts[2, "n"] == (False, True, [], False) and starts[2, "a"] == (False, False, [], False)
    either = got("ok || n == 0")
    assert either[1, "ok"] == (True, False, [], True) and either[3, "ok"] == (True, True, [], False) and either[2, "ok"] == (False, True, [], False)
    lists = got('tags.exists(t, t == "q")')
    assert lists[1, "tags"] == (True, True, ["q"], False) and lists[2, "tags"] == (False, False, [], False) and lists[3, "tags"] == (False, False, [], False)
    several = got('tags.exists(t, t.startsWith("p"))')
    assert several[4, "tags"] == (True, True, ["p", "p2"], False) and several[2, "tags"] == (True, True, ["p"], False)
    assert got("size(tags) > 1")[1, "tags"] == (True, True, [], False)


def test_numbering_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.place == r.x + 1 for r in tables.numbered(df, [F.col("x")]).collect())


def test_version_order(spark):
    want = ["0.9.9.9.9.1", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-beta", "v1.0.0", "1.0.0.0.0.1", "V1.2", "1.10.0+build", "odd"]
    df = spark.createDataFrame([(v,) for v in random.Random(1).sample(want, len(want))], "v string")
    assert [r.v for r in df.orderBy(*tables.sort_keys("v", "version")).collect()] == want
    assert [r.v for r in tables.sorted_by(df, "v.desc,nope.asc,v.asc", {"v": "version"}).collect()] == [*want[-2::-1], "odd"]


ROW = "a string, n int, ok boolean, tags array<string>"


@pytest.mark.parametrize("source,want", [
    ('a == "x" && n > 2 || !ok', True), ('tags.exists(t, t.startsWith("q"))', False), ('size(tags) == 2 && "t" in tags', True), ("n / 0 == 1", False), ("(n % 2 == 1 ? n + 1 : n) == 4", True),
    ('a.matches("^x$") && string(n) == "3"', True), ("tags.filter(t, t != \"t\") + [\"z\"] == [\"u\", \"z\"]", True), ('int("7x") == 7', False),
])
def test_rule_language(spark, source, want):
    df = spark.createDataFrame([("x", 3, True, ["t", "u"])], ROW)
    assert df.select(rules.compile_expression(source, df.schema, "bool").alias("v")).first().v is want


@pytest.mark.parametrize("source", ["a > 1", "nope == 1", "a ==", "size(n) > 1", "ok ? a : n", "a == 'x' extra", "((((((((((((((((((((((((((((((((((ok))))))))))))))))))))))))))))))))))", "a.nope(a)"])
def test_rule_errors(spark, source):
    with pytest.raises(rules.RuleError):
        rules.compile_expression(source, spark.createDataFrame([], ROW).schema, "bool")


def test_rules_fail_alone_and_null_is_zero(spark):
    df = spark.createDataFrame([("1", None, None), ("2", "b", 5)], "id string, a string, n int")
    found, failures = rules.evaluate(df, "s", [rules.Rule("r", "s", 'a == "" && n == 0', '"m" + id'), rules.Rule("bad", "s", "zzz")], "id")
    assert [(r.subject, r.message) for r in found.collect()] == [("1", "m1")] and failures[0][0] == "bad"
    with pytest.raises(rules.RuleError):
        rules.resolve_rules([rules.Rule("r", "s", "true")], [{"id": "r", "disabled": True}])


def test_diff_of_equal_sides_is_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "z")], "k long, x string, y string")
    assert diff.keyed_diff(df, df, ["k"], ["x", "y"], "thing").count() == 0


def test_finished_traces_stream(spark, tmp_path):
    from atlasframe.streaming.traces import finished_traces, windowed_counts

    schema = "trace_id string, span_id string, name string, start long, end long, ts timestamp"
    row = lambda t, i, n, s: (t, i, n, s, s + 5, s)
    rows = [row("a", "1", "open", 10), row("a", "2", "close", 20), row("b", "1", "open", 15), row("z", "1", "later", 5000)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, name string, start long, end long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.where("trace_id <> 'z'").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = finished_traces(stream, "ts", "10 seconds", 60_000).writeStream.outputMode("append").format("memory").queryName("finished").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    df.where("trace_id = 'z'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    assert {(r.trace_id, r.spans, r.route) for r in spark.table("finished").collect()} == {("a", 2, "open>close"), ("b", 1, "open")}
    q = windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "name", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["name"], r.spans) for r in spark.table("windows").collect()} == {("open", 2), ("close", 1), ("later", 1)}
