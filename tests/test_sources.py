"""Trace files, ownership files, commit logs, exports, and queries over flows and relations."""

import json

import pytest

from atlasframe.operators import flows, relations, traces
from atlasframe.sources import export, owners
from atlasframe.sources.fragments import explode_fragments, merge_tables, read_fragments
from atlasframe.sources.otlp import read_spans
from tests.test_catalog import A, B


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("estate")
    (folder / "a.json").write_text(json.dumps(A))
    (folder / "b.json").write_text(json.dumps(B))
    found = merge_tables(explode_fragments(read_fragments(spark, str(folder))))[0]
    return {k: v.cache() for k, v in found.items()}


def test_flow_queries(t):
    ways = {tuple(r.steps) for r in flows.paths(t["flow_nodes"]).collect()}
    assert ways == {("s1", "s2", "s4"), ("s1", "s3")}
    assert [(r.chapter, r.kind, r.steps) for r in flows.chapters(t["flow_nodes"]).orderBy("chapter").collect()] == [(1, "steps", 1), (2, "alt", 2), (3, "steps", 1)]
    assert {r.node_id for r in flows.with_lane_contexts(t["flow_nodes"], t["participants"]).where("crosses").collect()} == {"s2"}
    assert [(r.contexts, r.reach) for r in flows.flow_contexts(t["participants"]).collect()] == [(["museum", "vault"], 2)]
    same = flows.align(t["flow_nodes"], t["flow_nodes"].where("node_id <> 's4'"), ["from", "to", "ref", "status"]).orderBy("ord").collect()
    assert [(r.base_id, r.branch_id) for r in same] == [("s1", "s1"), ("s2", "s2"), ("s3", "s3"), ("s4", None)]


def test_event_chain(spark):
    step = lambda i, a, b, ref, path=(): ("f", i, f"s{i}", "step", a, b, "event", ref, "declared", list(path))
    nodes = spark.createDataFrame([step(1, "x", "a", "e1"), step(2, "a", "b", "e2", ["alt:q:0"]), step(3, "a", "c", "e3", ["alt:q:1:end"]), step(4, "b", "a", "e1")], "flow_id string, ord long, node_id string, type string, `from` string, `to` string, kind string, ref string, status string, path array<string>")
    publishers = spark.createDataFrame([("e1", "b"), ("e2", "a"), ("e3", "a")], "event string, service string")
    hops = flows.event_hops(nodes, publishers)
    assert {(r.event, r.service, r.published) for r in hops.collect()} == {("e1", "a", "e2"), ("e1", "a", "e3"), ("e2", "b", "e1")}
    consumers = spark.createDataFrame([("e1", "a", "declared"), ("e2", "b", "verified"), ("e3", "c", "unresolved")], "event string, consumer string, status string")
    got = {(r.level, r.event, r.consumer, r.published, r.cut) for r in flows.event_chain(hops, consumers, "e1").collect()}
    assert got == {(1, "e1", "a", "e2", None), (1, "e1", "a", "e3", None), (2, "e2", "b", "e1", "cycle"), (2, "e3", "c", None, None)}


def test_relations(t):
    back = {(r.kind, r.source) for r in relations.backlinks(t, "museum.desk.visit.Admitted").collect()}
    assert back == {("consumer", "vault.core"), ("consumer", "who"), ("event", "museum.desk")}
    issues = {(r.service, r.message, r.issue) for r in relations.messaging_claims(t).where("issue is not null").collect()}
    assert issues == {("vault.core", "museum.Lost", "no publisher")}
    assert {(r.kind, r.column) for r in relations.cross_store_references(t).collect()} == {("fk", "museum.pg.visits.receipt"), ("copy", "museum.pg.visits.receipt")}
    assert [(r.term, r.kind, r.id) for r in relations.term_bindings(t).collect()] == [("t1", "service", "museum.desk")]
    stats = {r.context: (r.services, r.events, r.unresolved) for r in relations.context_stats(t).collect()}
    assert stats == {"museum": (1, 1, 1), "vault": (1, 0, 0)}
    assert relations.declared_edges(t).count() == 0 or {r.kind for r in relations.declared_edges(t).collect()} <= {"call", "consumer"}
    assert relations.narrowed(t, ["prod"])["services"].count() == 0


def test_otlp_files(spark, tmp_path):
    span = lambda i, parent, kind, start: {"traceId": "t", "spanId": i, "parentSpanId": parent, "name": i, "kind": kind, "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + 2_000_000), "attributes": [{"key": "http.route", "value": {"stringValue": "/x"}}, {"key": "n", "value": {"intValue": "3"}}, {"key": "list", "value": {"arrayValue": {}}}]}
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "desk"}}]}, "scopeSpans": [{"spans": [span("b", "a", 3, 20), span("a", "", "SPAN_KIND_SERVER", 10), span("c", "gone", 1, 5), span("d", "b", 2, 21)]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(body, indent=1))
    spans = read_spans(spark, f"{tmp_path}/x.json")
    rows = {r.span_id: r for r in spans.collect()}
    assert (rows["a"].kind, rows["a"].parent_id, rows["a"].service, rows["a"].attributes) == (2, None, "desk", {"http.route": "/x", "n": "3"})
    assert [(r.span_id, r.depth) for r in traces.sequence(spans).orderBy("ord").collect()] == [("c", 0), ("a", 0), ("b", 1), ("d", 2)]


def test_owners(spark):
    text = "# all\n* @all\n/docs/ @writers\n*.go @gophers # code\nsrc/**/gen @none\nsrc/a* @a\n"
    rules = owners.owner_rules(spark.createDataFrame([("r", text)], "repo string, text string"), "text")
    paths = spark.createDataFrame([(p,) for p in ("docs/x/y.md", "main.go", "a/b/c.go", "src/x/y/gen/z", "src/abc", "README")], "path string")
    got = {r.path: r.owners for r in owners.owners_of(paths, "path", rules).collect()}
    assert got == {"docs/x/y.md": ["@writers"], "main.go": ["@gophers"], "a/b/c.go": ["@gophers"], "src/x/y/gen/z": ["@none"], "src/abc": ["@a"], "README": ["@all"]}
    text = "[Docs] @d\ndocs/\n[Code][2] @c\n*.py @p\n!vendor/\ndocs/x.py\n"
    rules = owners.owner_rules(spark.createDataFrame([("r", text)], "repo string, text string"), "text")
    got = {r.path: r.owners for r in owners.owners_of(spark.createDataFrame([("docs/x.py",), ("b.py",), ("vendor/c.py",)], "path string"), "path", rules, sections=True).collect()}
    assert got == {"docs/x.py": ["@c", "@d"], "b.py": ["@p"], "vendor/c.py": []}


def test_work_items(spark):
    lines = ["abcdef1|2024-01-01T00:00:00Z|ABC-1 and XYZ-9: fix", "", "src/a.go", "abcdef2|2024-02-01T00:00:00Z|ABC-1 again", "src/a.go", "b.go"]
    log = owners.parse_log(spark.createDataFrame(list(enumerate(lines)), "n long, line string"), "line", ["n"])
    assert {(r.key, r.path, r.commits) for r in owners.work_items(log, ["ABC"]).collect()} == {("ABC-1", "src/a.go", 2), ("ABC-1", "b.go", 1)}


def test_exports(spark, t, tmp_path):
    df = spark.createDataFrame([("=1+1", 'a "b", c', None), ("x|y", "l1\nl2", 3)], "a string, b string, n int")
    assert [r.line for r in export.csv_lines(df).collect()] == ["'=1+1,\"a \"\"b\"\", c\",", 'x|y,"l1\nl2",3']
    assert [r.line for r in export.markdown_lines(df).collect()][1] == "| x\\|y | l1<br>l2 | 3 |"
    export.write_csv(df, f"{tmp_path}/out")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/out").where("a = \"'=1+1\"").count() == 1
    diagram = export.sequence_diagram(t["flow_nodes"], t["participants"]).first().diagram
    assert diagram.startswith("sequenceDiagram\n  participant museum_desk") and "  web->>museum_desk: visits.Api/Admit" in diagram
    assert json.loads(export.sarif_results(spark.createDataFrame([("s", "w", "removed", "breaking", None)], "entity string, where string, kind string, severity string, field string")).first().result)["level"] == "error"
