"""Fragments as the format has them, flows told by several sources, replies and nesting, against plain walks over the trees."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from atlasframe.operators import flows
from atlasframe.operators.flow_trees import nested, overlay, replies_at_exits
from atlasframe.operators.relations import links
from atlasframe.operators.usages import concerning, covers
from atlasframe.sources.fragments import explode_fragments, flow_nodes, merge_tables, read_fragments


def step(ident, **more):
    return {"type": "step", "id": ident, "from": "a", "to": "b", "kind": "call", "status": "declared"} | more


def seen(node):
    return node["type"] == "step" and "seen" in node or node["type"] == "alt" and all("seen" in b and all(map(seen_inside, b["steps"])) for b in node["branches"]) and any(True for _ in steps(node))


def seen_inside(node):
    return "seen" in node if node["type"] == "step" else node["type"] == "alt" and all("seen" in b and all(map(seen_inside, b["steps"])) for b in node["branches"])


def lists(node):
    return [node["steps"]] if node["type"] == "loop" else [b["steps"] for b in node["branches"]] if node["type"] == "alt" else node["branches"] if node["type"] == "parallel" else []


def steps(node):
    if node["type"] == "step":
        yield node
    for items in lists(node):
        for x in items:
            yield from steps(x)


def plain_overlay(mine, theirs):
    """None if they disagree."""
    out, left = [], list(mine)
    for b in theirs:
        a = left[0] if left else None
        if (a is None or a["id"] != b["id"]) and seen(b):
            out.append(b)
            continue
        if a is None or a["id"] != b["id"] or a["type"] != b["type"]:
            return None
        left.pop(0)
        if a["type"] == "step":
            if any((a.get(k) or "") != (b.get(k) or "") for k in ("from", "to", "kind", "ref")):
                return None
            new = dict(a) | ({"seen": b["seen"]} if "seen" in b else {})
            if b["status"] == "verified" and a["status"] == "declared":
                new["status"] = "verified"
                if not a.get("note") and b.get("note"):
                    new["note"] = b["note"]
            out.append(new)
            continue
        if a["type"] == "loop" and a.get("title") != b.get("title") or len(lists(a)) != len(lists(b)) or a["type"] == "alt" and [x["title"] for x in a["branches"]] != [x["title"] for x in b["branches"]]:
            return None
        inner = [plain_overlay(x, y) for x, y in zip(lists(a), lists(b))]
        if None in inner:
            return None
        new = dict(a)
        if a["type"] == "loop":
            new["steps"] = inner[0]
        elif a["type"] == "alt":
            new["branches"] = [x | {"steps": y} for x, y in zip(a["branches"], inner)]
        else:
            new["branches"] = inner
        out.append(new)
    return out if not left else None


def tree(rng, depth=0, ids=None):
    ids = ids if ids is not None else iter(range(10_000))
    out = []
    for _ in range(rng.randrange(0 if depth else 1, 4)):
        kind = rng.choice(["step"] * 3 + (["alt", "loop", "parallel"] if depth < 3 else []))
        ident = f"n{next(ids)}"
        if kind == "step":
            out.append(step(ident, to=rng.choice("bcd"), status=rng.choice(["declared", "unresolved", "declared"]), **rng.choice([{}, {"note": "said"}, {"ref": "x/Y", "line": "f.go:1", "http": {"status": 200}}, {"handoff": {"kind": "job", "transport": "t", "channel": "c", "direction": "send"}, "reaches": ["r"]}])))
        elif kind == "loop":
            out.append({"type": "loop", "id": ident, "title": rng.choice(["", "each \"x\""]), "steps": tree(rng, depth + 1, ids)})
        elif kind == "alt":
            out.append({"type": "alt", "id": ident, "branches": [{"title": f"b{k}", "steps": tree(rng, depth + 1, ids)} | ({"terminal": True} if rng.random() < 0.4 else {}) for k in range(rng.randrange(1, 4))]})
        else:
            out.append({"type": "parallel", "id": ident, "branches": [tree(rng, depth + 1, ids) for _ in range(rng.randrange(1, 3))]})
    return out


def recording(rng, nodes, spoil, count):
    """A tree as a recording tells it: steps verified and seen, seen steps and partings put in, now and then something spoiled."""
    out = []
    for node in copy.deepcopy(nodes):
        if rng.random() < spoil:
            change = rng.choice(["drop", "to", "id", "kind", "unseen"])
            if change == "drop":
                continue
            if change == "unseen":
                out.append(step(f"u{next(count)}"))
            elif change == "id":
                node["id"] += "x"
            elif node["type"] == "step":
                node["to" if change == "to" else "ref"] = "other"
            else:
                node["title"] = "other"
                if node["type"] == "alt":
                    node["branches"] = node["branches"][:-1]
        if node["type"] == "step":
            node["status"] = rng.choice(["verified", "declared"])
            node |= rng.choice([{}, {"seen": {"traces": 3}}]) | rng.choice([{}, {"note": "seen"}])
        for k, items in enumerate(lists(node)):
            new = recording(rng, items, spoil, count)
            if node["type"] == "loop":
                node["steps"] = new
            elif node["type"] == "alt":
                node["branches"][k]["steps"] = new
            else:
                node["branches"][k] = new
        out.append(node)
        if rng.random() < 0.25:
            out.append(step(f"x{next(count)}", status="verified", seen={"traces": 1}))
        if rng.random() < 0.12:
            inner = [step(f"y{next(count)}", seen={"traces": 2})] if rng.random() < 0.7 else []
            out.append({"type": "alt", "id": f"z{next(count)}", "branches": [{"title": "1", "seen": {"traces": 1}, "steps": inner}, {"title": "2", "seen": {"traces": 4}, "steps": []}]})
    return out


def frame(spark, flows):
    return flow_nodes(spark.createDataFrame([(k, "s", json.dumps(v)) for k, v in flows.items()], "id string, _src_path string, steps string"))


def plain_replies(nodes):
    """(parent, branch) of each reply in the order of a walk."""
    out = []

    def visit(items, at, replies):
        falls = True
        for node in items:
            for k, inner in enumerate(lists(node)):
                visit(inner, (node["id"], k), node["type"] == "alt" and bool(node["branches"][k].get("terminal")))
            if node["type"] == "alt" and node["branches"] and all(b.get("terminal") for b in node["branches"]):
                falls = False
        if replies and falls:
            out.append(at)

    visit(nodes, (None, None), True)
    return out


def test_overlay_equals_a_plain_walk(spark):
    rng, count = random.Random(6), iter(range(10_000))
    mine = {f"f{k}": tree(rng) for k in range(150)}
    theirs = {k: recording(rng, v, rng.choice([0, 0, 0.05]), count) for k, v in mine.items()}
    want = {k: plain_overlay(mine[k], theirs[k]) for k in mine}
    laid, refused = overlay(frame(spark, mine), frame(spark, theirs))
    got = {r.flow_id: json.loads(r.steps) for r in nested(laid).collect()}
    assert {r.flow_id for r in refused.collect()} == {k for k, v in want.items() if v is None}
    assert 20 < len(got) < 140
    assert got == {k: v for k, v in want.items() if v}


def test_nesting_gives_the_trees_back(spark):
    rng = random.Random(9)
    flows = {f"f{k}": tree(rng) for k in range(80)} | {"none": []}
    nodes = frame(spark, flows)
    assert {r.flow_id: json.loads(r.steps) for r in nested(nodes).collect()} == {k: v for k, v in flows.items() if v}
    for r in nodes.where("type <> 'step'").collect():
        assert r.last >= r.ord
    assert nested(frame(spark, {"none": []})).count() == 0


def test_replies_equal_a_plain_walk(spark):
    rng = random.Random(12)
    flows = {f"f{k}": tree(rng) for k in range(120)} | {"none": []}
    answers = spark.createDataFrame([(k, "ok") for k in flows], "flow_id string, label string")
    got = {}
    for r in replies_at_exits(frame(spark, flows), answers).orderBy("flow_id", "exit").collect():
        got.setdefault(r.flow_id, []).append((r.parent_id, r.branch))
    assert got == {k: found for k, v in flows.items() if (found := plain_replies(v))}


SERVICE = {"id": "c.s", "slug": "s", "name": "S", "repo": "", "path": "", "readme": "", "provides": [], "consumes": [], "aggregates": []}
RECORD = {"slug": "x", "number": 1, "title": "T", "status": "accepted", "date": "2024-01-01", "body": "", "source": "adr/1.md"}
FULL = {
    "generatedAt": "2024-01-01T00:00:00Z", "commit": "abc", "defs": {"Money": {"fields": [{"name": "units", "type": "int64", "doc": "", "number": 1, "required": True, "rules": [{"name": "min", "value": "0"}]}]}},
    "contexts": [{"id": "c", "slug": "c", "name": "C", "summary": "", "services": [
        SERVICE | {
            "provides": [{"id": "Api", "source": "p", "methods": [{"name": "Get", "requestRef": "In", "responseRef": "Out", "http": {"method": "GET", "path": "/x", "methodBasis": "inferred", "methodEvidence": {"rule": "r", "source": "s"}}, "soap": {"action": "a", "version": "1.2", "faults": ["F"]}}], "enums": [{"name": "E", "values": [{"name": "A", "number": 0}]}]}],
            "consumes": [{"id": "http-client/GET /y", "peer": "", "status": "unresolved", "source": "s", "destination": {"callSite": "x", "endpointExpression": "e", "method": "GET", "baseURL": {"expression": "b", "kind": "literal", "value": "http://h", "source": "s"}}, "via": {"flow": "f", "step": "s"}}],
            "aggregates": [{"id": "c.s.a", "slug": "a", "name": "A", "readme": "", "root": "A", "entities": [], "valueObjects": [], "events": [], "operations": [{"id": "op", "kind": "command", "fields": [{"name": "n", "type": "int", "doc": "", "rules": [{"name": "max", "value": "3"}]}]}], "enums": [{"id": "c.s.a.E", "slug": "e", "name": "E", "doc": "", "values": [{"name": "ONE", "doc": ""}]}]}],
            "gatewayExposures": [{"id": "g", "hostnames": ["h"], "routeKind": "HTTPRoute", "routeNamespace": "n", "routeName": "r", "gatewayNamespace": "n", "gatewayName": "g", "listener": "l", "protocol": "HTTPS", "port": 443, "backendNamespace": "n", "backendName": "b", "basis": "manifest"}],
            "commands": [{"runner": "make", "name": "t", "run": "make t"}],
        },
        SERVICE | {"id": "c.t", "slug": "t"},
    ]}, {"id": "d", "slug": "d", "name": "D", "summary": "", "services": [SERVICE | {"id": "d.u", "slug": "u"}]}],
    "flows": [{"id": "f", "slug": "f", "name": "F", "summary": "", "owner": "c.s", "trigger": {"kind": "http", "confidence": "high"}, "participants": [{"id": "a", "kind": "actor", "context": None}, {"id": "b", "kind": "store", "context": "c", "entityRef": "c.s.pg"}], "steps": [step("s1"), step("s2", ref="Api/Get")], "examples": [{"id": "e1", "recording": "r", "traceId": "t", "durationMs": 1.5, "steps": [{"step": "s1", "durationMs": 1}]}]}],
    "adrs": [RECORD | {"id": "1", "scope": {"kind": "org"}, "relates": {}}, RECORD | {"id": "2", "scope": {"kind": "context", "context": "c"}, "relates": {"services": ["d.u"], "events": ["e"], "flows": ["f"]}, "supersedes": ["1"]}, RECORD | {"id": "3", "scope": {"kind": "service", "service": "c.t"}, "relates": {}}],
    "rfcs": [{"id": "r", "slug": "r", "displayId": "RFC-1", "title": "R", "status": "open", "lifecycle": "draft", "scope": {"kind": "org"}, "body": "", "sourceKind": "file", "source": "x", "relates": {"services": ["c.s"]}, "links": [{"kind": "adr", "id": "1", "relation": "related"}]}],
    "stores": [{"id": "c.s.kv", "slug": "kv", "name": "KV", "kind": "redis", "owner": "c.s", "tables": [], "keyspaces": [{"pattern": "cart:*", "operations": ["read"], "persists": {"aggregate": "c.s.a"}, "accesses": [{"operation": "read", "method": "Get", "ttl": "1h"}]}]}],
    "deployments": [{"id": "d", "name": "d", "project": "p", "environment": "prod", "cluster": "k", "namespace": "n", "repo": "r", "path": "", "targetRevision": "main", "revision": "1", "tool": "t", "url": "", "basis": "both", "drift": {"project": "q", "images": ["i"]}}],
    "workItems": [{"id": "w", "tracker": "t", "provider": "p", "key": "K-1", "url": "https://t/1"}], "workItemLinks": [{"workItem": "w", "target": {"kind": "step", "id": "s1", "flow": "f"}, "basis": "declared", "commits": [{"repository": "r", "sha": "1", "subject": "s", "author": "a", "date": "d", "paths": ["p"]}]}],
    "annotations": [{"version": 1, "catalog": "c", "target": {"kind": "service", "id": "c.s"}, "properties": {"tier": {"label": "Tier", "type": "number", "value": 1}}, "order": ["tier"], "source": "x", "basis": "declared"}],
    "externals": [{"id": "x", "slug": "x", "name": "X", "summary": "", "provides": []}], "specs": [{"id": "s", "slug": "s", "title": "S", "format": "kiro", "lifecycle": "draft", "source": "x", "artifacts": [{"kind": "design", "path": "p", "body": ""}], "requirements": [], "tasks": []}],
    "modules": [{"id": "m", "slug": "m", "name": "M", "packages": ["p"], "files": ["f"], "source": "x"}], "terms": [{"id": "t", "slug": "t", "context": "c", "name": "T", "definition": "d", "source": "x"}], "repos": [{"repo": "r", "commit": "1"}],
    "configurationBindings": [{"service": "c.s", "environment": "prod", "variable": "V", "value": "v", "source": "x"}],
}


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("full")
    seen_flow = copy.deepcopy(FULL["flows"][0])
    seen_flow["participants"].append({"id": "c", "kind": "broker", "context": None})
    seen_flow["steps"] = [step("s1", status="verified", note="seen", seen={"traces": 2}), step("new", to="c", seen={"traces": 1}), step("s2", ref="Api/Get")]
    seen_flow["examples"] = [FULL["flows"][0]["examples"][0], {"id": "e2", "recording": "r", "traceId": "u", "durationMs": 2, "steps": []}]
    other = copy.deepcopy(FULL["flows"][0]) | {"steps": [step("s1", to="zzz"), step("s2", ref="Api/Get")]}
    lanes = copy.deepcopy(FULL["flows"][0])
    lanes["participants"].reverse()
    for name, fragment in (("a", FULL), ("b", {"flows": [other]}), ("c", {"flows": [seen_flow]}), ("d", {"flows": [lanes]})):
        (folder / f"{name}.json").write_text(json.dumps(fragment))
    return merge_tables(explode_fragments(read_fragments(spark, str(folder))))


def test_every_collection_of_the_format_is_read(full):
    t, _ = full
    for name in ("keyspaces", "keyspace_accesses", "enums", "operation_fields", "exposures", "commands", "decision_links", "adrs", "rfcs", "annotations", "deployments", "workItemLinks", "flow_examples", "def_fields"):
        assert t[name].count(), name
    assert t["adrs"].where("id = '2'").first().scope.context == "c"
    assert t["methods"].first().http.methodBasis == "inferred" and t["deployments"].first().targetRevision == "main"
    assert t["operation_fields"].first().rules[0].value == "3"
    assert {(r.record, r.kind, r.ref) for r in t["decision_links"].collect()} == {("adr", "service", "d.u"), ("adr", "event", "e"), ("adr", "flow", "f"), ("rfc", "service", "c.s")}
    assert ("relates", "2", "f") in {(r.kind, r.source, r.target) for r in links(t).collect()}


def test_decisions_concern_services(full):
    t, _ = full
    services = t["services"].select(F.col("id").alias("service"), "context")
    got = {(r.service, r.id, r.by) for r in concerning(t["adrs"], services).collect()}
    assert got == {(None, "1", "org"), ("c.s", "2", "scope"), ("c.t", "2", "scope"), ("d.u", "2", "name"), ("c.t", "3", "scope")}
    pairs = services.crossJoin(t["adrs"].select("id", "scope", "relates")).where(covers(F.col("scope"), F.col("relates.services"), F.col("service"), F.col("context")))
    assert {(r.service, r.id) for r in pairs.collect()} == {(s, i) for s in ("c.s", "c.t", "d.u") for i, of in (("1", {"c.s", "c.t", "d.u"}), ("2", {"c.s", "c.t", "d.u"}), ("3", {"c.t"})) if s in of}


def test_later_sources_are_laid_over_a_flow(full):
    t, conflicts = full
    nodes = t["flow_nodes"].orderBy("ord").collect()
    assert [(r.node_id, r.status, r.note, r.seen and r.seen.traces) for r in nodes] == [("s1", "verified", "seen", 2), ("new", "declared", None, 1), ("s2", "declared", None, None)]
    assert [r.id for r in t["participants"].orderBy("place").collect()] == ["a", "b", "c"] and sorted(r.id for r in t["flow_examples"].collect()) == ["e1", "e2"]
    assert t["flows"].count() == 1 and conflicts.where("kind = 'flows'").count() == 2


def test_chapters_hold_no_table_of_groups(spark):
    """Chapters are read off the rows in their order; a frame without an id is no run of plain steps."""
    rows = [("f", 1, "step", [], "verified"), ("f", 2, "step", [], "declared"), ("f", 3, "step", ["alt::0"], "verified"), ("f", 4, "step", ["alt:x:0"], "unresolved"), ("f", 5, "step", ["alt:x:1"], "verified"), ("g", 7, "step", None, None)]
    df = spark.createDataFrame(rows, "flow_id string, ord long, type string, path array<string>, status string")
    found = flows.chapters(df)
    assert {tuple(r) for r in found.collect()} == {("f", 1, "steps", 1, 2, 2, 1, 1, 0), ("f", 2, "alt", 3, 3, 1, 1, 0, 0), ("f", 3, "alt", 4, 5, 2, 1, 0, 1), ("g", 1, "steps", 7, 7, 1, 0, 0, 0)}
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_steps_meet_entrypoints_and_openings_at_once(spark):
    rows = [("f", 1, "a", "step", "rpc", "x", "s"), ("f", 2, "b", "step", "rpc", "y", "t"), ("f", 3, "c", "step", "event", "z", "t"), ("g", 1, "a", "step", "rpc", "y", "t"), ("h", 1, "a", "step", "event", "z", "u"), ("i", 1, "a", "step", "other", "y", "t")]
    nodes = spark.createDataFrame([(*r, "me") for r in rows], "flow_id string, ord long, node_id string, type string, kind string, ref string, to string, from string")
    found = flows.continuations(nodes, spark.createDataFrame([("g", "x"), ("h", ""), ("f", None)], "id string, entrypoint string"))
    assert {tuple(r) for r in found.collect()} == {("f", "a", "g", "entrypoint"), ("f", "b", "g", "contract"), ("f", "c", "h", "event")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
