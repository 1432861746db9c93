"""Enrichment: wire names, bare foreign keys, summaries, and edges that only flows show."""

import json

from atlasframe.plans.enrich import enrich
from atlasframe.sources.fragments import explode_fragments, merge_tables, read_fragments


def service(i, **more):
    return {"id": f"c.{i}", "slug": i, "name": "", "repo": "", "path": "", "readme": "", "provides": [], "consumes": [], "aggregates": []} | more


def test_enrich(spark, tmp_path):
    event = {"id": "c.a.x.Done", "slug": "done", "name": "Done", "wire": {"name": "c.v1.Done"}, "versions": [], "consumers": []}
    step = lambda i, a, b, kind, ref, label="", status="unresolved": {"type": "step", "id": i, "from": a, "to": b, "kind": kind, "ref": ref, "label": label, "status": status}
    fragment = {
        "contexts": [{"id": "c", "slug": "c", "name": "", "summary": "", "services": [
            service("a", provides=[{"id": "Api", "source": "", "methods": [{"name": "Go", "doc": "Goes there.\n\nAnd back."}]}], aggregates=[{"id": "c.a.x", "slug": "x", "name": "X", "root": "X", "events": [event], "operations": []}]), service("b")]}],
        "flows": [{"id": "f", "slug": "f", "name": "", "summary": "", "owner": "c", "participants": [{"id": "c.a", "kind": "service", "context": "c"}, {"id": "c.b", "kind": "service", "context": "c"}],
                   "steps": [step("s1", "c.b", "c.a", "rpc", "Api/Go", status="declared"), step("s2", "c.a", "c.b", "event", None, "c.v1.Done"), step("s3", "c.a", "c.b", "event", None, "Done"), step("s4", "c.a", "c.b", "event", None, "Other")]}],
        "stores": [{"id": "c.a.pg", "slug": "pg", "name": "", "kind": "postgres", "owner": "c.a", "tables": [{"id": "c.a.pg.t", "name": "t", "columns": [{"name": "u", "type": "text", "fk": {"table": "u", "column": "id"}}, {"name": "d", "type": "text", "fk": {"table": "d", "column": "id"}}, {"name": "z", "type": "text", "fk": {"table": "z", "column": "id"}}]}, {"id": "c.a.pg.d", "name": "d", "columns": []}]},
                   {"id": "c.b.pg", "slug": "pg", "name": "", "kind": "postgres", "owner": "c.b", "tables": [{"id": "c.b.pg.u", "name": "u", "columns": []}, {"id": "c.b.pg.d", "name": "d", "columns": []}]}],
    }
    (tmp_path / "x.json").write_text(json.dumps(fragment))
    t = enrich(merge_tables(explode_fragments(read_fragments(spark, f"{tmp_path}/x.json")))[0])
    assert {r.node_id: (r.ref, r.status) for r in t["flow_nodes"].collect()} == {"s1": ("Api/Go", "declared"), "s2": ("c.a.x.Done", "declared"), "s3": ("c.a.x.Done", "declared"), "s4": (None, "unresolved")}
    assert {r.name: r.fk.table for r in t["columns"].collect()} == {"u": "c.b.pg.u", "d": "c.a.pg.d", "z": "z"}
    assert t["flows"].first().summary == "Goes there."
    assert [(r.service, r.id, r.peer, r.note) for r in t["calls"].collect()] == [("c.b", "Api/Go", "c.a", "seen in f at s1")]
    assert [(r.event, r.consumer, r.note) for r in t["consumers"].collect()] == [("c.a.x.Done", "c.b", "seen in f at s2")]
