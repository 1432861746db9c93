"""Fragments of a small estate: reading, merging, subject rows and built-in rules."""

import json

import pytest

from atlasframe.plans.rules import resolve_rules
from atlasframe.plans.subjects import BUILTIN, problems, subjects
from atlasframe.sources.fragments import explode_fragments, merge_tables, read_fragments

STEP = {"type": "step", "id": "s1", "from": "web", "to": "museum.desk", "kind": "rpc", "ref": "visits.Api/Admit", "status": "verified"}
A = {
    "generatedAt": "2024-01-02T00:00:00Z",
    "contexts": [{"id": "museum", "slug": "museum", "name": "Museum", "summary": "", "services": [{
        "id": "museum.desk", "slug": "desk", "name": "Visit DSK", "repo": "git/x", "path": "desk", "readme": "Takes visits.", "technologies": ["go"], "provides": [{"id": "visits.Api", "source": "a", "methods": [{"name": "Admit"}, {"name": "Cancel"}]}],
        "consumes": [{"id": "vault.Api/Stamp", "peer": "vault.core", "status": "declared", "source": "x", "note": ""}, {"id": "gone.Api/Do", "peer": "gone", "status": "unresolved", "source": "x", "note": "guess"}],
        "aggregates": [{"id": "museum.desk.visit", "slug": "visit", "name": "Visit", "root": "Visit", "entities": [], "valueObjects": [], "operations": [], "events": [
            {"id": "museum.desk.visit.Admitted", "slug": "admitted", "name": "Admitted", "wire": {"name": "museum.Admitted", "channel": "visits"}, "versions": [{"version": "1", "doc": "", "fields": []}], "consumers": [{"service": "vault.core", "status": "declared"}, {"service": "who", "status": "unresolved"}]}]}],
        "channels": [{"address": "visits", "kind": "event", "protocol": "kafka", "messages": [{"name": "museum.Admitted", "direction": "send", "encoding": "json"}]}],
        "stores": ["museum.pg"],
    }]}],
    "flows": [{"id": "f1", "slug": "admit", "name": "Admit", "summary": "", "owner": "museum", "participants": [{"id": "web", "kind": "actor", "context": None}, {"id": "museum.desk", "kind": "service", "context": "museum"}, {"id": "vault.core", "kind": "service", "context": "vault"}],
               "steps": [STEP, {"type": "alt", "id": "a1", "branches": [{"title": "ok", "steps": [{**STEP, "id": "s2", "from": "museum.desk", "to": "vault.core", "ref": None, "status": "declared"}]}, {"title": "no", "terminal": True, "steps": [{"type": "loop", "id": "l1", "title": "", "steps": [{**STEP, "id": "s3", "status": "unresolved"}]}]}]}, {**STEP, "id": "s4", "status": "declared"}]}],
    "stores": [{"id": "museum.pg", "slug": "pg", "name": "Visits", "kind": "postgres", "owner": "museum.desk", "tables": [
        {"id": "museum.pg.visits", "name": "visits", "columns": [{"name": "id", "type": "text", "nullable": False, "pk": True}, {"name": "receipt", "type": "text", "nullable": True, "fk": {"table": "vault.pg.receipts", "column": "id"}, "from": ["vault.pg.receipts.id"]}], "persists": {"aggregate": "museum.desk.visit"}},
        {"id": "museum.pg.outbox", "name": "outbox", "role": "outbox", "columns": [{"name": "id", "type": "bigint", "nullable": False}]}]}],
    "deployments": [{"id": "d1", "name": "desk-prod", "environment": "prod", "repo": "git/x", "path": "desk", "targetRevision": "v1", "revision": "1", "basis": "manifest"}, {"id": "d2", "name": "ghost", "environment": "prod", "repo": "git/y", "path": "z", "revision": "1"}],
}
B = {
    "contexts": [{"id": "museum", "slug": "museum", "name": "The museum", "summary": "Sells.", "services": [{"id": "museum.desk", "slug": "desk", "name": "", "repo": "", "path": "", "readme": "", "technologies": ["kafka", "go"], "provides": [], "consumes": [{"id": "gone.Api/Do", "peer": "gone", "status": "verified", "source": "x", "note": "seen"}], "aggregates": []}]},
                 {"id": "vault", "slug": "vault", "name": "Vault", "summary": "", "services": [{"id": "vault.core", "slug": "core", "name": "Core", "repo": "git/p", "path": "core", "readme": "", "provides": [{"id": "vault.Api", "source": "b", "methods": [{"name": "Refund"}]}], "consumes": [], "aggregates": [],
                     "channels": [{"address": "visits", "kind": "event", "protocol": "", "messages": [{"name": "museum.Admitted", "direction": "receive", "encoding": "avro"}, {"name": "museum.Lost", "direction": "receive"}, {"name": "vault.Other", "direction": "send"}]}]}]}],
    "stores": [{"id": "museum.pg", "slug": "pg", "name": "Again", "kind": "postgres", "owner": "vault.core", "tables": []}, {"id": "vault.pg", "slug": "pg", "name": "Receipts", "kind": "postgres", "owner": "vault.core", "tables": [{"id": "vault.pg.receipts", "name": "receipts", "columns": [{"name": "id", "type": "text", "nullable": False}]}],
                "views": [{"id": "vault.pg.v", "name": "v", "columns": [], "reads": ["museum.pg.visits"]}]}],
    "terms": [{"id": "t1", "slug": "desk", "name": "DSK", "context": "museum", "definition": "Visit management"}],
    "deployments": [{"id": "d1", "name": "desk-prod", "environment": "prod", "repo": "git/x", "path": "desk", "targetRevision": "v2", "revision": "2", "basis": "api"}],
}


@pytest.fixture(scope="module")
def estate(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("estate")
    (folder / "a.json").write_text(json.dumps(A))
    (folder / "b.json").write_text(json.dumps(B))
    return merge_tables(explode_fragments(read_fragments(spark, str(folder))))


def test_merge_takes_first_values_and_tells_conflicts(estate):
    t, conflicts = estate
    contexts = {r.id: r for r in t["contexts"].collect()}
    assert (contexts["museum"]["name"], contexts["museum"].summary) == ("Museum", "Sells.")
    services = {r.id: r for r in t["services"].collect()}
    assert services["museum.desk"].technologies == ["go", "kafka"] and services["museum.desk"]["name"] == "Visit DSK"
    calls = {r.id: (r.status, r.note) for r in t["calls"].collect()}
    assert calls["gone.Api/Do"] == ("verified", "guess")
    told = {(r.kind, r.where, r.message.split(" /")[0].split(" file:")[0]) for r in conflicts.collect()}
    assert ("contexts", "museum", "name is Museum, not The museum") in told and ("stores", "museum.pg", "already declared by") in told
    d = {r.id: r for r in t["deployments"].collect()}
    assert (d["d1"].basis, d["d1"].revision, d["d1"].drift.targetRevision, d["d1"].drift.path) == ("both", "2", "v1", None)


def test_flow_nodes_are_in_visit(estate):
    rows = estate[0]["flow_nodes"].orderBy("ord").collect()
    assert [(r.node_id, r.parent_id) for r in rows] == [("s1", None), ("a1", None), ("s2", "a1"), ("l1", "a1"), ("s3", "l1"), ("s4", None)]
    assert rows[4].path == ["alt:a1:1:end", "loop:l1:0"]


def test_builtin_rules(estate):
    t, conflicts = estate
    found = {(r.rule, r.subject) for r in problems(subjects(t), BUILTIN, conflicts).collect()}
    want = {
        ("consumer", "museum.desk.visit.Admitted <- who"), ("proto-missing", "vault.Api/Stamp"), ("shared-channel", "museum.desk @ visits"), ("shared-channel", "vault.core @ visits"), ("channel-unpublished", "vault.core @ visits"),
        ("subscription-unresolved", "vault.core <- visits#museum.Lost"), ("message-encoding", "vault.core <- visits#museum.Admitted"), ("cross-service-fk", "museum.pg.visits.receipt"), ("cross-service-lineage", "museum.pg.visits.receipt"),
        ("cross-service-view", "vault.pg.v"), ("outbox-payload", "museum.pg.outbox"), ("deployment-unclaimed", "d2"), ("deployment-drift", "d1"), ("service-stack-unknown", "vault.core"), ("service-undescribed", "vault.core"),
        ("flow-trigger-missing", "f1"), ("flow-summary-empty", "f1"), ("flow-step-unresolved", "f1"), ("flow-crossing-uncontracted", "f1"), ("flow-observed-coverage-low", "f1"), ("merge-conflict", "museum"), ("merge-conflict", "museum.pg"),
    }
    assert found == want


def test_copies_and_mapped_columns(spark, tmp_path):
    message = lambda *fields: [{"name": "Visit", "fields": [{"name": n, "type": t} for n, t in fields]}]
    fragment = {"contexts": [{"id": "c", "slug": "c", "name": "", "summary": "", "services": [
        {"id": "c.a", "slug": "a", "name": "", "repo": "", "path": "", "readme": "", "provides": [{"id": "Api", "source": "", "methods": [], "messages": message(("id", "string"), ("n", "int64"), ("new", "bool"))}], "consumes": [],
         "aggregates": [{"id": "c.a.visit", "slug": "visit", "name": "Visit", "root": "Visit", "entities": [{"id": "c.a.visit.visit", "slug": "visit", "name": "Visit", "doc": "", "fields": [{"name": "id", "type": "string"}, {"name": "n", "type": "int"}, {"name": "at", "type": "time.Time"}]}], "operations": [], "events": []}]},
        {"id": "c.b", "slug": "b", "name": "", "repo": "", "path": "", "readme": "", "provides": [], "copies": [{"id": "Api", "source": "x", "methods": [], "messages": message(("id", "string"), ("n", "int32"), ("old", "bool"))}], "consumes": [], "aggregates": []}]}],
        "stores": [{"id": "c.a.pg", "slug": "pg", "name": "", "kind": "postgres", "owner": "c.a", "tables": [{"id": "c.a.pg.t", "name": "t", "persists": {"aggregate": "c.a.visit"}, "columns": [
            {"name": "id", "type": "varchar(20)", "maps": "Visit.id"}, {"name": "n", "type": "bigint", "maps": "Visit.n"}, {"name": "at", "type": "text", "maps": "Visit.at"}, {"name": "gone", "type": "text", "maps": "Visit.gone.deep"}]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(fragment))
    rows = subjects(merge_tables(explode_fragments(read_fragments(spark, f"{tmp_path}/x.json")))[0])
    assert rows["copy"].first().differences == ["Visit.n is int32, published as int64", "Visit.new is missing", "Visit.old is not published"]
    rules = [r for r in BUILTIN if r.id in ("proto-drift", "persistence-drift", "column-type")]
    assert {(r.rule, r.subject) for r in problems(rows, rules).collect()} == {("proto-drift", "Api < c.b"), ("persistence-drift", "c.a.pg.t"), ("column-type", "c.a.pg.t.at")}


def test_a_rule_can_be_switched_off_with_a_reason(estate):
    rules = resolve_rules(BUILTIN, [{"id": "rpc", "severity": "error"}, {"id": "mine", "over": "service", "when": 'owners.exists(o, o == "me") || size(technologies) > 1', "message": "name"}, {"id": "deployment-drift", "disabled": True, "reason": "known"}])
    rows = problems(subjects(estate[0]), rules).collect()
    assert {r.subject for r in rows if r.rule == "mine"} == {"museum.desk"}
    assert [r.disabled for r in rows if r.rule == "deployment-drift"] == [True]
