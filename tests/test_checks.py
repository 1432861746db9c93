"""Integrity checks: a clean estate has none, a broken one has exactly those that were broken."""

import copy
import json

from atlasframe.plans.checks import catalog_violations
from atlasframe.sources.fragments import explode_fragments, merge_tables, read_fragments

CLEAN = {
    "contexts": [{"id": "museum", "slug": "museum", "name": "Museum", "summary": "", "kind": "system", "services": [{
        "id": "museum.desk", "slug": "desk", "name": "DSK", "repo": "", "path": "", "readme": "", "kind": "service", "stores": ["museum.desk.pg"], "provides": [{"id": "Api", "source": "", "methods": [{"name": "Admit"}]}], "consumes": [],
        "aggregates": [{"id": "museum.desk.visit", "slug": "visit", "name": "Visit", "root": "Visit", "operations": [{"id": "admit", "kind": "command", "exposedBy": ["Api/Admit"], "emits": ["e"]}], "events": [{"id": "e", "slug": "e", "name": "E", "wire": {"name": "w", "channel": "c"}, "versions": [{"version": "1", "fields": []}], "consumers": []}],
                        "lifecycle": {"states": ["a", "b"], "transitions": [{"from": "a", "to": "b", "on": "admit", "emits": "e"}]}}],
        "channels": [{"address": "c", "kind": "event", "messages": [{"name": "w", "direction": "send"}]}],
    }]}],
    "flows": [{"id": "f", "slug": "f", "name": "F", "summary": "s", "owner": "museum", "participants": [{"id": "x", "kind": "actor"}, {"id": "museum.desk", "kind": "service", "context": "museum"}], "steps": [{"type": "step", "id": "s1", "from": "x", "to": "museum.desk", "kind": "rpc", "status": "declared"}]}],
    "stores": [{"id": "museum.desk.pg", "slug": "pg", "name": "", "kind": "postgres", "owner": "museum.desk", "tables": [{"id": "museum.desk.pg.t", "name": "t", "columns": [{"name": "id", "type": "text"}, {"name": "up", "type": "text", "fk": {"table": "museum.desk.pg.t", "column": "id"}}]}], "views": [{"id": "museum.desk.pg.v", "name": "v", "columns": [{"name": "id", "type": "text", "from": ["museum.desk.pg.t.id"]}], "reads": ["museum.desk.pg.t"]}]}],
    "terms": [{"id": "t", "slug": "desk", "name": "DSK", "context": "museum", "definition": "d"}],
    "adrs": [{"id": "1", "title": "x", "status": "accepted", "date": "2024-01-01", "scope": {"kind": "context", "context": "museum"}, "relates": {}}],
    "rfcs": [{"id": "r", "displayId": "RFC-1", "title": "R", "status": "open", "lifecycle": "draft", "scope": {"kind": "org"}, "relates": {"services": ["museum.desk"], "events": ["e"], "flows": ["f"]}}],
    "specs": [{"id": "s", "title": "S", "lifecycle": "active", "requirements": [{"id": "q", "title": "Q", "text": "", "scenarios": [{"name": "n", "when": ["a"], "then": ["b"]}]}], "tasks": [{"id": "1", "title": "do", "done": False}]}],
    "repos": [{"repo": "git/x", "commit": "abc"}], "configurationBindings": [{"service": "museum.desk", "environment": "prod", "variable": "A", "value": "x"}],
    "workItems": [{"id": "w", "key": "K-1", "url": "https://t/1"}], "workItemLinks": [{"workItem": "w", "target": {"kind": "service", "id": "museum.desk"}, "basis": "declared"}],
    "defs": {"Money": {"fields": [{"name": "units", "type": "int64"}]}}, "annotations": [{"target": {"kind": "service", "id": "museum.desk"}, "properties": {"tier": "1"}, "source": "x"}],
}


def found(spark, folder, fragment):
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(fragment))
    tables = merge_tables(explode_fragments(read_fragments(spark, str(folder))))[0]
    return {(r.rule, r.subject) for r in catalog_violations(tables).collect()}


def test_clean_and_broken(spark, tmp_path):
    assert found(spark, tmp_path / "clean", CLEAN) == set()
    broken = copy.deepcopy(CLEAN)
    service = broken["contexts"][0]["services"][0]
    service |= {"kind": "robot", "dependsOn": ["gone", "museum.desk"]}
    service["aggregates"][0]["operations"][0] |= {"exposedBy": ["Api/Nope"], "emits": ["zzz"]}
    service["aggregates"][0]["events"][0]["versions"] = []
    broken["flows"][0]["steps"][0]["to"] = "nobody"
    broken["stores"][0]["tables"][0]["columns"][1]["fk"] = {"table": "museum.desk.pg.t", "column": "nope"}
    broken["stores"][0]["views"][0] |= {"reads": ["x"], "columns": [{"name": "id", "type": "text", "pk": True, "from": ["q.r"]}]}
    broken["terms"][0]["definition"] = ""
    broken["adrs"][0] |= {"date": "yesterday", "supersededBy": "9", "relates": {"services": ["nobody"]}}
    broken["rfcs"][0] |= {"displayId": "", "lifecycle": "done", "scope": {"kind": "service", "service": "mars"}}
    broken["specs"][0]["requirements"][0]["scenarios"][0]["then"] = []
    broken["specs"][0]["tasks"] += [{"id": "1", "title": "", "done": True}]
    broken["repos"][0]["commit"] = ""
    broken["configurationBindings"][0] |= {"service": "gone", "secretRef": "s"}
    broken["workItems"][0]["url"] = "t/1"
    broken["workItemLinks"] += [{"workItem": "v", "target": {"kind": "flow", "id": "zz"}, "basis": "hunch"}]
    service["aggregates"][0]["lifecycle"]["transitions"][0]["to"] = "limbo"
    broken["defs"]["Money"]["fields"] += [{"name": "units", "type": "int32"}]
    assert found(spark, tmp_path / "broken", broken) == {
        ("services-kind-unknown", "museum.desk"), ("dependency-unknown", "museum.desk"), ("dependency-on-itself", "museum.desk"), ("operation-exposed-by-unknown", "admit"), ("operation-emits-unknown", "admit"), ("event-without-version", "e"),
        ("step-to-unknown-lane", "f/s1"), ("foreign-key-column-unknown", "museum.desk.pg.t.up"), ("view-reads-unknown", "museum.desk.pg.v"), ("view-with-key", "museum.desk.pg.v.id"), ("lineage-unknown", "museum.desk.pg.v.id"),
        ("term-without-definition", "t"), ("decision-date-unreadable", "1"), ("decision-superseded-by-unknown", "1"), ("decision-relates-unknown", "1"), ("proposal-without-name", "r"), ("proposal-lifecycle-unknown", "r"), ("proposal-scope-unknown", "r"),
        ("scenario-without-steps", "q/n"), ("task-twice", "s/1"), ("task-without-title", "s/1"), ("repository-without-commit", "git/x"), ("binding-of-unknown-service", "gone|prod|A"), ("binding-of-value-and-secret", "gone|prod|A"), ("work-item-without-address", "w"),
        ("work-item-unknown", "v"), ("work-item-target-unknown", "v"), ("work-item-basis-unknown", "v"), ("transition-of-unknown-state", "museum.desk.visit"), ("definition-field-twice", "Money/units"),
    }
