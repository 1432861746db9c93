"""Changes between two loaded catalogs: each edit of an estate gives its change and nothing else."""

import copy
import json

from atlasframe.plans.catalog_diff import catalog_changes, diff_catalogs
from atlasframe.sources.fragments import explode_fragments, merge_tables, read_fragments


def service(i, **more):
    return {"id": f"m.{i}", "slug": i, "name": i, "repo": "", "path": "", "readme": "", "provides": [], "consumes": [], "aggregates": [], "technologies": ["go"], "owners": ["@one", "@two"]} | more


STEP = {"type": "step", "id": "s1", "from": "web", "to": "m.a", "kind": "rpc", "ref": "Api/Get", "status": "verified"}
ESTATE = {
    "generatedAt": "2024-01-02T00:00:00Z", "commit": "a",
    "contexts": [{"id": "m", "slug": "m", "name": "M", "summary": "", "services": [
        service("a", stores=["m.pg"], provides=[{"id": "Api", "source": "", "methods": [{"name": "Get", "request": "Ask", "response": "Told", "http": {"method": "GET", "path": "/x"}}, {"name": "Put", "soap": {"version": "1.1", "action": "put", "faults": ["Full"]}}]}],
                consumes=[{"id": "Far/Do", "peer": "m.b", "status": "verified", "source": "", "note": ""}], channels=[{"address": "news", "kind": "event", "protocol": "", "messages": [{"name": "Sold", "direction": "send", "encoding": "json"}]}],
                aggregates=[{"id": "m.a.x", "slug": "x", "name": "X", "root": "X", "entities": [], "valueObjects": [], "operations": [{"id": "Sell", "kind": "command"}], "lifecycle": {"states": ["new", "sold"], "transitions": [{"from": "new", "to": "sold", "on": "Sell"}]},
                             "events": [{"id": "m.a.x.Sold", "slug": "sold", "name": "Sold", "versions": [], "consumers": [{"service": "m.b", "status": "declared"}]}]}]),
        service("b", kind="worker")]}, {"id": "n", "slug": "n", "name": "N", "summary": "", "services": []}],
    "flows": [{"id": "f", "slug": "sell", "name": "", "summary": "", "owner": "m", "participants": [], "steps": [STEP, {**STEP, "id": "s2", "label": "puts"}]}],
    "stores": [{"id": "m.pg", "slug": "pg", "name": "", "kind": "postgres", "owner": "m.a", "tables": [{"id": "m.pg.t", "name": "t", "columns": []}]}],
    "modules": [{"id": "mod", "slug": "mod", "name": "", "commit": "0123456789"}], "repos": [{"repo": "git/x", "commit": "0123456789", "path": "x"}], "terms": [{"id": "t", "slug": "t", "name": "T", "context": "m", "definition": "one"}],
    "adrs": [{"id": "adr-1", "slug": "one", "number": 1, "title": "One", "status": "accepted", "body": "so"}], "rfcs": [{"id": "rfc-1", "slug": "one", "displayId": "RFC 1", "title": "One", "status": "Open", "lifecycle": "draft", "body": "so"}],
    "specs": [{"id": "sp", "slug": "sp", "title": "", "lifecycle": "draft", "requirements": [{"id": "sp/r", "title": "R", "text": "r", "scenarios": [{"name": "day", "when": ["a"], "then": ["b"]}]}], "tasks": [{"id": "1", "title": "do", "done": False}]}],
}


def loaded(spark, folder, fragment, merged=False):
    folder.mkdir()
    (folder / "x.json").write_text(json.dumps(fragment))
    t = explode_fragments(read_fragments(spark, f"{folder}/x.json"))
    return merge_tables(t)[0] if merged else t  # of one source, the tables are merged already


def test_each_edit_is_one_change(spark, tmp_path):
    after = copy.deepcopy(ESTATE)
    m, n = after["contexts"]
    a, b = m["services"]
    m["kind"], m["classification"] = "system", "core"
    n["services"].append(b)
    m["services"] = [a]
    b["kind"] = "job"
    a |= {"technologies": ["rust"], "owners": ["@one"], "stores": ["other"]}
    b["owners"] = []
    get, put = a["provides"][0]["methods"]
    get["http"]["path"], get["deprecated"], put["soap"]["faults"] = "/y", True, []
    a["consumes"][0]["status"] = "declared"
    a["channels"][0]["messages"][0]["encoding"] = "avro"
    x = a["aggregates"][0]
    x["operations"] = []
    x["lifecycle"] = {"states": ["new"], "transitions": []}
    x["events"][0]["consumers"] = []
    x["events"].append({"id": "m.a.x.Lost", "slug": "lost", "name": "Lost", "versions": [], "consumers": []})
    after["flows"][0]["steps"] = [{**STEP, "status": "declared"}]
    after["stores"][0] |= {"owner": "m.b", "tables": []}
    after["modules"][0]["commit"], after["repos"][0]["commit"], after["terms"][0]["definition"] = "9876543210", None, "two"
    after["adrs"][0]["body"] = "not so"
    after["rfcs"][0] |= {"status": "Done", "lifecycle": "accepted", "repository": "git/x"}
    after["specs"][0]["lifecycle"] = "done"
    after["specs"][0]["requirements"][0]["scenarios"][0]["then"] = ["c"]
    after["specs"][0]["requirements"].append({"id": "sp/q", "title": "Q", "text": "q", "scenarios": []})
    after["specs"][0]["tasks"][0]["done"] = True
    before, now = loaded(spark, tmp_path / "a", ESTATE), loaded(spark, tmp_path / "b", after, merged=True)
    rows = [(r["kind"], r.severity, r["where"], r.summary) for r in diff_catalogs(before, now).collect()]
    assert [r[1] for r in rows] == sorted((r[1] for r in rows), key=["breaking", "addition", "change"].index)
    assert sorted(rows) == sorted([
        ("context.kind", "change", "m", 'group "m" is a system, was bounded-context'), ("context.classification", "change", "m", 'context "m" is classified core, was nothing'),
        ("service.moved", "change", "m.b", 'service "m.b" moved from m to n'), ("service.kind", "change", "m.b", 'component "m.b" is a job, was worker'),
        ("technology.added", "change", "m.a", '"m.a" now uses rust'), ("technology.removed", "change", "m.a", '"m.a" no longer uses go'), ("service.store.added", "change", "m.a", '"m.a" touches other'), ("service.store.removed", "change", "m.a", '"m.a" no longer touches m.pg'),
        ("owner.removed", "change", "m.a", '@two no longer owns "m.a"'), ("owner.removed", "breaking", "m.b", '@one no longer owns "m.b"'), ("owner.removed", "breaking", "m.b", '@two no longer owns "m.b"'),
        ("method.signature", "breaking", "m.a", "Api/Get is now Ask → Told → GET /y, was Ask → Told → GET /x"), ("method.deprecated", "change", "m.a", "Api/Get is deprecated"),
        ("method.signature", "breaking", "m.a", "Api/Put is now ? → ? → SOAP 1.1 put ? ?, was ? → ? → SOAP 1.1 put ? ? fault:Full"),
        ("call.status", "breaking", "m.a", '"m.a" → Far/Do is declared, was verified'), ("message.encoding", "breaking", "m.a", "send message Sold on news uses avro, was json"),
        ("operation.removed", "breaking", "m.a.x", "Sell is gone"), ("state.removed", "breaking", "m.a.x", '"m.a.x" can no longer be sold'), ("transition.removed", "breaking", "m.a.x", '"m.a.x" no longer: new --Sell--> sold'),
        ("consumer.removed", "change", "m.a.x.Sold", "m.b no longer consumes m.a.x.Sold"), ("event.added", "addition", "m.a.x.Lost", "m.a.x.Lost is published, and nothing consumes it"),
        ("step.removed", "change", "f", "sell lost web → m.a puts"), ("step.status", "breaking", "f", "sell step s1 is declared, was verified"),
        ("store.owner", "breaking", "m.pg", 'store "m.pg" is owned by m.b, was m.a'), ("table.removed", "breaking", "m.pg", "m.pg.t is gone"),
        ("module.commit", "change", "mod", 'module "mod" is at 9876543, was 0123456'), ("repo.commit", "change", "git/x", "git/x moved from 0123456 to nothing"), ("term.definition", "change", "t", "t means something else now"),
        ("adr.body", "change", "adr-1", "adr-1 was edited after being accepted"), ("rfc.status", "change", "rfc-1", "RFC 1 is Done, was Open (accepted, was draft)"), ("rfc.repository", "change", "rfc-1", "RFC 1 moved from the catalog repository to git/x"),
        ("spec.lifecycle", "change", "sp", "sp is done, was draft"), ("scenario.changed", "change", "sp/r#scenario:day", "sp/r#scenario:day changed"), ("requirement.added", "addition", "sp/q", "sp/q — Q"), ("task.completed", "change", "sp#task:1", "1 was completed"),
    ])


def test_of_what_is_new_or_gone_nothing_else_is_told(spark, tmp_path):
    before = copy.deepcopy(ESTATE)
    before["contexts"][0]["services"][1]["aggregates"] = [before["contexts"][0]["services"][0]["aggregates"][0] | {"id": "m.b.y", "events": [], "operations": [], "lifecycle": None}]
    after = copy.deepcopy(before)
    a, b = after["contexts"][0]["services"]
    b["aggregates"][0]["lifecycle"] = {"states": ["on"], "transitions": []}
    after["contexts"][0]["services"] = [b]
    after["flows"], after["specs"], after["stores"] = [], [], []
    after |= {"commit": "b", "generatedAt": "2030-01-01T00:00:00Z"}  # no changes, as what is said by default isn't
    after["contexts"][0]["kind"] = "bounded-context"
    rows = {(r["kind"], r["where"]) for r in catalog_changes(loaded(spark, tmp_path / "a", before), loaded(spark, tmp_path / "b", after)).collect()}
    assert rows == {("service.removed", "m.a"), ("lifecycle.added", "m.b.y"), ("flow.removed", "f"), ("spec.removed", "sp"), ("store.removed", "m.pg")}
