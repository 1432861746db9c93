"""Links of a loaded estate: configured addresses, providers of HTTP calls, served methods, accesses of stores, lanes."""

import json

from atlasframe.operators import validate
from atlasframe.plans import links
from atlasframe.sources.fragments import explode_fragments, read_fragments


def service(i, **more):
    return {"id": f"c.{i}", "slug": i, "name": "", "repo": "", "path": "", "readme": "", "provides": [], "consumes": [], "aggregates": []} | more


def api(name, *routes):
    return [{"id": name, "source": "", "methods": [{"name": n, "http": {"method": v, "path": p} | more} for n, v, p, more in routes]}]


def call(i, **more):
    return {"id": i, "peer": "unknown:x", "status": "unresolved", "source": "", "note": ""} | more


def step(i, a, b, kind="rpc", **more):
    return {"type": "step", "id": i, "from": a, "to": b, "kind": kind, "status": "unresolved"} | more


def dest(variable, method, local, **more):
    return {"callSite": "", "endpointExpression": "", "method": method, "localPath": local, "baseURL": {"environmentVariable": variable}} | more


ESTATE = {
    "contexts": [{"id": "c", "slug": "c", "name": "", "summary": "", "services": [
        service("pay", hosts=["pay.internal", "*.pay.net"], provides=api("pay", ("Charge", "POST", "/v1/charge/{id}", {}), ("Same", "GET", "/same", {}), ("Read", "GET", "/odd", {"methodBasis": "inferred"}), ("Open", "", "/open", {}))),
        service("bill", hosts=["bill.internal"], provides=api("bill", ("Same", "GET", "/same", {}), ("Bill", "POST", "/bill", {}))),
        service("web", dials=["bill.internal"], channels=[{"address": "?", "kind": "event", "protocol": "", "addressBinding": {"environmentVariable": "TOPIC"}, "messages": [{"name": "M", "direction": "send"}]}, {"address": "two", "kind": "event", "protocol": "", "addressBinding": {"environmentVariable": "BOTH"}, "messages": []}],
                consumes=[call("http-client/POST /charge/:id"), call("http-client/GET /same"), call("http-client/GET /same @ x.pay.net"), call("http-client/GET /same @ nobody"), call("http-client/HTTP /odd"), call("http-client/GET /open"), call("http-client/POST /same"),
                          call("a", destination=dest("PAY", "get", "same")), call("b", destination=dest("SPLIT", "GET", "/same")), call("w", destination=dest("", "POST", "", fullPath="/charge/{x}")), call("v", destination=dest("", "POST", "", fullPath="/v1/charge/{x}")), call("http-client/GET /done", status="declared")]),
        service("loner", provides=api("l", ("Own", "GET", "/own", {})), consumes=[call("http-client/GET /own")])]}],
    "configurationBindings": [{"service": "c.web", "environment": e, "variable": v, "value": x} for e, v, x in [("prod", "TOPIC", "sales"), ("dev", "TOPIC", "sales"), ("prod", "BOTH", "p"), ("dev", "BOTH", "d"), ("prod", "PAY", "https://pay.internal:80/"), ("dev", "PAY", "http://pay/"), ("prod", "SPLIT", "http://pay/"), ("dev", "SPLIT", "http://bill/")]],
    "flows": [
        {"id": "f", "slug": "f", "name": "", "summary": "", "owner": "c", "trigger": {"kind": "http", "label": "HTTP · GET /same"}, "participants": [{"id": "user", "kind": "actor"}, {"id": "c.pay", "kind": "service"}, {"id": "gone", "kind": "unknown"}, {"id": "kept", "kind": "unknown"}, {"id": "c.web", "kind": "service"}, {"id": "db", "kind": "store"}, {"id": "c.pay.pg", "kind": "store"}, {"id": "s3", "kind": "store"}, {"id": "s4", "kind": "store"}],
         "steps": [step("s1", "user", "c.pay", label="handler"), {"type": "alt", "id": "x", "branches": [{"title": "", "steps": [step("s2", "c.web", "gone", ref="http-client/GET /same"), step("s3", "c.web", "kept", ref="http-client/GET /none")]}]},
                   step("s4", "c.pay", "db", kind="store", storeAccess={"store": "c.pay.redis", "method": "repo.Get"}), step("s5", "c.pay", "db", kind="store", storeAccess={"store": "c.pay.redis", "method": "Twice"}), step("s6", "c.bill", "s3", kind="store"), step("s7", "c.pay", "s4", kind="store")]},
        {"id": "g", "slug": "g", "name": "", "summary": "", "owner": "c", "trigger": {"kind": "grpc", "label": "gRPC · Charge"}, "participants": [{"id": "user", "kind": "actor"}], "steps": [step("s1", "user", "c.pay")]},
        {"id": "h", "slug": "h", "name": "", "summary": "", "owner": "c", "participants": [{"id": "user", "kind": "actor"}], "steps": [step("s1", "user", "c.pay", label="Charge")]},
        {"id": "i", "slug": "i", "name": "", "summary": "", "owner": "c", "trigger": {"kind": "grpc", "label": "Charge"}, "participants": [{"id": "c.web", "kind": "service"}], "steps": [step("s1", "c.web", "c.pay")]}],
    "stores": [{"id": "c.pay.redis", "slug": "r", "name": "", "kind": "redis", "owner": "c.pay", "tables": [], "keyspaces": [{"pattern": "k:*", "accesses": [{"method": "client.Get", "operation": "read", "source": "x"}, {"method": "Twice", "operation": "read"}]}, {"pattern": "l:*", "accesses": [{"method": "a.Twice", "operation": "write"}]}]},
               {"id": "c.pay.pg", "slug": "p", "name": "", "kind": "postgres", "owner": "c.pay", "tables": []}, {"id": "c.bill.pg", "slug": "p", "name": "", "kind": "postgres", "owner": "c.bill", "tables": []}],
}


def test_links_of_an_estate(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(ESTATE))
    t = explode_fragments(read_fragments(spark, f"{tmp_path}/x.json"))
    c = links.configured_channels(t)
    assert {(r.address, tuple(r.addresses)) for r in c["channels"].collect()} == {("sales", ("dev: sales", "prod: sales")), ("two", ("dev: d", "prod: p"))} and c["channel_messages"].first().address == "sales"

    hits = {r.id: (r.provider, r.ref, r.basis, r.inferred) for r in links.resolved_calls(t).collect()}
    assert hits == {
        "http-client/POST /charge/:id": ("c.pay", "pay/Charge", "unique-suffix", False), "http-client/GET /same": ("c.bill", "bill/Same", "kubernetes-host", False), "http-client/GET /same @ x.pay.net": ("c.pay", "pay/Same", "kubernetes-host", False),
        "http-client/HTTP /odd": ("c.pay", "pay/Read", "exact-route", True), "a": ("c.pay", "pay/Same", "deployment-config", False), "v": ("c.pay", "pay/Charge", "full-path", False),
    }
    h = links.http_calls(t)
    calls = {(r.service, r.id): (r.peer, r.status, r.destination.resolution.basis if r.destination and r.destination.resolution else None) for r in h["calls"].collect()}
    assert calls["c.web", "bill/Same"] == ("c.bill", "declared", "kubernetes-host") and calls["c.web", "b"] == ("unknown:x", "unresolved", None) and calls["c.loner", "http-client/GET /own"][1] == "unresolved"
    assert len(calls) == 11  # two became the same method, twice
    steps = {r.node_id: (r.to, r.ref, r.status) for r in h["flow_nodes"].where("flow_id = 'f'").collect()}
    assert steps["s2"] == ("c.bill", "bill/Same", "declared") and steps["s3"] == ("kept", "http-client/GET /none", "unresolved") and h["flow_nodes"].count() == t["flow_nodes"].count()
    assert [r.id for r in h["participants"].where("flow = 'f'").orderBy("place").collect()] == ["user", "c.pay", "kept", "c.web", "db", "c.pay.pg", "s3", "s4", "c.bill"]

    assert {r.flow_id: r.ref for r in links.served_methods(t).where("ord = 1").collect()} == {"f": "pay/Same", "g": "pay/Charge", "h": None, "i": None}
    access = {r.node_id: r.storeAccess for r in links.store_accesses(t).where("storeAccess is not null").collect()}
    assert (access["s4"].operation, access["s4"].keyspace, access["s4"].source) == ("read", "k:*", "x") and access["s5"].operation is None
    assert {r.id: r.entityRef for r in links.linked_lanes(t).where("kind = 'store'").collect()} == {"db": "c.pay.redis", "c.pay.pg": "c.pay.pg", "s3": "c.bill.pg", "s4": None}


def test_references_are_counted_before_they_meet_their_targets(spark):
    df, targets = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,), (None,)], "ref long"), spark.createDataFrame([(2,), (2,), (None,)], "id long")
    lost = validate.orphans(df, "ref", targets, "id", "lost")
    assert {tuple(r) for r in lost.collect()} == {("lost", "1", "2 references"), ("lost", "3", "3 references")}
    plan = lost._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Join") < plan.index("Aggregate") and "Broadcast" not in lost._jdf.queryExecution().executedPlan().toString()
