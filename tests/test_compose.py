"""Composed executions against a plain recursion over the trees."""

import json
import random

import pytest

from atlasframe.operators.compose import composed, doors
from atlasframe.operators.flow_trees import nested
from atlasframe.sources.fragments import flow_nodes
from tests.test_flow_trees import lists, step, steps, tree

FLOWS = "id string, slug string, owner string, entrypoint string, summary string, includes array<string>, trigger struct<kind: string>, _src_path string, steps string"


def key(h):
    return (h["kind"], h["transport"], h["channel"], h.get("message") or "")


def plain(flows, answers):
    """(flows by id, who is consumed): a direct recursion, one flow after the other."""
    entry, handed = {}, {}
    for f in flows.values():
        if f["entrypoint"]:
            entry[f["entrypoint"]] = None if f["entrypoint"] in entry else f["id"]
        for n, x in enumerate(f["steps"]):
            if x["type"] == "step" and x.get("handoff", {}).get("direction") == "receive":
                k = key(x["handoff"])
                handed[k] = None if k in handed else (f["id"], n)
    consumed = set()

    def next_of(flow, x):
        found = {}
        for e in [*filter(None, [x.get("continuesAt")]), *x.get("reaches", [])]:
            to = entry.get(e)
            if to and flows[to]["owner"] == flow["owner"]:
                found[to] = (0, True)
        h = x.get("handoff")
        if h and h["direction"] == "send":
            to = handed[key(h)] if key(h) in handed else handed.get((*key(h)[:3], "")) if h.get("message") else None
            if to and to[0] not in found:
                found[to[0]] = (to[1], False)
        return found

    def prefixed(nodes, p):
        out = []
        for x in nodes:
            x = x | {"id": f"{p}-{x['id']}"} | ({"replyTo": f"{p}-{x['replyTo']}"} if x.get("replyTo") else {})
            if x["type"] == "loop":
                x["steps"] = prefixed(x["steps"], p)
            elif x["type"] == "alt":
                x["branches"] = [b | {"steps": prefixed(b["steps"], p)} for b in x["branches"]]
            elif x["type"] == "parallel":
                x["branches"] = [prefixed(b, p) for b in x["branches"]]
            out.append(x)
        return out

    def replies(nodes, reply):
        n = [0]

        def make():
            n[0] += 1
            return reply if n[0] == 1 else reply | {"id": f"{reply['id']}-exit-{n[0]}"}

        def visit(items, at_end):
            falls, out = True, []
            for x in items:
                x = dict(x)
                if x["type"] == "loop":
                    x["steps"] = visit(x["steps"], False)
                elif x["type"] == "parallel":
                    x["branches"] = [visit(b, False) for b in x["branches"]]
                elif x["type"] == "alt":
                    x["branches"] = [b | {"steps": visit(b["steps"], bool(b.get("terminal")))} for b in x["branches"]]
                    falls &= not all(b.get("terminal") for b in x["branches"])
                out.append(x)
            if at_end and falls:
                out.append(make())
            return out

        return visit(nodes, True)

    def reply_to(x, label, what):
        return {"type": "step", "id": f"response-{x['id']}", "from": x["to"], "to": x["from"], "kind": "response", "label": label, "status": x["status"], "note": f"Synthesized from the proven synchronous {what}.", "replyTo": x["id"]}

    def replied(nodes, ident):
        return any(x["kind"] == "response" and x.get("replyTo") == ident for n in nodes for x in steps(n))

    def grow(flow, nodes, way, whole):
        out = []
        for x in nodes:
            x = dict(x)
            if x["type"] == "step":
                out.append(x)
                more, at_once = [], False
                for to, (start, sync) in next_of(flow, x).items():
                    g = flows[to]
                    if g["slug"] in way or g["slug"] in (flow["includes"] or []):
                        continue
                    more += prefixed(grow(g, g["steps"][start:], [*way, g["slug"]], g["steps"]), f"continuation-{g['slug']}-{x['id']}")
                    at_once |= sync
                    if g["entrypoint"] and g["trigger"] in (None, "unproven"):
                        consumed.add(to)
                if at_once and x["kind"] == "rpc" and answers.get(x.get("ref")) and not replied(whole, x["id"]):
                    more = replies(more, reply_to(x, answers[x["ref"]], "unary gRPC return"))
                out += more
                continue
            if x["type"] == "loop":
                x["steps"] = grow(flow, x["steps"], way, whole)
            elif x["type"] == "alt":
                x["branches"] = [b | {"steps": grow(flow, b["steps"], way, whole)} for b in x["branches"]]
            else:
                x["branches"] = [grow(flow, b, way, whole) for b in x["branches"]]
            out.append(x)
        return out

    told = {}
    for f in flows.values():
        nodes = grow(f, f["steps"], [f["slug"]], f["steps"])
        first = next((s for n in nodes for s in steps(n)), None)
        if f["trigger"] == "http" and first and first["kind"] == "rpc" and not replied(nodes, first["id"]):
            nodes = replies(nodes, reply_to(first, answers.get(first.get("ref")) or "HTTP response", "HTTP handler return"))
        told[f["id"]] = nodes
    return {k: v for k, v in told.items() if k not in consumed}, consumed


def frame(spark, flows):
    return spark.createDataFrame([(f["id"], f["slug"], f["owner"], f["entrypoint"], "s", f["includes"], (f["trigger"],) if f["trigger"] else None, "x", json.dumps(f["steps"])) for f in flows.values()], FLOWS)


def run(spark, flows, answers=None, depth=None):
    df = frame(spark, flows)
    a = spark.createDataFrame([*(answers or {}).items()], "ref string, response string")
    out, nodes, entries = composed(df.drop("steps"), flow_nodes(df.select("id", "_src_path", "steps")), a, depth)
    return {r.flow_id: json.loads(r.steps) for r in nested(nodes).collect()}, {r.id: r for r in out.collect()}, entries.collect()


def flow(ident, nodes, entrypoint="", owner="o", trigger=None, includes=None):
    return {"id": ident, "slug": ident, "owner": owner, "entrypoint": entrypoint, "trigger": trigger, "includes": includes, "steps": nodes}


def test_composed_flows_equal_a_plain_recursion(spark):
    rng = random.Random(21)
    flows = {}
    for k in range(40):
        nodes = tree(rng, 1) or [step("only")]
        for s in [s for n in nodes for s in steps(n)]:
            s.pop("handoff", None), s.pop("reaches", None)
            if k < 34 and rng.random() < 0.35:  # mostly to later flows, so that texts stay short
                to = f"fn{rng.choice([k + 1, k + 2, k + 5, rng.randrange(40)])}"
                s |= rng.choice([{"continuesAt": to}, {"reaches": [to, "nowhere"]}, {"handoff": {"kind": "job", "transport": "t", "channel": f"c{rng.randrange(8)}", "direction": "send"} | rng.choice([{"message": "m"}, {"message": "n"}, {}])}])
            if rng.random() < 0.5:
                s |= {"kind": "rpc", "ref": rng.choice(["Api/Get", "Api/Do", "Api/Stream"])}
        if rng.random() < 0.3:
            nodes.insert(rng.randrange(len(nodes) + 1), step(f"rx{k}", handoff={"kind": "job", "transport": "t", "channel": f"c{rng.randrange(8)}", "direction": "receive"} | rng.choice([{}, {"message": "m"}])))
        if rng.random() < 0.2:
            first = next(s for n in nodes for s in steps(n))
            nodes.append(step(f"back{k}", kind="response", replyTo=first["id"]))
        flows[f"f{k}"] = flow(f"f{k}", nodes, f"fn{k if k % 9 else 0}" if rng.random() < 0.9 else "", rng.choice(["o", "o", "p"]), rng.choice([None, "http", "unproven", "event"]), rng.choice([None, [], [f"f{k + 1}"]]))
    answers = {"Api/Get": "Got", "Api/Do": "Done"}
    want, consumed = plain(flows, answers)
    got, out, _ = run(spark, flows, answers)
    assert len(consumed) > 1 and set(out) == set(flows) - consumed
    assert sum(len(json.dumps(v)) for v in want.values()) > 1.2 * sum(len(json.dumps(f["steps"])) for k, f in flows.items() if k in want)
    assert {k: got[k] for k in want if want[k]} == {k: v for k, v in want.items() if v}


def test_chains_rings_and_shut_doors(spark):
    chain = {f"f{k:02}": flow(f"f{k:02}", [step("s", continuesAt=f"fn{k + 1}")], f"fn{k}" if k else "", trigger="event") for k in range(40)}
    ring = {f"r{k}": flow(f"r{k}", [step("s", continuesAt=f"rn{(k + 1) % 3}")], f"rn{k}", trigger="event") for k in range(3)}
    twice = {"a": flow("a", [step("s", continuesAt="two")]), "b": flow("b", [step("s")], "two"), "c": flow("c", [step("s")], "two")}
    got, out, entries = run(spark, chain | ring | twice)
    count = {k: sum(1 for n in v for _ in steps(n)) for k, v in got.items()}
    assert count["f00"] == 40 and count["f39"] == 1 and {count[f"r{k}"] for k in range(3)} == {3} and count["a"] == 1
    assert out["f38"].includes == ["f39"] and out["f38"].summary.endswith("are included.") and out["a"].summary == "s"
    assert sum(e.flow_id == "f00" for e in entries) == 39
    bounded, _, _ = run(spark, chain, depth=12)
    assert sum(1 for n in bounded["f00"] for _ in steps(n)) == 13


def test_nothing_to_compose(spark):
    flows = {"a": flow("a", [step("s"), {"type": "alt", "id": "x", "branches": [{"title": "t", "steps": []}]}])}
    got, out, entries = run(spark, flows)
    assert got == {"a": flows["a"]["steps"]} and entries == [] and lists(got["a"][1]) == [[]]


@pytest.mark.parametrize("message,opened", [("m", "exact"), ("other", "wide"), (None, "wide"), ("double", None)])
def test_messages_open_one_receiver(spark, message, opened):
    h = lambda m, way: {"handoff": {"kind": "message", "transport": "k", "channel": "c", "message": m, "direction": way}}
    flows = {"send": flow("send", [step("s", **h(message, "send"))]), "exact": flow("exact", [step("e", **h("m", "receive"))]), "wide": flow("wide", [step("q"), step("w", **h(None, "receive")), step("z")])}
    flows |= {f"d{k}": flow(f"d{k}", [step("d", **h("double", "receive"))]) for k in range(2)}
    df = frame(spark, flows)
    found = doors(flow_nodes(df.select("id", "_src_path", "steps")), df).collect()
    assert [(r.next_flow, r.opens) for r in found] == ([(opened, 2 if opened == "wide" else 1)] if opened else [])
