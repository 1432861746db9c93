"""Traces held against flows: a plain walk over span trees says the same."""

import json
import random
from collections import Counter

from atlasframe.operators.flow_trees import overlay
from atlasframe.operators.verify import held_against, intervals, recorded
from atlasframe.sources.fragments import flow_nodes
from tests.test_flow_trees import step

SPANS = "trace_id string, span_id string, parent_id string, start long, key string, opening string, entry boolean, consume boolean, call boolean"


def traces(seed, n):
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        size = rng.randrange(1, 14)
        for k in range(size):
            parent = None if k == 0 or rng.random() < 0.05 else f"t{t}s{rng.randrange(k)}"
            kind = rng.choice(["none", "rpc", "rpc", "pub", "entry", "consume", "consume", "call"])
            key = None if kind == "none" else f"{kind}{rng.randrange(4)}"
            rows.append((f"t{t}", f"t{t}s{k}", parent if rng.random() < 0.97 else "lost", rng.randrange(50), key, key if kind in ("entry", "consume") else None, kind == "entry", kind == "consume" if rng.random() < 0.95 else None, kind == "call"))
    return rows


def plain(rows, openings, declared):
    by = {(r[0], r[1]): r for r in rows}
    kids = {}
    roots = []
    for r in rows:
        if (r[0], r[2]) in by:
            kids.setdefault((r[0], r[2]), []).append(r)
        else:
            roots.append(r)

    def walk(r):
        out = [r]
        for x in sorted(kids.get((r[0], r[1]), []), key=lambda x: (x[3], x[1])):
            out += walk(x)
        return out

    def under(r, top):
        while (r[0], r[2]) in by:
            r = by[(r[0], r[2])]
            if r == top:
                return True
        return False

    flows, steps, routes, observed = Counter(), Counter(), Counter(), Counter()

    def cut(hops):
        out, top = [], None
        for i, h in enumerate(hops):
            if top is not None and under(h, top):
                continue
            top = h if i and h[7] else None
            out.append(h)
        return out

    def match(hops):
        flow = openings.get(hops[0][5])
        if flow is None:
            return False
        flows[flow] += 1
        after, anchor = {}, None
        for i, h in enumerate(hops):
            if (flow, h[4]) in declared:
                anchor = declared[(flow, h[4])]
                after.setdefault(anchor, [])
            elif anchor is not None and not h[8] and not (i and (h[6] or h[7])):
                after[anchor].append(h[4])
        for key in {h[4] for h in hops if (flow, h[4]) in declared}:
            steps[(flow, declared[(flow, key)], key)] += 1
        for a, route in after.items():
            routes[(flow, a, tuple(route))] += 1
        return True

    for r in roots:
        hops = [x for x in walk(r) if x[4] is not None]
        if not hops:
            continue
        own = cut(hops)
        if not match(own):
            observed[(own[0][5] or own[0][4], tuple(h[4] for h in own))] += 1
        for h in hops[1:]:
            if h[7]:
                match(cut([x for x in walk(h) if x[4] is not None]))
    return flows, steps, routes, observed


def test_recordings_equal_a_plain_walk(spark):
    rows = traces(4, 250)
    openings = {"entry0": "f0", "entry1": "f1", "consume0": "f2", "consume1": "f3"}
    declared = {(f, k): f"{f}-{k}" for f in ("f0", "f1", "f2", "f3") for k in ("rpc0", "rpc1", "pub2", "entry0", "consume0", "consume2") if hash((f, k)) or True}
    declared.pop(("f1", "rpc0")), declared.pop(("f2", "consume0"))
    o = [*openings.items(), ("entry2", "f0"), ("entry2", "f1")]
    d = [(f, k, s, 2) for (f, k), s in declared.items()] + [("f0", "rpc0", "earlier", 1)]
    got = held_against(spark.createDataFrame(rows, SPANS).repartition(3), spark.createDataFrame(o, "opening string, flow_id string"), spark.createDataFrame(d, "flow_id string, key string, step_id string, ord long"))
    flows, steps, routes, observed = plain(rows, openings, declared)
    assert {r.flow_id: r.traces for r in got["flows"].collect()} == flows
    assert {(r.flow_id, r.step_id, r.key): r.traces for r in got["steps"].collect()} == steps
    assert {(r.flow_id, r.anchor, tuple(r.route)): r.traces for r in got["routes"].collect()} == routes
    assert {(r.opening, tuple(r.route)): r.traces for r in got["observed"].collect()} == observed
    assert min(map(len, (flows, steps, routes, observed))) > 3


def test_intervals_tell_ancestry(spark):
    rows = traces(9, 30)
    by = {(r[0], r[1]): r for r in rows}
    found = intervals(spark.createDataFrame(rows, SPANS)).collect()
    assert len(found) == len(rows)
    for a in found:
        for b in found:
            if a.trace_id == b.trace_id:
                r, below = by[(b.trace_id, b.span_id)], False
                while (r[0], r[2]) in by and not below:
                    r = by[(r[0], r[2])]
                    below = r[1] == a.span_id
                assert below == (a.ord < b.ord <= a.last)


def test_recordings_verify_a_flow(spark):
    flow = [step("s1", to="desk", kind="rpc", ref="Api/Admit"), step("s2"), {"type": "loop", "id": "l", "title": "", "steps": [step("s3", status="unresolved")]}]
    nodes = flow_nodes(spark.createDataFrame([("f", "x", json.dumps(flow)), ("g", "x", json.dumps([step("q")]))], "id string, _src_path string, steps string"))
    spans = [("t", "1", None, 1, "entry|Admit", "Admit", True, False, False), ("t", "2", "1", 2, "rpc|b", None, False, False, False), ("t", "3", "1", 3, "new", None, False, False, False), ("u", "1", None, 1, "entry|Admit", "Admit", True, False, False)]
    got = held_against(spark.createDataFrame(spans, SPANS), spark.createDataFrame([("Admit", "f")], "opening string, flow_id string"), spark.createDataFrame([("f", "entry|Admit", "s1", 1), ("f", "rpc|b", "s3", 3)], "flow_id string, key string, step_id string, ord long"))
    laid, refused = overlay(nodes.where("flow_id = 'f'"), recorded(nodes, got["steps"]))
    assert refused.count() == 0
    assert [(r.node_id, r.status, r.seen and r.seen.traces) for r in laid.orderBy("ord").collect()] == [("s1", "verified", 2), ("s2", "declared", None), ("l", None, None), ("s3", "unresolved", 1)]
    assert {(r.anchor, tuple(r.route), r.traces) for r in got["routes"].collect()} == {("s1", (), 2), ("s3", ("new",), 1)}
