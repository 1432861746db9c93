"""Ways by counting against listing them all."""

import json
import random

from atlasframe.operators.ways import Ways, _count, way_counts, way_name, ways_of
from tests.test_flow_trees import step, tree


def listed(nodes, rest=()):
    """Every way as (choices, steps, ended), by a recursion that puts what follows a frame behind its insides."""
    nodes = [*nodes, *rest]
    for i, x in enumerate(nodes):
        if x["type"] == "step":
            continue
        before, after = [s["id"] for s in nodes[:i]], nodes[i + 1 :]
        if x["type"] != "alt":
            inside = x["steps"] if x["type"] == "loop" else [s for b in x["branches"] for s in b]
            return [(c, before + s, e) for c, s, e in listed(inside, after)]
        out = []
        for k, b in enumerate(x["branches"]):
            for c, s, e in listed(b["steps"], () if b.get("terminal") else after):
                out.append(([(x["id"], k), *c], before + s, e or bool(b.get("terminal"))))
        return out
    return [([], [s["id"] for s in nodes], False)]


def test_ranks_equal_a_listing(spark):
    rng = random.Random(31)
    flows, wanted = {}, []
    while len(flows) < 60:
        nodes = tree(rng)
        if Ways(nodes).total() < 400:
            flows[f"f{len(flows)}"] = nodes
    all_ = {k: listed(v) for k, v in flows.items()}
    assert max(map(len, all_.values())) > 8 and any(e for v in all_.values() for _, _, e in v)
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in flows.items()], "id string, steps string")
    assert {r.flow_id: (r.ways, r.ending) for r in way_counts(df).collect()} == {k: (str(len(v)), str(sum(e for _, _, e in v))) for k, v in all_.items()}
    for k, v in all_.items():
        wanted += [(k, str(i), None) for i in range(len(v))] + [(k, None, way_name(c)) for c, _, _ in v] + [(k, str(len(v)), None), (k, None, "nowhere:0")]
    got = [tuple(r) for r in ways_of(df, spark.createDataFrame(wanted, "flow_id string, way string, name string")).collect()]
    want = []
    for k, v in all_.items():
        want += [(k, str(i), way_name(c), s, e) for i, (c, s, e) in enumerate(v)] * 2 + [(k, str(len(v)), None, None, None), (k, None, "nowhere:0", None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_very_many_ways():
    fork = lambda k, *more: {"type": "alt", "id": f"a{k}", "branches": [{"title": "", "steps": [step(f"l{k}")]}, {"title": "", "steps": [step(f"r{k}"), *more]}]}
    ways = Ways([fork(k) for k in range(40)])
    assert ways.total() == 2**40
    choices, steps, ended = ways.at(2**40 - 2)
    assert steps == [*(f"r{k}" for k in range(39)), "l39"] and not ended and ways.rank(choices) == 2**40 - 2
    assert ways.at(2**40) is None and ways.rank(choices[:-1]) is None
    deep = Ways([{"type": "loop", "id": "l", "steps": [fork(k, fork(1000 + k)) for k in range(100)]}])
    assert deep.total() == 3**100 and deep.rank(deep.at(12345678901234567890)[0]) == 12345678901234567890


def test_no_ways(spark):
    df = spark.createDataFrame([("a", None), ("b", "[]"), ("c", '[{"type": "alt", "id": "x", "branches": []}]')], "id string, steps string")
    assert {r.flow_id: r.ways for r in way_counts(df).collect()} == {"a": "1", "b": "1", "c": "0"}
    out = ways_of(df, spark.createDataFrame([("a", "0", None), ("c", "0", None), ("b", None, ""), ("gone", "0", None)], "flow_id string, way string, name string")).collect()
    assert {(r.flow_id, r.name, None if r.steps is None else len(r.steps)) for r in out} == {("a", "", 0), ("c", None, None), ("b", "", 0)}


def test_flows_told_alike_are_counted_once():
    rng = random.Random(8)
    told = [tree(rng) for _ in range(200)]
    _count.cache_clear()
    for nodes in told * 3:
        on, end = Ways(nodes).of_list(nodes)
        assert _count(json.dumps(nodes)) == (str(on + end), str(end))
    assert _count.cache_info().misses <= 200 and _count.cache_info().maxsize == 1 << 14
