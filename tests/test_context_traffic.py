"""Traffic between contexts against counting shortest paths one by one."""

import random
from collections import Counter

from atlasframe.operators.graph import context_traffic, main_roads


def plain(edges, context):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    carried, pairs = Counter(), []
    for s in near:
        ways = {s: [[s]]}
        level = {s: [[s]]}
        while level:
            new = {}
            for v, paths in level.items():
                for w in near[v]:
                    if w not in ways:
                        new.setdefault(w, []).extend([*p, w] for p in paths)
            ways |= new
            level = new
        for t, paths in ways.items():
            if s < t:
                key = tuple(sorted((context[s], context[t])))
                pairs.append((s, t, key))
                for p in paths:
                    for v in p[1:-1]:
                        carried[(v, key)] += 1 / len(paths)
    return {(v, *key): (round(c, 6), sum(k == key and v not in (s, t) for s, t, k in pairs)) for (v, key), c in carried.items()}


def test_shares_equal_counted_paths(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(42)} | {(100, 101), (101, 102)}
    context = {n: f"c{n % 4}" for n in range(200)}
    out = context_traffic(spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame([*context.items()], "node long, context string"), roots_at_once=12)
    assert {(r.node, r.left, r.right): (round(r.carried, 6), r.total) for r in out.collect()} == plain(edges, context)
    roads = main_roads(out).collect()
    assert all(r.left != r.right and r.share > 0.5 and abs(r.share - r.carried / r.total) < 1e-9 for r in roads) and {r.place for r in roads} >= {1}


def test_no_way_between(spark):
    names = spark.createDataFrame([(1, "x"), (2, "y")], "node long, context string")
    assert context_traffic(spark.createDataFrame([(1, 2)], "a long, b long"), names).count() == 0
    assert context_traffic(spark.createDataFrame([], "a long, b long"), names).count() == 0
