"""Embedding links against brute force, and components against a plain union-find."""

import random

import numpy as np

from atlasframe.llm.common import connected_components
from atlasframe.llm.embeddings import link_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, own string"


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(5, 5)]
    want = roots(400, pairs)
    out = connected_components(spark.createDataFrame(pairs + pairs[:20], "a long, b long")).collect()
    assert len({r.node for r in out}) == len(out)
    assert {r.node: r.component for r in out} == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(rng, v, cos):
    w = rng.normal(size=len(v))
    w -= w @ v * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=32))
    vectors = [unit() for _ in range(1500)]
    for i in range(0, 400, 2):
        vectors.append(near(rng, vectors[i], rng.uniform(0.951, 0.999)))
    for _ in range(150):
        vectors.append(near(rng, vectors[7], 0.99))
    vectors += [vectors[3]] * 5 + [vectors[7] * 100]
    x = np.array(vectors, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= 0.95
    n = len(vectors)
    pairs = [(i, j) for i, j in zip(*np.nonzero(s)) if i < j]
    component = roots(n, pairs)
    rows = [(i, [float(c) for c in v], 1, "x", "y") for i, v in enumerate(vectors)]
    odd = [(n, None), (n + 1, [0.0] * 32), (n + 2, [float("nan")] * 32), (n + 3, [1.0, None] * 16), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [1.0, 2.0]), (n + 7, [float("inf")] * 32)]
    rows += [(*r, 1, "x", "y") for r in odd] + [rows[0], (None, [1.0] * 32, 1, "x", "y")]
    out = {r.vec_id: r for r in link_embeddings(spark.createDataFrame(rows, SCHEMA), leaf_rows=64).collect()}
    assert len(out) == n + len(odd)
    got, want = sum(out[i].n_links for i in range(n)), 2 * len(pairs)
    assert want * 0.995 <= got <= want
    assert all(out[i].n_links <= s[i].sum() - 1 for i in range(n))
    assert sum(out[i].component_id == component[i] for i in range(n)) >= n - 2
    assert all(out[i].kept == (out[i].component_id == i) for i in out)
    assert [out[n + k].n_links for k in range(8)] == [0, 0, 0, 0, 0, 1, 1, 0] and out[n + 6].component_id == n + 5
    assert link_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_leaf_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("atlasframe.llm.embeddings.BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    v = rng.normal(size=16)
    rows = [(i, [float(c) for c in v + rng.normal(size=16) * 0.01], 1, "", "") for i in range(150)]
    out = link_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(149, 0)}
