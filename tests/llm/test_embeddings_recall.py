"""Recall of the forest with its own parameters: pairs just over the threshold, scattered and inside tight groups."""

import numpy as np
import pytest

from atlasframe.llm.embeddings import SAMPLE_NUMBERS, Forest


@pytest.mark.parametrize("members,cosine", [(0, 0.0), (100, 0.92), (5_000, 0.9), (20_000, 0.92)])
def test_recall(members, cosine):
    rng = np.random.default_rng(11)
    dim, n = 64, 30_000
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    if members:  # a group whose members have that mean cosine
        center = rng.normal(size=dim)
        x[:members] = center / np.linalg.norm(center) + np.sqrt(1 / cosine - 1) * x[:members]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = min(1000, members or 1000)
    w = rng.normal(size=(pairs, dim))
    w -= (w * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    cos = rng.uniform(0.95, 0.96, (pairs, 1))
    y = cos * x[:pairs] + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w, axis=1, keepdims=True)
    every = np.concatenate([x, y])
    forest = Forest(every[rng.permutation(len(every))[: SAMPLE_NUMBERS // dim]], len(every), 0.95)
    cells = forest.cells(every)
    recall = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(cells[:pairs], cells[n:])])
    assert recall >= 0.99 and np.mean([len(c) for c in cells]) < 25
