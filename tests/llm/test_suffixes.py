"""Removal of repeated byte strings against brute force over all positions."""

import hashlib
import random

import numpy as np
import pytest

from atlasframe.llm import suffixes
from atlasframe.llm.suffixes import LENGTH, remove_repeats, sorted_groups

SCHEMA = "doc_id long, text string, lang string, slice string, data string"


def expected(rows):
    least = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, x in raw:
        for k in range(len(x) - LENGTH + 1):
            w = x[k : k + LENGTH]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, x in raw:
        cover = bytearray(len(x))
        for k in range(len(x) - LENGTH + 1):
            if least[x[k : k + LENGTH]] < i:
                cover[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(x)) if cover[k] and not (k and cover[k - 1]))
        out.append((i, len(x), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(x, cover) if not c)).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice(["", "x", passages[0]]) + text[k:]
        elif kind < 0.25:
            text = word() * rng.randrange(1, 200)
        else:
            text = " ".join(rng.choice(passages) if rng.random() < 0.02 else word() for _ in range(rng.randrange(1, 150)))
        rows.append((rng.randrange(10**6), text))
    return rows


@pytest.mark.parametrize("slice_bytes,chunk,at_once,hot", [(8 << 20, 1 << 18, 1 << 19, 1000), (4000, 1 << 18, 50, 1000), (6000, 64, 1000, 0), (5000, 1 << 18, 1000, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, slice_bytes, chunk, at_once, hot):
    monkeypatch.setattr(suffixes, "HOT_SLICES", hot)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "SORTED_AT_ONCE", at_once)
    rows = corpus(slice_bytes, 220)
    rows += [(-5, None), (-4, ""), (-3, "a" * 49), (-2, "a" * 50), (-1, "a" * 5000), (2, "b" * 120 + "\0" * 100), (3, "\0" * 90), rows[0], (rows[1][0], rows[2][1])]
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows] + [(None, "z" * 60, "en", "x", "y")], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(df).collect())
    assert got == expected(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_multikey_sort_groups_equal_rows():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    group = sorted_groups(words)
    rows = [tuple(w) for w in words.tolist()]
    for i in range(0, 500, 7):
        same = {j for j in range(500) if rows[j] == rows[i]}
        assert {j for j in range(500) if group[j] == group[i]} == same if len(same) > 1 else group[i] == -1
