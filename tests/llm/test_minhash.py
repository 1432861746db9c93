"""Near-duplicates against brute force over all pairs of sets."""

import random
import re

import pytest

from atlasframe.llm.minhash import near_duplicates
from tests.llm.test_embeddings import roots

SCHEMA = "doc_id long, text string, lang string, class string, members long"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected(texts):
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(texts), pairs)


def corpus(seed, n, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(30)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(1, 120))]
        if i % 3 == 0:
            words[rng.randrange(len(words)) :] = passage
        texts.append(words)
    for _ in range(copies):
        words = list(rng.choice(texts[: n // 4] if rng.random() < 0.7 else texts[:1]))
        for _ in range(rng.randrange(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = word()
        texts.append(words)
    rng.shuffle(texts)
    return [(" " if k % 2 else "\n\t").join(w).upper() if k % 5 == 0 else " ".join(w) for k, w in enumerate(texts)]


@pytest.mark.parametrize("short,block", [(48, 4096), (3, 40)])
def test_classes_equal_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr("atlasframe.llm.minhash.SHORT_LIST", short)
    monkeypatch.setattr("atlasframe.llm.minhash.BLOCK_ROWS", block)
    texts = [*corpus(1, 250, 250), None, "", " \t\n", "one", "One", "one two three four", "the same word " * 6000, "the same word " * 7000]
    sizes, component = expected(texts)
    rows = [(i, t, "en", "x", 0) for i, t in enumerate(texts)]
    out = near_duplicates(spark.createDataFrame([*rows, rows[0], (None, "x", "en", "x", 0)], SCHEMA).repartition(3)).collect()
    assert sorted(r.doc_id for r in out) == sorted([*range(len(texts)), 0])
    got = {r.doc_id: r for r in out}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == component
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
