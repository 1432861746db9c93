"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from atlasframe.llm.spelling import corpus_words, deletion_keys, group_spellings

SCHEMA = "word string, doc_id long, text string, n string, key string"


def plain_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                found[low] += 1
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words, times=10):
    forms, out = {}, []
    for w, n in words.items():
        others = [(-words[x], x) for x in words if near(w, x)]
        best = min(others, default=None)
        forms[w] = best[1] if best and -best[0] >= times * n else None
        out.append((w, n, len(others)))
    rows = []
    for w, n, n_near in out:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, words.get(forms[w])))
    return sorted(rows)


def texts(seed=2):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(40)]
    weight = [rng.choice([1, 3, 40, 400]) for _ in stems]
    docs = []
    for i in range(160):
        words = []
        for w in rng.choices(stems, weight, k=rng.randrange(1, 120)):
            if rng.random() < 0.08:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])
            words.append(w.title() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", ". ", "1", "\n"]).join(words)))
    long = "ab" * 400
    docs += [(200, f"{long} {long} {long}x {long}x"), (201, f"{long[1:]} {long[1:]}"), (202, "x" * 64 + " " + "x" * 65 + " " + "x" * 66), (203, "x" * 64 + " " + "x" * 65 + " " + "x" * 66)]
    docs += [(204, f"{'q' * 5000} {'q' * 4999}r"), (205, f"{'q' * 5000} {'q' * 4999}r"), (206, None), (207, ""), (None, "nowhere elsewhere nowhere"), docs[0], docs[0]]
    return docs


@pytest.fixture(scope="module")
def docs():
    return texts()


def frame(spark, docs):
    return spark.createDataFrame([("w", i, t, "n", "k") for i, t in docs], SCHEMA).repartition(3)


def test_words_equal_a_plain_count(spark, docs):
    got = {r.word: r.n for r in corpus_words(frame(spark, docs)).collect()}
    assert got == plain_words(docs)


def test_spellings_equal_brute_force(spark, docs):
    words = plain_words(docs)
    given = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = expected(words)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, group_spellings(given).collect())) == want


def test_ties_and_chains(spark):
    words = {"aaaaaaa": 5000, "aaaaaab": 500, "aaaaabb": 50, "aaaabbb": 5, "ccccccc": 40, "ccccccd": 4, "cccccce": 4, "cccccccc": 40, "abcdefg": 2, "acbdefg": 2000, "zzzzzzz": 2}
    out = sorted(map(tuple, group_spellings(spark.createDataFrame(list(words.items()), "word string, n long")).collect()))
    assert out == expected(words)
    assert next(r for r in out if r[0] == "aaaabbb")[1:3] == ("aaaaabb", "aaaaaaa")
    assert next(r for r in out if r[0] == "ccccccd")[1] == "ccccccc"  # both neighbours have 40; this one comes first
    assert next(r for r in out if r[0] == "abcdefg")[1] is None  # two letters that change places are two replacements


def test_deletions_share_hashes_just_where_they_are_equal():
    rng = random.Random(8)
    words = ["".join(rng.choice("aé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    place, keys = deletion_keys(words)
    plain = {(i, x) for i, w in enumerate(words) for x in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))] if x or True}
    assert len(place) == len(plain)
    strings = {}
    for i, k in zip(place.tolist(), keys.tolist()):
        strings.setdefault(k, set()).add(i)
    by_string = {}
    for i, x in plain:
        by_string.setdefault(x, set()).add(i)
    assert sorted(map(sorted, strings.values())) == sorted(map(sorted, by_string.values()))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert corpus_words(empty).count() == 0 and group_spellings(corpus_words(empty)).count() == 0
    with pytest.raises(ValueError):
        group_spellings(corpus_words(empty), times=1)
