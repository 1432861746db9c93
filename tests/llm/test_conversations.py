"""The prefix trie against a plain one of dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from atlasframe.llm.conversations import NOTHING, powers, prefix_trie, rebuild, running_sums, turn_mark, wrapping_sum

SCHEMA = "depth string, conv_id long, turn long, role string, text string, print string, size string"


def plain_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        rows.append((
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), kids(path), sum(kids(p) == 0 for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(98, 130), 305, 306, 1200, 10**12 + 7]:
        n = rng.choice([1, 2, 3, 5, 9])
        # few different turns, so that conversations share prefixes
        rows += [(c, k, rng.choice(["user", "assistant"]) if k > 2 else "user", rng.choice(["a", "bb", "é😀"])) for k in range(n)]
    rows += [(7, None, "user", "first of all"), (7, 0, None, None), (7, 0, None, None), (8, 3, "user", None), (9, 1, "z", "tie"), (9, 1, "b", "tie"), (None, 0, "user", "nobody's")]
    rows += [(400, k, "user", "round and round") for k in range(70)] + [(401, k, "user", "round and round") for k in range(70)] + [(402, 0, "u", "x" * 200_000)]
    rows += [(999, 0, "user", "no leader, cut away")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([("d", *r, "p", "s") for r in rows], SCHEMA).repartition(5)


def trie(spark, rows, mark=turn_mark):
    turns, sizes = rebuild(frame(spark, rows))
    return sorted(map(tuple, prefix_trie(turns, sizes, mark).collect()), key=str)


def test_rebuilt_turns(spark):
    rows = conversations()
    turns, sizes = rebuild(frame(spark, rows))
    want = plain_rebuilt(rows)
    got = {r.conv_id: [] for r in sizes.collect()}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.depth)):
        got[r.conv_id].append((r.role, r.text))
        assert r.depth == len(got[r.conv_id])
    assert got == want and {r.conv_id: r.size for r in sizes.collect()} == {c: len(t) for c, t in want.items()}
    assert any(not t for t in want.values())


def test_trie_equals_a_plain_one(spark):
    rows = conversations()
    assert trie(spark, rows) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("kinds", [1, 3])
def test_collisions_are_split(spark, kinds):
    """Turns whose first hashes are all the same, or one of three."""
    rows = conversations(3)
    assert trie(spark, rows, lambda seed: F.pmod(turn_mark(seed), F.lit(kinds))) == plain_trie(plain_rebuilt(rows))


def test_every_task_sees_a_part_of_one_conversation(spark):
    rows = [(5, k, "user", f"turn {k % 3}") for k in range(500)] + [(6, k, "user", "x") for k in range(3)]
    got = trie(spark, rows)
    assert got == plain_trie(plain_rebuilt(rows))
    sums = running_sums(spark.createDataFrame([(1 if k < 800 else 2, k, k * 9 * 10**15) for k in range(1000)], "key long, at long, v long").repartition(7), ["key", "at"], "v", None)
    total, wrap = {}, lambda x: (x + 2**63) % 2**64 - 2**63
    for r in sorted(sums.collect(), key=lambda r: r.at):
        assert r.before == wrap(total.get(r.key, 0))
        total[r.key] = total.get(r.key, 0) + r.v
        assert r.through == wrap(total[r.key])


def test_sums_and_powers_wrap(spark):
    pairs = [(2**63 - 1, 1), (-1, -1), (-(2**63), -(2**63)), (123456789 << 30, -5), (0, 0), (-1, 1)]
    out = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").select("i", wrapping_sum(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in sorted(out)] == [(a + b + 2**63) % 2**64 - 2**63 for a, b in pairs]
    import numpy as np

    from atlasframe.llm.conversations import BASE

    assert powers(np.array([0, 1, 2, 77, 1000])).tolist() == [pow(BASE, k, 1 << 64) for k in (0, 1, 2, 77, 1000)]


def test_no_conversations(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []
    assert trie(spark, [(999, 0, "user", "x")]) == plain_trie(plain_rebuilt([(999, 0, "user", "x")]))
    assert NOTHING == hashlib.sha256(b"").hexdigest()
