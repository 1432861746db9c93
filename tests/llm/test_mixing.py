"""Mixing: exponents against their definition, draws against their budgets."""

import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from atlasframe.llm.mixing import bisected_exponent, entropy, mix, most_repeated, tempered
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, n long, _tokens string, mix_pass string"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=8), st.floats(1.0, 20.0))
def test_exponent_meets_its_limits(tokens, limit):
    shares = {str(i): t / sum(tokens) for i, t in enumerate(tokens)}
    a = bisected_exponent(shares, repetition_limit=limit)
    assert most_repeated(shares, a) <= limit * (1 + 1e-9)
    assert a == 0 or most_repeated(shares, max(0, a - 1e-6)) > limit * (1 - 1e-3)
    target = 0.95 * math.log(len(tokens))
    b = bisected_exponent(shares, target_entropy=target)
    assert entropy(tempered(shares, b)) >= target - 1e-6 or b == 0.0


def test_draws_fill_budgets(spark):
    rows = [(i, "big" if i % 3 else "mid" if i % 2 else None, 1 + i % 7, "x", "y") for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mix(docs, F.col("n"), repetition_limit=1.5).collect()
    seen = Counter((r.source, r.mix_pass, r.doc_id) for r in out)
    assert max(seen.values()) == 1
    assert {r.doc_id for r in out if r.mix_pass == 0} == set(range(6000))  # nothing is lost
    total = sum(r.mix_tokens for r in out)
    for source in ("big", "mid", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.mix_tokens for r in mine) / total - mine[0].mix_weight) < 0.002
        assert all(0 <= r.mix_position <= 1 for r in mine)
    again = mix(docs.repartition(7), F.col("n"), repetition_limit=1.5).collect()
    assert sorted((r.doc_id, r.mix_pass) for r in again) == sorted((r.doc_id, r.mix_pass) for r in out)
    few = mix(docs, F.col("n"), repetition_limit=1.5, budget=3000).collect()
    assert abs(sum(r.mix_tokens for r in few) - 3000) < 30


def test_odd_tables(spark):
    assert mix(spark.createDataFrame([], SCHEMA), F.col("n")).count() == 0
    one = mix(spark.createDataFrame([(1, None, 5, "x", "y"), (1, None, 5, "x", None), (None, None, 5, None, None)], SCHEMA), F.col("n"))
    assert one.count() == 3 and one.columns[:4] == ["doc_id", "source", "n", "_tokens"]


def test_draws_equal_a_plain_one(spark):
    """Sources, passes and budgets by the definition: whole passes hold every row, the last one's tokens end with the row that fills the quota."""
    rows = [(i, "abc"[i % 7 % 3], (i * 7919) % 50 if i % 11 else None, "x", "y") for i in range(3000)] + [(5000 + i, "none", [0, None][i % 2], "x", "y") for i in range(40)] + [(1, "b", 7, "x", "y")] * 3
    rows += [(9000, "c", 100_000, "x", "y")]
    out = mix(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("n"), repetition_limit=2.0).collect()
    total = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in ("a", "b", "c", "none")}
    shares = {s: t / sum(total.values()) for s, t in total.items() if t}
    weights = tempered(shares, bisected_exponent(shares, repetition_limit=2.0))
    budget = math.ceil(max(total[s] / w for s, w in weights.items()))
    for s in total:
        mine = Counter((r.doc_id, r.mix_pass) for r in out if r.source == s)
        given = Counter(r[0] for r in rows if r[1] == s)
        want = int(round(weights[s] * budget)) if s in weights else 0
        whole = max(1, want // total[s]) if total[s] else 1
        for k in range(whole):
            assert Counter({i: n for (i, p), n in mine.items() if p == k}) == given
        last = [r.mix_tokens for r in out if r.source == s and r.mix_pass == whole]
        left = max(0, want - whole * total[s])
        assert (sum(last) >= left > sum(last) - max(last) if last else left == 0) and max((p for _, p in mine), default=0) <= whole
        assert {r.mix_weight for r in out if r.source == s} == {weights.get(s, 0.0)}


def test_sources_without_tokens(spark):
    out = mix(spark.createDataFrame([(i, "ab"[i % 2], None, "x", "y") for i in range(10)], SCHEMA), F.col("n")).collect()
    assert sorted(r.doc_id for r in out) == list(range(10)) and {r.mix_pass for r in out} == {0}
