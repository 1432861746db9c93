"""The quality classifier against a plain modified Kneser-Ney model, and on labelled rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasframe.llm.grams import END, START, compressed, different, gram_codes
from atlasframe.llm.quality import ORDER, QualityClassifier, dealt, fold_of, maybe_among, score, text_key, trusted_weights

SCHEMA = "doc_id long, text string, lang string, quality_keep string, n long, _slice int, fold string"
TRUSTED = [f"the {a} {b} the {c} on a mat." for a in ("cat", "dog", "rat") for b in ("saw", "met") for c in ("hen", "cow", "cat", "ape")]
OTHERS = ["the cat sat on the mat, twice twice", "zzz ünknown", "a mat", "the dog met the ape on a mat.", "東京タワー", "x"]


def plain(texts):
    """Probability of a byte string's last byte by the textbook recursion."""
    padded = [bytes([START]) * (ORDER - 1) + t.encode() + bytes([END]) for t in texts]
    levels = {ORDER: Counter(t[i : i + ORDER] for t in padded for i in range(len(t) - ORDER + 1))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, c in levels.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cuts[k] = [0.0] + [max(0.0, min(i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else i / 2)) for i in (1, 2, 3)]

    def p(gram):
        if not gram:
            return 1 / 256
        own, below = levels[len(gram)], p(gram[1:])
        follow = [v for g, v in own.items() if g[:-1] == gram[:-1]]
        if not follow:
            return below
        gamma = max(1e-9, sum(cuts[len(gram)][min(v, 3)] for v in follow) / sum(follow))
        return (own[gram] - cuts[len(gram)][min(own[gram], 3)]) / sum(follow) + gamma * below

    return p


@pytest.mark.parametrize("parts", [20, 1])
def test_joined_scores_equal_the_recursion(spark, parts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TRUSTED + OTHERS + OTHERS[:1] + ["", None, " \n"])], "doc_id long, text string")
    fold = {r.text: r.f for r in docs.select("text", fold_of(text_key()).alias("f")).collect()}
    held = dealt(docs, ["doc_id", "text"], parts)
    weights = trusted_weights(docs, docs.where(f"doc_id < {len(TRUSTED)}").select(F.col("doc_id").alias("_id")))
    got = score(held, weights, ["doc_id", "text"]).collect()
    assert len(got) == docs.count() and [r._n for r in got if not (r.text or "").strip()] == [0, 0, 0]
    for row in got:
        if (row.text or "").strip():
            p = plain([t for t in TRUSTED if fold[t] != fold[row.text]])  # counts leave out the text's own fold
            data = bytes([START]) * (ORDER - 1) + row.text.encode() + bytes([END])
            want = -sum(math.log(p(data[i : i + ORDER])) for i in range(len(data) - ORDER + 1))
            assert row._n == len(row.text.encode()) + 1 and row._nll == pytest.approx(want, rel=1e-5)


def test_gram_codes_stay_inside_texts():
    code, sizes = gram_codes([b"ab", b"", b"c"], ORDER)
    assert sizes.tolist() == [3, 1, 2]
    s, e = bytes([START]), bytes([END])
    want = [4 * s + b"a", 3 * s + b"ab", 2 * s + b"ab" + e, 4 * s + e, 4 * s + b"c", 3 * s + b"c" + e]
    assert code.tolist() == [int.from_bytes(x, "big") for x in want]
    assert not len(gram_codes([], ORDER)[0])


def test_different_codes():
    code = np.random.default_rng(0).integers(0, 50, 1000)
    values, place = different(code)
    assert values.tolist() == sorted(set(code.tolist())) and (values[place] == code).all()


def test_bitmap_lets_all_ids_through(spark):
    rows = spark.range(-5000, 5000).select(F.col("id").alias("_id"), F.lit("x").alias("y"))
    ids = spark.range(-5000, 5000, 7).select(F.col("id").alias("_id"))
    found = {r._id for r in maybe_among(rows, ids).collect()}
    assert set(range(-5000, 5000, 7)) <= found and len(found) < 1500
    assert maybe_among(rows, ids.limit(0)).count() == 0
    texts = [None, b"", b"abc" * 1000]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x binary")
    assert [r.x and len(r.x) < 100 for r in compressed(df, "x").orderBy("k").collect()] == [None, b"", True]


def test_table_grows_with_the_corpus(spark):
    rng = np.random.default_rng(1)
    sizes = []
    for k in (100, 1000):
        docs = spark.createDataFrame([(i, "".join(map(chr, rng.integers(97, 123, 50)))) for i in range(k)], "doc_id long, text string")
        sizes.append(trusted_weights(docs, docs.select(F.col("doc_id").alias("_id"))).count())
    assert sizes[1] > 6 * sizes[0]


def test_clean_rows_stay_and_junk_goes(spark):
    rng = np.random.default_rng(0)
    words = "the of and to in that was with for this from have which their other about".split()
    more = ("x", 0, 5, "y")
    good = [(i, " ".join(rng.choice(words, 40)) + ".", ["en", "de", None][i % 3], *more) for i in range(400)]
    junk = [(1000 + i, "### ".join(w.upper() for w in rng.choice(words, 40)), "en", *more) for i in range(20)]
    odd = [(2000, None, "en", None, None, None, None), (2001, "", "en", *more), (2002, "the and with " * 30000, "xx", *more), (2003, good[0][1], "en", *more), (2003, good[0][1], "en", *more), (None, good[1][1], "en", *more)]
    df = spark.createDataFrame(good + junk + odd, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(0,), (None,)], "doc_id long")
    fitted = QualityClassifier.fit(df, trusted, slice_bytes=20_000)
    out = fitted.classify(df)
    assert out.columns == ["doc_id", "text", "lang", "n", "_slice", "fold", "quality_cross_entropy", "quality_threshold", "quality_keep"]
    assert sorted(r[:6] for r in out.fillna(-1).fillna("-").collect()) == sorted((*r[:3], *r[4:]) for r in df.fillna(-1).fillna("-").collect())
    kept = Counter(r.doc_id for r in out.where("quality_keep").collect())
    assert sum(kept[i] for i in range(400)) >= 392 and not any(kept[1000 + i] for i in range(20))
    assert [kept[i] for i in (2000, 2001, 2003, None)] == [0, 0, 2, 1]
    again = fitted.classify(spark.createDataFrame(good[:5] + junk[:5], SCHEMA))
    assert sorted(r.doc_id for r in again.where("quality_keep").collect()) == [0, 1, 2, 3, 4]


def test_repeated_text_is_under_the_lower_limit(spark):
    """A few trusted words over and over are likelier than any text."""
    rng = np.random.default_rng(3)
    words = "the of and to in that was with for this from have which their other about".split()
    rows = [(i, "of the " * 3 + " ".join(rng.choice(words, 40)) + ".", "en") for i in range(300)]
    rows += [(1000 + i, "of the " * (200 + i), "en") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = QualityClassifier.fit(df, df.where("doc_id < 300").select("doc_id")).classify(df).where("quality_keep").collect()
    assert not any(r.doc_id >= 1000 for r in out) and len(out) >= 290


def test_empty_tables(spark):
    none, no_ids = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long")
    assert QualityClassifier.fit(none, no_ids).classify(none).count() == 0
    df = spark.createDataFrame([(1, "abc", "en", "x", 0, 1, "y"), (2, None, None, "x", 0, None, None)], SCHEMA)
    assert [r.doc_id for r in QualityClassifier.fit(df, no_ids).classify(df).where("quality_keep").collect()] == [1]
