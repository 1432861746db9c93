"""License scans, media columns and language identification against plain versions."""

import hashlib
import io
import re
import wave
import zlib

import numpy as np
import pyarrow as pa

from atlasframe.llm.langid import identify
from atlasframe.llm.licenses import BASE, named, normal, permitted, postfix, scan_licenses
from atlasframe.llm.media import MELS, TENSOR_FRAMES, audio_features, log_mel, resample
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, score string, media string"


def test_license_scan_equals_plain_search(spark):
    texts = [
        None, "", "Released under the MIT License.", "mit, LICENSE mit license\n* MIT -- license", "Apache license cc by cc-by CC BY-NC 4.0 ccby",
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "the GNU General\nPublic License, version 3", "été mit licenseé 日本 mit license", "mit " * 4000 + "license",
    ]
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts)] * 2
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(at)), text
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(filter(None, r.labels.split(",")))
    assert got[5].expressions == ["(apache-2.0 or mit) and gpl-2.0-only with classpath-exception-2.0"] and got[5].score == 1.0
    assert "classpath-exception-2.0" not in got[5].labels and "gpl-2.0-only" in got[5].labels
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_expressions():
    assert postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert postfix("MIT OR") is None and postfix("(MIT") is None and postfix("") is None
    assert normal(postfix("c AND (b or a) and c")) == "(a or b) and c" and normal(postfix("a or (b OR a)")) == "a or b" and normal(postfix("(a or b) with x")) == "(a or b) with x"
    assert named(postfix("a with x or b")) == {"a", "b"}


def test_no_alternative_of_a_long_expression_is_lost():
    pairs = [(f"a{i}", f"b{i}") for i in range(12)]  # 4096 alternatives
    order = postfix(" AND ".join(f"({a} OR {b})" for a, b in pairs))
    assert normal(order) == " and ".join(sorted(f"({a} or {b})" for a, b in pairs))
    rng = np.random.default_rng(0)
    for _ in range(50):
        chosen = {p[k] for p, k in zip(pairs, rng.integers(0, 2, 12))}
        assert permitted(order, chosen) and not permitted(order, chosen - {sorted(chosen)[0]})
    assert permitted(postfix("a with x and b"), {"a", "b"}) and not permitted(postfix("a with x"), {"x"})


def test_media_round_trip_and_features(spark):
    texts = [None, "", "x" * 64, "y" * 65, "été " * 3000, "abc" * 700000]
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts)]
    for r in audio_features(spark.createDataFrame(rows, SCHEMA)).collect():
        raw = (texts[r.doc_id] or "").encode()
        with wave.open(io.BytesIO(r.media)) as w:
            payload = w.readframes(w.getnframes())
        assert payload[: len(raw)] == raw and not payload[len(raw) :].strip(b"\0") and len(payload) == max(64, -(-len(raw) // 64) * 64) == len(r.media) - 44
        table = pa.ipc.open_stream(r.logmel).read_all()
        shape = table.column("logmel").chunk(0).to_numpy_ndarray().shape
        assert shape == (-(-r.n_frames // TENSOR_FRAMES), TENSOR_FRAMES, MELS)
        assert all(a["start_s"] < a["end_s"] for a in r.spans)
    assert audio_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_resampling_equals_filtering_then_dropping():
    from atlasframe.llm.media import low_pass

    x = np.random.default_rng(0).normal(size=1001).astype(np.float32)
    assert np.allclose(resample(x), np.convolve(x, low_pass())[: len(x)][::2], atol=1e-5)
    tone = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000).astype(np.float32)
    assert log_mel(tone, 8000).mean(axis=0).argmax() in (5, 6, 7)


def test_media_query_digests(spark, tmp_path):
    from atlasframe.llm.media import op9_media_columns

    spark.createDataFrame([(1, "hello wörld", "en", "a", "b"), (2, None, "en", "a", "b")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_media_columns(spark, str(tmp_path)).collect():
        raw = {1: "hello wörld".encode(), 2: b""}[r.doc_id]
        payload = raw + bytes(64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == 108 and len(r.media_sha256) == 64


def test_language_id_on_held_out_rows(spark):
    rng = np.random.default_rng(3)
    words = {"en": ["the", "thing", "with", "that", "other", "nothing"], "de": ["und", "nicht", "schön", "über", "lich", "keit"], "fr": ["que", "été", "les", "eaux", "même", "où"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang, "x", "y") for i in range(300) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en", "", ""), (901, "123 -- !", "en", "", ""), (902, "", None, "", ""), (903, "thing that " * 20000, None, "", ""), (0, rows[0][1], rows[0][2], "x", "y")]
    out = {r.doc_id: r for r in identify(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 4 != 2).collect()}
    assert all(out[i].lang_pred == rows[i][2] and 0 <= out[i].score <= 1 for i in range(300))
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert identify(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    none = identify(spark.createDataFrame([(1, "abc", None, "", "")], SCHEMA), F.lit(True)).collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_language_models_equal_plain_ones(spark):
    """Cross-entropies against the textbook recursion over the training texts, and no matter how rows are sliced."""
    from collections import Counter

    from atlasframe.llm.langid import ORDER

    texts = {"en": ["the cat sat on the mat", "a thing of that other kind"], "de": ["die katze saß auf der matte", "ein ding von jener art"]}
    rows = [(k, t, lang, "x", "y") for lang, own in texts.items() for k, t in enumerate(own * 8)] + [(99, "The Thing saß", None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("doc_id", F.monotonically_increasing_id())
    got = [r for r in identify(df, F.lit(True), slice_bytes=200).collect() if r.doc_id == df.where("lang is null").first().doc_id][0]
    counted = {lang: [t for t in own * 8 if spark.range(1).select(F.pmod(F.xxhash64(F.lit(t).cast("binary")), F.lit(10)).alias("h")).first().h] for lang, own in texts.items()}

    def entropy(own, text):
        pad = lambda t: b"\x02" * (ORDER - 1) + t.lower().encode() + b"\x03"
        levels = {ORDER: Counter(p[i : i + ORDER] for p in map(pad, own) for i in range(len(p) - ORDER + 1))}
        for k in range(ORDER - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        cuts = {}
        for k, c in levels.items():
            n = [sum(v == i for v in c.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            cuts[k] = [0.0] + [max(0.0, min(i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else i / 2)) for i in (1, 2, 3)]

        def p(g):
            if not g:
                return 1 / 256
            follow = [v for x, v in levels[len(g)].items() if x[:-1] == g[:-1]]
            if not follow:
                return p(g[1:])
            gamma = max(1e-9, sum(cuts[len(g)][min(v, 3)] for v in follow) / sum(follow))
            return (levels[len(g)][g] - cuts[len(g)][min(levels[len(g)][g], 3)]) / sum(follow) + gamma * p(g[1:])

        data = pad(text)
        return -np.mean([np.log(p(data[i : i + ORDER])) for i in range(len(data) - ORDER + 1)])

    want = {lang: entropy(own, "The Thing saß") for lang, own in counted.items() if own}
    best = min(want, key=want.get)
    assert got.lang_pred == best and abs(got.cross_entropy - want[best]) < 1e-4
