"""The pipeline on the smallest tables: each stage against what its decisions must be."""

import os
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import expected as near_expected
from tests.llm.test_suffixes import expected as strings_expected

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(docs)
    return found


def test_columns_stay(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.35 * len(bad)


def test_one_of_each_class_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    _, component = near_expected([t for _, t in rows])
    assert sorted(r.doc_id for r in stages[2].collect()) == [rows[k][0] for k in sorted(set(component))]


def test_repeated_strings_go(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    removed = {r[0]: r for r in strings_expected(before)}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert set(after) == {i for i, r in removed.items() if r[1] > r[2]}
    for i, text in before:
        if removed[i][2] == 0 and text:
            assert after[i].text == text
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixing_loses_nothing(stages):
    before, after = {r.doc_id for r in stages[3].collect()}, [r.doc_id for r in stages[4].collect()]
    assert set(after) == before and len(after) <= 2 * len(before) + 20


def test_packed_pieces_are_the_mixed_documents(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in stages[4].collect())
    whole = sorted(r.ids_crc32 for r in stages[5].where("length = doc_tokens").collect())
    assert len(whole) > 0.9 * len(want) and not (set(whole) - set(want))
    assert stages[5].where("start = 0").count() == len(want)


def test_halved_characters_go_and_others_stay(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a\ufffdé".encode()), (2, "été".encode()[1:]), (3, "日本".encode()[:-1]), (4, b"")]
    out = spark.createDataFrame(rows, "i long, b binary").select("i", corpus_pipeline.whole_characters(F.col("b")).alias("t")).collect()
    assert {r.i: r.t for r in out} == {1: "a\ufffdé", 2: "té", 3: "日", 4: ""}
