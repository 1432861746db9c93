"""The registered mixing counts tokens, not blanks."""

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from atlasframe.llm.mixing import op6_mixing

TEXTS = ["東京は日本の首都です。" * 50, "def f():\n" + " " * 200 + "return 1", "plain words here", "", None]


def test_tokens_are_those_of_the_library(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert want[0] > 100
    got = op6_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(5)) and all(r.mix_tokens == max(1, want[r.doc_id]) for r in got)
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(range(5))
