"""Token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from atlasframe.llm.packing import OpenWindows, best_fit_decreasing, pack
from atlasframe.llm.token_counts import count_tokens

SCHEMA = "doc_id long, text string, source string, n_tokens string, offset string"
ODD = [
    None, "", " ", "\n\n  \t x", "aaaa aaaaa aaaaaaa", "can't won't I'LL they've", "été ÉTÉ naïve Straße", "日本語 テキスト 123 4567 ٣٤", "a  b   c    \n\n\n d ",
    "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|startoftext|>z", "é ́x  y z　w\x85q\x1cr", "😀😀 🏳️‍🌈!!!??? ###$$$", "=" * 3000, "ab" * 4000, "word " * 9000, "a\n \nb", "\na b\n c", "x \ny", " a", "b ", "\n", "a\x00b c", "a\x1c b", "日本 語\u2003 x", "it was 3.5, no. 4, été, a,b ...,end. x_y,z «q», r. the.", "dog's dogs' 'tis o'clock' it's. don't!? a_b_ c_. x&y & z<|endoftext|>. <|ENDOFTEXT|> b<|EndOfText|>! e\u0301. q\u0301 (a) [b]. 5% é!", "ÀÉÎ ßÿ ªº µ Σας ΣΑΣ İ, ﬁ. A·b, c½. d", "x\r\ny\x0bz\x0c",
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    letters = "abcdefgh ETA éß.,!1 \n'#"
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(120))]
    return [(i, t, "s", "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "s", "x", "y")]


def test_counts_equal_the_library(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(map(tuple, count_tokens(spark.createDataFrame(rows, SCHEMA), path).collect()))
    want = sorted((r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows)
    assert got == want


def test_packing_is_whole_and_tight(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = rows[:-1]
    out = pack(spark.createDataFrame(rows, SCHEMA).repartition(2), path, window=256).toPandas()
    for doc_id, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = out[out.doc_id == doc_id].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        assert mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, one in out.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]] and one.length.sum() <= 256
    assert out.sequence_id.nunique() <= np.ceil(out.length.sum() / 256) * 1.1 + 4


def test_rows_without_id_are_packed(spark):
    out = pack(spark.createDataFrame([(None, "a b", None, None, None), (None, None, None, None, None), (1, "c", None, None, None)], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(((r.doc_id or 0), r.length) for r in out) == [(0, 1), (0, 3), (1, 2)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_tightest_window_equals_a_plain_search():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 65) for _ in range(500)]
    sequence, offset, used = best_fit_decreasing(lengths, 64)
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in free if x >= n]
        if fit:
            free[free.index(min(fit))] -= n
        else:
            free.append(64 - n)
    assert used == len(free)
    filled = pd.Series(lengths).groupby(sequence).sum()
    assert sorted(64 - filled) == sorted(free)
    assert OpenWindows(8).tightest(1) is None
