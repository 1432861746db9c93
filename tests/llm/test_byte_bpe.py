"""Merge replay against the tiktoken library and an exact round trip."""

import base64
import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from atlasframe.llm.byte_bpe import MergeReplay, Vocabulary, decode, encode, op11_byte_bpe, round_trip
from tests.llm.test_tokens_packing import ODD

PATHS = [public_tokenizers.path(f"byte_bpe_{x}50k.tiktoken") for x in ("", "multi_")]
SCHEMA = "ids string, decoded string, doc_id long, text string, n_tokens string"


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def corpus():
    rng = random.Random(11)
    letters = "abcdefgh ETA éß.,!1 \n'#日本ا😀"
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(150)), "x" * 50_000, "antidisestablishmentarianism " * 3000]


@pytest.mark.parametrize("path", PATHS)
def test_ids_equal_the_library_and_decode_to_the_text(spark, path):
    texts = corpus()
    rows = [("i", "d", i, t, "n") for i, t in enumerate(texts)]
    rows += [rows[7], ("i", "d", None, "no id", "n")]
    enc = library(path)
    out = decode(encode(spark.createDataFrame(rows, SCHEMA).repartition(3), path), path).collect()
    want = [(i, enc.encode_ordinary(t or ""), (t or "").encode()) for _, _, i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(str, round_trip(spark.createDataFrame(rows, SCHEMA), path).collect())) == sorted(map(str, out))
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out), key=key) == sorted(want, key=key)


def test_words_of_a_small_alphabet_in_one_corpus():
    """Runs and overlaps, where pairs of one rank or of lower ranks arise next to each other."""
    enc, rng = library(PATHS[0]), random.Random(3)
    replay = MergeReplay(Vocabulary(PATHS[0]))
    words = [("".join(rng.choice(a) for _ in range(rng.randrange(1, 60)))).encode() for a in ("ab", "aes", "0", "-=", "the in", "é日") for _ in range(300)]
    for word, ids in zip(words, replay.replay(words)):
        assert np.frombuffer(ids, "<i4").tolist() == enc._encode_single_piece(word) or word in replay.vocabulary.ranks


def test_a_rank_lower_than_the_merge_that_makes_its_pair(tmp_path):
    """A vocabulary whose later tokens make pairs of earlier ranks: the other places of the later merge wait."""
    tokens = [*(bytes([b]) for b in range(256)), b"abc", b"bc", b"ab", b"abab", b"cab"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    enc, rng = library(path), random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))).encode() for _ in range(500)]
    for word, ids in zip(words, MergeReplay(Vocabulary(path)).replay(words)):
        assert np.frombuffer(ids, "<i4").tolist() == enc._encode_single_piece(word) or word in tokens


def test_forgetting_changes_nothing():
    replay = MergeReplay(Vocabulary(PATHS[0]), remembered_bytes=100)
    enc = library(PATHS[0])
    for text in [t or "" for t in corpus()[:40]]:
        assert replay.encode([text, text])[1].tolist() == enc.encode_ordinary(text)


def test_lists_that_no_text_has(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [60_000]), (5, [-1, 5]), (6, [0, 1]), (6, [0, 1]), (7, [50_256])]
    out = decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1), PATHS[0]).collect()
    assert [(r.doc_id, r.decoded and bytes(r.decoded)) for r in out] == [(1, None), (2, b""), (3, None), (4, None), (5, None), (6, b'!"'), (6, b'!"'), (7, None)]


def test_query_and_empty_tables(spark, tmp_path):
    texts = corpus()[:30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = library(PATHS[0])
    want = []
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, op11_byte_bpe(spark, str(tmp_path)).collect())) == want
    assert decode(encode(spark.createDataFrame([], "doc_id long, text string"), PATHS[0]), PATHS[0]).count() == 0
