"""Packing token sequences into fixed windows by best-fit decreasing."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm.common import documents, slices, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that one task packs together; more are packed in groups, which bounds memory.
GROUP_PIECES = 1 << 18
#: Sequence ids are task * SEQUENCES_PER_TASK + the task's own count.
SEQUENCES_PER_TASK = 1 << 40
#: Words whose ids a worker remembers; beyond that it forgets them all.
REMEMBERED_WORDS = 800_000
#: A run of ASCII marks that ends a word after a letter: the pattern of such tokenizers parts it from the letters anyhow.
LAST_MARKS = re.compile(r"([a-zß-öø-ÿ])([!-/:-@\[-^`{-~]+)(?= |\Z)")


class WordIds:
    """Token ids by blank-separated word.

    Only for tokenizers that drop white space, fold case and keep runs of marks together, such as
    ``word_bpe_49k.json``: there the ids of a text are the ids of its words in a row. Each new word goes
    through the tokenizer once; the ids of all words lie in one array, from which texts are gathered.
    """

    def __init__(self, path: str, remember: int):
        from tokenizers import Tokenizer

        self.remember = remember
        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> None:
        """Words of plain letters go through the tokenizer many at once: each ends with a token that ends a word."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() and max(w) <= "ÿ" else other).append(w)
        joined = self.encode([" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in joined)])
        lengths = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        found = [e.ids for e in self.encode(other, add_special_tokens=False)]
        lengths = np.concatenate([lengths, np.fromiter(map(len, found), np.int64, len(found))])
        assert len(lengths) == len(words)
        ids = np.concatenate([ids, np.array([i for x in found for i in x], np.uint32)])
        self.known.update(zip(plain + other, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    @staticmethod
    def split(text: str) -> list[str]:
        """Blank-separated words with A-Z in lower case; marks at the end of words are words of their own, so that fewer differ."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<|" in text:  # maybe a special token, which must stay as it is
            return text.split(" ")
        text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return LAST_MARKS.sub(r"\1 \2", text).split(" ")

    def of(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.remember:
            self.forget()
        split = list(map(self.split, batch))
        flat = list(chain.from_iterable(split))
        new = set(flat).difference(self.known)
        if new:
            self.learn(list(new))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(1)
def word_ids(path: str, remember: int) -> WordIds:
    """One for each Python worker, so that later tasks know the words of earlier ones."""
    return WordIds(path, remember)


class OpenWindows:
    """Open windows by remaining capacity under a segment tree over the capacities 0 to ``window``."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, sequence: int) -> None:
        if capacity == 0:
            return
        self.open.setdefault(capacity, []).append(sequence)
        self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the open window with the least capacity of at least ``length``."""
        node = length + self.leaves
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):  # up to the first right neighbour that holds any
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        sequence = self.open[capacity].pop()
        self._count(capacity, -1)
        return capacity, sequence


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(sequence, offset) of each length, and how many sequences; the longest first, ties in the given order."""
    windows, used = OpenWindows(window), 0
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = windows.tightest(lengths[i])
        if found is None:
            found, used = (window, used), used + 1
        capacity, sequence[i] = found
        offset[i] = window - capacity
        windows.add(capacity - lengths[i], sequence[i])
    return sequence, offset, used


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, remember: int = REMEMBERED_WORDS) -> DataFrame:
    """Pack every document of ``docs`` (``doc_id``, ``text``) into windows of at most ``window`` tokens.

    A document is its token ids and ``end_id``. What fills whole windows is cut off first; the rest of
    each document is placed by best-fit decreasing. Every task packs its own documents, so there is
    no shuffle and the padding is at most about a window's share per task. Null text counts as empty
    (one piece that holds ``end_id``); rows without id are packed like any other, with a null id; very long texts are cut into whole windows and a rest; ``remember`` words stay in each
    worker; repeated rows are packed each; ties go in the order of reading; no rows, no pieces; other columns are ignored. A task packs GROUP_PIECES pieces at a time.
    Returns a row per piece, see ``PIECES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, used = TaskContext.get().partitionId() * SEQUENCES_PER_TASK, 0
        words, rows = word_ids(tokenizer_path, remember), []

        def placed() -> pa.RecordBatch:
            nonlocal used
            sequence, offset, n = best_fit_decreasing([r[2] for r in rows], window)
            ids, *numbers = zip(*rows)
            out = [ids, *numbers, np.array(sequence, np.int64) + first + used, np.array(offset, np.int64)]
            used += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.of(texts(batch))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            if len(rows) >= GROUP_PIECES:
                yield placed()
                rows = []
        if rows:
            yield placed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
