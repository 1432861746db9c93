"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.llm.common import documents, slices, texts

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Fixed value: the white space of the pattern below (Unicode's White_Space).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: how the public byte-level vocabularies split text before merging.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words whose counts a worker remembers; beyond that it forgets them all.
REMEMBERED = 800_000
#: White space next to white space, or other than blanks and line ends; ASCII ones are looked for one by one, which is faster.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\0")
OTHER_SPACE = r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
other_space = re.compile(OTHER_SPACE).search
NONE = np.int32(2**31 - 1)
#: Slots for the hashes of pairs that merge, many more than there are pairs.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def whole_chunks(findall: Callable[[str], list[str]], text: str) -> list[str]:
    """Parts of a text that the pattern (``findall``) cuts as it would inside the text.

    A pre-token never goes on from other characters into white space. So where single blanks or line ends stand between
    other characters, each blank may be taken with the word behind it, and each line end alone.
    """
    if any(x in text for x in RUNS) or not text.isascii() and other_space(text):
        return findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class RankMerger:
    """Counts the symbols that survive the merges of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str, remember: int = REMEMBERED):
        import regex

        self.remember = remember

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        # Each pair in the slot of its hash; pairs whose slot is taken lie sorted beside the slots.
        slot = self.slot(keys)
        _, first = np.unique(slot, return_index=True)
        late = np.setdiff1d(np.arange(len(keys)), first)
        late = late[np.argsort(keys[late])]
        self.keys, self.rank, self.merged = np.full(SLOTS, -1), np.full(SLOTS, NONE), np.zeros(SLOTS, np.int64)
        self.keys[slot[first]], self.rank[slot[first]], self.merged[slot[first]] = keys[first], first, merged[first]
        self.late_keys, self.late_rank, self.late_merged = keys[late], late.astype(np.int32), merged[late]
        self.crowded = np.zeros(SLOTS, bool)
        self.crowded[slot[late]] = True
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.findall = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    @staticmethod
    def slot(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pairs(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (NONE: no merge) and what it becomes."""
        at = self.slot(pair)
        hit = self.keys[at] == pair
        rank, merged = np.where(hit, self.rank[at], NONE), self.merged[at]
        rest = np.flatnonzero(self.crowded[at] & ~hit)
        if len(rest):
            place = np.minimum(np.searchsorted(self.late_keys, pair[rest]), len(self.late_keys) - 1)
            found = self.late_keys[place] == pair[rest]
            rank[rest[found]], merged[rest[found]] = self.late_rank[place[found]], self.late_merged[place[found]]
        return rank, merged

    def survivors(self, pieces: list[str]) -> np.ndarray:
        """Symbols left of each piece (not empty): in each step every sequence merges all its lowest-ranked pairs."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        left = sizes.copy()
        symbols = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.size + symbols[1:]
            rank, merged = self.pairs(pair)
            rank = np.append(np.where(owner[:-1] == owner[1:], rank, NONE), NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            runs = np.diff(np.append(starts, len(owner)))
            chosen = (rank == np.repeat(least, runs)) & (rank != NONE)
            place = np.flatnonzero(chosen)
            if not len(place):
                break
            # In a run such as "aaa" neighbouring choices overlap: the first, third, ... of each run are merged.
            head = np.append(True, np.diff(place) != 1)
            run_start = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run_start) % 2 == 0]
            symbols[place] = merged[place]
            left -= np.bincount(owner[place], minlength=len(left))
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            keep &= np.repeat(least != NONE, runs)  # sequences that have no pair to merge are done
            symbols, owner = symbols[keep], owner[keep]
        return left

    def learn(self, chunks: set[str]) -> None:
        """Count the tokens of each chunk, which the pattern cuts into pre-tokens; those that are new are merged as one batch."""
        known = self.known
        split = {chunk: self.findall(chunk) for chunk in chunks}
        new = list(set(chain.from_iterable(split.values())).difference(known))
        if new:
            known.update(zip(new, self.survivors(new).tolist()))
        for chunk, found in split.items():
            if len(found) != 1:
                known[chunk] = sum(map(known.__getitem__, found))

    def counts(self, batch: list[str]) -> list[int]:
        if len(self.known) > self.remember:
            self.known.clear()
        split, extra = [], []
        for text in batch:
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                split.append([p for part in parts for p in self.findall(part)])
                extra.append(len(parts) - 1)
            else:
                split.append(whole_chunks(self.findall, text))
                extra.append(0)
        known = self.known
        self.learn(set(chain.from_iterable(split)).difference(known))
        return [sum(map(known.__getitem__, found)) + n for found, n in zip(split, extra)]


@lru_cache(1)
def rank_merger(path: str, remember: int) -> RankMerger:
    """One for each Python worker, so that later tasks know the words of earlier ones."""
    return RankMerger(path, remember)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text of ``docs`` (``doc_id``, ``text``).

    Counts are those of the ``tokenizers`` library for a byte-level BPE file, without added special tokens;
    a special token's string inside a text is one token. Null text counts as empty (0 tokens); very long texts are read whole. One row per
    input row, repeated rows and rows without id too; an empty table gives no rows; no shuffle; other columns are ignored. See ``COUNTS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = rank_merger(tokenizer_path, REMEMBERED)
        for batch in slices(batches):
            found = texts(batch)
            n = merger.counts(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def with_tokens(docs: DataFrame, tokenizer_path: str, drop: tuple[str, ...] = (), remember: int = REMEMBERED) -> DataFrame:
    """All columns of ``docs`` (it has ``text``) but those of ``drop``, and ``n_tokens``, counted as in ``count_tokens``; ``remember`` words stay in each worker. No shuffle."""
    fields = [f for f in docs.schema.fields if f.name not in (*drop, "n_tokens")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = rank_merger(tokenizer_path, remember)
        for batch in slices(batches):
            n = pa.array(merger.counts(texts(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], n], names=[*names, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
