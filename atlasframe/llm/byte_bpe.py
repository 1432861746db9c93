"""Byte-level BPE by merge replay: every merge, in rank order, at all places of a corpus of words that an inverted index names."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm.common import documents, release_memory, texts
from atlasframe.llm.token_counts import PATTERN, whole_chunks

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, decoded binary"
#: Bytes of text whose new words are one corpus.
CORPUS_BYTES = 3 << 20
#: Bytes of words and ids that a worker remembers; beyond that it forgets them all.
REMEMBERED_BYTES = 150 << 20
#: What a remembered word costs besides its bytes.
ENTRY_BYTES = 220
#: Ranks with fewer places than this are not worth numpy operations; after so many of them in a row the rest of a replay goes place by place.
FEW_PLACES, PATIENCE = 24, 12


class Vocabulary:
    """The tokens of a rank file: ``base64 rank`` lines, where ranks are ids and order merges; single bytes are all there."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array(list(map(len, self.tokens)), np.int64)
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.shift = size.bit_length()

    def pairs(self) -> dict[int, int]:
        """What two tokens next to each other become: ``a << shift | b`` to the rank of their joined bytes."""
        ranks, found = self.ranks, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << self.shift | b] = rank
        return found


class MergeReplay:
    """Ids of pre-tokens; those of a corpus of new words are found together."""

    def __init__(self, vocabulary: Vocabulary, remembered_bytes: int = REMEMBERED_BYTES):
        import regex

        self.vocabulary, self.remembered_bytes = vocabulary, remembered_bytes
        self.pair = vocabulary.pairs()
        self.pair_keys = np.array(sorted(self.pair), np.int64)
        self.pair_ranks = np.array([self.pair[k] for k in self.pair_keys.tolist()], np.int64)
        self.findall = regex.compile(PATTERN).findall
        self.chunks = partial(whole_chunks, self.findall)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def ranks_of(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where nothing is made of it; the symbol -1 makes no pair."""
        wanted = a << self.vocabulary.shift | b
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], -1)

    @staticmethod
    def post(index: dict[int, list[np.ndarray]], waiting: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        """Put places under their ranks; a rank of -1 is none."""
        real = ranks >= 0
        ranks, places = ranks[real], places[real]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.append(0, np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        for rank, start, stop in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            if rank in index:
                index[rank].append(places[start:stop])
            else:
                index[rank] = [places[start:stop]]
                heappush(waiting, rank)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian 32-bit numbers.

        The words lie one after the other; the index names, for each rank, the places of the pairs that it merges (pairs of one rank make
        the same token, so they share a list and are merged from left to right). Ranks are taken from the lowest on; each merge looks at its
        two neighbours only and adds the pairs that have arisen. A pair may arise whose rank is lower than that of the merge: then the places
        that are left wait until it is done. So every word sees the merges that it would see alone, in the same order. While ranks
        have many places, those of different words are merged by one numpy operation; the long tail of ranks with few places goes one by one.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        owner = np.repeat(np.arange(len(words)), sizes)
        # Behind the last place, -1 stands for no neighbour.
        symbol = np.append(self.vocabulary.base[data], -1)
        after = np.append(np.where(last, -1, np.arange(1, len(data) + 1)), -1)
        before = np.append(np.where(np.append(True, last[:-1]), -1, np.arange(-1, len(data) - 1)), -1)
        made = np.append(self.ranks_of(symbol[:-1], symbol[after[:-1]]), -1)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        self.post(index, waiting, made, np.arange(len(made)))
        few = 0
        while waiting and few < PATIENCE:
            rank = heappop(waiting)
            at = np.sort(np.concatenate(index.pop(rank)))
            at = at[made[at] == rank]  # the others have been changed by earlier merges
            few = few + 1 if len(at) < FEW_PLACES else 0
            if not len(at):
                continue
            head = np.append(True, owner[at[1:]] != owner[at[:-1]])
            if not head.all():  # the next place of a word waits for what its first one makes
                index[rank] = [at[~head]]
                heappush(waiting, rank)
                at = at[head]
            gone, left = after[at], before[at]
            right = after[gone]
            symbol[at], symbol[gone], after[at], before[right] = rank, -1, right, at
            made[gone], made[at], made[left] = -1, self.ranks_of(rank, symbol[right]), self.ranks_of(symbol[left], rank)
            made[-1] = -1
            self.post(index, waiting, np.append(made[at], made[left]), np.append(at, left))
        self.one_by_one(symbol_list := symbol.tolist(), after.tolist(), before.tolist(), index, waiting)
        ids = np.array(symbol_list[:-1], np.int64)
        alive = ids >= 0
        counts = np.add.reduceat(alive, ends - sizes, dtype=np.int64) * 4
        packed, stops = ids[alive].astype("<i4").tobytes(), np.cumsum(counts)
        return [packed[a:b] for a, b in zip((stops - counts).tolist(), stops.tolist())]

    def one_by_one(self, symbol: list[int], after: list[int], before: list[int], posted: dict[int, list[np.ndarray]], waiting: list[int]) -> None:
        """The rest of a replay: merges what the index still names, in place."""
        pair, shift = self.pair.get, self.vocabulary.shift
        index: list[list[int] | None] = [None] * len(self.vocabulary.tokens)
        for rank, places in posted.items():
            index[rank] = np.concatenate(places).tolist()
        while waiting:
            rank = heappop(waiting)
            places, index[rank] = index[rank], None
            if places is None:
                continue
            places.sort()
            for k, at in enumerate(places):
                gone = after[at]
                if pair(symbol[at] << shift | symbol[gone]) != rank:
                    continue  # an earlier merge has changed it
                right, left = after[gone], before[at]
                symbol[at], symbol[gone], after[at], before[right] = rank, -1, right, at
                waits = False
                for place, new in ((at, pair(rank << shift | symbol[right])), (left, pair(symbol[left] << shift | rank))):
                    if new is not None:
                        if index[new] is None:
                            index[new] = [place]
                            heappush(waiting, new)
                        else:
                            index[new].append(place)
                        waits |= new < rank
                if waits:
                    if k + 1 < len(places):
                        index[rank] = places[k + 1 :]
                        heappush(waiting, rank)
                    break

    def learn(self, chunks: set[str]) -> None:
        """Ids of new chunks, which the pattern cuts into pre-tokens; a pre-token that is a token as a whole is that token, as in the library."""
        known, ranks, findall = self.known, self.vocabulary.ranks, self.findall
        split = {chunk: findall(chunk) for chunk in chunks}
        new = list(set(chain.from_iterable(split.values())).difference(known))
        if new:
            raw = [word.encode() for word in new]
            whole = list(map(ranks.get, raw))
            ids = iter(self.replay([r for r, w in zip(raw, whole) if w is None]))
            known.update((word, next(ids) if w is None else w.to_bytes(4, "little")) for word, w in zip(new, whole))
            self.held += sum(map(len, raw)) + len(raw) * ENTRY_BYTES
        for chunk, found in split.items():
            if len(found) != 1:
                known[chunk] = b"".join(map(known.__getitem__, found))
                self.held += len(chunk) + len(known[chunk]) + ENTRY_BYTES

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.held > self.remembered_bytes:
            self.known.clear()
            self.held = 0
        split = [self.chunks(text) for text in batch]
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, found)), "<i4") for found in split]


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def merge_replay(path: str) -> MergeReplay:
    """One for each Python worker, so that later tasks know the words of earlier ones."""
    return MergeReplay(vocabulary(path))


def corpora(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their second column (text, or lists of ids) has taken ``CORPUS_BYTES``, or 4 bytes an id."""
    for batch in batches:
        values = batch.column(1)
        sizes = (pa.compute.binary_length(values) if pa.types.is_string(values.type) else pa.compute.multiply(values.value_lengths(), 4)).fill_null(0)
        block = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // CORPUS_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, stop in pairwise(cuts):
            yield batch.slice(start, stop - start)
    release_memory()


def encoded_batches(ranks_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ENCODED`` for those of (``doc_id``, ``text``)."""
    replay = merge_replay(ranks_path)
    for batch in corpora(batches):
        ids = replay.encode(texts(batch))
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])


def decoded_batches(ranks_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``DECODED`` for those of ``ENCODED``."""
    known = vocabulary(ranks_path)
    for batch in corpora(batches):
        lists = batch.column(1)
        values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        bad = (values < 0) | (values >= len(known.tokens))
        sizes = np.where(bad, 0, known.sizes[np.where(bad, 0, values)])
        bad |= sizes == 0
        stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.append(0, stops[:-1]).astype(np.int64)[: len(stops)]
        at, wrong = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(bad))
        data = b"".join(map(known.tokens.__getitem__, values[~bad].tolist()))
        null = lists.is_null().to_numpy(zero_copy_only=False) | (wrong[stops] > wrong[starts])
        found = pa.array([None if n else data[a:b] for a, b, n in zip(at[starts].tolist(), at[stops].tolist(), null.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, found], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Token ids of every text of ``docs`` (``doc_id``, ``text``), see ``ENCODED``, as the ``tiktoken`` library gives them for a rank file without special tokens.

    Text is cut by the pattern of the public byte-level vocabularies; merges never cross its cuts. The corpus of a replay is the new words of
    ``CORPUS_BYTES`` of text of a task: no word leaves its executor, whereas one list of all words would have to be shuffled, and joined to the texts again, to save
    repeated work only. Null and empty texts have no ids (an empty list); strings that look like special tokens are ordinary text; very long texts and words are read
    whole. One row per input row, repeated rows and rows without id too; an empty table gives no rows; other columns are ignored. No shuffle.
    """

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(encoded_batches, ranks_path), ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The bytes of every list of ids (``doc_id``, ``ids``), see ``DECODED``.

    Bytes need not be whole characters. An empty list is empty bytes; a null list, or one with null or unknown ids, has null bytes. One row per input row; no shuffle.
    """

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(partial(decoded_batches, ranks_path), DECODED)


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task has one Python worker with one vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoded_batches(ranks_path, encoded_batches(ranks_path, batches))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DECODED)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = round_trip(documents(spark, sf_dir), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
