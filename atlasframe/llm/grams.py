"""N-grams of raw bytes as integers, Kneser-Ney weights in tables, and the models that slices of documents put together from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.common import release_memory, slices, written

#: The highest order that fits.
MOST_ORDER = 5
#: The bytes that stand before the first and after the last one of a text.
START, END = 2, 3
#: Bits of an n-gram's bytes; the order stands above them.
SHIFT = 8 * MOST_ORDER
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 2 << 20
#: Different n-grams that a counting task holds before it gives them out.
HELD_GRAMS = 1 << 23


def gram_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``order`` that end at each byte (and at the end mark) of each text in a row, and how many each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    start, end = bytes([START]) * (order - 1), bytes([END])
    data = np.frombuffer(b"".join(x for text in texts for x in (start, text, end)), np.uint8)
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(np.arange(len(texts)) * (order - 1), sizes)
    code = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        code = (code << 8) | data[k : k + len(code)]
    return code[at], sizes


def chunked(texts: Iterator[bytes], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Texts in lists of about ``limit`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def different(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in ascending order, and the place of each among them; hashed first, which is much faster than sorting all."""
    found = pa.array(code).dictionary_encode()
    values, index = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(values)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return values[order], place[index]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their counts, those of equal codes added up."""
    codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def compressed(df: DataFrame, name: str) -> DataFrame:
    """The binary column ``name`` as one compressed frame a row; null and empty stay as they are."""
    names, at = df.columns, df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=6, write_checksum=False).compress
        for batch in slices(batches):
            columns = batch.columns
            columns[at] = pa.array([x and small(x) for x in columns[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Compressed texts, one after the other; null is empty."""
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for x in chunk:
            yield whole(x.as_py()) if x.is_valid and len(x.as_buffer()) else b""


def count_grams(rows: DataFrame, order: int, read: Callable[[pa.Array], Iterator[bytes]]) -> DataFrame:
    """Counts of all n-grams of ``order`` over whole texts by model: ``model``, ``code``, ``n``. ``rows``: a number (``model``) and a text, which ``read`` makes bytes; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given_out() -> Iterator[pa.RecordBatch]:
            for model, parts in held.items():
                codes, n = summed(parts)
                for a in range(0, len(codes), 1 << 18):
                    c, m = codes[a : a + (1 << 18)], n[a : a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), model, np.int32)), pa.array(c), pa.array(m)], names=["model", "code", "n"])
            held.clear()

        waiting: dict[int, list[bytes]] = {}

        def counted(model: int) -> None:
            codes, place = different(gram_codes(waiting.pop(model), order)[0])
            own = held.setdefault(model, [])
            own.append((codes, np.bincount(place, minlength=len(codes))))
            if len(own) > 16:
                own[:] = [summed(own)]

        size: dict[int, int] = {}
        for batch in slices(batches):
            for model, text in zip(batch.column(0).to_pylist(), read(batch.column(1))):
                if text.strip():
                    waiting.setdefault(model, []).append(text)
                    size[model] = size.get(model, 0) + len(text)
                    if size[model] >= CHUNK_BYTES:
                        counted(model)
                        size[model] = 0
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD_GRAMS:
                yield from given_out()
        for model in list(waiting):
            counted(model)
        yield from given_out()

    return rows.mapInArrow(run, "model int, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))


def gram_weights(counts: DataFrame, order: int) -> DataFrame:
    """Modified Kneser-Ney weights of all n-grams of all orders, by model.

    The counts of a lower order are how many different bytes stand before. ``alpha`` is an n-gram's discounted
    share of its context, ``gamma`` the weight that it gives the lower order as a context; null where it isn't seen as such.
    Returns ``model``, ``gram`` (its order above its bytes), ``alpha``, ``gamma``.
    """
    level = written(counts)
    every = level.withColumn("k", F.lit(order))
    for k in range(order - 1, 0, -1):
        level = level.groupBy("model", F.col("code").bitwiseAND((1 << 8 * k) - 1).alias("code")).agg(F.count("*").alias("n"))
        every = every.unionByName(level.withColumn("k", F.lit(k)))
    every = written(every).withColumn("context", F.shiftright("code", 8))
    seen = every.groupBy("model", "k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)])
    # Absolute discounts of counts 1, 2 and more; half-way values where a count of counts is 0 (tiny corpora).
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    cut = [F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(i / 2)))).alias(f"d{i}") for i in (1, 2, 3)]
    discounts = F.broadcast(seen.select("model", "k", *cut))  # a row for each model and order
    contexts = every.groupBy("model", "k", "context").agg(F.sum("n").alias("total"), *[F.count_if(F.least("n", F.lit(3)) == i).alias(f"c{i}") for i in (1, 2, 3)])
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    gram = lambda k, code: (F.shiftleft(k.cast("long"), SHIFT) + code).alias("gram")
    alpha = every.join(contexts.select("model", "k", "context", "total"), ["model", "k", "context"]).join(discounts, ["model", "k"]).select(
        "model", gram(F.col("k"), F.col("code")), ((F.col("n") - d) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma")
    )
    gamma = contexts.join(discounts, ["model", "k"]).select(
        "model", gram(F.col("k") - 1, F.col("context")), F.lit(None).cast("double").alias("alpha"), (sum(F.col(f"c{i}") * F.col(f"d{i}") for i in (1, 2, 3)) / F.col("total")).alias("gamma")
    )
    both = alpha.unionByName(gamma).groupBy("model", "gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))
    return written(both.select("model", "gram", F.col("alpha").cast("float").alias("alpha"), F.col("gamma").cast("float").alias("gamma")))


class SliceModel:
    """The weights of the n-grams of one slice, put together to log-probabilities."""

    def __init__(self, gram: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, order: int):
        self.order, by = order, np.argsort(gram)
        gram, alpha, gamma = gram[by], alpha[by].astype(np.float64), gamma[by].astype(np.float64)
        level = gram >> SHIFT
        code = gram & ((1 << SHIFT) - 1)
        self.context = {k: (code[at], np.maximum(gamma[at], 1e-9)) for k in range(order) for at in [np.flatnonzero((level == k) & ~np.isnan(gamma))]}
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(1, np.int64), np.full(1, -8 * math.log(2)))}
        for k in range(1, order + 1):
            at = np.flatnonzero((level == k) & ~np.isnan(alpha))
            p = alpha[at] + self.gammas(k - 1, code[at] >> 8) * np.exp(self.seen[k - 1][1][self.place(k - 1, code[at] & ((1 << 8 * (k - 1)) - 1))[0]])
            self.seen[k] = code[at], np.log(np.maximum(p, 1e-12))

    def place(self, k: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.seen[k][0]
        if not len(known):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return at, known[at] == code

    def gammas(self, k: int, context: np.ndarray) -> np.ndarray:
        """The weights of contexts of ``k`` bytes; 1 for contexts that aren't seen."""
        known, gamma = self.context[k]
        if not len(known):
            return np.ones(len(context))
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where(known[at] == context, gamma[at], 1.0)

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Of each n-gram of the highest order: the longest seen end of it, times the weights of the longer contexts."""
        out, open_ = np.zeros(len(code)), np.arange(len(code))
        for k in range(self.order, -1, -1):
            own = code[open_] & ((1 << 8 * k) - 1)
            at, hit = self.place(k, own)
            out[open_[hit]] += self.seen[k][1][at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                break
            out[open_] += np.log(self.gammas(k - 1, own >> 8))
        return out


def wanted_grams(found: Iterator[bytes], order: int) -> np.ndarray:
    """The different n-grams of all orders that the texts of a slice ask for; blank texts ask for nothing."""
    codes: list[np.ndarray] = []
    for chunk in chunked(x for x in found if x.strip()):
        codes.append(different(gram_codes(chunk, order)[0])[0])
        if len(codes) > 8:
            codes = [np.unique(np.concatenate(codes))]
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
    start = int.from_bytes(bytes([START]) * (order - 1), "big")
    # All ends of the n-grams, which are also all beginnings but those of the first ones.
    grams = [np.unique(np.append(every, start) & ((1 << 8 * k) - 1)) + (k << SHIFT) for k in range(order)] + [every + (order << SHIFT)]
    release_memory()
    return np.concatenate(grams)


def text_sums(chunk: list[bytes], models: list[SliceModel], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of each text (rows) by each model (columns), and how many n-grams each text has; each different n-gram is looked up once."""
    code, sizes = gram_codes(chunk, order)
    values, place = different(code)
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.add.reduceat(m.log_probabilities(values)[place], starts) for m in models], axis=1) if models else np.zeros((len(chunk), 0)), sizes
