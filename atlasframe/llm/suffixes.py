"""Suffix-array dedup: bytes that an earlier document has too, in strings of a fixed length, are removed.

Sorting every suffix would move 50 times the corpus, so the suffix array is a sparse one: of the suffixes that start in a
string of LENGTH bytes only the one at its minimizer is kept (the place whose next GRAM bytes have the least hash, the first of
equals), with the bytes before it as its left context. Equal strings have equal minimizers, so:

1. each slice of documents gives out the hashes of its minimizers, once each; those that occur in two
   documents are sent back;
2. each slice gives out the suffixes at such minimizers, as the stretch of text around them that strings cover, range-partitioned by
   their leading GRAM bytes with splitters from a bounded sample. Suffixes whose leading bytes are equal never lie on two sides
   of a boundary, so there is nothing left to compare across it. Buckets sort the strings by multikey quicksort, eight bytes a
   key, to LENGTH bytes, and neighbours that are equal form a group with a smallest document;
3. each slice removes the covered bytes.

Within a slice equal stretches are given out once, for the smallest document that has them, so a passage
that a third of all documents share is one row per slice in its bucket. The strings of a minimizer that occurs in
more than HOT_SLICES slices, whatever stands around it, are dealt to buckets by their own bytes as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.llm.common import documents, release_memory

LENGTH, GRAM = 50, 24
#: Bytes of text in a slice on average.
SLICE_BYTES = 8 << 20
#: Window starts that are worked on at once.
CHUNK = 1 << 18
#: Documents, and bytes of each, from which the splitters are sampled. They decide the balance of buckets, not the result.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 4096
#: Suffixes that a bucket sorts at once (whole groups of a minimizer).
SORTED_AT_ONCE = 1 << 17
#: Slices in which a minimizer may occur before its strings are dealt out one by one instead of as stretches.
HOT_SLICES = 1000

_rng = np.random.default_rng(99)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPAN = CHUNK + 2 * LENGTH
UP = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(SPAN, BASE, np.uint64))])
DOWN = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(SPAN, INVERSE, np.uint64))])
PLACE = np.uint64((1 << 20) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Stretches:
    """Runs of window starts that share a minimizer: where each starts, how many, where its gram is, and hashes.

    ``data`` is a slice's documents in a row, ``bounds`` where each starts and the last one ends. Every window of
    LENGTH bytes inside a document lies in exactly one stretch.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        parts = []
        last = np.repeat(bounds[1:], np.diff(bounds)) - LENGTH  # the last window start of the document of each byte
        for c in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
            parts.append(self._chunk(data[c : c + CHUNK + LENGTH - 1], last[c : c + CHUNK] - c, c))
        self.start, self.count, self.gram, self.key, self.hash = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.int64, np.uint64, np.uint64)))
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1

    @staticmethod
    def _chunk(data: np.ndarray, last: np.ndarray, at: int):
        n = len(data) - LENGTH + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * DOWN[: len(data)], dtype=np.uint64)])
        grams = len(data) - GRAM + 1
        h = mixed((total[GRAM:] - total[:-GRAM]) * UP[:grams])
        low = (h & ~PLACE) | np.arange(grams, dtype=np.uint64)
        width, span = LENGTH - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:n], low[width - span : width - span + n])
        place = (low[:n] & PLACE).astype(np.int64)
        valid = np.arange(n) <= last[:n]
        place[~valid] = -1
        change = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        count = np.diff(np.append(change, n))
        keep = place[change] >= 0
        start, count = change[keep], count[keep]
        gram = place[start]
        end = start + count - 1 + LENGTH
        return start + at, count, gram + at, h[gram], mixed((total[end] - total[start]) * UP[start] + end.astype(np.uint64) - start.astype(np.uint64))


def ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all [start, start + size) in a row."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def slice_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, bounds, rows) of a slice in order of ids and bytes, which is the same whenever the slice is read."""
    given = list(zip(table.column("doc_id").to_pylist(), (x or b"" for x in table.column("data").to_pylist())))
    order = sorted(range(len(given)), key=given.__getitem__)
    bounds = np.concatenate([[0], np.cumsum([len(given[k][1]) for k in order])]).astype(np.int64)
    return np.array([given[k][0] for k in order], np.int64), np.frombuffer(b"".join(given[k][1] for k in order), np.uint8), bounds, np.array(order, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed frame behind their sizes in bytes: little room for small ones, as each slice has one for each bucket."""
    import zstandard

    raw = [a.tobytes() for a in arrays]
    return np.array([len(x) for x in raw], "<u4").tobytes() + zstandard.compress(b"".join(raw), 1)


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    ends = np.cumsum(np.frombuffer(blob, "<u4", len(types)).astype(np.int64))
    raw = zstandard.decompress(memoryview(blob)[4 * len(types) :]) if ends[-1] else b""
    return [np.frombuffer(raw, t, count=int(end - start) // np.dtype(t).itemsize, offset=int(start)) for t, start, end in zip(types, ends - np.diff(ends, prepend=0), ends)]


GIVEN = ("u1", "<u2", "<u2", "<u8", "<i8", "<u4", "<i8")  # bytes, windows, gram offset, hash, doc, places, place in the slice
RUNS = ("<i8", "<u4")  # first window by its place in the slice, windows


def window_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH bytes at each start."""
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), 1 << 15):
        part = data[start[a : a + (1 << 15), None] + np.arange(LENGTH)]
        out[a : a + len(part)] = (BYTE_VALUES[part] * DOWN[:LENGTH]).sum(axis=1, dtype=np.uint64)
    return mixed(out)


def suspects(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur twice, or once with a mark; and how often they occur."""
    order = np.argsort(keys, kind="stable")
    keys, many = keys[order], many[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    if not len(starts):
        return keys, np.zeros(0, int)
    times = np.diff(np.append(starts, len(keys)))
    hit = (times > 1) | np.logical_or.reduceat(many, starts)
    return keys[starts][hit], times[hit]


def sorted_groups(words: np.ndarray) -> np.ndarray:
    """Group number of each row of ``words`` (8-byte keys, most significant first); rows are in one group if all keys are equal.

    Multikey quicksort: sort by one key, and only runs of equals go on to the next. Rows that differ from all others
    have group -1.
    """
    n = len(words)
    group = np.zeros(n, np.int64)
    rows = np.arange(n)
    for k in range(words.shape[1]):
        if not len(rows):
            break
        order = np.lexsort((words[rows, k], group[rows]))
        rows = rows[order]
        own, key = group[rows], words[rows, k]
        starts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(rows)))
        group[rows] = np.repeat(np.where(sizes > 1, starts, -1), sizes)
        rows = rows[np.repeat(sizes > 1, sizes)]
    return group


def earlier_windows(data: np.ndarray, start: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of each stretch: does a stretch of a smaller document hold the same LENGTH bytes?"""
    owner = np.repeat(np.arange(len(start)), windows)
    at = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(len(owner))
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = np.empty((len(at), -(-LENGTH // 8)), np.uint64)
    for k in range(keys.shape[1]):
        word = np.ascontiguousarray(view[at + 8 * k]).view(">u8").ravel().astype(np.uint64)
        left = LENGTH - 8 * k
        keys[:, k] = word if left >= 8 else word >> np.uint64(8 * (8 - left))
    group = sorted_groups(keys)
    found = np.zeros(len(at), bool)
    live = np.flatnonzero(group >= 0)
    if len(live):
        order = live[np.lexsort((doc[owner[live]], group[live]))]
        head = np.append(True, group[order][1:] != group[order][:-1])
        least = doc[owner[order]][head]
        found[order] = doc[owner[order]] > np.repeat(least, np.diff(np.append(np.flatnonzero(head), len(order))))
    return found


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Remove from every text of ``docs`` (``doc_id``, ``text``) each byte of a LENGTH-byte string that also starts in a document with a smaller id.

    Strings are judged on the input as it comes; overlaps count; strings never cross documents. Null text is empty. Rows of one
    ``doc_id`` are documents of one rank: they don't remove one another's bytes. Documents are dealt to slices by a hash of their id, so a very long one makes its slice longer; ties go to no one, as equal ids are one rank. Rows without id are left out; no rows give no rows.
    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary) and the columns of ``carry``, by whatever
    name; other columns are ignored.

    The texts are dealt to slices by one exchange, which all three steps read.
    """
    carry = carry or []
    own = [F.col(c).alias(f"_carried_{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"), *own).where("doc_id is not null")
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count("*")).first()
    slices = max(1, math.ceil(size / SLICE_BYTES))
    buckets, hot_slices = max(8, slices // 2), HOT_SLICES
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(max(1, n // SAMPLE_DOCS))) == 0)
    sample = drawn.select(F.expr(f"substring(data, 1, {SAMPLE_BYTES})")).limit(2 * SAMPLE_DOCS).toPandas().iloc[:, 0]
    raw = [bytes(x or b"") for x in sample]
    s = Stretches(data := np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    grams = np.sort(ragged(data, s.gram, np.full(len(s.gram), GRAM)).view(f"S{GRAM}")) if len(s.gram) else np.zeros(0, f"S{GRAM}")
    splitters = grams[(np.arange(1, buckets) * len(grams)) // buckets] if len(grams) else grams

    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))

    def minimizers(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        _, data, bounds, _ = slice_of(table)
        s = Stretches(data, bounds)
        order = np.argsort(s.key, kind="stable")
        key, doc = s.key[order], s.doc[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        many = np.zeros(len(starts), bool)
        if len(starts):
            many = np.logical_or.reduceat(np.append(False, (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])), starts)
        # Minimizers are least hashes, so they crowd near 0: buckets go by their mixed bits.
        part = (mixed(key[starts]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        by = np.argsort(part, kind="stable")
        key, many, part = key[starts][by], many[by], part[by]
        ends = np.searchsorted(part, np.arange(buckets + 1))
        own = np.flatnonzero(ends[1:] > ends[:-1])  # no rows for empty parts, so there are never more rows than keys
        cut = [(ends[k], ends[k + 1]) for k in own]
        release_memory()
        return pa.table({
            "bucket": pa.array(own, pa.int32()), "slice": pa.array([number] * len(own), pa.int32()),
            "keys": pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()), "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in cut], pa.binary()),
        })

    def repeated(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("many").to_pylist(), keys)]
        hit, times = suspects(np.concatenate(keys), np.concatenate(many))
        if not len(hit):
            return table.select(["slice", "keys", "many"]).slice(0, 0).rename_columns(["slice", "keys", "hot"])
        own, hot = [], []
        for k in keys:
            at = np.minimum(np.searchsorted(hit, k), len(hit) - 1)
            found = hit[at] == k
            own.append(k[found].tobytes())
            hot.append(np.packbits(times[at[found]] > hot_slices).tobytes())
        return pa.table({"slice": table.column("slice"), "keys": pa.array(own, pa.binary()), "hot": pa.array(hot, pa.binary())})

    def stretches(table: pa.Table, flagged: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in flagged.column("keys").to_pylist()]
        marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(flagged.column("hot").to_pylist(), parts)]
        hit, hot = np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, np.uint8), *marks]).astype(bool)
        hit, hot = hit[order := np.argsort(hit)], hot[order]
        out: dict[str, list] = {"bucket": [], "slice": [], "sure": [], "blob": []}
        if table.num_rows and len(hit):
            number = table.column("slice")[0].as_py()
            ids, data, bounds, _ = slice_of(table)
            s = Stretches(data, bounds)
            at = np.minimum(np.searchsorted(hit, s.key), len(hit) - 1)
            live = np.flatnonzero(hit[at] == s.key)
            # Strings of hot minimizers go one by one, so that they can be dealt by their own bytes too.
            alone = hot[at[live]]
            times = np.where(alone, s.count[live], 1)
            live, alone = np.repeat(live, times), np.repeat(alone, times)
            start = s.start[live] + np.arange(len(live)) - np.repeat(np.cumsum(times) - times, times)
            count, gram, doc, own_hash = np.where(alone, 1, s.count[live]), s.gram[live], s.doc[live], s.hash[live]
            own_hash[alone] = window_hashes(data, start[alone])
            kind = mixed(own_hash ^ (s.key[live] * BASE) ^ (gram - start).astype(np.uint64))
            ids_of = ids[doc]
            order = np.lexsort((ids_of, kind))
            heads = np.flatnonzero(np.append(True, kind[order][1:] != kind[order][:-1])) if len(order) else np.zeros(0, int)
            sizes = np.diff(np.append(heads, len(order)))
            least = np.repeat(ids_of[order][heads], sizes)
            first = ids_of[order] == least  # places in the smallest document; all others are surely repeated
            sure = order[~first]
            out["bucket"].append(number % buckets)
            out["slice"].append(number)
            out["sure"].append(True)
            out["blob"].append(packed(start[sure].astype("<i8"), count[sure].astype("<u4")))
            head = order[heads]
            text = ragged(data, gram[head], np.full(len(head), GRAM)).view(f"S{GRAM}") if len(head) else np.zeros(0, f"S{GRAM}")
            bucket = np.searchsorted(splitters, text, side="right")
            bucket = np.where(alone[head], (bucket + (kind[head] % np.uint64(buckets)).astype(np.int64)) % buckets, bucket)
            places = np.add.reduceat(first.astype(np.int64), heads) if len(heads) else np.zeros(0, int)
            by = np.lexsort((text, bucket))
            offset = np.cumsum(places) - places
            every = start[order[first]]
            for b in np.unique(bucket):
                own = by[slice(*np.searchsorted(bucket[by], [b, b + 1]))]
                h = head[own]
                out["bucket"].append(int(b))
                out["slice"].append(number)
                out["sure"].append(False)
                out["blob"].append(packed(
                    ragged(data, start[h], count[h] - 1 + LENGTH), count[h].astype("<u2"), (gram[h] - start[h]).astype("<u2"), kind[h].astype("<u8"), ids_of[h].astype("<i8"),
                    places[own].astype("<u4"), ragged(every, offset[own], places[own]).astype("<i8"),
                ))
        release_memory()
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "slice": pa.array(out["slice"], pa.int32()), "sure": pa.array(out["sure"], pa.bool_()), "blob": pa.array(out["blob"], pa.binary())})

    def judged(table: pa.Table) -> pa.Table:
        slice_, sure, blobs = table.column("slice").to_pylist(), table.column("sure").to_pylist(), table.column("blob").to_pylist()
        out_slice = [n for n, ok in zip(slice_, sure) if ok]
        out_blob = [b for b, ok in zip(blobs, sure) if ok]
        given = [(n, unpacked(b, *GIVEN)) for n, b, ok in zip(slice_, blobs, sure) if not ok]
        if given:
            data, count, offset, kind, doc, places, place = (np.concatenate([g[1][k] for g in given]) for k in range(len(GIVEN)))
            count, offset, places = count.astype(np.int64), offset.astype(np.int64), places.astype(np.int64)
            number = np.repeat([g[0] for g in given], [len(g[1][1]) for g in given])
            size = count - 1 + LENGTH
            start = np.cumsum(size) - size
            gram = ragged(data, start + offset, np.full(len(start), GRAM)).view(f"S{GRAM}")
            order = np.lexsort((doc, kind, gram))
            head = np.append(True, (kind[order][1:] != kind[order][:-1]) | (gram[order][1:] != gram[order][:-1]))
            firsts = order[head]  # the smallest document of each different stretch
            later = order[~head]
            later = later[doc[later] > np.repeat(doc[firsts], np.diff(np.append(np.flatnonzero(head), len(order))))[np.flatnonzero(~head)]]
            hits = [(later, np.zeros(len(later), np.int64), count[later])]
            new = np.append(True, gram[firsts][1:] != gram[firsts][:-1])
            sizes = np.diff(np.append(np.flatnonzero(new), len(firsts)))
            rivals = firsts[np.repeat(sizes > 1, sizes)]  # minimizers with different stretches around
            # Cut into runs of whole minimizers, and sort the suffixes of each run.
            cuts = np.flatnonzero(np.append(True, gram[rivals][1:] != gram[rivals][:-1])) if len(rivals) else np.zeros(0, int)
            done = np.cumsum(count[rivals])
            a = 0
            while a < len(rivals):
                goal = (done[a - 1] if a else 0) + SORTED_AT_ONCE
                b = int(np.searchsorted(done, goal, side="right"))
                later_cuts = cuts[cuts > a]
                fit = later_cuts[later_cuts <= b]
                b = int(fit[-1]) if len(fit) and b < len(rivals) else (int(later_cuts[0]) if len(later_cuts) and b < len(rivals) else len(rivals))
                own = rivals[a:b]
                found = earlier_windows(data, start[own], count[own], doc[own])
                owner = np.repeat(np.arange(len(own)), count[own])
                window = np.arange(len(owner)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
                edge = np.flatnonzero(found & np.append(True, ~found[:-1] | (owner[1:] != owner[:-1])))
                stop = np.flatnonzero(found & np.append(~found[1:] | (owner[1:] != owner[:-1]), True))
                hits.append((own[owner[edge]], window[edge], stop - edge + 1))
                a = b
            row, window, windows = (np.concatenate([h[k] for h in hits]) for k in range(3))
            n = places[row]
            at = ragged(place, (np.cumsum(places) - places)[row], n) + np.repeat(window, n)
            by_slice, windows = np.repeat(number[row], n), np.repeat(windows, n)
            order = np.argsort(by_slice, kind="stable")
            for k, g in zip(*np.unique(by_slice, return_counts=True)) if len(order) else ():
                part, order = order[:g], order[g:]
                out_slice.append(int(k))
                out_blob.append(packed(at[part].astype("<i8"), windows[part].astype("<u4")))
        release_memory()
        return pa.table({"slice": pa.array(out_slice, pa.int32()), "blob": pa.array(out_blob, pa.binary())})

    def removed(table: pa.Table, runs: pa.Table) -> pa.Table:
        ids, data, bounds, order = slice_of(table)
        cover = np.zeros(len(data) + 1, np.int32)
        for blob in runs.column("blob").to_pylist():
            at, windows = unpacked(blob, *RUNS)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows - 1 + LENGTH, -1)
        mask = np.cumsum(cover[:-1], dtype=np.int32) > 0
        rows = []
        for k, doc_id in enumerate(ids.tolist()):
            own, text = mask[bounds[k] : bounds[k + 1]], data[bounds[k] : bounds[k + 1]]
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0])
            rows.append((doc_id, len(text), int(own.sum()), spans, text[~own].tobytes()))
        types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        carried = table.take(pa.array(order))
        release_memory()
        return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(types)} | {f"_carried_{k}": carried.column(f"_carried_{k}") for k in range(len(carry))})

    keys = sliced.groupBy("slice").applyInArrow(minimizers, "bucket int, slice int, keys binary, many binary")
    flagged = keys.groupBy("bucket").applyInArrow(repeated, "slice int, keys binary, hot binary")
    given = sliced.groupBy("slice").cogroup(flagged.groupBy("slice")).applyInArrow(stretches, "bucket int, slice int, sure boolean, blob binary")
    runs = given.groupBy("bucket").applyInArrow(judged, "slice int, blob binary")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    schema = T.StructType([*schema.fields, *(T.StructField(f"_carried_{k}", docs.schema[c].dataType) for k, c in enumerate(carry))])
    out = sliced.groupBy("slice").cogroup(runs.groupBy("slice")).applyInArrow(removed, schema)
    return out.withColumnsRenamed({f"_carried_{k}": c for k, c in enumerate(carry)})


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
