"""MinHash near-dedup by a signature-coordinate inverted join with prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm.common import checkpoint, connected_components, documents, slices, whole_groups

SHINGLE = 5
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Coordinates of a signature, and how many must agree for a pair to be looked at. At the link
#: threshold 48 of 64 agree on average, with a deviation of 3.5: fewer than 32 do in 3 of a million pairs.
COORDINATES, AGREE = 64, 32
#: Members of a posting list or of a candidate class that one unit of work holds of either side.
BLOCK_ROWS = 4096
#: Shingles for which a long text counts as one more member, so that a block of long texts stays small: 32 MB.
ROW_SHINGLES = 1024
#: Lists up to this length are compared pair by pair for many lists at once.
SHORT_LIST = 48

_rng = np.random.default_rng(20240229)
WORD_FACTORS = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEYS = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; A-Z in lower case; empty without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + n] * WORD_FACTORS[k]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of the set under each of COORDINATES hash functions."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        x = shingles[start : start + 4096, None] * KEYS
        x ^= x >> np.uint64(31)
        x *= KEYS[::-1]
        np.minimum(least, x.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of fingerprints agree (byte 0: a value that no other text has)."""
    return ((a == b) & (a != 0)).sum(axis=-1)


class Unit:
    """The rows of one unit of work: which pairs it is to look at, and which rows are known to be in one class.

    First round (``rest`` is None): block 0 of a group meets every block, and each block meets itself. Second round:
    the rows of ``rest``, which the first round left outside the group's largest class, meet every row of the unit's own block.
    """

    def __init__(self, own: np.ndarray, unit: int, label: np.ndarray | None = None, rest: np.ndarray | None = None):
        self.own, self.unit, self.rest = own, unit, rest
        self.label = np.arange(len(own)) if label is None else np.unique(label, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def turns(self):
        """(row, rows to compare it with); rows of its own class are left out."""
        n = len(self.own)
        if self.rest is None:
            for i in range(n - 1):
                others = np.arange(i + 1, n)
                if self.unit and self.own[i] == 0:
                    others = others[self.own[others] != 0]
                others = others[self.label[others] != self.label[i]]
                if len(others):
                    yield i, others
        else:
            home = np.flatnonzero(self.own == self.unit)
            for i in np.flatnonzero(self.rest):
                others = home[self.label[home] != self.label[i]]
                if len(others):
                    yield int(i), others

    def unite(self, i: int, others: np.ndarray) -> None:
        """Link ``i`` with one row of each class among ``others``, and make one class of them."""
        classes, at = np.unique(self.label[others], return_index=True)
        self.links += [(i, int(others[k])) for k in at]
        self.label[np.isin(self.label, classes)] = self.label[i]


def collide(unit: Unit, prints: np.ndarray) -> None:
    """Candidates: pairs whose fingerprints agree often enough."""
    for i, others in unit.turns():
        hit = others[agreements(prints[others], prints[i]) >= AGREE]
        if len(hit):
            unit.unite(i, hit)


def confirm(unit: Unit, sets: list[np.ndarray], prints: np.ndarray) -> None:
    """Links that the full sets confirm."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    for i, others in unit.turns():
        others = others[PERCENT * np.maximum(size[others], size[i]) <= 100 * np.minimum(size[others], size[i])]
        for j in others[agreements(prints[others], prints[i]) >= AGREE] if len(others) else ():
            if unit.label[i] != unit.label[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= PERCENT * (size[i] + size[j] - common):
                    unit.unite(i, np.array([j]))


def first_units(df: DataFrame, members: str, block_rows: int) -> DataFrame:
    """Cut groups of ``members`` rows into blocks: ``own`` block and the ``unit`` a row goes to; block 0 goes to every unit."""
    n = F.greatest(F.lit(1), F.ceil(F.col(members) / F.lit(float(block_rows))).cast("int"))
    own = F.pmod(F.xxhash64(F.col("rep"), F.lit(17)), n.cast("long")).cast("int")
    staged = df.withColumn("_blocks", n).withColumn("own", own)
    return staged.select("*", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("own"))).alias("unit"))


def second_units(df: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """For groups of several blocks: every row in its own block, and those outside the group's largest class in every block.

    Two rows in different classes are never both in the largest one, so each such pair meets. ``classes``: node, component.
    """
    staged = df.where("_blocks > 1").where(F.col("unit") == F.col("own")).drop("unit")
    known = staged.join(classes.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    sizes = known.groupBy(key, "label").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy(key).agg(F.max_by("label", F.struct("_n", "label")).alias("_largest"))
    marked = known.join(largest, key).withColumn("rest", F.col("label") != F.col("_largest")).drop("_largest")
    return marked.select("*", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("own"))).alias("unit"))


def in_two_rounds(rows: DataFrame, key: str, members: str, compare) -> DataFrame:
    """Links (``a``, ``b``) that join all rows of a group which ``compare`` links, within and across the blocks of large groups.

    The copies of rows stay few: one block of a group, and what the first round hasn't put into its largest class.
    """
    placed = checkpoint(first_units(rows, members, BLOCK_ROWS))
    first = checkpoint(placed.repartition(key, "unit").sortWithinPartitions(key, "unit").mapInArrow(compare, "a long, b long"))
    if placed.where("_blocks > 1").isEmpty():
        return first
    again = second_units(placed, key, connected_components(first))
    return first.unionByName(again.repartition(key, "unit").sortWithinPartitions(key, "unit").mapInArrow(compare, "a long, b long"))


def units_of(table: pa.Table, start: int, end: int) -> Unit:
    part = table.slice(start, end - start)
    label, rest = (part.column(c).to_numpy() if c in part.column_names else None for c in ("label", "rest"))
    return Unit(part.column("own").to_numpy(), part.column("unit")[0].as_py(), label, rest)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (128-bit hash of the set) and ``values`` of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s).view(np.int32) if len(s) else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "set_key", "values"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, values array<int>")


def candidates(reps: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) that join all texts whose signatures agree in AGREE coordinates (``rep``, ``values``).

    Each text is posted under every coordinate and value. Values that one text alone has can't collide, so
    a text with fewer than AGREE shared values is done. The others are posted under a prefix: ordered by list length, two
    texts that agree AGREE times share one of the first COORDINATES - AGREE + 1 values of either, so very common values
    are skipped by all texts that have rarer ones. Long lists are compared in blocks.
    """
    posted = reps.select("rep", F.posexplode("values").alias("at", "value")).select("rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + 2**31).alias("kv"))
    shared = posted.groupBy("kv").agg(F.count("*").alias("n")).where("n > 1")
    lists = posted.join(shared, "kv").groupBy("rep").agg(F.collect_list(F.struct("n", "kv")).alias("lists")).where(F.size("lists") >= AGREE)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            kv, n, rep, prints = [], [], [], []
            for own, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                postings = sorted((x["n"], x["kv"]) for x in postings)
                print_ = np.zeros(COORDINATES, np.uint8)
                for _, x in postings:
                    print_[x >> 32] = (x & 0xFFFFFFFF) % 255 + 1
                chosen = postings[: len(postings) - AGREE + 1]
                kv += [x for _, x in chosen]
                n += [x for x, _ in chosen]
                rep += [own] * len(chosen)
                prints += [print_.tobytes()] * len(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(kv, pa.int64()), pa.array(n, pa.int64()), pa.array(rep, pa.int64()), pa.array(prints, pa.binary())], names=["kv", "n", "rep", "prints"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["kv", "unit"]):
            rep = table.column("rep").to_numpy()
            prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            sizes = np.diff(np.append(starts, table.num_rows))
            group = np.repeat(np.arange(len(starts)), sizes)
            # Short lists of one block are compared pair by pair, many lists at once.
            plain = (sizes <= SHORT_LIST) & (table.column("_blocks").to_numpy()[starts] == 1)
            short = np.repeat(plain, sizes)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, int(sizes[plain].max(initial=0))):
                i = np.flatnonzero(short[:-d] & (group[:-d] == group[d:]))
                i = i[agreements(prints[i], prints[i + d]) >= AGREE]
                left.append(rep[i])
                right.append(rep[i + d])
            for g in np.flatnonzero(~plain):
                a, b = starts[g], starts[g] + sizes[g]
                unit = units_of(table, a, b)
                collide(unit, prints[a:b])
                if unit.links:
                    i, j = np.array(unit.links).T
                    left.append(rep[a:b][i])
                    right.append(rep[a:b][j])
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return in_two_rounds(lists.mapInArrow(prefixes, "kv long, n long, rep long, prints binary"), "kv", "n", compare)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``docs`` (``doc_id``, ``text``) by their sets of five-word shingles.

    Texts with equal sets are one. Candidates of the inverted join fall into classes; each class's
    texts meet once more with their full sets, where links are confirmed exactly, save between texts that links join
    already. Large classes are cut into blocks: one block meets all others, then what is left outside the largest class does. Null or blank texts have no
    set and link with nothing; very long texts are read whole; repeated rows count as copies, ties in similarity link; rows without id are left out; other columns are ignored;
    no rows give no rows. Returns ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    signed = checkpoint(signatures(docs))
    reps = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("values").alias("values"), F.max("n_shingles").alias("n_shingles"))
    classes = connected_components(candidates(reps.select("rep", "values"))).withColumnRenamed("component", "class")
    long = classes.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sizes = long.groupBy("class").agg(F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / F.lit(float(ROW_SHINGLES)))).alias("members"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x) for x in batch.column(2).to_pylist()]
            prints = [(signature(s) % 255 + 1).astype(np.uint8).tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(prints, pa.binary())], names=["rep", "class", "members", "shingles", "prints"])

    wanted = classes.join(sizes, "class").select(F.col("node").alias("doc_id"), "class", "members")
    held = docs.join(wanted, "doc_id").select("doc_id", "class", "text", "members").mapInArrow(sets, "rep long, class long, members long, shingles binary, prints binary")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["class", "unit"]):
            rep = table.column("rep").to_numpy()
            shingles = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
                unit = units_of(table, a, b)
                confirm(unit, shingles[a:b], prints[a:b])
                if unit.links:
                    i, j = np.array(unit.links).T
                    left.append(rep[a:b][i])
                    right.append(rep[a:b][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    links = in_two_rounds(held, "class", "members", compare)
    components = connected_components(links).withColumnRenamed("node", "rep")
    classed = reps.select("set_key", "rep").join(components, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(classed, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: All pairs of documents that share a shingle, on full sets, and what links reach.
ORACLE_SQL = r"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
 e as materialized (select doc_id, unnest(s) as g from s), p as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 l as materialized (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)), u as materialized (select a, b from l union select b, a from l),
 r(node, root) as (select doc_id, doc_id from s union select u.b, r.root from r join u on u.a = r.node)
 select s.doc_id, len(s.s)::bigint as n_shingles, c.root as component_id, s.doc_id = c.root as kept from s join (select node, min(root) as root from r group by 1) c on c.node = s.doc_id"""
