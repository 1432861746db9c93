"""Embedding near-dedup by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.llm.common import connected_components, slices, whole_groups, with_blocks, written

TREES = 5
LEAF_ROWS = 384
#: Numbers (rows times dimensions) of the sample on which the split points are fitted; every row is indexed.
SAMPLE_NUMBERS = 4_000_000
#: Half the width of the overlap at a split, in standard deviations of the difference of a pair at the threshold.
SPILL = 0.5
#: A node is split only if each side gets at most this share of it: where vectors lie about as far apart as linked ones, splits
#: would mostly copy them, and a larger leaf costs less.
SIDE = 0.62
#: Rows of a block of a leaf that wasn't split further, and rows of it that are compared at once.
BLOCK_ROWS, TILE_ROWS = 4096, 512


class Forest:
    """Trees whose inner nodes halve a random projection at the sample's median; rows near it go to both sides."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        self.dim = sample.shape[1]
        self.margin = SPILL * math.sqrt(2 - 2 * threshold) / math.sqrt(self.dim)
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.leaves = 0
        least = max(8, leaf_rows * len(sample) / max(rows, 1))
        rng = np.random.default_rng(seed)
        self.roots = [self._grow(sample, least, rng, 40) for _ in range(trees)]

    def _grow(self, points: np.ndarray, least: float, rng: np.random.Generator, depth: int) -> int:
        if len(points) > least and depth:
            for _ in range(3):
                direction = rng.normal(size=self.dim)
                direction /= np.linalg.norm(direction)
                at = points @ direction
                cut = float(np.median(at))
                left, right = points[at <= cut + self.margin], points[at >= cut - self.margin]
                if max(len(left), len(right)) < SIDE * len(points):
                    node = len(self.nodes)
                    self.nodes.append(None)
                    self.nodes[node] = (direction, cut, self._grow(left, least, rng, depth - 1), self._grow(right, least, rng, depth - 1))
                    return node
        self.leaves += 1
        return -self.leaves

    def cells(self, points: np.ndarray) -> list[np.ndarray]:
        """The leaves that each row reaches, over all trees, ascending; single precision will do on the way down."""
        points = points.astype(np.float32)
        rows, leaves, open_ = [], [], [(root, np.arange(len(points))) for root in self.roots]
        while open_:
            node, index = open_.pop()
            if not len(index):
                continue
            if node < 0:
                rows.append(index)
                leaves.append(np.full(len(index), -node, np.int64))
                continue
            direction, cut, left, right = self.nodes[node]
            at = points[index] @ direction.astype(np.float32)
            open_ += [(left, index[at <= cut + self.margin]), (right, index[at >= cut - self.margin])]
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return np.split(leaf[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(points)))[:-1])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Memberships:
    """The cells of some rows: all cells in a row, and where each row's begin."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        self.flat, self.bounds = flat, bounds

    def take(self, rows: np.ndarray) -> Memberships:
        sizes = np.diff(self.bounds)[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.bounds[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Memberships(self.flat[at], np.append(0, ends))

    def matrix(self, columns: np.ndarray) -> np.ndarray:
        """Rows by cells of ``columns`` (ascending): is the row in the cell?"""
        row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        at = np.minimum(np.searchsorted(columns, self.flat), len(columns) - 1)
        hit = columns[at] == self.flat
        out = np.zeros((len(self.bounds) - 1, len(columns)), np.float32)
        out[row[hit], at[hit]] = 1
        return out


def linked_pairs(x: np.ndarray, y: np.ndarray, cells_x: Memberships, cells_y: Memberships, cell: int, threshold: float, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at or over the threshold that meet in no earlier cell than ``cell``, so that each is found once.

    ``first``: if rows of ``x`` are those of ``y`` from there on, only pairs with a later row of ``y`` count.
    """
    i, j = np.nonzero(x @ y.T >= threshold)
    if first is not None:
        later = i + first < j
        i, j = i[later], j[later]
    if not len(i):
        return i, j
    ui, i_at = np.unique(i, return_inverse=True)
    uj, j_at = np.unique(j, return_inverse=True)
    of_i, of_j = cells_x.take(ui), cells_y.take(uj)
    earlier = np.intersect1d(of_i.flat[of_i.flat < cell], of_j.flat[of_j.flat < cell])
    if len(earlier):
        fresh = (of_i.matrix(earlier) @ of_j.matrix(earlier).T == 0)[i_at, j_at]
        i, j = i[fresh], j[fresh]
    return i, j


class Union:
    """Smallest row that links reach within a unit; links come in parts."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


def link_embeddings(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Near-duplicate classes of ``vectors`` (``vec_id`` long, ``embedding`` array of numbers) by cosine.

    Equal vectors (by a hash of 96 bits) are one row with a weight. The split points of the trees are fitted on a bounded sample, every vector
    goes down all trees, and all vectors of a leaf are compared in double precision. A pair counts in the first leaf that holds both. Leaves
    that hold more than a block are compared by pairs of blocks, so no task holds a whole hot leaf; tasks give back
    sums and one link per vector, not pairs. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different dimensions. Repeated rows of one ``vec_id`` count as one (the smallest vector); rows without id are left out; ties at the threshold link; vectors may be of any length; other
    columns are ignored; no rows give no rows. Returns ``vec_id``, ``n_links``, ``component_id``, ``kept``.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)  # their own width is enough on the way
    array = "array<float>" if single else "array<double>"
    one = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(array).alias("embedding")).where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    one = written(one.withColumn("_sound", F.coalesce(sound, F.lit(False))).withColumn("_h", F.xxhash64("embedding")).withColumn("_g", F.hash("embedding")))
    classes = one.where("_sound").groupBy("_h", "_g").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("dim", F.size("embedding")))
    forests = {}
    for dim, n in classes.groupBy("dim").count().collect():  # one row for each dimension in use
        rows = max(1000, SAMPLE_NUMBERS // dim)
        drawn = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(-(-n // rows))) == 0))
        sample = drawn.select("embedding").limit(2 * rows).toArrow()
        forests[dim] = Forest(matrix(sample.column("embedding")), n, threshold, trees, leaf_rows)
    given = spark.sparkContext.broadcast(forests)

    key = ["dim", "cell", "block_a", "block_b"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            table = pa.Table.from_batches([batch])
            for dim in set(table.column("dim").to_pylist()):
                part = table.filter(pa.compute.equal(table.column("dim"), dim))
                cells = given.value[dim].cells(matrix(part.column("embedding")))
                out = part.append_column("cells", pa.array(cells, pa.list_(pa.int32())))
                yield from out.combine_chunks().to_batches()

    routed = written(classes.select("embedding", "rep", "weight", "dim").mapInArrow(route, f"embedding {array}, rep long, weight long, dim int, cells array<int>"))
    # Cells that need blocks; Spark sends this table to all tasks only while it is small.
    large = written(routed.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("_members")).where(f"_members > {BLOCK_ROWS}"))
    placed = routed.withColumn("cell", F.explode("cells")).join(large, ["dim", "cell"], "left")
    units = with_blocks(placed, ["dim", "cell"], F.coalesce("_members", F.lit(1)), BLOCK_ROWS, "rep").drop("_members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, key):
            lists = table.column("cells").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = lists.offsets.to_numpy()
            cells = Memberships(lists.flatten().to_numpy(), (offsets - offsets[0]).astype(np.int64))
            side, block_a, block_b, cell, rep, weight = (table.column(c).to_numpy() for c in ("own", "block_a", "block_b", "cell", "rep", "weight"))
            out = []
            for start, end in zip(starts, np.append(starts[1:], table.num_rows)):
                x = matrix(table.column("embedding").slice(start, end - start))
                own, a, b = side[start:end], block_a[start], block_b[start]
                left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
                name, w = rep[start:end], weight[start:end]
                order = np.argsort(name)
                union, links = Union(len(name)), np.zeros(len(name))
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                for t in range(0, len(left), TILE_ROWS):
                    tile = left[t : t + TILE_ROWS]
                    i, j = linked_pairs(x[tile], x[right], cells.take(start + tile), cells.take(start + right), cell[start], threshold, t if a == b else None)
                    if len(i):
                        i, j = tile[i], right[j]
                        union.join(place[i], place[j])
                        links += np.bincount(i, w[j], len(name)) + np.bincount(j, w[i], len(name))
                if links.any():
                    label = name[order][union.root][place]
                    hit = np.flatnonzero(links)
                    out.append((name[hit], links[hit].astype(np.int64), label[hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "links", "leader"])

    units = units.repartition(*key).sortWithinPartitions(*key)
    found = written(units.mapInArrow(compare, "rep long, links long, leader long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("leader").alias("b"))).withColumnRenamed("node", "rep")
    classed = classes.join(links, "rep", "left").join(components, "rep", "left").select(
        "_h", "_g", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    of = F.when(F.col("_sound"), F.col("_h")).alias("_h")  # others meet no class
    return one.select("vec_id", of, "_g").join(classed, ["_h", "_g"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept")
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of vectors, in double precision, and what links reach.
ORACLE_SQL = """with recursive v as materialized (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95), n as (select a, count(*) as n from u group by 1),
 r(node, root) as (select vec_id, vec_id from embeddings union select u.b, r.root from r join u on u.a = r.node)
 select node as vec_id, coalesce(any_value(n.n), 0) as n_links, min(root) as component_id, node = min(root) as kept from r left join n on n.a = node group by node"""
