"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasframe.plans.checkpoints import checkpoint, ensure_checkpoint_dir, tables_folder

__all__ = [
    "checkpoint", "connected_components", "documents", "ensure_checkpoint_dir", "release_memory", "row_hash", "slices", "texts", "whole_groups", "with_blocks", "written",
]

#: SQL (DuckDB): the table of CRC-32, and the checksum of a list of byte values.
CRC_TABLE_SQL = """crc as (select list(c order by i) as tab from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)))"""
CRC_SQL = "xor(list_reduce(list_concat([4294967295::bigint], {bytes}), lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295)"

#: Rows of a slice of an Arrow batch that is turned into Python strings at once.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder of the shared checkpoint folder as Parquet, which takes far less room than a checkpoint of rows, and go on from there."""
    folder = f"{tables_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64-bit hash of the named columns (all). Maps can't be hashed, so columns that hold some are hashed as JSON text, where the order of a map's entries counts."""
    fields = [df.schema[c] for c in (df.columns if columns is None else columns)]
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in fields])


def release_memory() -> None:
    """Give freed memory back to the machine: Python workers live on after a task, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release_memory()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as strings; null becomes empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of a partition that is sorted by ``keys``, cut between groups: (rows, where each group starts)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            change |= values[1:] != values[:-1]
        starts = np.append(0, np.flatnonzero(change) + 1)
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)
    release_memory()


def with_blocks(df: DataFrame, key: list[str], members: Column, block_rows: int, ident: str) -> DataFrame:
    """Split large groups into pairs of blocks.

    A group of ``members`` rows is cut by a hash of ``ident`` into ceil(members / block_rows)
    blocks; every unordered pair of blocks is one unit of work (``block_a <= block_b``), and each row
    goes to the units its block belongs to with ``own`` naming its block. A group of one block
    yields one unit and no copies, so every pair of rows of a group meets in exactly one unit if
    a unit compares across its two blocks (or within its only one).
    """
    n = F.greatest(F.lit(1), F.ceil(members / F.lit(float(block_rows))).cast("int"))
    own = F.pmod(F.xxhash64(F.col(ident), F.lit(17)), n.cast("long")).cast("int")
    staged = df.withColumn("_n", n).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return (
        staged.select("*", other.alias("_other"))
        .withColumn("block_a", F.least("own", "_other"))
        .withColumn("block_b", F.greatest("own", "_other"))
        .drop("_n", "_other")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id that links reach, for every node of ``edges`` (``a``, ``b`` longs).

    Alternating large-star and small-star rounds: each node hangs its larger neighbours on the
    smallest one it knows, then its smaller neighbours likewise, until the edges are stars. Each half is
    one map-side combined minimum and one join, so a node with very many links is spread over tasks
    (skew joins are split at run time). Every round is cut by a checkpoint. Returns ``node``, ``component``;
    nodes without links don't appear; self-links and repeated links change nothing; no links, no rows.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        e = checkpoint(small.select("x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
