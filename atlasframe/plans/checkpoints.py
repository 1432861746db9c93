"""Cutting the lineage of iterative plans in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; a temporary one only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="atlasframe-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, whatever kind it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tables_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: below the checkpoint folder, or in the scratch folder in use."""
    ensure_checkpoint_dir(spark)
    return _scratch.get() or spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there: packed by columns, it takes a fraction of a checkpoint, but forgets how rows were partitioned."""
    folder = f"{tables_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: The scratch folder in use; other threads have their own.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside are deleted at the end, when nothing reads them any more."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        delete_folder(spark, folder)
