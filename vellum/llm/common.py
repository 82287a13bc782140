"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder of its own; on a cluster, whose
    executors couldn't read such a folder, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = "file://" + tempfile.mkdtemp(prefix="spark-vellum-")
        found = _own[application]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, below one folder per application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage with a real copy: a lost executor costs a reread, never a recomputation
    of what came before, and every reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, what)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Remove what :func:`materialise` stored; nothing that is still to be computed may read it."""
    for df in stored:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text modulo ``modulus``: which fold a row belongs to. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))
