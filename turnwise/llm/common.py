"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors are one process, may do without: it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, so that a lost executor costs no recomputation.

    ``checkpoint()`` is eager and replicated by the shared file system; the context cleaner removes the files
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Like :func:`cut`, but as a compressed Parquet table: for wide intermediate results."""
    return _written(df, _new_path(df.sparkSession, what))


def _new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared folder, deleted when the block ends; what :meth:`kept` writes stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(_new_path(self.spark, what))
        return _written(df, self.paths[-1])

    def kept(self, df: DataFrame, what: str) -> DataFrame:
        """A result that outlives the block: it must not be read from what the block deletes."""
        return stored(df, what)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table by the file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches in slices of few rows, so that what is made of long texts is handed on soon."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
