"""Vectors of image contents: batches of bounded bytes into an encoder that is passed in, one table per dataset and model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of contents that an encoder gets at a time, unless one content alone is larger.
BATCH_BYTES = 64 << 20


class ContentEncoder(Protocol):
    """Contents to vectors, one row each; it may raise for contents that it can't read."""

    def __call__(self, contents: list[bytes]) -> np.ndarray: ...


def histogram_encoder(bins: int = 64) -> ContentEncoder:
    """How often each range of byte values occurs, of unit length: needs no model; empty contents can't be read."""

    def encode(contents: list[bytes]) -> np.ndarray:
        if not all(contents):
            raise ValueError("empty content")
        counts = np.array([np.bincount(np.frombuffer(c, np.uint8) // (256 // bins), minlength=bins) for c in contents], np.float64)
        return counts / np.linalg.norm(counts, axis=1, keepdims=True)

    return encode


def bounded(sizes: list[int], items: int, limit: int) -> Iterator[slice]:
    """Slices of at most ``items`` items and ``limit`` bytes together."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > limit or i - begin >= items):
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def readable(encoder: ContentEncoder, contents: list[bytes]) -> list[np.ndarray | None]:
    """The vectors of a batch; one that fails as a whole is halved until what can't be read stands alone."""
    try:
        got = np.asarray(encoder(contents), np.float64)
        return [v if np.isfinite(v).all() else None for v in got]
    except Exception:
        if len(contents) == 1:
            return [None]
        half = len(contents) // 2
        return readable(encoder, contents[:half]) + readable(encoder, contents[half:])


def encode_contents(files: DataFrame, make: Callable[[], ContentEncoder], batch: int = 32, batch_bytes: int = BATCH_BYTES, normalise: bool = True) -> DataFrame:
    """``files`` without ``content``, with ``vec`` and ``decode_ok``. ``make`` is called once per task: there the model is loaded.

    A content that is null or can't be read has a null vector and a false ``decode_ok``; it stops no other. Vectors are of unit
    length with ``normalise``. Bytes between the JVM and Python are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    kept = [f for f in files.schema if f.name != "content"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "vec array<double>, decode_ok boolean"])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encoder = make()
        for b in batches:
            column = b.column(b.schema.get_field_index("content"))
            sizes = [0 if n is None else n for n in pa.compute.binary_length(column).to_pylist()]
            for part in bounded(sizes, batch, batch_bytes):
                some = column.slice(part.start, part.stop - part.start).to_pylist()
                there = [c for c in some if c is not None]
                made = iter(readable(encoder, there) if there else [])
                vectors = [None if c is None else next(made) for c in some]
                if normalise:
                    vectors = [None if v is None else v / max(np.linalg.norm(v), 1e-12) for v in vectors]
                rows = b.slice(part.start, len(some))
                columns = [rows.column(b.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float64())), pa.array([v is not None for v in vectors])]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "vec", "decode_ok"])

    return files.select(*[f.name for f in kept], "content").mapInArrow(run, schema)


def with_contents(spark: SparkSession, registry: DataFrame, root: str, pattern: str = "*") -> DataFrame:
    """``registry`` (image_path, ...) with the files' contents, which meet their paths inside the executors; null for files that aren't there or are empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return registry.join(files.select(F.col("path").alias("image_path"), "content"), "image_path", "left")


def rewrite_features(features: DataFrame, path: str) -> None:
    """Write features by ``dataset``, ``model`` and, where there is one, ``feature_type``: only partitions that have rows here are replaced."""
    by = [c for c in ("dataset", "model", "feature_type") if c in features.columns]
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def feature_metadata(features: DataFrame) -> DataFrame:
    """(dataset, model, images, failed, feature_dim, splits): what a feature table says about itself; ``splits`` counts images by split."""
    keys = ["dataset", "model"]
    by_split = features.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("decode_ok")).alias("bad"), F.max(F.size("vec")).alias("dim"))
    splits = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("split", F.lit("")), "n"))))  # a dataset has few splits
    return by_split.groupBy(*keys).agg(F.sum("n").alias("images"), F.sum("bad").alias("failed"), F.max("dim").alias("feature_dim"), splits.alias("splits"))


def encode_datasets(spark: SparkSession, images: DataFrame, root: str, model: str, make: Callable[[], ContentEncoder], path: str, **options) -> DataFrame:
    """Encode the images (dataset, split, image_path, img_hash) below ``root`` and rewrite their datasets' partitions; gives :func:`feature_metadata`."""
    made = encode_contents(with_contents(spark, images, root), make, **options).withColumn("model", F.lit(model))
    rewrite_features(made, path)
    names = [r[0] for r in images.select("dataset").distinct().collect()]  # the few datasets of a run
    return feature_metadata(spark.read.parquet(path).where(F.col("dataset").isin(names) & (F.col("model") == model)))
