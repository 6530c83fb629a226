"""Captions and vectors: readers of the two file forms, tables, and key normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators.dedupe import last_by, merge_by_priority
from turnwise.operators.durable import exists


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, image_key, caption) of a JSON file, be it a map of captions or a list of objects with ``image_id`` or ``id``.

    A folder that :func:`export_caption_map` has written is read line by line, by many tasks; a file is one row of one task.
    """
    if exists(spark, f"{path}/_SUCCESS"):
        lines = spark.read.schema("image_key string, caption string").json(path)
        return lines.select(F.monotonically_increasing_id().alias("pos"), "image_key", "caption")
    whole = spark.read.text(path, wholetext=True)
    as_map = F.map_entries(F.from_json("value", "map<string,string>"))
    as_list = F.from_json("value", "array<struct<image_id:string,id:string,caption:string>>")
    is_list = F.ltrim("value").startswith("[")
    mapped = whole.where(~is_list).select(F.posexplode(as_map).alias("pos", "e")).select("pos", F.col("e.key").alias("image_key"), F.col("e.value").alias("caption"))
    listed = whole.where(is_list).select(F.posexplode(as_list).alias("pos", "e")).select("pos", F.coalesce("e.image_id", "e.id").alias("image_key"), F.col("e.caption").alias("caption"))
    return mapped.unionByName(listed)


def reference_captions(sources: list[DataFrame], coco: DataFrame | None = None) -> DataFrame:
    """(image_key, caption): later sources override earlier ones; COCO captions (image_id, caption) only fill gaps."""
    ranked = list(reversed(sources))
    if coco is not None:
        ranked.append(coco.select(text.padded_id(F.col("image_id"), 6, ".jpg").alias("image_key"), "caption"))
    return merge_by_priority([s.select("image_key", "caption") for s in ranked], "image_key")


def read_coco_captions(spark: SparkSession, path: str) -> DataFrame:
    schema = "annotations array<struct<image_id:long,caption:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("annotations"))


def export_caption_map(captions: DataFrame, path: str) -> None:
    """One JSON object a line, ``{"image_key": ..., "caption": ...}``, in as many files as there are partitions."""
    captions.select("image_key", "caption").write.mode("overwrite").json(path)


def by_stem(features: DataFrame) -> DataFrame:
    """(image_key, vec) with keys cut to the file's stem; on collision the last row (by ``pos``) wins."""
    return last_by(features.select(text.stem(F.col("image_key")).alias("image_key"), "pos", "vec"), "image_key", "pos")


def with_aliases(features: DataFrame, hashes: DataFrame) -> DataFrame:
    """(image_key, vec) under stems, stems with ``.jpg``, and content hashes."""
    stems = by_stem(features).select("image_key", "vec")
    jpg = stems.select(F.concat("image_key", F.lit(".jpg")).alias("image_key"), "vec")
    known = hashes.select(text.strip_zeros(text.stem(F.col("image_id"))).alias("__id"), "img_hash").distinct()
    hashed = stems.join(known, text.strip_zeros(F.col("image_key")) == F.col("__id")).select(F.col("img_hash").alias("image_key"), "vec")
    return merge_by_priority([stems, jpg, hashed], "image_key")


def write_features(features: DataFrame, path: str) -> None:
    """A feature table, partitioned for pruning by dataset, model and, where there is one, feature type."""
    by = [c for c in ("dataset", "model", "feature_type") if c in features.columns]
    features.write.mode("append").partitionBy(*by).parquet(path)


def read_features(spark: SparkSession, path: str, dataset: str | None = None, model: str | None = None) -> DataFrame:
    """Lazy; both selections prune partitions."""
    df = spark.read.parquet(path)
    for name, value in (("dataset", dataset), ("model", model)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def features_of(features: DataFrame, images: DataFrame, split: str | None = None, category: str | None = None) -> DataFrame:
    """The ``features`` (img_hash, ...) of the images (split, category, img_hash) of a split or category."""
    for name, value in (("split", split), ("category", category)):
        if value is not None:
            images = images.where(F.col(name) == value)
    return features.join(images.select("img_hash"), "img_hash", "left_semi")


def feature_width(features: DataFrame) -> int | None:
    """The width that vectors have, measured."""
    got = features.select(F.size("vec")).limit(1).collect()
    return got[0][0] if got else None


def from_vector_map(rows: DataFrame) -> DataFrame:
    """(pos, image_key, vec) from rows whose ``features`` is a map of vectors by key: the older file form."""
    return rows.select(F.posexplode(F.map_entries("features")).alias("pos", "e")).select("pos", F.col("e.key").alias("image_key"), F.col("e.value").alias("vec"))
