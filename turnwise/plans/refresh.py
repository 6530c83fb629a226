"""Incremental runs: captions for what has none yet, vectors for captions that have none yet."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators import digests, resume
from turnwise.operators.durable import cut, exists, stored
from turnwise.plans import models

log = logging.getLogger(__name__)


def to_caption(registry: DataFrame, have: DataFrame) -> DataFrame:
    """(image_path, category, image_index): what has no caption yet."""
    todo = resume.missing(registry, have, "image_path").select("image_path").distinct()
    return todo.withColumn("category", text.category_from_path(F.col("image_path"))).withColumn("image_index", F.monotonically_increasing_id())


def caption_images(registry: DataFrame, have: DataFrame, make: Callable[[], Callable[[str, str], dict]], **limits) -> tuple[DataFrame, DataFrame]:
    """(calls, captions): calls for the representatives without a caption, and captions of all paths, copies included.

    ``registry`` (image_path, duplicate_paths), ``have`` (image_path, caption). Calls are written before anything reads them, so each is made once.
    For jobs that may be stopped see :func:`turnwise.streaming.captions.caption_job`.
    """
    calls = stored(models.call_captioner(to_caption(registry, have), make, **limits), "calls")
    made = calls.where("success").select("image_path", "caption")
    return calls, resume.finish_captions(have.unionByName(made), registry)


def refresh_vectors(captions: DataFrame, have: DataFrame, make: Callable[[], models.Encoder], feature_type: str, force: bool = False, batch: int = 32) -> DataFrame:
    """``have`` (image_key, feature_type, vec) with vectors for captions that lack one; ``force`` makes all anew."""
    def encode(items: DataFrame) -> DataFrame:
        return models.encode_column(items.select("image_key", "caption"), "caption", make, batch).select("image_key", F.lit(feature_type).alias("feature_type"), "vec")

    own = have.where(F.col("feature_type") == feature_type)
    return encode(captions) if force else resume.append_missing(own, captions, "image_key", encode)


def refresh_saved(captions: DataFrame, path: str, make: Callable[[], models.Encoder], feature_type: str, force: bool = False, batch: int = 32) -> str:
    """Bring the vectors saved at ``path`` (pos, image_key, feature_type, vec) up to ``captions`` (pos, image_key, caption), and say what was done.

    ``complete``: the saved list has the same ids in the same order; two digests tell, no list is compared. ``extended``:
    vectors for missing ids were appended, what is no longer asked for stays. ``kept``: other ids or another order, but none is missing. ``made``: there
    was nothing, or ``force``. ``made anew``: what is there can't be read. Appended rows come behind the saved ones in ``pos``.
    """
    spark = captions.sparkSession

    def write(items: DataFrame, mode: str) -> None:
        models.encode_column(items.select("pos", "image_key", "caption"), "caption", make, batch).select("pos", "image_key", F.lit(feature_type).alias("feature_type"), "vec").write.mode(mode).partitionBy("feature_type").parquet(path)

    spark_path = f"{path}/feature_type={feature_type}"
    if force or not exists(spark, spark_path):
        _replace(spark, lambda: write(captions, "overwrite"))
        return "made"
    try:
        saved = spark.read.parquet(spark_path)
        last = saved.agg(F.max("pos"), F.count("vec")).first()[0]
        same = digests.ordered_digest(saved, "pos", "image_key") == digests.ordered_digest(captions, "pos", "image_key")
    except Exception as e:  # whatever a broken file raises, in the driver or in a task
        log.warning("saved vectors at %s can't be read, all are made anew: %s", spark_path, str(e).split("\n")[0])
        _replace(spark, lambda: write(captions, "overwrite"))
        return "made anew"
    if same:
        return "complete"
    new = cut(resume.missing(captions, saved, "image_key").withColumn("pos", F.col("pos") + F.lit(0 if last is None else last + 1)))
    if new.isEmpty():
        return "kept"
    write(new, "append")
    return "extended"


def _replace(spark: SparkSession, write: Callable[[], None]) -> None:
    """Overwrite only the partitions that are written."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        write()
    finally:
        spark.conf.set(key, before)


def progress(items: DataFrame, have: DataFrame, key: str) -> dict:
    """How many there are, and how many are still missing."""
    left = resume.missing(items, have, key).count()
    total = items.count()
    return {"total": total, "done": total - left, "remaining": left, "done_pct": 100.0 * (total - left) / total if total else 0.0}
