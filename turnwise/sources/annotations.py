"""Annotation files as the canonical ``queries`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.functions import text
from turnwise.operators.durable import cut
from turnwise.sources.schemas import QUERIES

CAPTION_MODES = ("separate", "combined", "first_only")


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array, with ``pos``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("pos", "row")).select(F.col("pos").cast("long").alias("pos"), "row.*")


def as_queries(df: DataFrame) -> DataFrame:
    """``df`` with the columns of ``queries``; those that it lacks are null."""
    wanted = StructType.fromDDL(QUERIES)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def _hash_or_name(id_: Column, found: Column) -> Column:
    return F.coalesce(found, text.padded_id(id_, 12, ".jpg"))


def circo_queries(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """From (pos, id, reference_img_id, target_img_id, gt_img_ids, relative_caption, shared_concept).

    ``hashes`` (image_id, img_hash) turns numeric ids into content hashes; an unknown id becomes a 12-digit file name.
    """
    known = hashes.select(F.col("image_id").cast("long").alias("image_id"), "img_hash").dropDuplicates(["image_id"])
    find = lambda name: known.select(F.col("image_id").alias(f"__{name}"), F.col("img_hash").alias(f"__{name}_hash"))
    one = rows.join(find("r"), F.col("reference_img_id") == F.col("__r"), "left").join(find("t"), F.col("target_img_id") == F.col("__t"), "left")
    gt = rows.select("pos", F.posexplode("gt_img_ids").alias("i", "gt")).join(find("g"), F.col("gt") == F.col("__g"), "left")
    gt = gt.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("i", _hash_or_name(F.col("gt"), F.col("__g_hash")).alias("h")))).alias("gts"))
    return as_queries(
        one.join(gt, "pos", "left").select(
            F.lit("circo").alias("dataset"),
            "pos",
            F.col("id").cast("string").alias("query_id"),
            _hash_or_name(F.col("reference_img_id"), F.col("__r_hash")).alias("reference_image_id"),
            _hash_or_name(F.col("target_img_id"), F.col("__t_hash")).alias("target_image_id"),
            "relative_caption",
            F.coalesce(F.transform("gts", lambda x: x["h"]), F.array().cast("array<string>")).alias("ground_truth_ids"),
            "shared_concept",
            F.col("reference_img_id").cast("string").alias("original_reference_id"),
            F.col("target_img_id").cast("string").alias("original_target_id"),
            F.col("gt_img_ids").cast("array<string>").alias("original_gt_ids"),
        )
    )


def read_circo(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    return circo_queries(_rows(spark, path, "id:long,reference_img_id:long,target_img_id:long,gt_img_ids:array<long>,relative_caption:string,shared_concept:string"), hashes)


def cirr_queries(rows: DataFrame) -> DataFrame:
    """From (pos, reference, target_hard, caption, pairid, id): one hard target is the ground truth."""
    return as_queries(
        rows.select(
            F.lit("cirr").alias("dataset"),
            "pos",
            F.coalesce("pairid", "id", F.lit(0)).cast("string").alias("query_id"),
            F.col("reference").alias("reference_image_id"),
            F.col("target_hard").alias("target_image_id"),
            F.col("caption").alias("relative_caption"),
            F.array("target_hard").alias("ground_truth_ids"),
        )
    )


def read_cirr(spark: SparkSession, path: str) -> DataFrame:
    return cirr_queries(_rows(spark, path, "reference:string,target_hard:string,caption:string,pairid:long,id:long"))


def fashioniq_queries(rows: DataFrame, mode: str = "separate") -> DataFrame:
    """From (pos, target, candidate, captions); blank captions don't count, and rows without others give nothing.

    ``separate`` gives a row per caption, ``combined`` joins them, ``first_only`` takes the first. Ids run through the
    rows given, in order.
    """
    if mode not in CAPTION_MODES:
        raise ValueError(f"mode is one of {CAPTION_MODES}")
    valid = rows.withColumn("valid", text.valid_captions(F.col("captions"))).where("size(valid) > 0")
    if mode == "separate":
        flat = valid.select("*", F.posexplode("valid").alias("caption_index", "relative_caption"))
    else:
        caption = text.join_english(F.col("valid")) if mode == "combined" else F.get("valid", F.lit(0))
        flat = valid.withColumn("relative_caption", caption).withColumn("caption_index", F.lit(0 if mode == "first_only" else None).cast("int"))
    numbered = running_number(flat, ["pos", "caption_index"], "query_id")
    return as_queries(
        numbered.select(
            F.lit("fashioniq").alias("dataset"),
            F.col("query_id").alias("pos"),
            F.col("query_id").cast("string").alias("query_id"),
            F.col("candidate").alias("reference_image_id"),
            F.col("target").alias("target_image_id"),
            "relative_caption",
            F.array("target").alias("ground_truth_ids"),
            "caption_index",
            F.col("captions").alias("original_captions"),
            F.col("valid").alias("valid_captions"),
        )
    )


def running_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in order, without gathering them in one task.

    Rows are range-partitioned and sorted; each partition's count is collected (one number each), and a row's number is
    its place in its partition plus the counts before it.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    start = F.create_map([F.lit(x) for p, n in offsets.items() for x in (p, n)])
    return placed.withColumn(name, F.element_at(start, part) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def read_fashioniq(spark: SparkSession, path: str, mode: str = "separate") -> DataFrame:
    return fashioniq_queries(_rows(spark, path, "target:string,candidate:string,captions:array<string>"), mode)
