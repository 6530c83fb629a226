"""Which ids that annotations need are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def needed_ids(queries: DataFrame) -> DataFrame:
    """(role, image_id): distinct ids of references, targets and ground truths."""
    role = lambda name, col: queries.select(F.lit(name).alias("role"), col.alias("image_id"))
    both = role("reference", F.col("reference_image_id")).unionByName(role("target", F.col("target_image_id")))
    return both.unionByName(role("ground_truth", F.explode("ground_truth_ids"))).where("image_id IS NOT NULL").distinct()


def missing_by_role(queries: DataFrame, available: DataFrame) -> DataFrame:
    """(role, needed, missing) by anti-join, in one aggregation."""
    there = available.select("image_id", F.lit(True).alias("__there")).distinct()
    got = needed_ids(queries).join(there, "image_id", "left")
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("needed"), F.count_if(F.col("__there").isNull()).alias("missing"))


def processable(queries: DataFrame, available: DataFrame) -> DataFrame:
    """The queries all of whose images are there."""
    needs = F.array_distinct(F.array_compact(F.concat(F.coalesce("ground_truth_ids", F.array().cast("array<string>")), F.array("reference_image_id", "target_image_id"))))
    lacking = queries.select("query_id", F.explode(needs).alias("image_id")).join(available.select("image_id").distinct(), "image_id", "left_anti").select("query_id").distinct()
    whole = queries.where("reference_image_id IS NOT NULL AND target_image_id IS NOT NULL AND size(ground_truth_ids) > 0")
    return whole.join(lacking, "query_id", "left_anti")
