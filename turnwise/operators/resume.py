"""Restartable batches: what is done already is left out by anti-joins, results are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.dedupe import fan_out


def signature(dataset: str, separate_captions: bool = True) -> list[Column]:
    """What makes a query of ``dataset`` the same query in a later run."""
    if dataset == "fashioniq" and separate_captions:
        return [F.col("reference_image_id"), F.col("target_image_id"), F.col("relative_caption")]
    if dataset == "circo":
        return [F.col("reference_image_id"), F.array_join(F.array_sort("ground_truth_ids"), "\x1f")]
    return [F.col("reference_image_id"), F.col("target_image_id")]


def remaining(queries: DataFrame, done: DataFrame, key: list[Column]) -> DataFrame:
    """Queries without a result. Null parts of a key are equal to each other."""
    names = [f"__k{i}" for i in range(len(key))]
    left, right = queries.withColumns(dict(zip(names, key, strict=True))), done.select(*[k.alias(n) for k, n in zip(key, names, strict=True)]).distinct()
    on = [left[n].eqNullSafe(right[n]) for n in names]
    return left.join(right, on, "left_anti").drop(*names)


def done_keys(sessions: DataFrame) -> DataFrame:
    """Sessions as finished queries: the caption that a session began with stands in ``original_query``."""
    return sessions.withColumn("relative_caption", F.col("original_query"))


def missing(items: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't there yet."""
    return items.join(have.select(key).distinct(), key, "left_anti")


def append_missing(have: DataFrame, items: DataFrame, key: str, make) -> DataFrame:
    """``have`` with what ``make`` gives for the items that it lacks; stale rows stay."""
    return have.unionByName(make(missing(items, have, key)).select(*have.columns))


def finish_captions(captions: DataFrame, groups: DataFrame, path: str = "image_path") -> DataFrame:
    """Captions of all paths, duplicates included, whether or not anything new was made."""
    return fan_out(captions, groups, path).dropDuplicates([path])


def first_n(queries: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` by ``pos``: for trial runs, taken after finished ones are left out."""
    return queries.orderBy("pos").limit(n)
