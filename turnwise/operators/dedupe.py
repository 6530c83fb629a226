"""Content deduplication, fan-out and last-wins reduction. All are partial aggregations: a hot key costs one row a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """Of the rows of each key the first in ``order``."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*orders) if len(orders) > 1 else F.col(orders[0])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def last_by(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """Of the rows of each key the last in ``order``: what writing them into a dict would leave."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*orders) if len(orders) > 1 else F.col(orders[0])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def content_hash(content: Column) -> Column:
    return F.md5(content)


def dedupe_content(items: DataFrame, hash_col: str = "img_hash", order: str = "pos") -> DataFrame:
    """The first item of each content hash represents it."""
    return first_by(items.where(F.col(hash_col).isNotNull()), hash_col, order)


def dedupe_with_duplicates(items: DataFrame, hash_col: str = "img_hash", path: str = "image_path", order: str = "pos") -> DataFrame:
    """(hash, path, duplicate_paths): the first path of each content, and the others in order.

    The paths of one content are an array in one row, as the caption store wants it; for contents with unbounded numbers
    of copies use :func:`representatives`, which keeps one row per path.
    """
    ordered = F.sort_array(F.collect_list(F.struct(order, path)))
    got = items.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(ordered.alias("all"))
    paths = F.transform("all", lambda x: x[path])
    return got.select(hash_col, F.get(paths, F.lit(0)).alias(path), F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))).alias("duplicate_paths"))


def representatives(items: DataFrame, hash_col: str = "img_hash", path: str = "image_path", order: str = "pos") -> DataFrame:
    """``items`` with ``representative``, the first path of the same content."""
    rep = items.groupBy(hash_col).agg(F.min_by(path, order).alias("representative"))
    return items.join(rep, hash_col)


def fan_out(captions: DataFrame, groups: DataFrame, path: str = "image_path") -> DataFrame:
    """Captions of representatives, and the same for each of their duplicate paths."""
    extra = groups.select(F.col(path).alias("__rep"), F.explode("duplicate_paths").alias("__dup"))
    copies = captions.join(extra, captions[path] == extra["__rep"]).drop(path, "__rep").withColumnRenamed("__dup", path)
    return captions.unionByName(copies.select(*captions.columns))


def merge_by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of ``sources``; where a key stands in several, the earliest source's row wins."""
    ranked = [s.withColumn("__priority", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s)
    return first_by(out, key, "__priority").drop("__priority")
