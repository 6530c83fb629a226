"""Places of rows within their keys, and what is made of them, without gathering a key in one task or one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.durable import cut


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``rows`` with ``name``, from 0 on in ``order`` within each of ``keys``; nulls are a key like others and come first.

    Rows are cut into ranges of keys and order, sorted and written, so a key with a third of all rows is in many tasks. A row's number is its place in
    its range, less that of its key's first row there, plus what the key has in earlier ranges: one count per range and key,
    added up by a window over as many rows as a key has ranges. Rows equal in ``keys`` and ``order`` stay in one range.
    """
    placed = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    held = placed.groupBy(*named, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("__shift", before - F.col("__first")).drop("__first", "__n").withColumnRenamed("__part", "__p")
    same = part == F.col("__p")
    for i, k in enumerate(keys):
        same &= placed[k].eqNullSafe(F.col(f"__k{i}"))
    return placed.join(held, same).withColumn(name, F.col("__at") + F.col("__shift")).select(*rows.columns, name)


def index_runs(items: DataFrame, key: str, index: str) -> DataFrame:
    """(key, run, first, last): the indexes of each key as runs of consecutive numbers, numbered from 0.

    An index minus its place among its key's is the same all along a run, so runs are an aggregation that is combined before
    the shuffle. A key's list is as many rows as it has gaps; repeated and null indexes don't count.
    """
    own = items.where(F.col(index).isNotNull()).select(F.col(key), F.col(index).cast("long").alias("__index")).distinct()
    placed = numbered_within(own, [key], ["__index"], "__nth")
    found = placed.groupBy(key, (F.col("__index") - F.col("__nth")).alias("__gap")).agg(F.min("__index").alias("first"), F.max("__index").alias("last")).drop("__gap")
    return numbered_within(found, [key], ["first"], "run").select(key, "run", "first", "last")


def duplicate_chunks(items: DataFrame, chunk: int = 1000, hash_col: str = "img_hash", path: str = "image_path", order: str = "pos") -> DataFrame:
    """(hash, path, chunk, duplicate_paths): the first path of each content, and its copies in lists of at most ``chunk``.

    A content without copies has one row with an empty list. However many copies one content has, no list, task or group grows beyond
    ``chunk``.
    """
    placed = numbered_within(items.where(F.col(hash_col).isNotNull()).select(hash_col, path, order), [hash_col], [order, path], "__nth")
    nth = F.col("__nth")
    of = F.when(nth > 0, F.call_function("div", nth - 1, F.lit(chunk))).otherwise(F.lit(0).cast("long"))
    copy = F.when(nth > 0, F.struct(nth.alias("n"), F.col(path).alias("p")))
    lists = placed.groupBy(hash_col, of.alias("chunk")).agg(F.array_sort(F.collect_list(copy))["p"].alias("duplicate_paths"))
    first = placed.where(nth == 0).select(hash_col, path)
    return lists.join(first, hash_col).select(hash_col, path, "chunk", "duplicate_paths")


def fan_out_chunks(captions: DataFrame, chunks: DataFrame, path: str = "image_path", salts: int = 64) -> DataFrame:
    """``captions`` of representatives, and the same for each of their copies (see :func:`duplicate_chunks`).

    A representative with many chunks meets them in up to ``salts`` parts; one with a single chunk isn't repeated.
    """
    some = chunks.where(F.size("duplicate_paths") > 0)
    parts = some.groupBy(F.col(path).alias("__rep")).agg(F.least(F.count(F.lit(1)), F.lit(salts)).cast("int").alias("__parts"))
    asked = captions.join(parts, captions[path] == parts["__rep"]).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop(path, "__parts")
    told = some.join(parts.withColumnRenamed("__rep", "__own"), F.col(path) == F.col("__own"))
    told = told.select("__own", (F.col("chunk") % F.col("__parts")).cast("int").alias("__own_salt"), F.col("duplicate_paths").alias("__dups"))
    copies = asked.join(told, (F.col("__rep") == F.col("__own")) & (F.col("__salt") == F.col("__own_salt"))).withColumn(path, F.explode("__dups"))
    return captions.unionByName(copies.select(*captions.columns))
