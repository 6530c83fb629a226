"""Lookups through ordered alternative spellings, and plain ones with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators.durable import cut


def image_spellings(id_: Column) -> Column:
    """The id, its file name, its stem, and with or without an image extension: in the order in which they are tried."""
    name = text.basename(id_)
    bare = text.drop_extension(name)
    has = text.has_image_extension(id_)
    more = F.when(has, F.array(text.drop_extension(id_))).otherwise(F.array(F.concat(id_, F.lit(".png")), F.concat(id_, F.lit(".jpg"))))
    return F.array_distinct(F.concat(F.array(id_), F.when(id_.contains("/"), F.array(name, bare)).otherwise(F.array().cast("array<string>")), more))


def caption_spellings(id_: Column) -> Column:
    return F.array_distinct(F.array(id_, F.concat(id_, F.lit(".jpg")), text.stem(id_)))


def first_match(rows: DataFrame, key: str, spellings: Column, table: DataFrame, table_key: str, order: str | None = None) -> DataFrame:
    """``rows`` left-joined to ``table`` by the first of ``spellings`` that it has; ``rows`` has one row per ``key``.

    Alternatives become rows, meet the table in one equi-join, and an aggregation keeps the best: no nested loop, and
    no row is compared with more than its own spellings.
    """
    tried = rows.select(F.col(key).alias("__key"), F.posexplode(spellings).alias("__priority", "__spelling")).distinct()
    values = [c for c in table.columns if c != table_key]
    hits = tried.join(table.withColumnRenamed(table_key, "__spelling"), "__spelling")
    rank = F.struct("__priority", order) if order else F.struct("__priority")
    best = hits.groupBy("__key").agg(F.min_by(F.struct(F.col("__spelling").alias("matched"), *values), rank).alias("__hit"))
    return rows.join(best, rows[key] == best["__key"], "left").select(*rows.columns, "__hit.*")


class Unmatched(KeyError):
    """Keys that a table should have, and hasn't."""


def unmatched(matched: DataFrame, key: str) -> DataFrame:
    """(rows, unmatched, example) of the result of :func:`first_match`: how many keys no spelling of which was there, and the least of them."""
    none = F.col("matched").isNull()
    return matched.agg(F.count(F.lit(1)).alias("rows"), F.count_if(none).alias("unmatched"), F.min(F.when(none, F.col(key))).alias("example"))


def all_matched(rows: DataFrame, key: str, spellings: Column, table: DataFrame, table_key: str, order: str | None = None) -> DataFrame:
    """:func:`first_match` for rows that must all have one: raises :class:`Unmatched` with their number, and one of them, otherwise."""
    got = cut(first_match(rows, key, spellings, table, table_key, order))
    n, missing, example = unmatched(got, key).first()
    if missing:
        raise Unmatched(f"{missing} of {n} keys have no row under any spelling, {example!r} for one")
    return got


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: Column) -> DataFrame:
    """``rows`` with ``value`` of ``table`` for ``key``, or ``default``."""
    t = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v")).dropDuplicates(["__k"])
    return rows.join(t, F.col(key) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", default)).drop("__k", "__v")


def alias_rows(ids: DataFrame, id_col: str, spellings: Column) -> DataFrame:
    """One row for each spelling under which an id may be asked for."""
    return ids.withColumn(id_col, F.explode(spellings)).distinct()
