"""Session filters. Each takes sessions and ids and gives the ids that stay, with the list semantics of the rules:
ids may repeat in lists, while per-id facts are those of the id's last row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import text, vectors
from turnwise.operators.dedupe import last_by

# How much a rank may grow from one turn to the next, and how like two modification texts may be.
RANK_MARGIN = 30
SIMILARITY = 0.8


def numeric_id(query_id: Column) -> Column:
    """The id as a number, null where it isn't one."""
    return query_id.try_cast("bigint")


def succeeded(sessions: DataFrame) -> DataFrame:
    """An id for every row that succeeded and whose id is a number."""
    return sessions.where(F.coalesce("success", F.lit(False)) & numeric_id(F.col("query_id")).isNotNull()).select("query_id", "pos")


def last_rows(sessions: DataFrame) -> DataFrame:
    return last_by(sessions, "query_id", "pos")


def last_row_facts(sessions: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(query_id, multi_turn, original_query): of each id's last row, whether it succeeded after the first turn, and
    whether its query isn't blank. ``last``, here and below: the ids' last rows, where they are at hand."""
    last = last_rows(sessions.select("query_id", "pos", "success_turn", "original_query")) if last is None else last
    asked = F.length(text.py_strip(F.coalesce("original_query", F.lit("")))) > 0
    return last.select("query_id", (F.coalesce("success_turn", F.lit(0)) > 0).alias("multi_turn"), asked.alias("original_query"))


def multi_turn(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids whose last row succeeded after the first turn."""
    return ids.join(last_row_facts(sessions).where("multi_turn").select("query_id"), "query_id", "left_semi")


def with_original_query(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids whose last row has a query that isn't blank."""
    return ids.join(last_row_facts(sessions).where("original_query").select("query_id"), "query_id", "left_semi")


def rank_jumps(turns: DataFrame, margin: float = RANK_MARGIN) -> DataFrame:
    """(query_id, n_turns, n_ranks, jumps): turns and finite ranks of each id, and how often a rank grew by over ``margin``.

    ``turns`` (query_id, turn, pos, rank): null or infinite ranks are left out before neighbours are compared, -1 takes part.
    """
    finite = F.col("rank").isNotNull() & (F.col("rank") != float("inf"))
    w = Window.partitionBy("query_id").orderBy("turn", "pos")
    steps = turns.where(finite).withColumn("before", F.lag("rank").over(w))
    jumps = steps.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_ranks"), F.count_if(F.col("rank") > F.col("before") + margin).alias("jumps"))
    return turns.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_turns")).join(jumps, "query_id", "left")


def rank_consistent(turns: DataFrame, ids: DataFrame, margin: float = RANK_MARGIN) -> DataFrame:
    """Ids with at least two finite ranks that never grow by over ``margin``, and ids without turns, which come last.

    If no id has turns at all, all stay as they are.
    """
    seen = ids.join(rank_facts(turns, margin), "query_id", "left")
    return seen.where(F.coalesce("fine", F.lit(True))).drop("fine")


def rank_facts(turns: DataFrame, margin: float = RANK_MARGIN) -> DataFrame:
    """(query_id, fine): whether an id has at least two finite ranks and none grows by over ``margin``."""
    fine = (F.col("n_turns") > 1) & (F.coalesce("n_ranks", F.lit(0)) > 1) & (F.coalesce("jumps", F.lit(0)) == 0)
    return rank_jumps(turns, margin).select("query_id", fine.alias("fine"))


def modification_texts(sessions: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """(query_id, i, text): the texts that a session's turns add; the first is the original query. Blank ones are left out."""
    last = last_rows(sessions.select("query_id", "pos", "original_query", "turns")) if last is None else last
    flat = last.select("query_id", "original_query", F.posexplode("turns").alias("i", "t"))
    said = flat.select("query_id", "i", F.when(F.col("i") == 0, F.col("original_query")).otherwise(F.col("t.relative_caption")).alias("text"))
    return said.where(F.coalesce("text", F.lit("")) != "")


def too_alike(texts: DataFrame, encoded: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Ids with two texts of similarity ``least`` or more, whichever they are.

    ``encoded`` (text, vec) has unit vectors. Pairs are formed inside a session only, whose turns are few by design.
    """
    v = texts.join(encoded, "text").select("query_id", "i", "vec")
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.i") < F.col("b.i")))
    return pairs.where(vectors.dot(F.col("a.vec"), F.col("b.vec")) >= least).select(F.col("a.query_id").alias("query_id")).distinct()


def diverse(sessions: DataFrame, ids: DataFrame, encoded: DataFrame, least: float = SIMILARITY) -> DataFrame:
    return ids.join(too_alike(modification_texts(sessions), encoded, least), "query_id", "left_anti")


def repeats_an_image(sessions: DataFrame, hashes: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Ids that select an image with the content of the reference image, or the same content twice.

    ``hashes`` (image_id, img_hash); images of unknown content don't count.
    """
    known = hashes.select("image_id", "img_hash").dropDuplicates(["image_id"])
    last = last_rows(sessions.select("query_id", "pos", "reference_image_id", "turns")) if last is None else last
    images = F.concat(F.array(F.struct(F.lit(True).alias("is_ref"), F.col("reference_image_id").alias("image_id"))), F.transform("turns", lambda t: F.struct(F.lit(False).alias("is_ref"), t["selected_image"].alias("image_id"))))
    asked = last.select("query_id", F.inline(images)).where("image_id IS NOT NULL").join(known, "image_id")
    # a content with the reference among its uses and a selection, or with two selections
    uses = asked.groupBy("query_id", "img_hash").agg(F.count_if(F.col("is_ref")).alias("refs"), F.count_if(~F.col("is_ref")).alias("picks"))
    return uses.where("picks > 1 OR (picks > 0 AND refs > 0)").select("query_id").distinct()


def hash_lookups(sessions: DataFrame, hashes: DataFrame) -> DataFrame:
    """(asked, found, failed): how many of the selected and reference images of all ids' last rows have a known content."""
    last = last_rows(sessions.select("query_id", "pos", "reference_image_id", "turns"))
    images = F.concat(F.array("reference_image_id"), F.transform("turns", lambda t: t["selected_image"]))
    asked = last.select(F.explode(images).alias("image_id")).where("image_id IS NOT NULL")
    got = asked.join(hashes.select("image_id", "img_hash").dropDuplicates(["image_id"]), "image_id", "left")
    return got.agg(F.count(F.lit(1)).alias("asked"), F.count("img_hash").alias("found"), F.count_if(F.col("img_hash").isNull()).alias("failed"))


def without_repeats(sessions: DataFrame, ids: DataFrame, hashes: DataFrame) -> DataFrame:
    return ids.join(repeats_an_image(sessions, hashes), "query_id", "left_anti")


def materialise(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id stays and which themselves succeeded after the first turn."""
    return sessions.where(F.col("success_turn") > 0).join(ids.select("query_id").distinct(), "query_id", "left_semi").select(*sessions.columns)
