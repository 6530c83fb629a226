"""Choosing a shown item and moving the query towards it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import vectors


def select_candidate(shown: DataFrame, used: DataFrame, targets: DataFrame, captions: DataFrame, id_col: str = "corpus_idx", hashes: DataFrame | None = None) -> DataFrame:
    """(query_id, selected, caption_sim): of the shown items not used yet, the one whose caption is most like the target's.

    ``shown`` (query_id, rank, id), ``used`` (query_id, id), ``targets`` (query_id, target id), ``captions`` (id, vec).
    Items without a caption vector, or with a cosine of -1 or less, can't be chosen; ties go to the better rank.
    Queries without a candidate give no row. With ``hashes`` (id, img_hash) an item is used once any item of its content
    is; items without a hash go by their id.
    """
    free, taken = shown.select("query_id", "rank", F.col(id_col).alias("id")), used.select("query_id", F.col(id_col).alias("id"))
    if hashes is None:
        free = free.join(taken, ["query_id", "id"], "left_anti")
    else:
        known = hashes.where("img_hash IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg(F.min("img_hash").alias("h"))
        content = F.coalesce(F.concat(F.lit("#"), "h"), F.concat(F.lit("="), F.col("id").cast("string"))).alias("content")
        taken = taken.join(known, "id", "left").select("query_id", content)
        free = free.join(known, "id", "left").select("query_id", "rank", "id", content).join(taken, ["query_id", "content"], "left_anti")
    cap = captions.select(F.col(id_col).alias("id"), F.col("vec").alias("c_vec"))
    goal = targets.join(captions.select(F.col(id_col).alias("target"), F.col("vec").alias("t_vec")), "target").select("query_id", "t_vec")
    scored = free.join(cap, "id").join(goal, "query_id").select("query_id", "rank", "id", vectors.cosine(F.col("c_vec"), F.col("t_vec")).alias("caption_sim"))
    best = scored.where("caption_sim > -1").groupBy("query_id").agg(F.max_by(F.struct("id", "caption_sim"), F.struct("caption_sim", -F.col("rank"))).alias("b"))
    return best.select("query_id", F.col("b.id").alias("selected"), F.col("b.caption_sim").alias("caption_sim"))


def others_mean(shown: DataFrame, selected: DataFrame, corpus: DataFrame, id_col: str = "corpus_idx") -> DataFrame:
    """(query_id, others_mean): the mean unit vector of the shown items that weren't selected."""
    left = shown.select("query_id", "rank", F.col(id_col).alias("id")).join(selected.select("query_id", F.col("selected").alias("id")), ["query_id", "id"], "left_anti")
    got = left.join(corpus.select(F.col(id_col).alias("id"), F.col("vec").alias("v")), "id")
    # only what is shown is scaled, not the corpus
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: vectors.normalised(x["v"]))
    return got.groupBy("query_id").agg(vectors.mean_of(ordered).alias("others_mean"))


def update_queries(queries: DataFrame, selected: DataFrame, means: DataFrame, texts: DataFrame, corpus: DataFrame, alpha: float = vectors.ALPHA, beta: float = vectors.BETA, gamma: float = vectors.GAMMA, id_col: str = "corpus_idx") -> DataFrame:
    """(query_id, vec): each query with a selection, moved. ``texts`` (query_id, t_vec)."""
    s = selected.join(corpus.select(F.col(id_col).alias("selected"), F.col("vec").alias("s_vec")), "selected").select("query_id", "s_vec")
    got = queries.select("query_id", "vec").join(s, "query_id").join(texts, "query_id").join(means, "query_id", "left")
    return got.select("query_id", vectors.feedback(F.col("vec"), F.col("t_vec"), F.col("s_vec"), F.col("others_mean"), alpha, beta, gamma).alias("vec"))
