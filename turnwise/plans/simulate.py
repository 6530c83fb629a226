"""Simulated retrieval sessions: all sessions advance one turn at a time, as joins and one search per turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import ranks
from turnwise.operators import feedback, search
from turnwise.operators.durable import cut
from turnwise.plans.saved import TurnStore

Texts = Callable[[DataFrame, int], DataFrame]


def simulate(queries: DataFrame, corpus: DataFrame, truths: DataFrame, captions: DataFrame, texts: Texts, max_turns: int = 5, k: int = ranks.TOP_K, hashes: DataFrame | None = None, store: TurnStore | None = None) -> DataFrame:
    """(query_id, turn, best_gt_rank, selected, found): one row per session and turn; ``found`` ends a session.

    ``queries`` (query_id, vec, reference, target), ``corpus`` and ``captions`` (corpus_idx, vec), ``truths``
    (query_id, gt_idx). ``texts`` gives (query_id, t_vec) for the (query_id, selected, target) of a turn. A session whose
    candidates run out, or that gets no text, is left out altogether. ``hashes`` (corpus_idx, img_hash) keep copies of
    used items from being chosen. State is cut every turn: a lost executor costs one turn at most. With a ``store`` it is
    kept there: the same call, with the same queries, goes on after the last full turn, and one that has ended is read back.
    """
    keep = store.put if store else lambda turn, name, table: cut(table)
    first = queries.select("query_id", F.col("reference").cast("long").alias("corpus_idx"))
    at = store.last() if store else None
    if at is None:
        turn, ended = -1, False
        state, used, picked, done, failed = cut(queries.select("query_id", "vec", "target")), cut(first), None, None, None
    else:
        turn, ended = at
        done, failed = store.all("rows", turn + 1), store.all("failed", turn + 1)
        if not ended:
            state, picked = store.get(turn, "state"), store.get(turn, "picked")
            used = cut(first.unionByName(store.all("picked", turn + 1).select("query_id", F.col("selected").alias("corpus_idx"))))
            if hasattr(texts, "resume"):
                texts.resume(store.all("said", turn + 1))
    while not ended:
        turn += 1
        shown = cut(search.topk(state, corpus, k))
        gt = truths.join(state.select("query_id"), "query_id", "left_semi")
        best = search.best_ranks(search.ground_truth_ranks(state, gt, corpus))
        row = state.select("query_id").join(best, "query_id", "left").select("query_id", F.lit(turn).alias("turn"), F.coalesce("best_gt_rank", F.lit(-1)).alias("best_gt_rank"))
        row = row.join(picked, "query_id", "left") if picked is not None else row.withColumn("selected", F.lit(None).cast("long"))
        row = keep(turn, "rows", row.withColumn("found", ranks.is_hit(F.col("best_gt_rank"), k)))
        done = row if done is None else done.unionByName(row)
        going = state.join(row.where("NOT found").select("query_id"), "query_id", "left_semi")
        ended = turn == max_turns or going.isEmpty()
        if not ended:
            shown = shown.join(going.select("query_id"), "query_id", "left_semi")
            chosen = feedback.select_candidate(shown, used, going.select("query_id", F.col("target")), captions, hashes=hashes)
            picked = keep(turn, "picked", chosen.select("query_id", "selected"))
            means = feedback.others_mean(shown, picked, corpus)
            said = cut(texts(picked.join(going.select("query_id", "target"), "query_id"), turn).where("t_vec IS NOT NULL"))
            if store and getattr(texts, "said", None) is not None:
                store.put(turn, "said", texts.said.where(F.col("turn") == turn))
            lost = keep(turn, "failed", going.select("query_id").join(said.select("query_id"), "query_id", "left_anti"))
            failed = lost if failed is None else failed.unionByName(lost)
            going = going.join(said.select("query_id"), "query_id", "left_semi")
            moved = feedback.update_queries(going, picked, means, said, corpus)
            state = keep(turn, "state", moved.join(going.select("query_id", "target"), "query_id").select("query_id", "vec", "target"))
            used = cut(used.unionByName(picked.select("query_id", F.col("selected").alias("corpus_idx"))))
        if store:
            store.close(turn, ended)
    return done if failed is None else done.join(failed.distinct(), "query_id", "left_anti")


def outcomes(turns: DataFrame) -> DataFrame:
    """(query_id, success, success_turn, n_turns) of simulated turns; a failure's turn is -1."""
    return turns.groupBy("query_id").agg(
        F.bool_or("found").alias("success"), F.coalesce(F.min(F.when(F.col("found"), F.col("turn"))), F.lit(-1)).alias("success_turn"), F.count(F.lit(1)).alias("n_turns")
    )


def split_runnable(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries that can run, skipped): ``skipped`` (query_id, error) are those whose reference or target isn't in the corpus."""
    there = corpus.select(F.col("corpus_idx").alias("__id"), F.lit(True).alias("__there")).distinct()
    got = queries
    for column in ("reference", "target"):
        got = got.join(there.toDF("__id", f"__{column}"), F.col(column) == F.col("__id"), "left").drop("__id")
    error = F.when(F.col("__reference").isNull(), F.lit("reference not in the corpus")).when(F.col("__target").isNull(), F.lit("target not in the corpus"))
    got = got.withColumn("__error", error)
    return got.where("__error IS NULL").select(*queries.columns), got.where("__error IS NOT NULL").select("query_id", F.col("__error").alias("error"))


def evaluate(queries: DataFrame, corpus: DataFrame, truths: DataFrame, captions: DataFrame, texts: Texts, done: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(turns, errors) of the sessions that aren't in ``done`` (query_id) yet.

    Every session is either in ``turns``, whole, or in ``errors`` (query_id, error): nothing stops the other sessions.
    """
    if done is not None:
        queries = queries.join(done.select("query_id").distinct(), "query_id", "left_anti")
    runnable, skipped = split_runnable(queries, corpus)
    runnable = cut(runnable)
    turns = cut(simulate(runnable, corpus, truths, captions, texts, **options))
    ended = runnable.select("query_id").join(turns.select("query_id").distinct(), "query_id", "left_anti")
    return turns, skipped.unionByName(ended.withColumn("error", F.lit("no candidate or no text")))
