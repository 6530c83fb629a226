"""Session statistics. All are one or two aggregations; none looks at single sessions on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import ranks

# Dollars for a thousand tokens in and out, and the tokens that a small picture counts for.
PRICE_IN, PRICE_OUT, IMAGE_TOKENS = 0.00015, 0.0006, 85


def turn_table(sessions: DataFrame) -> DataFrame:
    """(query_id, i, turn, best_gt_rank, query_text, relative_caption, selected_image): one row per turn."""
    flat = sessions.select("query_id", "pos", F.posexplode("turns").alias("i", "t"))
    return flat.select("query_id", "pos", "i", "t.turn", F.col("t.best_gt_rank").cast("double").alias("best_gt_rank"), "t.query_text", "t.relative_caption", "t.selected_image")


def session_summary(sessions: DataFrame) -> DataFrame:
    """One row per session: its length and how its best rank moved."""
    first, last = F.try_element_at("turns", F.lit(1))["best_gt_rank"].cast("double"), F.try_element_at("turns", F.lit(-1))["best_gt_rank"].cast("double")
    return sessions.select(
        "query_id",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("success_turn", F.lit(-1)).alias("success_turn"),
        F.size("turns").alias("total_turns"),
        ranks.improvement(first, last).alias("gt_rank_improvement"),
        first.alias("initial_rank"),
        last.alias("final_rank"),
    )


def success_rate(sessions: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.coalesce("success", F.lit(False)))
    return sessions.agg(n.alias("total"), ok.alias("successes"), ranks.percent(ok, n).alias("success_pct"))


def turn_count_histogram(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy((F.size("turns") - 1).alias("turn_count")).agg(F.count(F.lit(1)).alias("sessions"))


def success_turn_histogram(sessions: DataFrame) -> DataFrame:
    return sessions.where("success").groupBy("success_turn").agg(F.count(F.lit(1)).alias("sessions"))


def reach_per_turn(sessions: DataFrame) -> DataFrame:
    """(turn, reached, evaluated): sessions with that many turns, and those of them with a positive rank there."""
    flat = sessions.select(F.posexplode("turns").alias("turn", "t"))
    return flat.groupBy("turn").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("t.best_gt_rank") > 0).alias("evaluated"))


def hits_at_turn(sessions: DataFrame, max_turns: int | None = None) -> DataFrame:
    """(turn, new_hits, cum_hits, hit_rate) for the turns below ``max_turns``; sessions that never succeed count in the whole.

    By default the turns are as many as the longest session has.
    """
    total = sessions.agg(F.count(F.lit(1)).alias("total"))
    new = sessions.where("success").groupBy(F.col("success_turn").alias("turn")).agg(F.count(F.lit(1)).alias("new_hits"))
    if max_turns is None:
        longest = sessions.agg(F.max(F.size("turns")).alias("n")).where("n > 0")
        grid = longest.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("turn"))
    else:
        grid = sessions.sparkSession.range(max_turns).select(F.col("id").cast("int").alias("turn"))
    w = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # max_turns rows
    got = grid.join(new, "turn", "left").select("turn", F.coalesce("new_hits", F.lit(0).cast("long")).alias("new_hits"))
    got = got.withColumn("cum_hits", F.sum("new_hits").over(w)).crossJoin(total)
    return got.select("turn", "new_hits", "cum_hits", F.coalesce(F.try_divide("cum_hits", "total"), F.lit(0.0)).alias("hit_rate"))


def auc_of_hits(sessions: DataFrame, max_turns: int | None = None) -> DataFrame:
    return hits_at_turn(sessions, max_turns).agg(F.coalesce(F.avg("hit_rate"), F.lit(0.0)).alias("auc"))


def recall_per_turn(sessions: DataFrame) -> DataFrame:
    """(turn, hits, evaluated, recall): successes at a turn among the sessions evaluated there; turns with none are left out."""
    new = sessions.where("success").groupBy(F.col("success_turn").alias("turn")).agg(F.count(F.lit(1)).alias("hits"))
    got = reach_per_turn(sessions).where("evaluated > 0").join(new, "turn", "left")
    return got.select("turn", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "evaluated", (F.coalesce("hits", F.lit(0)) / F.col("evaluated")).alias("recall"))


def rank_stats(sessions: DataFrame, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per turn: mean, least and greatest of the positive ranks, and how many are within each of ``tops``."""
    r = turn_table(sessions).where("best_gt_rank > 0")
    within = [F.count_if(F.col("best_gt_rank") <= k).alias(f"top{k}") for k in tops]
    got = r.groupBy(F.col("i").alias("turn")).agg(F.count(F.lit(1)).alias("n"), F.avg("best_gt_rank").alias("avg_rank"), F.min("best_gt_rank").alias("min_rank"), F.max("best_gt_rank").alias("max_rank"), *within)
    return got.select("*", *[ranks.percent(F.col(f"top{k}"), F.col("n")).alias(f"top{k}_pct") for k in tops])


def improvement_breakdown(sessions: DataFrame) -> DataFrame:
    """Sessions of two turns or more whose first and last ranks are positive: improved, worsened, unchanged."""
    s = sessions.where("size(turns) >= 2").select(F.element_at("turns", 1)["best_gt_rank"].alias("a"), F.element_at("turns", -1)["best_gt_rank"].alias("b")).where("a > 0 AND b > 0")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("b < a")).alias("improved"), F.count_if(F.expr("b > a")).alias("worsened"), F.count_if(F.expr("b = a")).alias("unchanged"))


def success_breakdown(sessions: DataFrame) -> DataFrame:
    """(outcome, sessions, pct): ``turn_N`` or ``no_success``; outcomes sort as text, so turn_10 stands before turn_2."""
    outcome = F.when(F.coalesce("success", F.lit(False)), F.concat(F.lit("turn_"), F.col("success_turn").cast("string"))).otherwise(F.lit("no_success"))
    total = sessions.agg(F.count(F.lit(1)).alias("total"))
    got = sessions.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("sessions")).crossJoin(total)
    return got.select("outcome", "sessions", ranks.percent(F.col("sessions"), F.col("total")).alias("pct")).orderBy("outcome")


def drawn(seed: int) -> Column:
    """The order in which samples are drawn: by a seeded digest of the ids, the same in every run and in any engine."""
    return F.md5(F.concat(F.col("query_id"), F.lit(f":{seed}")))


def sample_sessions(sessions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` sessions, chosen by a seeded digest of their ids."""
    return sessions.orderBy(drawn(seed), "pos").limit(n)


def dialogues(sessions: DataFrame) -> DataFrame:
    """(query_id, final_rank, final_query, dialogue): each turn as what the user said and what the system did."""

    def turn(t, i):
        said = F.when(i == 0, F.col("original_query")).otherwise(t["relative_caption"])
        did = F.when(t["selected_image"].isNull(), F.lit("initial search")).otherwise(F.concat(F.lit("selected "), t["selected_image"]))
        return F.struct(i.alias("turn"), said.alias("user_input"), did.alias("system_action"), t["best_gt_rank"].alias("best_gt_rank"), (i == F.col("success_turn")).alias("success"))

    last = F.try_element_at("turns", F.lit(-1))
    return sessions.select("query_id", last["best_gt_rank"].alias("final_rank"), last["query_text"].alias("final_query"), F.transform("turns", turn).alias("dialogue"))


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Means over summaries (see :func:`session_summary`) of all sessions and of those kept."""
    means = lambda s, name: s.agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("total_turns").alias("avg_turns"), F.avg(F.when(F.col("success"), F.col("gt_rank_improvement"))).alias("avg_improvement")
    ).select(F.lit(name).alias("which"), "*")
    return means(before, "original").unionByName(means(after, "filtered"))


def token_costs(calls: DataFrame, image_tokens: int = IMAGE_TOKENS) -> DataFrame:
    """Sums over (input_tokens, output_tokens) of model calls, and their price."""
    tin, tout = F.sum(F.col("input_tokens") + image_tokens), F.sum("output_tokens")
    cost = tin / 1000 * PRICE_IN + tout / 1000 * PRICE_OUT
    n = F.count(F.lit(1))
    return calls.agg(n.alias("calls"), tin.alias("input_tokens"), tout.alias("output_tokens"), cost.alias("cost"), F.coalesce(F.try_divide(cost, n), F.lit(0.0)).alias("cost_per_call"))


def cleaning_stats(pairs: DataFrame) -> DataFrame:
    """Over (old, new): how many there are and how many were changed."""
    n, changed = F.count(F.lit(1)), F.count_if(~F.col("old").eqNullSafe(F.col("new")))
    return pairs.agg(n.alias("total"), changed.alias("modified"), ranks.percent(changed, n).alias("modified_pct"))


def count_by(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def index_lists(items: DataFrame, key: str, index: str) -> DataFrame:
    """(key, indices): the sorted indexes of each key, for sidecar files."""
    return items.groupBy(key).agg(F.sort_array(F.collect_list(index)).alias("indices"))


def window_rate(sessions: DataFrame, n: int) -> DataFrame:
    """The success rate of the last ``n`` sessions, by ``pos``."""
    return success_rate(sessions.orderBy(F.col("pos").desc()).limit(n))


def outcome_examples(sessions: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """Up to ``n`` sessions of each outcome, chosen by a seeded digest; the limit is pushed below the exchange."""
    outcome = F.when(F.coalesce("success", F.lit(False)), F.concat(F.lit("turn_"), F.col("success_turn").cast("string"))).otherwise(F.lit("no_success"))
    w = Window.partitionBy("outcome").orderBy(drawn(seed), "pos")
    return sessions.withColumn("outcome", outcome).withColumn("__n", F.row_number().over(w)).where("__n <= " + str(int(n))).drop("__n")


def baseline(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(annotations, captions, processed, coverage_pct): captions count blank ones too."""
    a = rows.agg(F.count(F.lit(1)).alias("annotations"), F.sum(F.size("captions")).cast("long").alias("captions"))
    p = sessions.agg(F.countDistinct("query_id").alias("processed"))
    got = a.withColumn("__k", F.lit(1)).join(p.withColumn("__k", F.lit(1)), "__k").drop("__k")  # one row each
    return got.select("*", ranks.percent(F.col("processed"), F.col("annotations")).alias("coverage_pct"))
