"""The public form of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.sources.annotations import running_number


def public_turns(sessions: DataFrame) -> DataFrame:
    """``sessions`` with ``public_turns``: the opening turn, then each later turn that has both an image and a caption.

    Turn numbers start at 1 and keep their gaps.
    """
    opening = F.array(F.struct(F.lit(1).alias("turn"), F.col("reference_image_id").alias("reference_image_id"), F.col("original_query").alias("relative_caption")))
    told = F.filter("turns", lambda t: (F.coalesce(t["turn"], F.lit(0)) >= 1) & (F.coalesce(t["selected_image"], F.lit("")) != "") & (F.coalesce(t["relative_caption"], F.lit("")) != ""))
    later = F.transform(told, lambda t: F.struct((t["turn"] + 1).alias("turn"), t["selected_image"].alias("reference_image_id"), t["relative_caption"].alias("relative_caption")))
    return sessions.withColumn("public_turns", F.concat(opening, F.coalesce(later, F.slice(opening, 1, 0))))


def public_sessions(sessions: DataFrame, subset: str) -> DataFrame:
    """(session_id, subset, ground_truth_ids, num_turns, turns); ids number the sessions given, in order."""
    numbered = running_number(public_turns(sessions), ["pos"], "__n")
    return numbered.select(
        F.format_string("%s_%04d", F.lit(subset), F.col("__n")).alias("session_id"),
        F.lit(subset).alias("subset"),
        F.coalesce("ground_truth_ids", F.array().cast("array<string>")).alias("ground_truth_ids"),
        F.size("public_turns").alias("num_turns"),
        F.col("public_turns").alias("turns"),
    )


def export_totals(public: DataFrame) -> DataFrame:
    return public.agg(F.count(F.lit(1)).alias("sessions"), F.sum("num_turns").alias("turns"))
