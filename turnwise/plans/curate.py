"""The session filter pipeline: six stages with toggles, a stage log, and the rows that stay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import ranks
from turnwise.operators import filters, stats
from turnwise.operators.durable import cut

STAGES = ("success", "multi_turn", "original_query", "rank_margin", "text_similarity", "image_duplication")


@dataclass(frozen=True)
class Options:
    """Which stages run, and their limits. Ids that fail ``success_turn > 0`` go in any case."""

    success: bool = True
    multi_turn: bool = True
    original_query: bool = True
    rank_margin: bool = True
    text_similarity: bool = True
    image_duplication: bool = True
    margin: float = filters.RANK_MARGIN
    similarity: float = filters.SIMILARITY


Encoded = DataFrame | Callable[[DataFrame], DataFrame]


def _flagged(sessions: DataFrame, turns: DataFrame, encoded: Encoded | None, hashes: DataFrame | None, o: Options, on: dict[str, bool]) -> DataFrame:
    """(query_id, pos) of every row whose id is a number, with a flag for each stage that runs.

    Facts of ids are those of their last rows, which are found and written once.
    """
    last = cut(filters.last_rows(sessions.select("query_id", "pos", "success_turn", "original_query", "reference_image_id", "turns"))) if any(on[s] for s in STAGES[1:3] + STAGES[4:]) else None
    out = sessions.where(filters.numeric_id(F.col("query_id")).isNotNull()).select("query_id", "pos", F.coalesce("success", F.lit(False)).alias("success"))
    if on["multi_turn"] or on["original_query"]:
        out = out.join(filters.last_row_facts(sessions, last), "query_id", "left")
    if on["rank_margin"]:
        facts = filters.rank_facts(turns, o.margin).select("query_id", F.col("fine").alias("rank_margin"))
        out = out.join(facts, "query_id", "left").withColumn("rank_margin", F.coalesce("rank_margin", F.lit(True)))
    if on["text_similarity"]:
        said = filters.modification_texts(sessions, last)
        vectors = encoded(said.select("text").distinct()) if callable(encoded) else encoded
        out = _without(out, filters.too_alike(said, vectors, o.similarity), "text_similarity")
    if on["image_duplication"]:
        out = _without(out, filters.repeats_an_image(sessions, hashes, last), "image_duplication")
    return out


def _without(rows: DataFrame, bad: DataFrame, stage: str) -> DataFrame:
    """``rows`` with a flag that is false for the ids of ``bad``."""
    return rows.join(bad.select("query_id", F.lit(False).alias(stage)), "query_id", "left").withColumn(stage, F.coalesce(stage, F.lit(True)))


def curate(sessions: DataFrame, turns: DataFrame | None = None, encoded: Encoded | None = None, hashes: DataFrame | None = None, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept sessions, stage log). The log is (stage, stage_no, entering, leaving, filtered_pct).

    ``turns`` defaults to the sessions' own; ``encoded`` is a table (text, vec) or makes one of the texts (text); without it or ``hashes`` (image_id, img_hash) the stage
    that needs them is left out. A stage that nothing enters isn't logged. Sessions are cut once; each stage becomes a flag of an id; the flags
    are joined once, cut once, and counted for all stages in one aggregation.
    """
    o = options or Options()
    sessions = cut(sessions)
    turns = stats.turn_table(sessions).select("query_id", "turn", "pos", F.col("best_gt_rank").alias("rank")) if turns is None else turns
    on = {s: getattr(o, s) for s in STAGES}
    on["text_similarity"] &= encoded is not None
    on["image_duplication"] &= hashes is not None
    flags = cut(_flagged(sessions, turns, encoded, hashes, o, on))
    used = [s for s in STAGES if on[s]]
    passed = [F.forall(F.array(*used[: i + 1]), lambda f: f) for i in range(len(used))]
    counts = flags.agg(F.count(F.lit(1)), *[F.count_if(p) for p in passed]).first()
    log, entering = [], sessions.count()
    for name, leaving in zip(used, counts[1:], strict=True):
        if log and entering == 0:
            break
        log.append((name, len(log) + 1, entering, leaving))
        entering = leaving
    ids = flags.where(passed[-1]) if used else flags
    kept = filters.materialise(sessions, ids)
    logged = sessions.sparkSession.createDataFrame(log, "stage string, stage_no int, entering long, leaving long")
    return kept, logged.select("*", ranks.percent(F.col("entering") - F.col("leaving"), F.col("entering")).alias("filtered_pct"))


def report(sessions: DataFrame, kept: DataFrame) -> dict:
    """Totals before and after, success rates, outcome counts and retention, as a small dict."""
    before, after = stats.success_rate(sessions).first().asDict(), stats.success_rate(kept).first().asDict()
    return {
        "original_analysis": before,
        "filtering_analysis": {r["outcome"]: r["sessions"] for r in stats.success_breakdown(kept).collect()},
        "final_analysis": after,
        "comparison": {"retention_pct": 100.0 * after["total"] / before["total"] if before["total"] else 0.0},
    }


def _analysis(sessions: DataFrame) -> dict:
    """Outcomes of the sessions whose ids are numbers."""
    rows = stats.success_breakdown(sessions.where(filters.numeric_id(F.col("query_id")).isNotNull())).collect()  # one row an outcome
    total = sum(r["sessions"] for r in rows)
    lost = sum(r["sessions"] for r in rows if r["outcome"] == "no_success")
    return {
        "total_queries": total,
        "turn_success_breakdown": {r["outcome"]: {"count": r["sessions"], "percentage": r["pct"]} for r in rows},
        "summary": {"successful_queries": total - lost, "unsuccessful_queries": lost, "success_rate": 100.0 * (total - lost) / total if total else 0.0},
    }


def detailed_report(dataset: str, sessions: DataFrame, kept: DataFrame, log: DataFrame, annotations: DataFrame | None = None) -> dict:
    """What a filter run found and did: coverage of the dataset, outcomes before and after, every stage, and both success rates.

    ``annotations`` are the dataset's queries: coverage is the share of them that was processed, 100 if they aren't given or none. ``log``
    is the stage log of :func:`curate`.
    """
    processed = sessions.count()
    there = annotations.count() if annotations is not None else processed
    before, after = _analysis(sessions), _analysis(kept)
    share = lambda part, whole: 100.0 * part / whole if whole else 0.0
    stages = [
        {"stage_name": r["stage"], "input_count": r["entering"], "output_count": r["leaving"], "filtered_count": r["entering"] - r["leaving"], "filtering_rate": r["filtered_pct"], "retention_rate": share(r["leaving"], r["entering"])}
        for r in log.orderBy("stage_no").collect()
    ]
    n, m = before["total_queries"], after["total_queries"]
    return {
        "dataset_info": {"dataset_name": dataset, "baseline_stats": {"total_queries_in_dataset": there, "actual_processed_queries": processed}, "experiment_stats": {"total_processed_queries": processed, "processing_coverage": share(processed, there) if there else 100.0}},
        "original_analysis": before,
        "filtering_analysis": {"stages": stages, "overall_summary": {"initial_count": n, "final_count": m, "total_filtered": n - m, "overall_filtering_rate": share(n - m, n), "overall_retention_rate": share(m, n)}},
        "final_analysis": after,
        "comparison": {"quality_improvement": {"original_success_rate": before["summary"]["success_rate"], "final_success_rate": after["summary"]["success_rate"]}},
    }


def coverage_rollup(reports: list[dict]) -> dict:
    """Totals over the :func:`detailed_report` of several datasets, and the coverage of each."""
    infos = [r["dataset_info"] for r in reports]
    there = sum(i["baseline_stats"]["total_queries_in_dataset"] for i in infos)
    processed = sum(i["experiment_stats"]["total_processed_queries"] for i in infos)
    first, last = (sum(r["filtering_analysis"]["overall_summary"][k] for r in reports) for k in ("initial_count", "final_count"))
    return {
        "datasets": {i["dataset_name"]: i["experiment_stats"]["processing_coverage"] for i in infos},
        "total_queries_in_datasets": there,
        "total_processed_queries": processed,
        "processing_coverage": 100.0 * processed / there if there else 100.0,
        "initial_count": first,
        "final_count": last,
        "overall_retention_rate": 100.0 * last / first if first else 0.0,
    }


def envelope(sessions: DataFrame, kept: DataFrame, options: Options) -> dict:
    """What a filtered file says about how it came about."""
    n, m = sessions.count(), kept.count()
    on = [s for s in STAGES if getattr(options, s)]
    return {"original_count": n, "filtered_count": m, "filtering_rate": 100.0 * (n - m) / n if n else 0.0, "similarity_threshold": options.similarity, "rank_margin": options.margin, "applied_filters": on}
