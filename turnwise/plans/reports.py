"""Console reports over statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnwise.operators import stats


def _lines(title: str, df: DataFrame, order: str | None = None, limit: int = 50) -> list[str]:
    rows = (df.orderBy(order) if order else df).limit(limit).collect()
    body = [", ".join(f"{k} {v:.4g}" if isinstance(v, float) else f"{k} {v}" for k, v in r.asDict().items()) for r in rows]
    return [title, *(f"  {b}" for b in body)]


def statistics(sessions: DataFrame, max_turns: int = 5) -> str:
    """The full report of a run."""
    parts = [
        ("Sessions", stats.success_rate(sessions), None),
        ("Turns per session", stats.turn_count_histogram(sessions), "turn_count"),
        ("Success by turn", stats.success_turn_histogram(sessions), "success_turn"),
        ("Hits at turn", stats.hits_at_turn(sessions, max_turns + 1), "turn"),
        ("Recall at 10 by turn", stats.recall_per_turn(sessions), "turn"),
        ("Area under the hit curve", stats.auc_of_hits(sessions, max_turns + 1), None),
        ("Ranks by turn", stats.rank_stats(sessions), "turn"),
        ("First against last rank", stats.improvement_breakdown(sessions), None),
    ]
    return "\n".join(line for p in parts for line in _lines(*p))


def simple_statistics(sessions: DataFrame) -> str:
    return "\n".join(_lines("Sessions", stats.success_rate(sessions)) + _lines("Outcomes", stats.success_breakdown(sessions)))
