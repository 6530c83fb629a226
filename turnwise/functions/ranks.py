"""Rank expressions: -1 stands for an item that isn't in the result list, null for a missing rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP_K = 10


def best_rank(ranks: Column) -> Column:
    """The least positive rank of a map by item, or -1."""
    return F.coalesce(F.array_min(F.filter(F.map_values(ranks), lambda x: x > 0)), F.lit(-1))


def is_hit(rank: Column, k: int = TOP_K) -> Column:
    return F.coalesce((rank >= 1) & (rank <= k), F.lit(False))


def any_in_top(wanted: Column, found: Column, k: int = TOP_K) -> Column:
    """Whether any of ``wanted`` is among the first ``k`` of ``found``."""
    return F.coalesce(F.arrays_overlap(wanted, F.slice(found, 1, k)), F.lit(False))


def improvement(initial: Column, final: Column) -> Column:
    """``initial - final``, 0 if either is missing; -1 counts as a number."""
    return F.when(initial.isNull() | final.isNull(), F.lit(0).cast("double")).otherwise((initial - final).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """A percentage, 0 of nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def jumps_over(ranks: Column, margin: float) -> Column:
    """Whether any rank of an array without nulls exceeds its predecessor by more than ``margin``."""
    step = F.sequence(F.lit(1), F.greatest(F.size(ranks) - 1, F.lit(1)))
    return (F.size(ranks) >= 2) & F.exists(step, lambda i: F.get(ranks, i) > F.get(ranks, i - 1) + margin)
