"""What simulated sessions are told each turn: a change that they haven't been told yet, merged into a description."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.durable import cut
from turnwise.plans import models

Suggest = Callable[[str, str, list[str], int], str]
Merge = Callable[[str, str], str]


def suggest_words(base: str, goal: str, previous: list[str], attempt: int) -> str:
    """The goal's words that neither the base nor an earlier suggestion has; the goal itself if there is none."""
    known = set(re.findall(r"\w+", " ".join([base, *previous]).lower()))
    new = [w for w in dict.fromkeys(re.findall(r"\w+", goal.lower())) if w not in known]
    return f"with {' '.join(new)}" if new else goal


def merge_words(base: str, change: str) -> str:
    return ", ".join(t for t in (base, change) if t)


class Instructions:
    """The ``texts`` of a simulation: from the selected to the target caption, with up to ``tries`` suggestions a turn.

    ``captions`` (corpus_idx, caption); a missing caption counts as empty. A suggestion as like an earlier one of its
    session as ``least`` is made again, the last is taken all the same. A session without any suggestion is told
    nothing, and the simulation leaves it out. ``make`` and ``suggest`` run in tasks; ``said`` (query_id, turn,
    instruction, vec) grows by at most one row per session and turn; no suggestion is encoded twice, and ``batch`` texts are encoded at a time.
    """

    def __init__(self, captions: DataFrame, make: Callable[[], models.Encoder], suggest: Suggest = suggest_words, merge: Merge = merge_words, least: float = 0.8, tries: int = 3, batch: int = 256):
        self.captions, self.make, self.suggest, self.merge, self.least, self.tries, self.batch = captions.select("corpus_idx", "caption"), make, suggest, merge, least, tries, batch
        self.said: DataFrame | None = None

    def resume(self, said: DataFrame | None) -> None:
        """Go on from what a stopped run has said."""
        self.said = said

    def __call__(self, picked: DataFrame, turn: int) -> DataFrame:
        rows = picked.join(self.captions.toDF("selected", "base"), "selected", "left").join(self.captions.toDF("target", "goal"), "target", "left").select("query_id", "base", "goal")
        if self.said is None:
            rows = rows.withColumn("before", F.array().cast("array<string>")).withColumn("vectors", F.array().cast("array<array<double>>"))
        else:
            told = self.said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "instruction", "vec"))).alias("told"))
            rows = rows.join(told.select("query_id", F.col("told.instruction").alias("before"), F.col("told.vec").alias("vectors")), "query_id", "left")
        make, suggest, merge, least, tries, size = self.make, self.suggest, self.merge, self.least, self.tries, self.batch

        def run(batches: Iterable) -> Iterator:
            import pyarrow as pa

            encoder = make()
            vector = pa.list_(pa.float64())
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    b = whole.slice(at, size)
                    base, goal, before, coded = ([x or empty for x in b.column(i).to_pylist()] for i, empty in ((1, ""), (2, ""), (3, []), (4, [])))
                    known = [[np.asarray(v) for v in vs] for vs in coded]
                    got = models.distinct_differences(lambda i, n, b=base, g=goal, f=before: suggest(b[i], g[i], f[i], n), known, encoder, least, tries)
                    merged = [merge(c, g[0]) for c, g in zip(base, got, strict=True) if g]
                    moved = iter(np.asarray(encoder(merged), np.float64).tolist() if merged else [])
                    columns = [[g and g[0] for g in got], [g and g[1].tolist() for g in got], [g and next(moved) for g in got]]
                    kinds = (pa.string(), vector, vector)
                    yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["query_id", "instruction", "vec", "t_vec"])

        got = cut(rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, instruction string, vec array<double>, t_vec array<double>").where("instruction IS NOT NULL"))
        new = got.select("query_id", F.lit(turn).alias("turn"), "instruction", "vec")
        self.said = new if self.said is None else self.said.unionByName(new)
        return got.select("query_id", "t_vec")
