"""Search in blocks: both ways of meeting, ties, missing vectors, bounded memory."""

from __future__ import annotations

import functools
import math
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import vectors
from turnwise.operators import search


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    items = rng.integers(-2, 3, size=(400, 4)).astype(float)  # many equal directions: ties
    corpus = spark.createDataFrame([(i, v.tolist() if i % 11 else None) for i, v in enumerate(items)], "corpus_idx int, vec array<double>").repartition(5)
    asked = rng.integers(-2, 3, size=(37, 4)).astype(float)
    queries = spark.createDataFrame([(f"q{i}", v.tolist() if i % 9 else None) for i, v in enumerate(asked)], "query_id string, vec array<double>").repartition(3)
    return items, corpus, asked, queries


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def ranked(items, q):
    """Indexes in the order of their ranks, similarities rounded so that ties are ties."""
    sims = np.round(unit(items) @ unit(q), 9)
    return sorted((i for i in range(len(items)) if i % 11), key=lambda i: (-sims[i], i))


@pytest.mark.parametrize("broadcast", [search.BROADCAST_VALUES, 0])
@pytest.mark.parametrize("block_values", [search.BLOCK_VALUES, 12])
def test_ranks_of_truths_are_those_of_a_sorted_list(spark, monkeypatch, tables, broadcast, block_values):
    monkeypatch.setattr(search, "BROADCAST_VALUES", broadcast)
    items, corpus, asked, queries = tables
    truths = spark.createDataFrame([(f"q{i}", j) for i in range(37) for j in (3, 11, 50 + i, 399, 4000)], "query_id string, gt_idx int")
    got = {(r.query_id, r.gt_idx): r["rank"] for r in search.ground_truth_ranks(queries, truths, corpus, block_values).collect()}
    for i in range(37):
        order = ranked(items, asked[i])
        for j in (3, 11, 50 + i, 399, 4000):
            want = -1 if i % 9 == 0 or j not in order else order.index(j) + 1
            assert got[f"q{i}", j] == want, (i, j)


@pytest.mark.parametrize("broadcast", [search.BROADCAST_VALUES, 0])
@pytest.mark.parametrize("tile", [search.TILE_VALUES, 50])
def test_hits_are_the_first_of_a_sorted_list(monkeypatch, tables, broadcast, tile):
    monkeypatch.setattr(search, "BROADCAST_VALUES", broadcast)
    monkeypatch.setattr(search, "PART_VALUES", 130)
    monkeypatch.setattr(search, "KEPT_HITS", 60)  # blocks are handed on before all parts were seen
    items, corpus, asked, queries = tables
    k = 7
    got = search.topk(queries, corpus, k, block_values=20)
    monkeypatch.setattr(search, "TILE_VALUES", tile)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, {})[r["rank"]] = r.sim
    for i in range(37):
        if i % 9 == 0:
            assert f"q{i}" not in rows
            continue
        sims = np.sort((unit(items) @ unit(asked[i]))[[j for j in range(400) if j % 11]])[::-1][:k]
        assert np.allclose([rows[f"q{i}"][n + 1] for n in range(k)], sims, atol=1e-12)


def test_the_ways_agree_and_empty_sides_give_nothing(tables):
    _, corpus, _, queries = tables
    some = queries.where("query_id < 'q2'")
    rows = lambda df: sorted((r.query_id, r["rank"], round(r.sim, 9)) for r in df.collect())
    assert rows(search.topk(some, corpus, 3)) == rows(search.topk_sql(some, corpus, 3)) == rows(search.topk_sql(some, corpus, 3, block_values=10))
    for q, c in ((queries.limit(0), corpus), (queries, corpus.limit(0)), (queries.where("vec IS NULL"), corpus)):
        assert search.topk(q, c).count() == 0
    assert search.topk(queries, corpus).columns == ["query_id", "rank", "corpus_idx", "sim"]


def test_exact_ties_go_to_the_earlier_item():
    sims = np.array([[0.5, 0.9, 0.5, 0.5, 0.9], [0.1, 0.1, 0.1, 0.1, 0.1]])
    best, places = search._merged(np.zeros((2, 0)), np.zeros((2, 0), np.int64), sims, np.array([8, 7, 2, 9, 4]), 3)
    assert places.tolist() == [[4, 7, 2], [2, 4, 7]]
    best, places = search._merged(best, places, np.array([[0.9, 0.5], [0.1, 0.0]]), np.array([5, 1]), 3)
    assert places.tolist() == [[4, 5, 7], [2, 4, 5]] and best.tolist() == [[0.9, 0.9, 0.9], [0.1, 0.1, 0.1]]


def test_a_full_block_against_a_full_part_stays_small():
    rng = np.random.default_rng(1)
    q, items = unit(rng.normal(size=(search.BLOCK_VALUES // 64, 64))), unit(rng.normal(size=(10_000, 64)))
    idx, k = np.arange(10_000), 10
    tracemalloc.start()
    sims, places = search._advanced(np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), q, idx, items, k)
    better = np.zeros(len(q), np.int64)
    step = search.TILE_VALUES // len(idx)
    for at in range(0, len(q), step):
        better[at : at + step] += search._better(q[at : at + step] @ items.T, sims[at : at + step, k - 1], places[at : at + step, k - 1], idx)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (better == k - 1).all() and peak < 300e6, peak


def test_vectors_that_are_not_finite_are_left_out(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [float("inf"), 1.0])], "corpus_idx long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0])], "query_id long, vec array<double>")
    assert [(r.query_id, r.corpus_idx) for r in search.topk(q, c).collect()] == [(1, 1)]
    t = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, gt_idx long")
    assert {(r.query_id, r.gt_idx): r["rank"] for r in search.ground_truth_ranks(q, t, c).collect()} == {(1, 1): 1, (1, 2): -1, (2, 1): -1}
    assert search.best_ranks(search.ground_truth_ranks(q, t, c)).where(F.col("query_id") == 2).first().best_gt_rank == -1


def test_copies_have_one_similarity_and_go_by_their_place(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = rng.normal(size=(90, 64)).astype(np.float32)
    items = some[rng.permutation(np.repeat(np.arange(90), 13))]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "corpus_idx long, vec array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some[:40])], "query_id long, vec array<float>")
    unit_of = lambda v: [x / math.sqrt(functools.reduce(lambda s, y: s + y * y, v, 0.0)) for x in v]
    units, asked = [unit_of(v) for v in items.astype(float).tolist()], [unit_of(v) for v in some[:40].astype(float).tolist()]
    sims = [[functools.reduce(lambda s, p: s + p[0] * p[1], zip(q, v, strict=True), 0.0) for v in units] for q in asked]
    want = {(i, n + 1): (j, s[j]) for i, s in enumerate(sims) for n, j in enumerate(sorted(range(len(s)), key=lambda j, s=s: (-s[j], j))[:20])}
    for f in (search.topk, search.topk_sql):
        assert {(r.query_id, r["rank"]): (r.corpus_idx, r.sim) for r in f(queries, corpus, 20).collect()} == want


def test_queries_meet_a_corpus_that_is_dealt_out(spark):
    corpus = spark.range(50).coalesce(1).selectExpr("id AS corpus_idx", "array(id + 1.0D, 1.0D) AS vec")
    queries = corpus.selectExpr("corpus_idx AS query_id", "vec")
    truths = queries.selectExpr("query_id", "query_id AS gt_idx")
    for got in (search.topk(queries, corpus), search.ground_truth_ranks(queries, truths, corpus)):
        assert "hashpartitioning(corpus_idx" in got._jdf.queryExecution().executedPlan().toString()
    joined = search.topk_sql(queries, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in joined and "CartesianProduct" not in joined


def test_a_norm_is_worked_out_once_for_a_vector(spark):
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v")).localCheckpoint()
    began = time.time()
    assert len(long.select(vectors.normalised(F.col("v")).alias("u")).first().u) == 20_000
    assert time.time() - began < 10
