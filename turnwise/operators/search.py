"""Exact cosine search with deterministic ranks, and ranks of ground truths.

Both are a product of matrices in blocks, and read the corpus once. Queries of a checked size are broadcast, and the corpus is dealt
out to all cores. Beyond it, queries are packed into blocks and the corpus into parts, each a row with a
matrix of bounded size; parts are dealt out to groups once, every group gets all blocks, and they meet in one
equi-join. A task keeps the best hits of the queries that it is working on.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import vectors

#: Values (rows x dimensions) of a block of queries, of a part of the corpus, and of all queries that are broadcast: 8, 4 and 64 MB.
BLOCK_VALUES = 1_000_000
PART_VALUES = 500_000
BROADCAST_VALUES = 8_000_000
#: Queries that are broadcast at most.
BROADCAST_ROWS = 10_000
#: Similarities of one product.
TILE_VALUES = 4_000_000
#: Hits that a task keeps before it hands them on.
KEPT_HITS = 8_000_000
#: Similarities as near as this to each other are ties.
EPSILON = 1e-12


def restrict(corpus: DataFrame, space: DataFrame | None = None, files: DataFrame | None = None, id_col: str = "image_id") -> DataFrame:
    """Corpus rows whose id is in the search space and whose file exists."""
    for allowed in (space, files):
        if allowed is not None:
            corpus = corpus.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    return corpus


def restrict_by_hash(corpus: DataFrame, space: DataFrame, metadata: DataFrame, files: DataFrame) -> DataFrame:
    """As :func:`restrict`, by content hash; rows without metadata are kept, rows whose known file is gone aren't."""
    known = metadata.select("img_hash", F.col("image_id").alias("__id")).dropDuplicates(["img_hash"])
    there = files.select(F.col("image_id").alias("__id"), F.lit(True).alias("__there")).distinct()
    got = corpus.join(space.select("img_hash").distinct(), "img_hash", "left_semi").join(known, "img_hash", "left").join(there, "__id", "left")
    return got.where("__id IS NULL OR __there").drop("__id", "__there")


def topk_sql(queries: DataFrame, corpus: DataFrame, k: int = 10, block_values: int = BROADCAST_VALUES) -> DataFrame:
    """As :func:`topk`, always through the equi-join of blocks and parts: no query passes through the driver."""
    blocks = packed(queries, ["query_id"], min(block_values, BLOCK_VALUES))
    return _joined(blocks, corpus.select(F.col("corpus_idx").cast("long").alias("corpus_idx"), "vec"), k, _hit_schema(queries))


def _hit_schema(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, corpus_idx long, sim double"


def _joined(blocks: DataFrame, items: DataFrame, k: int, schema: str, normalise: bool = True) -> DataFrame:
    parts = packed(items, ["corpus_idx"], PART_VALUES, normalise)
    return _ranked(_met(blocks, parts).mapInArrow(_task_topk(k), schema), k)


def _ranked(sims: DataFrame, k: int) -> DataFrame:
    """Rank by similarity, ties by corpus order. The limit is pushed below the exchange: k rows per query and task."""
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("corpus_idx"))
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "corpus_idx", "sim")


def _sums(m: np.ndarray) -> np.ndarray:
    """The sum of each row, added up value by value as SQL does: equal rows have equal sums, which a matrix product doesn't promise."""
    return np.cumsum(m, axis=1)[:, -1] if m.shape[1] else np.zeros(len(m))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt(_sums(v * v)), vectors.TINY)[:, None]


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed(rows: DataFrame, keys: list[str], values: int, normalise: bool = True, against: str | None = None) -> DataFrame:
    """Rows with ``vec`` as rows of at most ``values`` values: the ``keys`` as arrays, ``dims``, and ``matrix`` (doubles).

    Vectors are of unit length with ``normalise``; those with values that aren't finite are left out. With ``against``, a column of vectors, ``own``
    holds each row's product with it.
    """
    kind = {k: rows.schema[k].dataType.simpleString() for k in keys}
    columns = [*keys, "vec", *([against] if against else [])]
    names = [*keys, "dims", "matrix", *(["own"] if against else [])]
    schema = ", ".join([*(f"`{k}` array<{kind[k]}>" for k in keys), "dims int, matrix binary", *(["own binary"] if against else [])])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            step = max(1, values // max(1, len(batch.column(len(keys))[0]))) if batch.num_rows else 1
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                m = _matrix(some.column(len(keys)))
                fine = np.isfinite(m).all(axis=1)
                m = _unit(m) if normalise else m
                own = np.einsum("ij,ij->i", m, _unit(_matrix(some.column(len(keys) + 1)))) if against else None
                fine = fine if own is None else fine & np.isfinite(own)
                if not fine.any():
                    continue
                mask = pa.array(fine)
                lists = [pa.ListArray.from_arrays(pa.array([0, int(fine.sum())], pa.int32()), some.column(i).filter(mask)) for i in range(len(keys))]
                made = [pa.array([m.shape[1]], pa.int32()), pa.array([m[fine].tobytes()], pa.binary())]
                if own is not None:
                    made.append(pa.array([own[fine].tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays([*lists, *made], names=names)

    return rows.where("vec IS NOT NULL").select(*columns).mapInArrow(run, schema)


def _met(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Every block with every part, through one equi-join: a group of parts is kept on disk where it doesn't fit."""
    parts = parts.select(*[F.col(c).alias(f"part_{c}") for c in parts.columns])
    groups = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.withColumn("g", (F.monotonically_increasing_id() % groups).cast("int"))
    asked = blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return asked.join(dealt.hint("merge"), "g").drop("g")


def _vectors(column, normalise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors of an Arrow column are finite, those as a matrix)."""
    m = _matrix(column) if len(column) else np.zeros((0, 1))
    fine = np.isfinite(m).all(axis=1)
    return fine, _unit(m[fine]) if normalise else m[fine]


def _corpus_batches(batches: Iterable, normalise: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, items) of Arrow batches of (corpus_idx, vec)."""
    for batch in batches:
        fine, items = _vectors(batch.column(1), normalise)
        if len(items):
            yield batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[fine], items


def _each(batch, names: list[str]) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, its columns, queries, corpus indexes, items) of the rows of an Arrow batch."""
    at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
    for i in range(batch.num_rows):
        shape = (-1, at["dims"][i].as_py())
        q = np.frombuffer(at["matrix"][i].as_buffer(), np.float64).reshape(shape)
        items = np.frombuffer(at["part_matrix"][i].as_buffer(), np.float64).reshape(shape)
        idx = at["part_corpus_idx"][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
        yield at["block"][i].as_py(), {n: at[n][i] for n in names}, q, idx, items


def topk(queries: DataFrame, corpus: DataFrame, k: int = 10, block_values: int = BLOCK_VALUES, normalise: bool = True) -> DataFrame:
    """(query_id, rank, corpus_idx, sim): products of blocks and parts, then a merge of each task's best.

    Each task keeps ``k`` hits a query, so what is shuffled is tasks x queries x k, never all pairs. Products are made for
    ``TILE_VALUES`` similarities at a time. Queries without a vector have no hits, items without one are none. Without ``normalise`` the similarity is the
    plain product.
    """
    schema = _hit_schema(queries)
    items = corpus.where("vec IS NOT NULL").select(F.col("corpus_idx").cast("long").alias("corpus_idx"), "vec")
    if (asked := _few(queries.where("vec IS NOT NULL").select("query_id", "vec"))) is not None:
        fine, q = _vectors(_whole(asked, "vec"), normalise)
        shared = corpus.sparkSession.sparkContext.broadcast((_whole(asked, "query_id").to_numpy(zero_copy_only=False)[fine], q))
        return _ranked(_spread(items).mapInArrow(_corpus_topk(shared, k, normalise), schema), k)
    return _joined(packed(queries, ["query_id"], block_values, normalise), items, k, schema, normalise)


def _spread(items: DataFrame) -> DataFrame:
    """The corpus, dealt out to all cores: a file with one row group is read by one task, which would do all the work."""
    return items.repartition("corpus_idx")


def _few(rows: DataFrame):
    """``rows`` as an Arrow table if they are at most ``BROADCAST_ROWS`` and their ``vec`` at most ``BROADCAST_VALUES`` values; otherwise None, and no
    more than that many have been looked at."""
    got = rows.limit(BROADCAST_ROWS + 1).toArrow().combine_chunks()
    if got.num_rows > BROADCAST_ROWS or len(_whole(got, "vec").flatten()) > BROADCAST_VALUES:
        return None
    return got


def _whole(table, name: str):
    """A column of an Arrow table as one array."""
    import pyarrow as pa

    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _hits(ids: np.ndarray, sims: np.ndarray, places: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sims.shape[1])), pa.array(places.ravel()), pa.array(sims.ravel())], names=["query_id", "corpus_idx", "sim"])


def _corpus_topk(shared, k: int, normalise: bool) -> Callable:
    def run(batches: Iterable) -> Iterator:
        ids, q = shared.value
        sims, places = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for idx, items in _corpus_batches(batches, normalise):
            if len(q):
                sims, places = _advanced(sims, places, q, idx, items, k)
        if sims.size:
            yield _hits(ids, sims, places)

    return run


def _task_topk(k: int) -> Callable:
    def run(batches: Iterable) -> Iterator:
        best: OrderedDict = OrderedDict()
        held = 0

        def hits():
            return _hits(*best.popitem(last=False)[1])

        for batch in batches:
            for block, own, q, idx, items in _each(batch, ["query_id"]):
                if block not in best:
                    held += k * len(q)
                    while best and held > KEPT_HITS:
                        held -= k * len(next(iter(best.values()))[1])
                        yield hits()
                    best[block] = own["query_id"].values.to_numpy(zero_copy_only=False), np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
                ids, sims, places = best[block]
                best[block] = ids, *_advanced(sims, places, q, idx, items, k)
        while best:
            yield hits()

    return run


def _advanced(best_sim: np.ndarray, best_idx: np.ndarray, q: np.ndarray, idx: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of what was best and a part's items, for each query, in tiles.

    A product of matrices only says which items can be among them; their similarities are summed one by one.
    """
    step = max(1, TILE_VALUES // len(idx))
    margin = EPSILON * max(1.0, float(np.sqrt((q * q).sum(axis=1).max(initial=0) * (items * items).sum(axis=1).max(initial=0))))
    got = []
    for at in range(0, len(q), step):
        some = q[at : at + step]
        got.append(_merged(best_sim[at : at + step], best_idx[at : at + step], some @ items.T, idx, k, margin, lambda rows, cols, some=some: _dots(some, items, rows, cols)))
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _dots(q: np.ndarray, items: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The products of some rows of ``q`` with some of ``items``, of bounded size at a time."""
    step = max(1, TILE_VALUES // max(1, q.shape[1]))
    return np.concatenate([np.zeros(0), *(_sums(q[rows[at : at + step]] * items[cols[at : at + step]]) for at in range(0, len(rows), step))])


def _merged(best_sim: np.ndarray, best_idx: np.ndarray, sims: np.ndarray, idx: np.ndarray, k: int, margin: float = 0.0, exact: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Only similarities from the k-th best on are sorted: that of a query's hits so far, or of the tile if there aren't k yet.

    With ``exact``, ``sims`` may be off by ``margin``, and the similarities of (rows, columns) are asked for.
    """
    n, m = sims.shape
    width = best_sim.shape[1]
    if width >= k:
        floor = best_sim[:, -1]
    elif m > k:
        floor = np.partition(sims, m - k, axis=1)[:, m - k]
    else:
        floor = np.full(n, -np.inf)
    rows, cols = np.nonzero(sims >= (floor - margin)[:, None])
    row = np.concatenate([np.repeat(np.arange(n), width), rows])
    sim, place = np.concatenate([best_sim.ravel(), sims[rows, cols] if exact is None else exact(rows, cols)]), np.concatenate([best_idx.ravel(), idx[cols]])
    order = np.lexsort((place, -sim, row))
    per_row = np.bincount(row, minlength=n)
    nth = np.arange(len(order)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    first = order[nth < k]
    return sim[first].reshape(n, -1), place[first].reshape(n, -1)


def ground_truth_ranks(queries: DataFrame, truths: DataFrame, corpus: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, gt_idx, rank): the 1-based rank of each ground truth among the whole corpus; -1 if it, or the query's vector, isn't there.

    A rank is one more than the number of better items (greater similarity, or the same and an earlier place): a sum of
    counts over tasks. No list is sorted.
    """
    corpus = corpus.where("vec IS NOT NULL").withColumn("corpus_idx", F.col("corpus_idx").cast("long"))
    kind = queries.schema["query_id"].dataType.simpleString()
    wanted = truths.select("query_id", F.col("gt_idx").cast("long").alias("gt_idx")).distinct()
    vec_of = corpus.select(F.col("corpus_idx").alias("gt_idx"), F.col("vec").alias("gt_vec"))
    asked = queries.where("vec IS NOT NULL").select("query_id", vectors.as_doubles(F.col("vec")).alias("vec"))
    q = wanted.join(asked, "query_id").join(vec_of, "gt_idx").select("query_id", "gt_idx", "vec", "gt_vec")
    schema = f"query_id {kind}, gt_idx long, better long"
    items = corpus.select("corpus_idx", "vec")
    if (few := _few(q)) is not None:
        fine, m = _vectors(_whole(few, "vec"))
        own, g = _vectors(_whole(few, "gt_vec"))
        both = fine & own
        m, g = m[both[fine]], g[both[own]]
        keys = [_whole(few, c).to_numpy(zero_copy_only=False)[both] for c in ("query_id", "gt_idx")]
        shared = corpus.sparkSession.sparkContext.broadcast((*keys, m, np.einsum("ij,ij->i", m, g)))
        found = _spread(items).mapInArrow(_corpus_better(shared), schema)
    else:
        blocks = packed(q, ["query_id", "gt_idx"], block_values, against="gt_vec")
        found = _met(blocks, packed(items, ["corpus_idx"], PART_VALUES)).mapInArrow(_task_better, schema)
    counted = found.groupBy("query_id", "gt_idx").agg((F.sum("better") + 1).cast("int").alias("rank"))
    return wanted.join(counted, ["query_id", "gt_idx"], "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))


def _task_better(batches: Iterable) -> Iterator:
    import pyarrow as pa

    better: OrderedDict = OrderedDict()
    held = 0

    def counts():
        _, (ids, gts, n) = better.popitem(last=False)
        return pa.RecordBatch.from_arrays([ids, gts, pa.array(n)], names=["query_id", "gt_idx", "better"])

    for batch in batches:
        for block, own, q, idx, items in _each(batch, ["query_id", "gt_idx", "own"]):
            if block not in better:
                held += len(q)
                while better and held > KEPT_HITS:
                    held -= len(next(iter(better.values()))[2])
                    yield counts()
                better[block] = own["query_id"].values, own["gt_idx"].values, np.zeros(len(q), np.int64)
            gts = own["gt_idx"].values.to_numpy(zero_copy_only=False)
            better[block][2][:] += _all_better(q, np.frombuffer(own["own"].as_buffer(), np.float64), gts, idx, items)
    while better:
        yield counts()


def _corpus_better(shared) -> Callable:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        ids, gts, q, own = shared.value
        better = np.zeros(len(q), np.int64)
        for idx, items in _corpus_batches(batches):
            if len(q):
                better += _all_better(q, own, gts, idx, items)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gts), pa.array(better)], names=["query_id", "gt_idx", "better"])

    return run


def _all_better(q: np.ndarray, own: np.ndarray, gts: np.ndarray, idx: np.ndarray, items: np.ndarray) -> np.ndarray:
    """How many of a part's items are better than each truth, in tiles."""
    step = max(1, TILE_VALUES // len(idx))
    return np.concatenate([_better(q[at : at + step] @ items.T, own[at : at + step], gts[at : at + step], idx) for at in range(0, len(q), step)])


def _better(sims: np.ndarray, own: np.ndarray, gts: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """How many of a tile's items are better than each truth: more alike, or as alike and earlier. Few rows have ties."""
    above = (sims > (own + EPSILON)[:, None]).sum(axis=1)
    tied = np.flatnonzero((sims >= (own - EPSILON)[:, None]).sum(axis=1) > above)
    for r in tied:
        near = np.abs(sims[r] - own[r]) <= EPSILON
        above[r] += (idx[near] < gts[r]).sum()
    return above


def best_ranks(ranks: DataFrame) -> DataFrame:
    """(query_id, best_gt_rank): the least positive rank, or -1."""
    return ranks.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("rank") > 0, F.col("rank"))), F.lit(-1)).alias("best_gt_rank"))
