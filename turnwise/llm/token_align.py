"""Alignment of two tokenizers over the same texts, and how often their tokens stand for the same bytes.

Method: both tokenizers' tokens are laid over the bytes of a space and the text. NumPy's ``cumsum`` gives the tokens'
ends, ``intersect1d`` the offsets where tokens of both end, and ``searchsorted`` the group of every token between two
such cuts. Two tokens are linked where their byte ranges overlap; links are made by ``repeat``, for a whole batch of texts
at a time. How many documents hold a pair of ids linked is counted by a salted two-stage shuffle: a third of all
documents may hold the same pair, and each task and each salt hands on one row for it.

Plan: one scan tokenises and stores each document's distinct pairs with the number of their links. The pair counts are
aggregated from that table. They go back to the documents in blocks of at most ``BLOCK_PAIRS`` pairs, cut between ids of
the first tokenizer, so that a block knows the highest count of each of its ids: each block is broadcast (24 bytes a
pair) and adds its part to every document's sums. However many pairs the corpus has, no document's links are shuffled
and nothing broadcast exceeds a block.

Defined results: a text that is null, empty or not given back byte for byte by either tokenizer has no tokens: zeros, and
an empty digest. Special tokens' strings inside texts are plain text. A null ``doc_id`` is kept; rows that repeat a document count
as documents of their own; equal counts are all highest. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import small, stored

#: Pairs of one broadcast block: 48 MB.
BLOCK_PAIRS = 2_000_000
#: Bytes of text that are aligned at a time, unless a single text is longer.
BATCH_BYTES = 1_000_000
SALTS = 16
#: The faster library's pattern gives up on very long runs of white space: such texts go to the other one.
LONG_SPACE = re.compile(r"\s{4096}")

LINKS_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
BASE = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def default_paths() -> tuple[str, str, str]:
    """Of A's vocabulary, of the same vocabulary as ranks, and of B's model."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


class ByteTokens:
    """A: byte-level BPE. The ids are the vocabulary file's; the ranks file holds the same vocabulary for a faster library."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.vocabulary = vocabulary
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        got = Tokenizer.from_file(self.vocabulary)
        got.encode_special_tokens = True
        return got

    def encode(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """B: pieces with U+2581 for a space, and bytes where there is no piece."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(self.model.get_piece_size())
        spelt = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, spelt, strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Spelling:
    """Ids of one tokenizer as text with the sign that follows them in a list of groups."""

    def __init__(self, n: int, last: str):
        self.inner = np.array([f"{i}," for i in range(n)], object)
        self.last = np.array([f"{i}{last}" for i in range(n)], object)

    def of(self, ids: np.ndarray, is_last: np.ndarray) -> np.ndarray:
        return np.where(is_last, self.last[ids], self.inner[ids])


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens that follow each other."""
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def links(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs of tokens whose byte ranges overlap, in the order of a."""
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    of_a = np.repeat(np.arange(len(starts_a)), n)
    return of_a, np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Alignments of texts in batches; the library objects of one Python worker."""

    def __init__(self, a: str, ranks: str, b: str):
        self.a, self.b = ByteTokens(a, ranks), PieceTokens(b)
        self.len_a, self.len_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.spell_a, self.spell_b = Spelling(len(self.len_a), "|"), Spelling(len(self.len_b), ";")

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Both tokenizers' ids, or none where one of them doesn't give the text back."""
        if not text:
            return [], []
        shown = f" {text}"
        a, b, said = self.a.encode(shown), self.b.encode(text), shown.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != said or b"".join(map(self.b.bytes.__getitem__, b)) != said:
            return [], []
        return a, b

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text.

        The texts' tokens are laid end to end: each text ends where tokens of both end, so no group or link crosses texts.
        """
        both = [self.ids(t) for t in texts]
        n_a, n_b = (np.array([len(x[i]) for x in both], np.int64) for i in (0, 1))
        a, b = (np.fromiter((i for x in both for i in x[side]), np.int64) for side in (0, 1))
        starts_a, ends_a = spans(self.len_a[a])
        starts_b, ends_b = spans(self.len_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left")
        # In the list of groups an a token stands behind all b tokens of earlier groups, a b token behind the a tokens of its own, too
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = self.spell_a.of(a, np.diff(group_a, append=len(cuts)) > 0)
        shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.spell_b.of(b, np.diff(group_b, append=len(cuts)) > 0)
        of_a, of_b = links(starts_a, ends_a, starts_b, ends_b)
        pairs = (a[of_a] << 32) | b[of_b]
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        to_link = np.searchsorted(of_a, to_a, "left")
        out = []
        for i, (na, nb) in enumerate(zip(n_a.tolist(), n_b.tolist(), strict=True)):
            if not na:
                out.append((0, 0, 0, 0, "", pairs[:0], pairs[:0]))
                continue
            at_a, at_link, at_shown = to_a[i] - na, to_link[i - 1] if i else 0, to_a[i] - na + to_b[i] - nb
            said = "".join(shown[at_shown : to_a[i] + to_b[i]].tolist())[:-1]
            own, times = np.unique(pairs[at_link : to_link[i]], return_counts=True)
            n_groups = int(group_a[to_a[i] - 1] - group_a[at_a]) + 1
            out.append((na, nb, n_groups, int(to_link[i] - at_link), hashlib.sha256(said.encode()).hexdigest(), own, times))
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(paths: tuple[str, str, str]) -> Aligner:
    """One for all tasks of a Python worker."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _portions(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t or "")
    yield slice(begin, len(texts))


def align_documents(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Each document's alignment: counts, the digest of its groups, its distinct linked pairs (a << 32 | b) and their links."""
    paths = paths or default_paths()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        aligner = _aligner(paths)
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            for part in _portions(texts):
                got = aligner.align(texts[part])
                if not got:
                    continue
                sizes = np.cumsum([0, *[len(x[5]) for x in got]])
                lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([x[k] for x in got]), kind)) for k, kind in ((5, pa.int64()), (6, pa.int32()))]
                counts = [pa.array([x[k] for x in got], pa.int64()) for k in range(4)]
                ids = batch.column(0).slice(part.start, len(got))
                yield pa.RecordBatch.from_arrays([ids, *counts, pa.array([x[4] for x in got], pa.string()), *lists], names=[*BASE, "pairs", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LINKS_SCHEMA)


def pair_counts(linked: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, n): how many documents hold a pair linked; combined in each task, then by pair and salt, then by pair."""
    told = linked.select(F.explode("pairs").alias("pair"))
    salted = told.groupBy("pair", (F.spark_partition_id() % salts).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def _blocks(sizes: list[tuple[int, int]], limit: int) -> Iterator[tuple[int, int]]:
    """First and last id of runs of ids whose pairs are at most ``limit`` together, unless one id alone has more."""
    first = last = None
    total = 0
    for i, n in sizes:
        if first is not None and total + n > limit:
            yield first, last
            first, total = None, 0
        first, last, total = i if first is None else first, i, total + n
    if first is not None:
        yield first, last


def _block_sums(shared):
    """Adds to each document's ``n_best`` and ``count_sum`` what one block of pairs gives."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        pairs, counts, best = shared.value
        for batch in small(batches, 2048):
            lists = batch.column(batch.schema.get_field_index("pairs"))
            own = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
            known = pairs[at] == own
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = []
            for value in (np.where(known & best[at], times, 0), np.where(known, times * counts[at], 0)):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row, value)
                sums.append(pa.array(total))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("row", *BASE)]
            yield pa.RecordBatch.from_arrays([*kept, *sums], names=["row", *BASE, "n_best", "count_sum"])

    return run


def linked_counts(linked: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Documents of ``linked`` (with ``row``, a number of its own for each) with the sums over their links; see the module's docstring."""
    spark = linked.sparkSession
    by_id = counts.withColumn("a", F.shiftright("pair", 32))
    sizes = [(r["a"], r["n"]) for r in by_id.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy("a").collect()]  # as many as A has ids
    kinds = {f.name: f.dataType.simpleString() for f in linked.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("row", *BASE)) + ", n_best long, count_sum long"
    parts = []
    for first, last in _blocks(sizes, block_pairs):
        got = by_id.where(F.col("a").between(first, last)).select("pair", "n").toArrow()
        pairs, n = (got.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        begins = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, begins), np.diff(begins, append=len(n)))
        parts.append(linked.mapInArrow(_block_sums(spark.sparkContext.broadcast((pairs, n, best))), schema))
    if not parts:
        return linked.select(*BASE, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    if len(parts) == 1:
        return parts[0].drop("row")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("row", *BASE).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("row")


def align_corpus(docs: DataFrame, paths: tuple[str, str, str] | None = None, block_pairs: int = BLOCK_PAIRS, salts: int = SALTS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    linked = stored(align_documents(docs, paths).withColumn("row", F.monotonically_increasing_id()), "token-links")
    counts = stored(pair_counts(linked, salts), "token-pairs")
    got = linked_counts(linked, counts, block_pairs)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
