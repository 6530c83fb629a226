"""Pluggable model calls. Each default is deterministic and needs no network; callers pass their own functions."""

from __future__ import annotations

import hashlib
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.journal import Journal, recorded


class Encoder(Protocol):
    """Texts or contents to unit vectors, one row each."""

    def __call__(self, items: list) -> np.ndarray: ...


def hashing_encoder(dims: int = 64) -> Encoder:
    """Signed feature hashing of words: equal texts are equal, texts that share words are near."""

    def encode(items: list) -> np.ndarray:
        out = np.zeros((len(items), dims))
        for row, item in zip(out, items, strict=True):
            for word in re.findall(r"\w+", str(item or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode_column(df: DataFrame, column: str, make: Callable[[], Encoder], batch: int = 32, name: str = "vec") -> DataFrame:
    """``df`` with a vector for ``column``. ``make`` is called once per task: there the model is loaded."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` array<double>"

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        encoder = make()
        for b in batches:
            items = b.column(b.schema.get_field_index(column)).to_pylist()
            vectors = [row for i in range(0, len(items), batch) for row in np.asarray(encoder(items[i : i + batch]), np.float64).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def bpe_counter(ranks: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts of a byte-pair vocabulary's tokens: ``ranks`` is a file of base-64 tokens and their ranks, ``pattern`` cuts texts before merging."""

    def make() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(ranks, "rb") as file:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

    return make


def count_tokens(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[int]]], name: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of ``column``, a null text has none. ``make`` is called once per task: there the vocabulary is loaded."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` long"

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        count = make()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count(texts), pa.int64())], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def merged_text(caption: Column, change: Column) -> Column:
    """A caption and a change as one description (the default joiner)."""
    return F.concat_ws(", ", F.nullif(caption, F.lit("")), F.nullif(change, F.lit("")))


def difference_text(selected: Column, target: Column) -> Column:
    """What the target's caption says that the selected one's doesn't (the default difference)."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\w+"), 0)
    new = F.array_except(words(target), words(selected))
    return F.when(F.size(new) > 0, F.concat(F.lit("with "), F.array_join(new, " "))).otherwise(target)


def echo_captioner() -> Callable[[str, str], dict]:
    """A captioner that names the category and the file: for trial runs."""

    def ask(path: str, category: str) -> dict:
        caption = f"{category} {path.rsplit('/', 1)[-1]}"
        return {"success": True, "caption": caption, "error": None, "input_tokens": 1, "output_tokens": len(caption.split())}

    return ask


class NoSuggestion(ValueError):
    """The last try gave no text."""


def distinct_differences(make: Callable[[int, int], str], previous: list[list[np.ndarray]], encode: Encoder, least: float = 0.8, tries: int = 3) -> list[tuple[str, np.ndarray] | None]:
    """For each item the first of up to ``tries`` suggestions, ``make(item, attempt)``, that is less like each of its ``previous`` than ``least``, with its vector.

    If none is, the last is taken all the same; an empty last suggestion gives None. Suggestions of one attempt are encoded together.
    """
    got: list[tuple[str, np.ndarray] | None] = [None] * len(previous)
    left = list(range(len(previous)))
    for attempt in range(tries):
        made = [(i, text) for i in left if (text := make(i, attempt))]
        coded = np.asarray(encode([t for _, t in made]), np.float64) if made else []
        for (i, text), v in zip(made, coded, strict=True):
            if attempt + 1 == tries or all(float(v @ p) < least for p in previous[i]):
                got[i] = text, v
        left = [i for i in left if got[i] is None]
    return got


def distinct_difference(make: Callable[[int], str], previous: list[np.ndarray], encode: Callable[[str], np.ndarray], least: float = 0.8, tries: int = 3) -> str:
    """:func:`distinct_differences` of one item; no suggestion is an error."""
    (got,) = distinct_differences(lambda _, attempt: make(attempt), [previous], lambda texts: np.array([encode(t) for t in texts]), least, tries)
    if got is None:
        raise NoSuggestion("no suggestion")
    return got[0]


def with_retries(call: Callable[[], dict], tries: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Call until it succeeds: rate limits wait twice as long each time, other reported errors end it, exceptions wait
    a little longer each time."""
    for attempt in range(tries):
        try:
            got = call()
        except Exception:
            if attempt + 1 < tries:
                sleep(delay * (attempt + 1))
            continue
        if got.get("success"):
            return got
        if "rate limit" not in str(got.get("error") or "").lower():
            break
        sleep(delay * 2**attempt)
    return {"success": False, "caption": None, "error": f"failed after {tries} attempts"}


class RateLimit:
    """At most so many calls a minute, spread evenly over the threads that share it; the first not before ``first`` seconds."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, first: float = 0.0):
        self.step, self.clock, self.sleep, self.lock = 60.0 / per_minute, clock, sleep, threading.Lock()
        self.next = clock() + first if first else 0.0

    def wait(self) -> None:
        with self.lock:  # a time of its own for every call; waiting for it doesn't keep others from taking theirs
            now = self.clock()
            mine = max(now, self.next)
            self.next = mine + self.step
        if mine > now:
            self.sleep(mine - now)


CALL_SCHEMA = "image_path string, category string, caption string, success boolean, error string, image_index long, input_tokens long, output_tokens long"


def call_captioner(items: DataFrame, make: Callable[[], Callable[[str, str], dict]], per_minute: float = 1500, tasks: int = 4, concurrency: int = 8, journal: Journal | None = None, window: int = 64) -> DataFrame:
    """A row per item (``image_path``, ``category``, ``image_index``): what the captioner said, with tries and rate limit.

    ``make`` gives, once per task, a function of path and category that returns ``caption``, ``success``, ``error`` and
    token counts. Calls of a task overlap in up to ``concurrency`` threads. The stage is a barrier stage: exactly ``tasks``
    tasks run, all at a time, none speculatively, and a retry begins when all have stopped. So the limit holds for
    the whole job, retries included: each task has its share, and their first calls are set off against each other. What the
    ``journal`` holds is neither asked nor waited for again. ``tasks`` must fit the cluster's cores.
    """

    def run(batches: Iterable) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa
        from pyspark import TaskContext

        ask = make()
        limit = RateLimit(per_minute / tasks, first=(TaskContext.get().partitionId() + 1) * 60.0 / per_minute)

        def paid(path: str, category: str) -> dict:
            def once() -> dict:
                limit.wait()
                return ask(path, category)

            return with_retries(once)

        one = recorded(paid, journal) if journal else paid
        with ThreadPoolExecutor(concurrency) as pool:
            for whole in batches:
                for at in range(0, whole.num_rows, window):
                    b = whole.slice(at, window)
                    got = list(pool.map(one, b.column(0).to_pylist(), b.column(1).to_pylist()))
                    col = lambda k, t, got=got: pa.array([g.get(k) for g in got], t)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(1), col("caption", pa.string()), col("success", pa.bool_()), col("error", pa.string()), b.column(2), col("input_tokens", pa.int64()), col("output_tokens", pa.int64())],
                        names=["image_path", "category", "caption", "success", "error", "image_index", "input_tokens", "output_tokens"],
                    )

    return items.select("image_path", "category", "image_index").repartition(tasks).mapInArrow(run, CALL_SCHEMA, barrier=True)
