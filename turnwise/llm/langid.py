"""Language identification by the nearest of several clustered centroids per language.

Method: character 1- to 3-grams of the text's lower-case letters are hashed into a fixed number of dimensions, weighted
``sqrt(tf) * idf`` and scaled to unit length. Each language's training vectors are clustered by spherical k-means into up
to ``CENTROIDS`` centroids. A text gets the language of the centroid with the greatest cosine. It is *rejected* when
that cosine lies below the language's limit: ``SLACK`` times the cosine that all but ``TAIL`` of its training texts
reach, so that texts of repeated words and the like stay and texts in another language go. Short texts have few n-grams and so lower cosines: below ``FULL`` letters the limit falls with the square root
of the length.

Training is bounded: about ``PER_LANG`` texts of at most ``TRAIN_CHARS`` characters per language are fetched, for the ``MAX_LANGS``
most frequent languages, chosen by a hash of their id, so the sample neither grows with the input nor depends on its order. Everything else reads whole texts of all rows in one scan
without a shuffle; the model (centroids x ``DIMS`` floats) travels with the task.

Defined results: null or letterless texts get ``und``, score 0.0 and ``rejected``; ties between centroids go to the
first language in alphabetical order; with no labelled text at all everything is ``und``; repeated rows are
predicted each on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 4096
CENTROIDS = 4
#: The training sample: about so many texts per language.
PER_LANG = 600
#: Longer texts aren't trained on; nor are languages beyond so many.
TRAIN_CHARS = 100_000
MAX_LANGS = 500
ROUNDS = 8
#: A language's limit as a share of the cosine that nearly all of its training texts reach.
SLACK = 0.5
#: The share of training texts that a language's limit leaves below it.
TAIL = 0.002
#: Number of letters from which a language's limit holds in full.
FULL = 400
UNKNOWN = "und"
#: Texts are counted together up to so many characters.
CHUNK = 2_000_000

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def _folding() -> np.ndarray:
    """For every code point its lower-case letter, or a space if it is no letter."""
    letters = (c.lower() if c.isalpha() else " " for c in map(chr, range(0x110000)))
    return np.fromiter((ord(c[0]) for c in letters), np.uint32, 0x110000)


def grams(text: str, dims: int = DIMS) -> np.ndarray:
    """The hashed 1- to 3-grams of a text's letters, other runs taken as one space, as indexes below ``dims``."""
    code = _folding()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]
    shift = np.uint32(33 - dims.bit_length())
    one = code * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (code[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (code[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return np.concatenate([one, two, three]) >> shift


def counts(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """A row of n-gram counts for each text."""
    return np.stack([np.bincount(grams(t, dims), minlength=dims) for t in texts]).astype(np.float32)


@dataclass
class Model:
    """idf by dimension; centroids (unit rows), their languages (indexes into ``langs``) and each language's limit."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.sqrt(tf) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, cosine, rejected) by row."""
        cos = self.vectors(tf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(cos)), best], 0.0, 1.0).astype(np.float64)
        lang = self.owner[best]
        letters = tf.sum(axis=1) / 3
        return lang, score, score < self.limits[lang] * np.sqrt(np.minimum(1.0, letters / FULL))


def _cluster(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts from the first vector and then the least covered one each time."""
    chosen = [v.mean(axis=0)]
    while len(chosen) < min(k, len(v)):
        nearest = np.max(v @ np.stack(chosen).T, axis=1)
        chosen.append(v[nearest.argmin()])
    c = np.stack(chosen)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[str, str]], dims: int = DIMS, k: int = CENTROIDS) -> Model | None:
    """A model from (text, language) pairs; None if there is none with a letter."""
    by_lang: dict[str, list[str]] = {}
    for text, lang in sorted(rows):
        if any(map(str.isalpha, text)):
            by_lang.setdefault(lang, []).append(text)
    if not by_lang:
        return None
    langs = sorted(by_lang)
    df, total = np.zeros(dims), 0
    for lang in langs:
        for text in by_lang[lang]:
            df[np.unique(grams(text, dims))] += 1
            total += 1
    model = Model(langs, np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.01), np.empty(0), np.empty(0), np.empty(0))
    cents, owner, limits = [], [], []
    for n, lang in enumerate(langs):
        v = model.vectors(counts(by_lang[lang], dims))
        c = _cluster(v, k)
        cents.append(c)
        owner += [n] * len(c)
        limits.append(SLACK * max(0.0, float(np.quantile(np.max(v @ c.T, axis=1), TAIL))))
    model.centroids, model.owner, model.limits = np.concatenate(cents).astype(np.float32), np.array(owner), np.array(limits)
    return model


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """The labelled sample: of each language the documents whose hashed id falls into a share worth ``per_lang`` rows."""
    if "lang" not in docs.columns:
        return []
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length(F.col("text").cast("string")) <= TRAIN_CHARS))
    frequent = known.groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    sizes = {r[0]: r[1] for r in frequent.collect()}
    if not sizes:
        return []
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map([F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_lang / n))])
    picked = known.where(hashed < share[F.col("lang").cast("string")]).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return [(r[0], r[1]) for r in picked.collect()]


def predict_texts(texts: Iterable[str | None], n: int, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, scores, rejected) of ``n`` texts."""
    lang, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    held: list[str] = []
    at: list[int] = []
    size = 0

    def flush() -> None:
        if at:
            got, cos, bad = model.predict(counts(held))
            score[at], rejected[at] = cos, bad
            for i, x in zip(at, got, strict=True):
                lang[i] = model.langs[x]
        held.clear()
        at.clear()

    for i, text in enumerate(texts):
        if model is not None and text is not None and any(map(str.isalpha, text)):
            held.append(text)
            at.append(i)
            size += len(text)
            if len(at) >= 64 or size >= CHUNK:
                flush()
                size = 0
    flush()
    return lang, score, rejected


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Predict every document of ``docs`` (``doc_id``, ``text``): see ``SCHEMA``."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lang, score, rejected = predict_texts((x.as_py() for x in batch.column(2)), batch.num_rows, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    doc_id = F.col("doc_id")
    return docs.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def identify_languages(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Fit on the labelled, not held out documents of ``docs`` and predict all of them."""
    return identify(docs, fit(training_rows(docs, per_lang)))


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns kept; a null ``lang``, if there is the column, becomes the predicted one.

    With no model, which needs labelled texts, nothing can be told apart and all rows stay.
    """
    if model is None:
        return docs
    names, at = docs.columns, docs.columns.index("text")
    to = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lang, _, rejected = predict_texts((x.as_py() for x in batch.column(at)), batch.num_rows, model)
            columns = list(batch.columns)
            if to is not None:
                columns[to] = pa.array([x if x is not None else y for x, y in zip(columns[to].to_pylist(), lang, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~rejected))

    # Columns that Arrow's batches carry; text and lang as strings
    typed = docs.withColumns({c: F.col(c).cast("string") for c in ("text", "lang") if c in names}).select(*names)
    return typed.mapInArrow(run, typed.schema)
