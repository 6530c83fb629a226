"""Toxicity scores of texts whose words may be disguised.

Method: noisy-channel deobfuscation. What a reader sees is taken as the output of a channel that swaps letters for
digits and signs, masks single letters, repeats letters, and puts spaces, points or invisible characters between them. Words that
show such signs become a lattice of what each character may have been, with a cost for every alternative. A Viterbi search finds the
likeliest way through the lattice under a character language model; its states are the last three letters. The
restored words, and the plain ones, are then scored by a learned lexicon.

The language model counts 4-grams within words over all documents: each task adds up its own, and their sums are merged by
one shuffle. Letters are folded to ``SYMBOLS`` symbols, so there are ``SYMBOLS ** 4`` (about a million) 4-grams at
most: a 4 MB table, whatever the corpus. Probabilities are interpolated (Witten-Bell).

The lexicon is fitted on at most ``PER_LABEL`` documents of each label, chosen by a hash of their ids (documented bound):
words and beginnings of words, by the lower bound of their log odds. A text's evidence is its strongest word and the
number of strong ones; a logistic curve over both, fitted with each text's own counts left out and moved to the labels'
true shares, gives the score.

Defined results: a null text is an empty one; texts without evidence, empty ones too, get the curve's value there. A null ``doc_id`` is
kept and not held out. Labels of one id count as toxic if one of them is; of rows that repeat a labelled id the least text is learned from.
Without labels every score is 0; if they are all alike every score is their smoothed share. Equal texts have equal scores. An empty table gives no rows;
further columns are ignored. Words without any letter are left alone. Characters beyond the basic plane are no letters.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import small, stored, text_or_empty

PER_LABEL = 4_000
#: Entries of the lexicon at most, and documents that must hold one.
MAX_ENTRIES = 100_000
MIN_SUPPORT = 3
#: Words whose weight is at least this count as strong.
STRONG = 1.5
HELD_OUT = 5
BEGINNINGS = (4, 5, 6)
#: Words that a Python worker remembers.
CACHE = 500_000

#: 0: between words, 1 to 26: letters, 27: other letters, 28: digits.
SYMBOLS, OTHER, DIGIT = 32, 27, 28
SCORES_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_restored long, evidence string"

# Letters that digits and signs stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
# Letters of another script that look alike; they count only in words with Latin letters
TWINS = {"\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x", "\u0443": "y", "\u0456": "i"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# Costs of the channel, in nats
SWAP, MASK, DOUBLED, REPEATED, POINT, SPACE = 1.5, 4.5, 5.0, 0.5, 2.5, 0.3

SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]{1,2}\S(?!\S)){2,}")
TWICE = re.compile(r"(.)\1")
WORDS = re.compile(r"[^\W\d_]+")
LATIN = re.compile("[a-z]")
TWIN = re.compile(f"[{''.join(TWINS)}]")
#: Single letters with signs between them
SPELT = re.compile(r"(?:\w[^\w\s]+){2,}\w?")
EDGE = ".,;:?\"'()[]{}…–—“”„»«"


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """The symbol of every character of the basic plane: letters by their base letter, whatever their case and accents."""
    table = np.zeros(65536, np.uint8)
    for code in range(65536):
        c = chr(code)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[:1]
            table[code] = ord(base) - 96 if "a" <= base <= "z" else 19 if c == "ß" else OTHER
        elif c.isdigit():
            table[code] = DIGIT
    return table


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return folding()[np.where(codes < 65536, codes, 0)].astype(np.int64)


def gram_counts(text: str, piece: int = 1_000_000) -> np.ndarray:
    """How often each 4-gram stands in ``text``: contexts begin anew with every word, runs of spaces count once."""
    counts = np.zeros(SYMBOLS**4, np.int64)
    carried = np.zeros(3, np.int64)
    for at in range(0, len(text) + 1, piece):
        s = np.concatenate([carried, symbols(text[at : at + piece] + ("\n" if at + piece > len(text) else ""))])
        carried = s[-3:]
        last, one = s[3:], s[2:-1]
        two = np.where(one == 0, 0, s[1:-2])
        three = np.where(two == 0, 0, s[:-3])
        kept = (last != 0) | (one != 0)
        counts += np.bincount((((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + last)[kept], minlength=SYMBOLS**4)
    return counts


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts: one row per 4-gram of each task, then one sum each."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in small(batches):
            total += gram_counts("\n".join(t or "" for t in batch.column(0).to_pylist()))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> array:
    """log P(symbol | three before it) of every 4-gram, by interpolation with the shorter ones."""
    by_length = [counts.reshape((SYMBOLS,) * 4).astype(np.float64)]
    for _ in range(3):
        by_length.append(by_length[-1].sum(axis=0))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for c in reversed(by_length):
        n, kinds = c.sum(axis=-1, keepdims=True), np.count_nonzero(c, axis=-1)[..., None]
        kinds = np.maximum(kinds, 1)
        p = (c + kinds * p) / (n + kinds)
    return array("f", np.log(p).astype(np.float32).ravel().tobytes())


def language_model(docs: DataFrame) -> array:
    got = count_grams(docs).toArrow()  # as many rows as there are 4-grams
    counts = np.zeros(SYMBOLS**4, np.int64)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return log_probabilities(counts)


Unit = list[tuple[str, float]]


def lattice(shown: str) -> list[Unit]:
    """What each run of equal characters of ``shown`` (lower case) may have been: (text, cost), cheapest kept as it is."""
    units: list[Unit] = []
    i, n = 0, len(shown)
    swaps = LEET | TWINS if LATIN.search(shown) else LEET
    point = SPACE if SPELT.fullmatch(shown) else POINT
    while i < n:
        c, j = shown[i], i + 1
        while j < n and shown[j] == c:
            j += 1
        m, run = j - i, shown[i:j]
        inside = 0 < i and j < n
        if c in INVISIBLE:
            units.append([("", 0.0)])
        elif c in swaps:
            unit = [(run, 0.0)]
            for letter in swaps[c]:
                unit.append((letter, SWAP + (REPEATED if m > 1 else 0.0)))
                if m > 1:
                    unit.append((letter * 2, SWAP + (REPEATED if m > 2 else 0.0)))
            units.append(unit)
        elif c.isalpha():
            unit = [(run, 0.0)] if m < 3 else [(c * 2, REPEATED)]
            if m > 1:
                unit.append((c, DOUBLED if m == 2 else REPEATED))
            units.append(unit)
        elif c.isspace():
            units.append([(" ", 0.0), ("", SPACE)])
        elif inside and not c.isdigit():
            unit = [(run, 0.0), ("", point)]
            if run == "*":
                unit += [(letter, MASK) for letter in LETTERS]
            units.append(unit)
        else:
            units.append([(run, 0.0)])
        i = j
    return units


class Channel:
    """Restores texts under a language model; remembers words."""

    def __init__(self, logp: array, cache: int = CACHE):
        self.logp, self.limit = logp, cache
        self.known: dict[str, tuple[str, ...]] = {}
        self.restored: dict[str, str] = {}
        self.halved: dict[tuple[str, str, str], bool] = {}
        self.symbol_of: dict[str, int] = {}

    def _symbol(self, c: str) -> int:
        got = self.symbol_of.get(c)
        if got is None:
            got = self.symbol_of[c] = int(folding()[ord(c)]) if ord(c) < 65536 else 0
        return got

    def _read(self, state: int, text: str) -> tuple[int, float]:
        """The state after ``text``, and its log-probability. Between words nothing counts, and contexts begin anew."""
        total = 0.0
        for c in text:
            s = self._symbol(c)
            if s:
                total += self.logp[state * SYMBOLS + s]
                state = (state * SYMBOLS + s) % SYMBOLS**3
            elif state:
                total += self.logp[state * SYMBOLS]
                state = 0
        return state, total

    def decode(self, units: list[Unit]) -> str:
        """The likeliest text of a lattice; of equally likely ones the alternative that stands first."""
        best: dict[int, float] = {0: 0.0}
        steps: list[dict[int, tuple[int, str]]] = []
        for unit in units:
            ahead: dict[int, float] = {}
            came: dict[int, tuple[int, str]] = {}
            if len(unit) == len(best) == 1:
                (text, cost), ((state, score),) = unit[0], best.items()
                to, gain = self._read(state, text)
                best = {to: score + gain - cost}
                steps.append({to: (state, text)})
                continue
            for state, score in best.items():
                for text, cost in unit:
                    to, gain = self._read(state, text)
                    total = score + gain - cost
                    if to not in ahead or total > ahead[to]:
                        ahead[to], came[to] = total, (state, text)
            best = ahead
            steps.append(came)
        state = max(best, key=lambda s: best[s] + (self.logp[s * SYMBOLS] if s else 0.0))
        out = []
        for came in reversed(steps):
            state, text = came[state]
            out.append(text)
        return "".join(reversed(out))

    def words(self, shown: str) -> tuple[str, ...]:
        """The words of a run without spaces, in lower case, plain and restored; what was changed goes to ``restored``."""
        got = self.known.get(shown)
        if got is not None:
            return got
        if len(self.known) >= self.limit:
            self.known.clear()
            self.restored.clear()
        inner = shown if shown.isalpha() else shown.strip(EDGE)
        if inner.isalpha() and not TWICE.search(inner) and not TWIN.search(inner):
            got = (inner,)
        elif not WORDS.search(shown):
            got = ()
        else:
            made = self._undoubled(inner) if inner.isalpha() and not TWIN.search(inner) else None
            made = self.decode(lattice(shown)) if made is None else shown.replace(inner, made, 1)
            got = tuple(WORDS.findall(shown))
            if made != shown:
                self.restored[shown] = made
                got = tuple(dict.fromkeys([*got, *WORDS.findall(made)]))
        self.known[shown] = got
        return got

    def _undoubled(self, word: str) -> str | None:
        """What :meth:`decode` makes of a word whose only signs are pairs of a letter, each judged by the letters near it.

        Contexts are three letters long, so a pair's two alternatives differ only up to the third letter behind it. Pairs nearer to each
        other, and longer runs, are left to the whole search: None.
        """
        out, at = [], 0
        for m in TWICE.finditer(word):
            i, j = m.span()
            if (at and i < at + 3) or word[j : j + 1] == m.group(1) or (i and word[i - 1] == m.group(1)):
                return None
            key = word[max(0, i - 3) : i], m.group(1), word[j : j + 3]
            drop = self.halved.get(key)
            if drop is None:
                if len(self.halved) >= self.limit:
                    self.halved.clear()
                drop = self.halved[key] = self._halves(*key)
            out.append(word[at : i + 1] if drop else word[at:j])
            at = j
        return "".join([*out, word[at:]])

    def _halves(self, before: str, letter: str, behind: str) -> bool:
        """Whether one letter between its neighbours is likelier than two; with fewer than three neighbours the word ends there."""
        state, _ = self._read(0, before)
        told = []
        for text in (letter * 2 + behind, letter + behind):
            to, gain = self._read(state, text)
            told.append(gain + (self.logp[to * SYMBOLS] if len(behind) < 3 else 0.0))
        return told[1] - DOUBLED > told[0]

    def spaced(self, text: str) -> list[tuple[str, str]]:
        """(shown, restored) of runs of single characters with spaces between them, in lower case."""
        return [(m.group(), self.decode(lattice(m.group()))) for m in SPACED.finditer(text)]

    def restore(self, text: str) -> str:
        """The whole text: what is left as it was keeps its case."""

        def word(m: re.Match) -> str:
            shown = m.group().lower()
            self.words(shown)
            return self.restored.get(shown, m.group())

        def spaced(m: re.Match) -> str:
            shown = m.group().lower()
            got = self.decode(lattice(shown))
            return m.group() if got == shown else got

        return re.sub(r"\S+", word, SPACED.sub(spaced, text))


def entries(word: str) -> list[str]:
    """What the lexicon may know of a word: its beginnings, and itself."""
    return [*[f"^{word[:k]}" for k in BEGINNINGS if len(word) > k], f"^{word}$"]


def text_words(channel: Channel, text: str) -> tuple[set[str], int]:
    """The words of a text, plain and restored, and how many distinct runs were restored."""
    text = text.lower()
    words: set[str] = set()
    changed = 0
    for shown in set(text.split()):
        words.update(channel.words(shown))
        changed += shown in channel.restored
    for shown, got in channel.spaced(text):
        if got != shown:
            words.update(WORDS.findall(got))
            changed += 1
    return words, changed


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of at most ``per_label`` documents of each label, and how many there are of each in all.

    Only rows whose id isn't held out count.
    """
    learn = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    by_id = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in by_id.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [by_id.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # 2 * per_label rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(chosen, "doc_id")
    return stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample"), totals


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def weight(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Lower bound of the log odds of an entry held by so many toxic and clean documents."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return float(odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


class Lexicon:
    """Entries with the number of toxic and clean documents that hold them, and the curve over a text's evidence."""

    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, curve: tuple[float, float, float] = (0.0, 1.0, 1.0)):
        self.counts, self.n_toxic, self.n_clean, self.curve = counts, n_toxic, n_clean, curve
        self.weights = {e: weight(t, c, n_toxic, n_clean) for e, (t, c) in counts.items()}

    def word(self, word: str, own: int | None = None) -> float:
        """The greatest weight of a word's entries, 0 at least; ``own`` is the label of a text whose own counts are left out."""
        best = 0.0
        for e in entries(word):
            w = self.weights.get(e)
            if w is None:
                continue
            if own is not None:
                t, c = self.counts[e]
                w = weight(max(0, t - (own == 1)), max(0, c - (own == 0)), self.n_toxic - (own == 1), self.n_clean - (own == 0))
            best = max(best, w)
        return best

    def evidence(self, words: Iterable[str], own: int | None = None) -> tuple[float, float, str]:
        """(greatest weight, log of one more than the number of strong words, the strongest word)."""
        most, strong, which = 0.0, 0, ""
        for word in words:
            w = self.word(word, own)
            strong += w >= STRONG
            if w > most or (w == most and w > 0 and word < which):
                most, which = w, word
        return most, float(np.log1p(strong)), which

    def score(self, most: float, strong: float) -> float:
        a, b, c = self.curve
        return round(float(1 / (1 + np.exp(-(a + b * most + c * strong)))), 6)


def _count_entries(logp):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        channel = Channel(logp.value)
        counts: dict[str, list[int]] = {}
        for batch in small(batches):
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words, _ = text_words(channel, text.as_py())
                for e in {e for w in words for e in entries(w)}:
                    counts.setdefault(e, [0, 0])[toxic] += 1
        names = ["entry", "clean", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]], names=names)

    return run


def _own_evidence(logp, lexicon):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        channel, known = Channel(logp.value), lexicon.value
        for batch in small(batches):
            labels = batch.column(1).to_pylist()
            got = [known.evidence(text_words(channel, t.as_py())[0], own) for t, own in zip(batch.column(0), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array(labels, pa.int32())], names=["most", "strong", "toxic"])

    return run


def fit_curve(most: np.ndarray, strong: np.ndarray, toxic: np.ndarray, totals: dict[int, int], ridge: float = 0.02, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the constant is moved from the sample's shares to the labels'."""
    x = np.column_stack([np.ones(len(most)), most, strong])
    beta, punish = np.zeros(3), ridge * np.diag([0.0, 1.0, 1.0]) + 1e-9 * np.eye(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + punish, x.T @ (toxic - p) - punish @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    share = np.log((totals[1] + 0.5) / (totals[0] + 0.5)) - np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 0.5))
    return float(beta[0] + share), float(beta[1]), float(beta[2])


def fit(docs: DataFrame, labels: DataFrame, logp: array, per_label: int = PER_LABEL) -> Lexicon:
    """The lexicon and the curve of a labelled sample; see the module's docstring for labels that are all alike."""
    spark = docs.sparkSession
    chosen, totals = sample(docs, labels, per_label)
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        n, toxic = sum(totals.values()), totals.get(1, 0)
        return Lexicon({}, 0, 0, (float(np.log((toxic + 0.5) / (n - toxic + 0.5))) if n else -40.0, 0.0, 0.0))
    shared = spark.sparkContext.broadcast(logp)
    rows = chosen.select("text", "toxic")
    counted = rows.mapInArrow(_count_entries(shared), "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likelier = F.col("toxic") * sizes[0] > F.col("clean") * sizes[1] * 2
    kept = counted.where((F.col("toxic") >= MIN_SUPPORT) & likelier).orderBy(F.col("clean") / F.col("toxic"), F.col("toxic").desc(), "entry").limit(MAX_ENTRIES)
    lexicon = Lexicon({r["entry"]: (r["toxic"], r["clean"]) for r in kept.collect()}, sizes[1], sizes[0])
    seen = rows.mapInArrow(_own_evidence(shared, spark.sparkContext.broadcast(lexicon)), "most double, strong double, toxic int").toArrow()
    lexicon.curve = fit_curve(*[seen.column(c).to_numpy().astype(np.float64) for c in ("most", "strong", "toxic")], totals)
    return lexicon


def score_texts(docs: DataFrame, logp: array, lexicon: Lexicon) -> DataFrame:
    """``SCORES_SCHEMA`` for each row of ``docs``: one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((logp, lexicon))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        logp, known = shared.value
        channel = Channel(logp)
        weights: dict[str, float] = {}

        def weighed(word: str) -> float:
            w = weights.get(word)
            if w is None:
                if len(weights) >= CACHE:
                    weights.clear()
                w = weights[word] = known.word(word)
            return w

        for batch in small(batches):
            scores, changes, which = [], [], []
            for text in batch.column(2):
                words, changed = text_words(channel, text.as_py())
                strong = [(w, word) for word in words if (w := weighed(word)) > 0]
                most = max((w for w, _ in strong), default=0.0)
                scores.append(known.score(most, float(np.log1p(sum(w >= STRONG for w, _ in strong)))))
                changes.append(changed)
                which.append(min((word for w, word in strong if w == most), default=""))
            kinds = (pa.float64(), pa.int32(), pa.int64(), pa.string())
            made = [pa.array(c, k) for c, k in zip((scores, [int(s >= 0.5) for s in scores], changes, which), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "score", "predicted", "n_restored", "evidence"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, SCORES_SCHEMA)


def restore_texts(docs: DataFrame, logp: array) -> DataFrame:
    """(doc_id, restored): the texts with disguised words as they may have been."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        channel = Channel(shared.value)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([channel.restore(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, restored string")


def score_documents(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Scores of all documents by a language model of all of them and a lexicon of labelled ones."""
    logp = language_model(docs)
    return score_texts(docs, logp, fit(docs, labels, logp, per_label))
