"""SentencePiece encoding and decoding with N-best segmentations.

Method: the piece lattice of a text has an edge for every piece of the vocabulary that matches at a place, weighted by
the piece's score. A forward Viterbi pass gives the best score from the start to each place; these scores are exact
heuristics for a backward A-star search from the end, which yields segmentations in order of their total scores without
expanding any that cannot be among the N best.

No piece of such a vocabulary crosses from one word into the next (a word begins at the first of the marks that stand
for spaces; this is checked when the model is loaded), nor, in most, from letters to digits or other characters. The
lattice falls into parts there. Parts are searched once and remembered. A text's best segmentation is that of its
parts; for the next ones only the parts with the smallest losses can matter, and a second A-star search, over whole
parts, combines their alternatives.

Scores: those of a unigram model are log-probabilities and used as they are. A BPE model has merge ranks instead (its
scores are 0, -1, -2, ...), whose sums mean nothing; they become log-probabilities by Zipf's law, ``-log(rank + OFFSET)``. The
best segmentation is thus the likeliest one, not what the model's merges give; decoding gives the same text for both.

Characters without a piece are spelled in byte pieces at a fixed penalty. Decoding joins pieces and bytes and drops the
mark in front. One Arrow pass over whole texts; nothing is shuffled.

Defined results: null and empty texts have one segmentation without pieces, score 0; a word's segmentations
of equal score are ordered by their piece ids, and texts' by which words differ from the best, later words first; the mark character itself in a text decodes as a space; repeated rows are encoded alike; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import small

MARK = "▁"
N_BEST = 4
#: Penalty below the worst piece for a character that must be spelled in bytes.
UNKNOWN = 10.0
#: Added to merge ranks before their logarithm is taken.
OFFSET = 10.0
#: Words that a worker remembers; when there are more, it starts anew.
CACHE = 500_000
#: Scores that differ by less are equal.
TIE = 1e-9

DIGEST_SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, nbest_crc32 array<long>, round_trip boolean"
ENCODED_SCHEMA = "doc_id long, rank int, score double, ids array<int>"

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Nodes of the tree of pieces: what follows by character, and the score and id of the piece that ends here.
Tree = dict[str, tuple["Tree", float | None, int]]

Segmentation = tuple[float, tuple[int, ...]]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """N-best search over the pieces of a SentencePiece model."""

    def __init__(self, model: str, words: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in usable}
        if all(x == round(x) for x in scores.values()):
            scores = {i: -math.log(OFFSET - x) for i, x in scores.items()}
        self.score = {self.pieces[i]: (x, i) for i, x in scores.items()}
        crossing = [p for p in self.score if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces that cross words, such as {crossing[0]!r}, are not supported")
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        # What each id decodes to
        self.raw = [bytes((int(p[3:-1], 16),)) if sp.is_byte(i) else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.raw[self.unknown] = b" \xe2\x81\x87 "
        self.longest = max(map(len, self.score))
        self.floor = min(s for s, _ in self.score.values()) - UNKNOWN
        # lengths of the pieces by their first three characters, so that few substrings are looked up
        lengths: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 2:
                lengths.setdefault(p[:3], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v)) for k, v in lengths.items()}
        self.tree: Tree = {}
        for p, (value, i) in self.score.items():
            at = self.tree
            for c in p[:-1]:
                at = at.setdefault(c, ({}, None, -1))[0]
            at[p[-1]] = (at.get(p[-1], ({}, None, -1))[0], value, i)
        self.part = self._parts()
        self.limit = words
        # Of each word met: its number; by number the score, the loss of the second best segmentation and the ids
        self.number: dict[str, int] = {}
        self.totals: list[float] = []
        self.losses: list[float] = []
        self.ids: list[bytes] = []
        self.more: dict[tuple[str, int], list[Segmentation]] = {}

    def _parts(self) -> re.Pattern:
        """What cuts a text into parts that no piece crosses: runs of letters, of digits or of others, if the pieces are such."""
        letter, digit = re.compile(r"[^\W\d_]"), re.compile(r"\d")
        odd = {c for p in self.score for c in p if letter.match(c) and not c.isalpha()}
        kind = lambda c: "digit" if digit.match(c) else "letter" if letter.match(c) and c not in odd else "other"
        if any(len(set(map(kind, p.lstrip(MARK)))) > 1 for p in self.score):
            return _WORD
        no = re.escape("".join(sorted(odd)))
        return re.compile(rf"{MARK}*(?:[^\W\d_{no}]+|\d+|(?:[\W_{no}](?<!{MARK}))+)|{MARK}+")

    def spelled(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character, or the unknown piece where the model has none."""
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)

    def forward(self, word: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """The lattice as (start, score, id) by end place, and the best score from the start to each place.

        Id -1 is a character spelled in bytes.
        """
        n, score, lengths = len(word), self.score.get, self.lengths.get
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        alpha = [0.0] + [float("-inf")] * n
        for i in range(n):
            a = alpha[i]
            s, piece = score(word[i]) or (self.floor, -1)
            into[i + 1].append((i, s, piece))
            if a + s > alpha[i + 1]:
                alpha[i + 1] = a + s
            if i + 1 == n:
                break
            if hit := score(word[i : i + 2]):
                into[i + 2].append((i, *hit))
                if a + hit[0] > alpha[i + 2]:
                    alpha[i + 2] = a + hit[0]
            for size in lengths(word[i : i + 3], ()):
                j = i + size
                if j > n:
                    break
                if hit := score(word[i:j]):
                    into[j].append((i, *hit))
                    if a + hit[0] > alpha[j]:
                        alpha[j] = a + hit[0]
        return into, alpha

    def nbest_word(self, word: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations of a word: backward A-star, with the forward scores as heuristics."""
        into, alpha = self.forward(word)
        end = len(word)
        # (loss against the best at least, ids from here to the end, place, what is sure)
        heap: list[tuple[float, tuple[int, ...], int, float]] = [(0.0, (), end, 0.0)]
        out: list[Segmentation] = []
        while heap and len(out) < n:
            _, ids, place, sure = heapq.heappop(heap)
            if place == 0:
                out.append((sure, ids))
                continue
            for start, s, piece in into[place]:
                new = self.spelled(word[start]) if piece < 0 else (piece,)
                heapq.heappush(heap, (round(alpha[end] - sure - s - alpha[start], 9), new + ids, start, sure + s))
        return out

    def alternatives(self, word: str, n: int) -> list[Segmentation]:
        key = (word, n)
        got = self.more.get(key)
        if got is None:
            if len(self.more) >= self.limit // 4:
                self.more.clear()
            got = self.more[key] = self.nbest_word(word, n)
        return got

    def learn(self, words: Iterable[str]) -> None:
        """Search the words that have no number yet."""
        if len(self.number) > self.limit:
            self.number, self.totals, self.losses, self.ids = {}, [], [], []
        for word in words:
            if word not in self.number:
                total, ids, loss = self._search(word)
                self.number[word] = len(self.ids)
                self.totals.append(total)
                self.losses.append(loss)
                self.ids.append(ids)

    def numbered(self, words: list[str]) -> list[int]:
        try:
            return list(map(self.number.__getitem__, words))
        except KeyError:
            self.learn(words)
            return list(map(self.number.__getitem__, words))

    def _search(self, word: str) -> tuple[float, bytes, float]:
        """(score, ids, loss of the second best segmentation, infinite if there is none), by Viterbi with the two best of each place."""
        n, none = len(word), float("-inf")
        best, second = [0.0] + [none] * n, [none] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        tree, longest = self.tree, self.longest
        for i in range(n):
            a, a2, j, children = best[i], second[i], i, tree
            for c in word[i : i + longest]:
                node = children.get(c)
                if node is None:
                    break
                children, s, piece = node
                j += 1
                if s is None:
                    if j > i + 1:
                        continue
                    s, piece = self.floor, -1
                v = a + s
                if v > best[j]:
                    second[j] = max(best[j], a2 + s)
                    best[j] = v
                    back[j] = (i, piece)
                elif v > second[j]:
                    second[j] = v
            if j == i:  # no piece begins with this character
                v = a + self.floor
                if v > best[i + 1]:
                    second[i + 1] = max(best[i + 1], a2 + self.floor)
                    best[i + 1] = v
                    back[i + 1] = (i, -1)
                elif v > second[i + 1]:
                    second[i + 1] = v
        ids, at = [], n
        while at:
            at, piece = back[at]
            if piece < 0:
                ids += reversed(self.spelled(word[at]))
            else:
                ids.append(piece)
        ids.reverse()
        loss = best[n] - second[n]
        # Where several segmentations are the best, the A-star search decides by ids
        if loss < TIE:
            ids = list(self.nbest_word(word, 1)[0][1])
        return best[n], array("i", ids).tobytes(), loss

    def words(self, text: str) -> list[str]:
        """The parts of a text between which no piece stands."""
        return self.part.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> bytes:
        """The ids of the best segmentation, as 32-bit numbers."""
        return b"".join(map(self.ids.__getitem__, self.numbered(self.words(text))))

    def nbest(self, text: str, n: int = N_BEST) -> tuple[list[float], list[bytes]]:
        """(scores, ids as 32-bit numbers) of the ``n`` best segmentations of a text, best first."""
        words = self.words(text)
        numbers = self.numbered(words)
        parts = list(map(self.ids.__getitem__, numbers))
        total = math.fsum(map(self.totals.__getitem__, numbers))
        whole = b"".join(parts)
        # At most n - 1 places differ from the best in any of the n best, and they are among those of least loss, the
        # first of equal ones.
        losses = np.array(list(map(self.losses.__getitem__, numbers)))
        if n < 2 or not len(losses) or losses.min() == float("inf"):
            return [total], [whole]
        if len(losses) > n - 1:
            near = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2])
            places = near[np.argsort(losses[near], kind="stable")][: n - 1].tolist()
        else:
            places = np.argsort(losses, kind="stable").tolist()
        choices = []
        for p in places:
            found = self.alternatives(words[p], n)
            choices.append([(max(0.0, found[0][0] - s), array("i", ids).tobytes()) for s, ids in found])
        # A-star over the chosen places: without any further change, the rest costs nothing
        heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(places))]
        seen, picked = set(), []
        while heap and len(picked) < n:
            loss, at = heapq.heappop(heap)
            if at in seen:
                continue
            seen.add(at)
            picked.append((loss, at))
            for i, c in enumerate(choices):
                if at[i] + 1 < len(c):
                    heapq.heappush(heap, (round(loss + c[at[i] + 1][0] - c[at[i]][0], 9), (*at[:i], at[i] + 1, *at[i + 1 :])))
        # the places where something changes, in text order, as bytes of the best
        ends = np.cumsum(list(map(len, parts)))
        order = sorted(range(len(places)), key=places.__getitem__)
        out = []
        for _, at in picked:
            pieces, last = [], 0
            for i in order:
                if at[i]:
                    end = int(ends[places[i]])
                    pieces += [whole[last : end - len(parts[places[i]])], choices[i][at[i]][1]]
                    last = end
            out.append(b"".join([*pieces, whole[last:]]) if pieces else whole)
        return [total - loss for loss, _ in picked], out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a sequence of ids."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def shared_lattice(path: str) -> Lattice:
    """One lattice per Python worker: what its words cost is kept from task to task."""
    return Lattice(path)


def encode_documents(docs: DataFrame, model: str | None = None, n: int = N_BEST) -> DataFrame:
    """A row for each of the up to ``n`` best segmentations of each document: see ``ENCODED_SCHEMA``."""
    path = model or default_model()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        lattice = shared_lattice(path)
        for batch in small(batches):
            cols: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rank, (score, ids) in enumerate(zip(*lattice.nbest(text.as_py() or "", n), strict=True)):
                    for c, v in zip(cols, (doc_id, rank, score, memoryview(ids).cast("i").tolist()), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "rank", "score", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED_SCHEMA)


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, rank, text) from (doc_id, rank, ids)."""
    path = model or default_model()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        lattice = shared_lattice(path)
        for batch in small(batches):
            texts = [lattice.decode(x or ()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return encoded.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")


def encode_digests(docs: DataFrame, model: str | None = None, n: int = N_BEST) -> DataFrame:
    """Per document the size and digests of its ``n`` best segmentations, and whether the best decodes to its text."""
    path = model or default_model()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        lattice = shared_lattice(path)
        for batch in small(batches):
            sizes, crcs, scores, each, back = [], [], [], [], []
            for item in batch.column(1):
                text = item.as_py() or ""
                s, ids = lattice.nbest(text, n)
                sums = [zlib.crc32(i) for i in ids]
                sizes.append(len(ids[0]) // 4)
                crcs.append(sums[0])
                scores.append(s)
                each.append(sums)
                back.append(lattice.decode(memoryview(ids[0]).cast("i")) == text.replace(MARK, " "))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
            cols = [pa.array(c, k) for c, k in zip((sizes, crcs, scores, each, back), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_pieces", "ids_crc32", "scores", "nbest_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST_SCHEMA)
