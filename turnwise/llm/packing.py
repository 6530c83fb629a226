"""Best-fit packing of documents into fixed-length token sequences.

Method: bounded-space online best-fit. At most ``open_bins`` sequences are open at a time, kept in a bitset keyed
by free space. A piece goes to the open sequence with the least free space that still holds it; if none does, a new
one is opened, and when all places are taken the fullest open sequence is closed first.

Plan: tokenise whole texts in one scan (no shuffle), store the small piece table in the shared folder, then deal
the pieces out evenly and pack each share in its own task. A share holds ``pieces_per_task`` pieces, whatever the
input's size, and leaves at most a few sequences part-filled. Within a share the pieces come in an order fixed by a
hash of their ids, so that a rerun task packs them alike.

Defined results: a null text counts as empty (only the end id); a null ``doc_id`` is kept; repeated rows are packed
each on its own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import stored, text_or_empty

MAX_TOKENS = 4096
END_ID = 1
OPEN_BINS = 1024
PIECES_PER_TASK = 250_000
#: Entries kept of each word cache of a Python worker.
CACHE = 600_000

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECES_SCHEMA + ", sequence_id long, offset long"

# White space as the vocabulary's normaliser sees it, where str.split() would also cut at the four separators below.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts for a vocabulary that drops white space and never merges across it.

    Each distinct white-space-free run is tokenised once by the ``tokenizers`` library's model and remembered; a
    text's ids are those of its runs, one after the other. Texts for which that doesn't hold go to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.limit = cache
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            shown = word if word.isascii() and word.isprintable() else "".join(map(self.alphabet.__getitem__, word.encode()))
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            if len(self.words) >= self.limit:
                self.words.clear()
            self.words[word] = got
        return got

    def _run(self, run: str) -> bytes:
        got = b"".join([self._word(w) for w in self.pattern.findall(run)])
        if len(self.runs) >= self.limit:
            self.runs.clear()
        self.runs[run] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _NOT_SPACE.search(text):
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        if not text.isascii():
            # lower() alone would turn a final capital sigma into another letter than the library does
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known, out = self.runs.get, []
        for run in text.lower().split():
            got = known(run)
            out.append(self._run(run) if got is None else got)
        return b"".join(out)


def cut_document(ids: bytes, max_tokens: int = MAX_TOKENS) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document of 4-byte ids."""
    step = 4 * max_tokens
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def tokenise(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece of every document: its ids by the vocabulary, then the end id."""
    path = vocabulary or default_vocabulary()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        tok = WordTokenizer(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in cut_document(tok.ids(text.as_py()) + end, max_tokens):
                    for c, v in zip(cols, (doc_id, *row), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES_SCHEMA)


class OpenBins:
    """The open sequences: a bitset with bit ``f`` set where a sequence with ``f`` free places is open."""

    def __init__(self, size: int = MAX_TOKENS, limit: int = OPEN_BINS):
        self.size, self.limit = size, limit
        self.mask = self.open = self.made = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``length`` tokens, 1 to ``size``."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            seq, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.mask |= 1 << left
            self.by_free[left].append(seq)
            self.open += 1
        return seq, self.size - free


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (see ``PIECES_SCHEMA``)."""
    shares = max(1, -(-pieces.count() // pieces_per_task))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(max_tokens, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            more = [pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(shares).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, PACKED_SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Pack every document of ``docs`` (``doc_id``, ``text``): one row per piece, see ``PACKED_SCHEMA``."""
    return pack(stored(tokenise(docs, vocabulary, max_tokens), "pieces"), max_tokens, open_bins, pieces_per_task)
