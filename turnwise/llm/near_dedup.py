"""Near-duplicate documents by Order MinHash.

Method: a text's word 5-mers, each labelled with its occurrence number, are hashed by several functions. Each sketch
samples the few smallest and keeps them in text order, so that it answers to edit similarity rather than to mere overlap.
Documents that share a sketch are candidates, and a banded alignment of their word sequences decides: they are
near-duplicates when ``1 - edits / longer length`` is ``SIMILARITY`` or more. Classes are the connected components of the
links.

Plan, from a hot group's point of view:

1. One scan makes sketches (Arrow batches). Equal texts collapse by partial aggregation to one row, so copies cost
   nothing further on.
2. Buckets are never gathered. Each sketch gives a key, and so does the least 5-mer alone of further functions: edits
   that are spread over a text leave few 5-mers, and seldom two of a sketch. With each key goes the text's length, in steps of
   ``CELL`` times that start elsewhere for every function, so that texts of unlike lengths seldom meet; short texts have more
   keys, of single 3-mers. An
   aggregation keeps of each bucket its size and its first and last member in a fixed random order; a
   skew-splittable join brings these two back to every member: at most 2 B candidate pairs of B documents.
3. Only documents in candidate pairs have their words read again, as 32-bit numbers. Pairs whose lengths alone forbid
   the similarity go before any words travel; the others meet their words by two joins on the document id, the second on
   the pair's hub, so that a hub's words aren't sent once per pair.
4. Each document's first partner is verified before the others: of these, pairs whose documents are in one class by
   then need no look.
5. Buckets whose members are still of several classes are mixed: a passage that many documents share makes
   such. Their members are split by rounds of further sketches (other functions, of three-word k-mers, two to
   six in text order; ``FURTHER`` rounds, and then as long as a round finds links), in which steps 2 to 4 are repeated for pairs of different classes, with last members
   by another order in every bucket. The more k-mers in order a sketch has, the fewer unlike texts share it, however
   much text they have in common; so every round leaves smaller buckets, and goes on with those still mixed.
6. Components are found by contraction: each partition joins what its links join and hands on a row per node, the rows
   of a node meet in one partition, and only roots that meet there are links of the next level, written to the shared folder.
7. Numbers of words and labels travel with the keys, so that no pair is joined with its documents for them: on small
   tables the number of shuffles is what counts. The files of each are deleted when the query that made them ends.

All joins are merge joins, at every size: none depends on a side being small. Intermediate tables are deleted.

Defined results: one row per input row. Null text counts as empty; empty texts are copies of each other. Words are
runs of letters, digits and underscores, in lower case; a text of fewer than five words has one k-mer, all its words,
and one with no word at all is only a copy of equal texts. Ties keep the least ``doc_id``; rows with a null ``doc_id``
get the class of their text, and different texts under one ``doc_id`` their own classes. Further columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import Scratch, stored, text_or_empty

K = 5
#: Sketches of a first round as (k, k-mers of a sketch, functions); those of each further round of mixed buckets.
FIRST = ((5, 2, 12), (5, 1, 20))
MORE = ((3, 2, 6), (3, 4, 20), (3, 6, 18))
#: Sketches that texts of up to ``SHORT_WORDS`` words have besides: edits leave them few 5-mers, or none.
SHORT = ((3, 1, 20),)
SHORT_WORDS = 60
#: Rounds of further sketches: at least, and at most; they go on as long as the last one found links.
FURTHER, FURTHER_MOST = 2, 12
SIMILARITY = 0.8
#: Lengths that share a bucket differ by less than this factor; it is well over 1 / SIMILARITY.
CELL = 2.0
#: Up to so many words an alignment is made in bit vectors, a word of one text against all of the other at a time.
BIT_WORDS = 16_384
#: In longer texts, up to so many edits the alignment follows diagonals; beyond it fills a band row by row.
DIAGONALS = 48
MAX_ROUNDS = 60

SCHEMA = "doc_id long, cluster_id long, is_duplicate boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), by element."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _letters() -> np.ndarray:
    """For every code point the lower-case form, by code point, of a letter, digit or underscore, and 0 for all others."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x32400):  # no letters stand above
        c = chr(i)
        if c.isalnum() or c == "_":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@cache
def _powers() -> np.ndarray:
    return np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


class Words:
    """Texts as arrays of 32-bit word numbers: hashes of the words, all of a text at a time."""

    def numbers(self, text: str) -> np.ndarray:
        codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = np.flatnonzero(codes)
        if not len(at):
            return np.empty(0, np.uint32)
        first = np.flatnonzero(np.append(True, np.diff(at) != 1))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        values = (codes[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x2545F4914F6CDD1D)) * _powers()[place & 4095]
        return (_mixed(np.add.reduceat(values, first)) >> np.uint64(32)).astype(np.uint32)


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer in text order, together with its occurrence number."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = words.astype(np.uint64)
    size = min(k, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - size + 1 + i])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if new.all():
        return h
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    label = np.empty(len(h), np.uint64)
    label[order] = nth.astype(np.uint64)
    return np.where(label > 0, _mixed(h + label * np.uint64(0xD6E8FEB86659FD93)), h)


def sketches(words: np.ndarray, m: int = 20, order: int = 2, k: int = K) -> np.ndarray | None:
    """``m`` order-min-hashes: of each hash function the ``order`` least k-mers, in text order, as one number."""
    kmers = labelled_kmers(words, k)
    return _least(kmers, m, order, 1) if len(kmers) else None


def keys_of(words: np.ndarray, plan: tuple = FIRST, first: int = 1) -> np.ndarray | None:
    """A document's bucket keys by a plan of (k, order, functions), each with the text's length in steps of ``CELL``."""
    if not len(words):
        return None
    kmers = {k: labelled_kmers(words, k) for k in {k for k, _, _ in plan}}
    keys = []
    for k, order, m in plan:
        keys.append(_least(kmers[k], m, order, first))
        first += m
    all_keys = np.concatenate(keys)
    # every function's steps of length start elsewhere
    offset = _mixed(np.arange(first, first + len(all_keys), dtype=np.uint64)).astype(np.float64) / 2.0**64
    cell = np.floor(np.log(len(words)) / np.log(CELL) + offset).astype(np.uint64)
    return _mixed(all_keys + cell * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def first_keys(words: np.ndarray) -> np.ndarray | None:
    """The keys of a first round: those of ``FIRST``, and behind them those of ``SHORT`` if the text is short."""
    keys = keys_of(words)
    return np.concatenate([keys, keys_of(words, SHORT, 501)]) if 0 < len(words) <= SHORT_WORDS else keys


def _least(kmers: np.ndarray, m: int, order: int, first: int, cells: int = 4_000_000) -> np.ndarray:
    """The sketches of the hash functions ``first`` to ``first + m - 1``; up to ``cells`` hashes at a time."""
    step = max(1, cells // len(kmers))
    if step < m:
        return np.concatenate([_least(kmers, min(step, m - i), order, first + i, cells) for i in range(0, m, step)])
    odd = _mixed(np.arange(first, first + m, dtype=np.uint64)) | np.uint64(1)
    # 32 bits of a multiply-shift order the k-mers; their whole hashes make the key
    values = ((kmers[None, :] * odd[:, None]) >> np.uint64(32)).astype(np.uint32)
    least = min(order, len(kmers))
    rows, places = np.arange(m), np.empty((m, least), np.int64)
    for i in range(least):
        places[:, i] = values.argmin(axis=1)
        values[rows, places[:, i]] = np.uint32(0xFFFFFFFF)
    places.sort(axis=1)
    key = odd.copy()
    for i in range(least):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + kmers[places[:, i]])
    return key


def _by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance by furthest-reaching diagonals, or None if it is over ``most``."""
    n, m = len(a), len(b)
    stops: dict[int, np.ndarray] = {}

    def slide(k: int, i: int) -> int:
        """From place i of a on diagonal k (b is k ahead), how far equal words lead."""
        if k not in stops:
            lo, hi = max(0, -k), min(n, m - k)
            stops[k] = np.append(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo, hi)
        s = stops[k]
        return int(s[min(np.searchsorted(s, i), len(s) - 1)]) if i < s[-1] else i

    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if d:
            far: dict[int, int] = {}
            for k in range(max(-d, -n), min(d, m) + 1):
                i = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
                if i >= max(0, -k):
                    i = min(i, n, m - k)
                    far[k] = slide(k, i)
            reach = far
        if reach.get(m - n, -1) >= n:
            return d
    return None


def _by_band(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance within a band of ``most`` around the diagonal, or None if it is over ``most``."""
    n, m = len(a), len(b)
    big, width = n + m + 1, 2 * most + 1
    at = np.arange(width)
    row = np.where((at >= most) & (at - most <= m), at - most, big)
    padded = np.full(n + m + 2 * width, -1, np.int64)
    padded[most : most + m] = b
    for i in range(1, n + 1):
        j = i - most + at
        hit = padded[i - 1 : i - 1 + width] == a[i - 1]
        best = np.minimum(row + ~hit, np.append(row[1:], big) + 1)
        best = np.where((j >= 0) & (j <= m), best, big)
        if i <= most:
            best[most - i] = i
        row = np.minimum.accumulate(best - at) + at
        row = np.where((j >= 0) & (j <= m), row, big)
        if row.min() > most:
            return None
    got = int(row[m - n + most])
    return got if got <= most else None


def _by_bits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance by bit vectors, or None if it is over ``most``.

    A column of the table of distances is two integers: in which rows it is one more, and one less, than the row above.
    """
    n, left = len(a), len(b)
    mask, last = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    more, less, found = mask, 0, n
    for word in b.tolist():
        left -= 1
        equal = where.get(word, 0)
        steep = equal | less
        flat = (((equal & more) + more) ^ more) | equal
        up = less | (mask & ~(flat | more))
        down = more & flat
        if up & last:
            found += 1
            if found - left > most:
                return None
        elif down & last:
            found -= 1
        elif found - left > most:
            return None
        up = up << 1 | 1
        more = (down << 1 | ~(steep | up)) & mask
        less = up & steep & mask
    return found if found <= most else None


def _by_anchors(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the edit distance: the cost of the alignment that common labelled 3-mers, in one order, give."""
    n, m = len(a), len(b)
    if min(n, m) < 3:
        return max(n, m)
    _, ia, ib = np.intersect1d(labelled_kmers(a, 3), labelled_kmers(b, 3), assume_unique=True, return_indices=True)
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    # Moved 3-mers far off the common diagonal would break the order
    shift = ib - ia
    near = np.abs(shift - np.median(shift)) <= max(8, abs(n - m) + max(n, m) // 10) if len(shift) else []
    ia, ib = ia[near], ib[near]
    chain = (ib == np.maximum.accumulate(ib)) & (ib == np.minimum.accumulate(ib[::-1])[::-1]) if len(ib) else []
    ia, ib = ia[chain], ib[chain]
    if not len(ia):
        return max(n, m)
    da, db = np.diff(ia), np.diff(ib)
    between = np.maximum(da, db) - np.minimum(3, np.minimum(da, db))
    return int(max(ia[0], ib[0]) + between.sum() + max(n - ia[-1], m - ib[-1]) - 3)


def _least_edits(a: np.ndarray, b: np.ndarray, most: int, q: int) -> int:
    """A lower bound of the edit distance if that is ``most`` or less: of one's q-mers that the other hasn't got within
    ``most`` places, an edit accounts for ``q`` at most."""
    if min(len(a), len(b)) < q:
        return 0
    parts = []
    for x in (a, b):
        h = x[: len(x) - q + 1].astype(np.uint64)
        for i in range(1, q):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - q + 1 + i])
        parts.append((h & np.uint64(0xFFFFFFFF)).astype(np.int64) << 31)
    bound = 0
    for x, y in (parts, parts[::-1]):
        at = np.arange(len(x))
        known = np.sort(y + np.arange(len(y)))
        low = np.searchsorted(known, x + np.maximum(at - most, 0))
        hit = known[np.minimum(low, len(known) - 1)]
        missing = len(x) - int(((low < len(known)) & (hit <= x + at + most) & (hit >= x)).sum())
        bound = max(bound, -(-missing // q))
    return bound


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two word sequences is ``least`` or more; exact.

    Bounds settle nearly all pairs in time about linear in their lengths. The alignment of what is left takes time in
    proportion to the length and to the edits allowed.
    """
    longer = max(len(a), len(b))
    if longer == 0:
        return True
    most = _most(longer, least)
    if abs(len(a) - len(b)) > most:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short -= head
    if short:
        differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    if min(len(a), len(b)) == 0:
        return False
    # words of one that the other lacks each cost an edit
    both = np.concatenate([a, b])
    sign = np.ones(len(both), np.int32)
    sign[len(a) :] = -1
    order = np.argsort(both)
    ranked = both[order]
    left = np.add.reduceat(sign[order], np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])))
    bound = max(int(left[left > 0].sum()), int(-left[left < 0].sum()))
    if bound > most:
        return False
    if _by_anchors(a, b) <= most:
        return True
    for q in (1, 2, 3):
        bound = max(bound, _least_edits(a, b, most, q))
        if bound > most:
            return False
    if max(len(a), len(b)) <= BIT_WORDS:
        return _by_bits(a, b, most) is not None
    found = _by_diagonals(a, b, min(most, DIAGONALS)) if bound <= DIAGONALS else None
    if found is None and most > DIAGONALS:
        found = _by_band(a.astype(np.int64), b.astype(np.int64), most)
    return found is not None


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, same, n, keys): ``same`` is the text's SHA-256, ``n`` its words, ``keys`` its bucket keys (null if it has no word)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(2):
                numbers = words.numbers(text.as_py())
                sizes.append(len(numbers))
                keys.append(first_keys(numbers))
            columns = [*batch.columns[:2], pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n", "keys"])

    return identified(docs).select("doc_id", "same", "text").mapInArrow(run, "doc_id long, same binary, n int, keys array<long>")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, same, text) of every row."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), text.alias("text"))


def further_sketches(words: DataFrame, turn: int) -> DataFrame:
    """(node, n, keys) of (node, n, words), by the functions of a further round."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        first = 1001 + 100 * turn
        for batch in batches:
            keys = [keys_of(np.frombuffer(x.as_py(), np.uint32), MORE, first) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64()))], names=["node", "n", "keys"])

    return words.select("node", "n", "words").mapInArrow(run, "node long, n int, keys array<long>")


def meetings(nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, bucket, lo, hi, size) of (node, n, keys): every member of a bucket of several with its first and last member.

    ``lo`` and ``hi`` are null where they are the member itself, or their number of words forbids the similarity.
    """
    member = members(nodes)
    rank = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"), "n")
    ends = member.groupBy("bucket").agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count(F.lit(1)).alias("size")).where("lo.id <> hi.id")
    other = lambda c: F.when((F.col(f"{c}.id") != F.col("node")) & of_like_length("n", f"{c}.n", least), F.col(f"{c}.id")).alias(c)
    return member.join(ends.hint("merge"), "bucket").select("node", "bucket", other("lo"), other("hi"), "size")


def members(nodes: DataFrame) -> DataFrame:
    """(node, bucket) and what else stands beside (keys)."""
    rest = [c for c in nodes.columns if c != "keys"]
    return nodes.where("keys IS NOT NULL").select(*rest, F.posexplode("keys").alias("band", "key")).select(*rest, F.xxhash64("band", "key").alias("bucket"))


def meetings_across(nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, label, bucket, lo, hi, size) of (node, n, label, keys): as :func:`meetings`, of buckets with several labels.

    The last member is that by an order of the bucket's own. ``lo`` and ``hi`` have an ``id`` and a ``label``, and are null
    also where they have the member's own label.
    """
    member = members(nodes)
    by = lambda h: F.struct(h.alias("h"), F.col("node").alias("id"), "label", "n")
    lo, hi = F.min(by(F.xxhash64("node"))), F.max(by(F.xxhash64("node", "bucket")))
    ends = member.groupBy("bucket").agg(lo.alias("lo"), hi.alias("hi"), F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size"))
    met = member.join(ends.where("least <> most").hint("merge"), "bucket")
    end = lambda c: F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.label").alias("label"))
    other = lambda c: F.when((F.col(f"{c}.label") != F.col("label")) & of_like_length("n", f"{c}.n", least), end(c)).alias(c)
    return met.select("node", "label", "bucket", other("lo"), other("hi"), "size")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, from meetings: every member of a bucket with the bucket's first and last member."""
    two = met.select("node", F.explode(F.array("lo", "hi")).alias("other")).where("other IS NOT NULL")
    return two.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def candidate_pairs_across(met: DataFrame) -> DataFrame:
    """Distinct (a, b, a_label, b_label), a < b, from :func:`meetings_across`."""
    two = met.select(F.struct(F.col("node").alias("id"), "label").alias("one"), F.explode(F.array("lo", "hi")).alias("other")).where("other IS NOT NULL")
    a, b = F.least("one", "other"), F.greatest("one", "other")
    return two.select(a["id"].alias("a"), b["id"].alias("b"), a["label"].alias("a_label"), b["label"].alias("b_label")).distinct()


def named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with their ``label``; one without a label is its own."""
    return nodes.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def undecided(met: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node) of the members of buckets that hold members not compared with each other and of different labels."""
    many = met.where("size > 3").select("node", "bucket", "size")
    mixed = scratch.stored(named(many, labels).groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket"), "mixed")
    # a node's largest bucket settles most; only nodes that it leaves open look into all of theirs
    largest = many.groupBy("node").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("bucket"))
    sure = scratch.stored(largest.join(mixed.hint("merge"), "bucket", "left_semi").select("node"), "sure")
    open_ = many.select("node", "bucket").join(sure.hint("merge"), "node", "left_anti")
    return sure.unionByName(open_.join(mixed.hint("merge"), "bucket", "left_semi").select("node").distinct())


def _most(longer: int, least: float) -> int:
    """The edits that a text of ``longer`` words may have."""
    return int(longer * (1 - least) + 1e-9)


def of_like_length(one: str, other: str, least: float = SIMILARITY) -> F.Column:
    """Whether two numbers of words allow the similarity."""
    return F.abs(F.col(one) - F.col(other)) <= F.floor(F.greatest(one, other) * (1 - least) + 1e-9)


def word_numbers(texts: DataFrame) -> DataFrame:
    """(node, n, words) of (node, text): the word numbers of each text as little-endian 32-bit."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            out = [words.numbers(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(list(map(len, out)), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "words"])

    return texts.mapInArrow(run, "node long, n int, words binary")


def verified(pairs: DataFrame, words: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of (a, b) whose alignment says similar; further columns are kept."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            numbers = [(np.frombuffer(c.as_py(), np.uint32) for c in column) for column in batch.columns[-2:]]
            keep = [similar(x, y, least) for x, y in zip(*numbers, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    # the one of a pair that is the first of more pairs is met last
    swap = F.xxhash64("a") < F.xxhash64("b")
    turned = pairs.select("*", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("one"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("hub"))
    left = words.select(F.col("node").alias("one"), F.col("words").alias("one_words"))
    right = words.select(F.col("node").alias("hub"), F.col("words").alias("hub_words"))
    met = turned.join(left.hint("merge"), "one").join(right.hint("merge"), "hub")
    return met.select(*pairs.columns, "one_words", "hub_words").mapInArrow(run, pairs.schema)


def first_partners(pairs: DataFrame) -> DataFrame:
    """Of (a, b) those pairs in which one is the other's first partner in a fixed random order."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    first = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("other").alias("h"), "other"))["other"].alias("other"))
    return first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, a_label, b_label) of the pairs whose documents have different labels; one without a label is its own."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")).hint("merge")
    got = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return got.select("a", "b", F.coalesce("a_label", "a").alias("a_label"), F.coalesce("b_label", "b").alias("b_label")).where("a_label <> b_label")


def linked(pairs: DataFrame, words: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> DataFrame:
    """(node, label) of the components that the similar ones of (a, b) make."""
    first = scratch.stored(first_partners(pairs), "first")
    near = scratch.stored(components(verified(first, words, least), scratch), "near")
    return further_linked(near, across(pairs.join(first.hint("merge"), ["a", "b"], "left_anti"), near), words, scratch, least)


def further_linked(near: DataFrame, pairs: DataFrame, words: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> DataFrame:
    """``near`` (node, label), with the components joined that the similar ones of (a, b, a_label, b_label) join; ``near`` itself if they join none."""
    joined = scratch.stored(verified(pairs, words, least).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), "joined")
    if joined.isEmpty():
        return near
    far = grouped(joined, scratch).select(F.col("node").alias("old"), F.col("label").alias("top"))
    known = near.select("node", F.col("label").alias("old")).unionByName(far.select(F.col("old").alias("node"), "old"))
    # a label that isn't a node of the first round stands for a single document
    single = known.groupBy("node").agg(F.min("old").alias("old"))
    return single.join(far.hint("merge"), "old", "left").select("node", F.coalesce("top", "old").alias("label"))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): the distinct nodes of the links, in order, and the first node of each one's component by a fixed random order."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(_mixed(nodes.view(np.uint64)))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    x, y = rank[at[: len(a)]], rank[at[len(a) :]]
    top = np.arange(len(nodes))
    while (top[x] != top[y]).any():
        u, v = top[x], top[y]
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
        while (top[top] != top).any():
            top = top[top]
    return nodes, nodes[order[top[rank]]]


def _contracted(batches: Iterable) -> Iterator:
    """(node, root) of links (node, root): what the links at hand join, a row per node, roots included."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _roots(*(c.to_numpy() for c in batch.columns))], names=["node", "root"])


def _settled(batches: Iterable) -> Iterator:
    """(node, root, open) of (node, root), all rows of a node at hand: a row per node; open are links of the next level, between roots."""
    import pyarrow as pa

    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if held:
        of, to = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, roots = _roots(of, to)
        for ids, is_open in ((np.unique(of), False), (np.unique(to), True)):
            root = roots[np.searchsorted(nodes, ids)]
            keep = root != ids if is_open else np.full(len(ids), True)
            columns = [pa.array(ids[keep], pa.int64()), pa.array(root[keep], pa.int64()), pa.array(np.full(keep.sum(), is_open), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "open"])


def grouped(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) of every node of (a, b) links; the label is some node of its component, the same for all.

    A level leaves of each node at most a row a partition, however many links it has, and a part of the nodes as roots:
    those that come first, in a random order, among their neighbours.
    """
    keep = scratch.stored if scratch else stored
    open_, levels = links.select(F.col("a").alias("node"), F.col("b").alias("root")), []
    for _ in range(MAX_ROUNDS):
        met = open_.mapInArrow(_contracted, "node long, root long").repartition("node")
        level = keep(met.mapInArrow(_settled, "node long, root long, open boolean"), "level")
        levels.append(level.where("NOT open").select("node", F.col("root").alias("label")))
        open_ = level.where("open").select("node", "root")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"roots still meet after {MAX_ROUNDS} levels")
    labels = levels.pop()
    for level in reversed(levels):
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = level.join(top.hint("merge"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return labels


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """As :func:`grouped`; the label is the least node of its component."""
    groups = grouped(links, scratch)
    least = groups.groupBy("label").agg(F.min("node").alias("least"))
    return groups.join(least.hint("merge"), "label").select("node", F.col("least").alias("label"))


def repeats(seen: DataFrame) -> tuple[bool, bool]:
    """Whether any id stands in several rows of :func:`sketch_table`, and whether with different texts."""
    by_id = seen.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min("same") != F.max("same")).alias("unlike"))
    found = by_id.agg(F.max(F.col("n") > 1).alias("rows"), F.max("unlike").alias("texts")).first()
    return bool(found["rows"]), bool(found["texts"])


def nodes_of(seen: DataFrame, unlike: bool) -> DataFrame:
    """(same, doc_id, node, n, keys): a row for each text of :func:`sketch_table`, with its least id and a number of its own.

    The number is the id. Where different texts stand under one id (``unlike``: anywhere), it is made of their digests; where there
    is no id at all, null.
    """
    texts = seen.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    if not unlike:
        return texts.withColumn("node", F.col("doc_id"))
    twice = seen.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("doc_id")
    own = -F.shiftrightunsigned(F.xxhash64("same"), 2) - F.lit(1 << 40)
    marked = texts.join(twice.withColumn("several", F.lit(True)).hint("merge"), "doc_id", "left")
    return marked.withColumn("node", F.when(F.col("several"), own).otherwise(F.col("doc_id"))).drop("several")


def classes(docs: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, bool]:
    """((doc_id, same) of every row, (same, doc_id, cluster_id, kept) of every text, whether any id stands in several rows).

    ``cluster_id`` is the least id of a text's class; ``kept`` marks the text that has it (of several, the least digest).
    """
    seen = scratch.stored(sketch_table(docs), "sketches")
    repeated, unlike = repeats(seen)
    texts = scratch.stored(nodes_of(seen, unlike), "texts")
    met = scratch.stored(meetings(texts.where("node IS NOT NULL").select("node", "n", "keys"), least), "meetings")
    pairs = scratch.stored(candidate_pairs(met), "pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(met.where("size > 3").select("node")).distinct()
    chosen = texts.select("same", "node", "doc_id").join(involved.hint("merge"), "node", "left_semi")
    whole = identified(docs).join(chosen.hint("merge"), ["same", "doc_id"]).select("node", "text")
    numbers = word_numbers(whole)
    words = scratch.stored(numbers.dropDuplicates(["node"]) if repeated else numbers, "words")
    labels = scratch.stored(linked(pairs, words, scratch, least), "labels")
    left = scratch.stored(undecided(met, labels, scratch), "undecided")
    for turn in range(FURTHER_MOST):
        if left.isEmpty():
            break
        # all pairs to come are of these nodes: no round reads the words of more than the one before left
        words = scratch.stored(words.join(left.hint("merge"), "node", "left_semi"), "words")
        again = scratch.stored(meetings_across(named(further_sketches(words, turn), labels), least), "meetings")
        joined = further_linked(labels, candidate_pairs_across(again), words, scratch, least)
        if joined is not labels:
            labels = scratch.stored(joined, "labels")
            left = scratch.stored(undecided(again, labels, scratch), "undecided")
        elif turn + 1 >= FURTHER:
            break
        else:  # all these buckets have members of several labels
            left = scratch.stored(again.where("size > 3").select("node").distinct(), "undecided")
    own = named(texts.where("node IS NOT NULL").select("same", "doc_id", "node"), labels)
    least_of = own.groupBy("label").agg(F.min(F.struct("doc_id", "same")).alias("least"))
    told = own.join(least_of.hint("merge"), "label").select("same", "doc_id", F.col("least.doc_id").alias("cluster_id"), (F.col("least.same") == F.col("same")).alias("kept"))
    return seen.select("doc_id", "same"), told, repeated


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The files of a shuffle go when the query that made them ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, all columns kept: the one with the least ``doc_id``.

    Of rows with equal ids and texts one stays, the first when they are written as JSON. Rows without ``doc_id`` all stay;
    they have no part in the classes.
    """
    with shuffles_deleted(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        with_id = docs.where("doc_id IS NOT NULL")
        _, told, repeated = classes(with_id, scratch, least)
        chosen = scratch.kept(told.where("kept").select(F.col("doc_id").alias("__id"), F.col("same").alias("__same")), "chosen")
    text = F.unhex(F.sha2(text_or_empty().cast("binary"), 256))
    kept = with_id.join(chosen.hint("merge"), (with_id["doc_id"].cast("long") == chosen["__id"]) & (text == chosen["__same"]), "left_semi")
    if repeated:
        order = Window.partitionBy("doc_id", text).orderBy(F.to_json(F.struct(*docs.columns)))
        kept = kept.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: its class, named by the least ``doc_id`` in it, and whether it isn't that document.

    Rows without ``doc_id`` have the class of equal texts with one, or else none.
    """
    with shuffles_deleted(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        seen, told, _ = classes(docs, scratch, least)
        met = seen.join(told.select("same", "cluster_id").hint("merge"), "same", "left")
        return scratch.kept(met.select("doc_id", "cluster_id", (~F.col("doc_id").eqNullSafe(F.col("cluster_id"))).alias("is_duplicate")), "classes")
