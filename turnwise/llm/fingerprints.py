"""Document fingerprints with SQL functions only.

Method: canonical exact digests. A text is brought to Unicode form NFC, its case is folded in full (so that ``ß`` equals ``SS`` and
a final sigma any other), it is composed again, and its white-space runs become single spaces, none at the ends; two xxhash64 values with different seeds make a digest of 128 bits. Documents
group by digest, and inside a bucket the canonical bytes are compared, so that a collision can't join different texts.

Plan: :func:`neighbours` puts documents next to each other in descending order of ``doc_id`` without a global sort. Ids
fall into ranges of about ``RANGE_ROWS`` rows, and the first document of each range also goes, as a
copy, to the range before. Each range is then one small window; nothing is gathered in one place. The range bounds are
driver-side numbers, as many as there are ranges. Texts are shuffled once.
:func:`groups` shuffles digests only, and the texts of buckets with more than one member; a bucket's members meet one
representative each, by a join that can split hot buckets.

Defined results: null text counts as empty, and white-space-only texts have the empty text's fingerprint; rows with a null
``doc_id`` come last in descending order; ties in ``doc_id`` are ordered by text; a single row's next document is
itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import text_or_empty

#: Rows of one range of ids, about.
RANGE_ROWS = 500
#: Not more ranges than so many (half a megabyte of bounds); beyond 33 million rows ranges grow, and sort with spilling.
MAX_RANGES = 65_536
#: Bounds compared at a time.
STEP = 256


def _composed(text: Column) -> Column:
    """NFC. Texts of code points below U+0300 only are in NFC as they are."""
    return F.when(text.rlike("[^\\u0000-\\u02ff]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))).otherwise(text)


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC, white space folded. For ASCII, folding is lower case."""
    folded = F.when(text.rlike("[^\\u0000-\\u007f]"), _composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _composed(text), F.lit(True)))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of two xxhash64 chains with different seeds, in hexadecimal."""
    wide = [F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2)]
    return F.lower(F.concat(*wide))


def fingerprint(text: Column) -> Column:
    return digest(canonical(text))


def id_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS) -> list[int]:
    """Ascending lower bounds of ranges of ``doc_id``; found by quantiles of the ids alone."""
    total = docs.count()
    n = min(MAX_RANGES, max(1, total // range_rows))
    if n == 1:
        return []
    q = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in q})


def _longs(values: list[int | None]) -> Column:
    """An array literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _rank(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or below an id; found in two steps of few comparisons."""
    if not bounds:
        return F.lit(0)
    coarse = F.size(F.filter(_longs(bounds[::STEP]), lambda b: b <= doc_id))
    first = (F.greatest(coarse, F.lit(1)) - 1) * STEP
    return first + F.size(F.filter(F.slice(_longs(bounds), first + 1, STEP), lambda b: b <= doc_id))


def neighbours(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """``doc_id``, ``text``, ``fp`` of every document with ``next_text``, ``next_fp`` of the next in descending order."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # null ids stand below all others
    rows = ids.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(_rank(F.col("doc_id"), bounds)))
    tops = {r[0]: r[1] for r in rows.groupBy("bucket").agg(F.max("doc_id")).collect()}
    # The last row of a bucket is followed by the first of the bucket below, which goes there as a copy; the lowest
    # bucket's last row by the first of the highest: a ring.
    used = sorted(tops)
    above = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    places = range(max(used, default=-1) + 1)
    is_top = F.get(_longs([tops.get(b) for b in places]), F.col("bucket")) == F.col("doc_id")
    copy_to = F.when(F.col("doc_id").isNull(), F.lit(above.get(-1))).when(is_top, F.get(_longs([above.get(b) for b in places]), F.col("bucket")))
    spot = lambda copy, b: F.struct(F.lit(copy).alias("copy"), b.cast("long").alias("b"))
    spots = F.array_compact(F.array(spot(0, F.col("bucket")), F.when(copy_to.isNotNull(), spot(1, copy_to))))
    dealt = rows.withColumn("fp", fingerprint(F.col("text"))).withColumn("spot", F.explode(spots))
    dealt = dealt.select("doc_id", "text", "fp", F.col("spot.copy").alias("copy"), F.col("spot.b").alias("b"))
    w = Window.partitionBy("b").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("copy = 0").drop("copy", "b")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many of the following text's first."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def fingerprint_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they are (1 if equal, else 0)."""
    near = neighbours(docs, id_ranges(docs, range_rows))
    near = near.withColumn("edit", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fingerprint", fingerprint(F.col("edit")))
    same = lambda a: (F.col("fp") == F.col(a)).cast("double")
    return near.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        "edited_fingerprint",
        same("edited_fingerprint").alias("near_edited"),
        same("next_fp").alias("near_next"),
    )


def fingerprint_groups(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """:func:`fingerprint_documents` with ``group_id``: the least ``doc_id`` of the documents with the same canonical bytes."""
    of = groups(docs).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id")).withColumnsRenamed({"doc_id": "__id", "fingerprint": "__fp"})
    near = fingerprint_documents(docs, range_rows)
    return near.join(of.hint("merge"), (near["fingerprint"] == of["__fp"]) & near["doc_id"].eqNullSafe(of["__id"]), "left").drop("__id", "__fp")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id): documents of equal canonical bytes have the least ``doc_id`` among them as group."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(text_or_empty()).alias("canon"))
    rows = rows.withColumn("fingerprint", digest(F.col("canon")))
    many = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = rows.join(many, "fingerprint", "left_anti").select("doc_id", "fingerprint", F.col("doc_id").alias("group_id"))
    reps = rows.join(many.select(F.col("rep").alias("doc_id"), "fingerprint"), ["doc_id", "fingerprint"], "left_semi")
    reps = reps.select("fingerprint", F.col("doc_id").alias("rep"), F.col("canon").alias("rep_canon")).dropDuplicates(["fingerprint"])
    met = rows.join(many.select("fingerprint"), "fingerprint", "left_semi").join(reps, "fingerprint")
    equal = met.where(F.col("canon") == F.col("rep_canon")).select("doc_id", "fingerprint", F.col("rep").alias("group_id"))
    # A collision: other bytes than the representative's. They group by their bytes.
    other = met.where(F.col("canon") != F.col("rep_canon")).select("doc_id", "fingerprint", "canon")
    least = other.groupBy("canon").agg(F.min("doc_id").alias("group_id"))
    return single.unionByName(equal).unionByName(other.join(least, "canon").select("doc_id", "fingerprint", "group_id"))
