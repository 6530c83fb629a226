"""Merkle manifest against plain Python and against DuckDB."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from turnwise.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps_of(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield i % 3, run[: i % 3] + run[i % 3 + 1 :]
        i //= 3


def plain(rows):
    by_source: dict = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        struck = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = h(*map(field, (doc_id, source, lang, n_chars, text.replace("\n", "") if struck and text is not None else text)))
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf for *_, leaf, _, _ in sorted(by_source[s])]) for s in sources}
    crown = levels_of([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for i, (*_, leaf, changed, doc_id) in enumerate(sorted(by_source[s])):
            steps = [*steps_of(trees[s], i), *steps_of(crown, k)]
            own = changed
            for place, others in steps:
                own = h(*others[:place], own, *others[place:])
            root = crown[-1][0]
            out.append((doc_id, leaf, trees[s][-1][0], root, h(*[x for _, o in steps for x in o]), own, own == root))
    return sorted(out, key=str)


def rows_of(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in ("tree", "idx", "n", "hash", "steps", "level", "row", "root", "leaf")})


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [1, 1, 1, 1], [9, 1, 28], [27, 81, 82, 5]])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(100 * k + i, f"s{k}", "en", i, f"text {i}\nof {k}") for k, n in enumerate(sizes) for i in range(n)]
    got = merkle.verified_documents(rows_of(spark, rows))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_nulls_repeats_and_odd_values(spark):
    rows = [(1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 4, "other"), (None, "a", None, None, None), (None, None, "de", 1, "\n"), (-7, "", "", 0, ""), (5, "é", "fr", 2, "é\n🎉"), (6, "z", None, -1, "\n\n"), (8, "z", "en", 9, "12:3-" * 20_000)]
    got = sorted(map(tuple, merkle.verified_documents(rows_of(spark, rows)).collect()), key=str)
    assert got == plain(rows)
    assert merkle.verified_documents(rows_of(spark, rows).limit(0)).collect() == []


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", 1, "a\nb" if i % 2 else "ab") for i in range(60)]
    for doc_id, *_, ok in merkle.verified_documents(rows_of(spark, rows)).collect():
        assert ok == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 2 == 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_duckdb_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(merkle.duckdb_sql()).fetchall()
    got = merkle.verified_documents(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
