"""Cross-tokenizer alignment against a plain version that walks the bytes."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwise.llm import queries as llm_queries
from turnwise.llm import token_align
from turnwise.llm.common import table

TEXTS = ["The quick brown fox", None, "", "naïve café 🎉 ﬁ", "  two  spaces\n\nand\ttabs ", "<|endoftext|> <s> <0x41> </s>", "▁mark", "The quick brown fox", "\u0000\u001c x", "a", " ", "zzzzzz " * 300]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(libraries, text):
    """((id, bytes) of A, of B), by the vocabulary file's own library."""
    a, b = libraries
    if not text:
        return [], []
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    said = f" {text}".encode()
    got_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    got_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    return (got_a, got_b) if all(b"".join(t for _, t in x) == said for x in (got_a, got_b)) else ([], [])


def plain(libraries, rows):
    made = []
    for doc_id, text in rows:
        a, b = plain_tokens(libraries, text)
        ranges = []
        for side in (a, b):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            ranges.append(own)
        cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        begin, groups = 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s < cut) for side in ranges))
            begin = cut
        linked = [(i, j) for i, s, e in ranges[0] for j, s2, e2 in ranges[1] if s < e2 and s2 < e]
        made.append((doc_id, len(a), len(b), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    counts = Counter(p for *_, linked, _ in made for p in set(linked))
    best: dict = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    return sorted([(d, na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, ng, ls, sha in made], key=str)


@pytest.mark.parametrize("block_pairs", [token_align.BLOCK_PAIRS, 40])
def test_alignment_is_the_plain_one(spark, libraries, block_pairs):
    rows = [*enumerate(TEXTS), (None, "no id"), (0, "The quick brown fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "pairs", "times", "n_a", "pair", "a")}).repartition(3)
    got = token_align.align_corpus(docs, block_pairs=block_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(libraries, rows)


def test_alignment_of_the_tables(spark, sf_dir, libraries):
    docs = table(spark, sf_dir, "documents").where("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_align.align_corpus(docs).collect()), key=str) == plain(libraries, rows)
    assert llm_queries.op13_cross_tokenizer_alignment(spark, sf_dir).count() == table(spark, sf_dir, "documents").count()


def test_nothing_and_only_unmapped_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align_corpus(empty).collect() == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, token_align.align_corpus(blank).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_texts_of_any_length_and_space():
    aligner = token_align.Aligner(*token_align.default_paths())
    for text in (" " * 600_000, "a" * 300_000, "x\n" * 50_000):
        (n_a, n_b, n_groups, n_links, _, pairs, times), = aligner.align([text])
        assert 0 < n_groups <= min(n_a, n_b) and n_links >= max(n_a, n_b)
        assert times.sum() == n_links and len(set(pairs.tolist())) == len(pairs)


def test_blocks_keep_an_id_together():
    sizes = [(1, 3), (2, 4), (5, 9), (7, 1), (9, 1)]
    assert list(token_align._blocks(sizes, 7)) == [(1, 2), (5, 5), (7, 9)]
    assert list(token_align._blocks([], 7)) == []
