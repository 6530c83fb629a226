"""Toxicity: the channel against brute force, disguised words, held-out labels, awkward rows."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import queries as llm_queries
from turnwise.llm import toxicity as tox
from turnwise.llm.common import table

SF = "/root/testdata/sf0.1"
DISGUISED = ["1d10t", "m0r0n", "st*pid", "stuuupid", "l.o.s.e.r", "p@thet1c", "$cum", "tr4sh", "d1sgust1ng", "loooser", "lo​ser", "c10wn", "i d i o t", "lоser"]
PLAIN = ["idiot", "moron", "stupid", "stupid", "loser", "pathetic", "scum", "trash", "disgusting", "loser", "loser", "clown", "idiot", "loser"]


@pytest.fixture(scope="module")
def logp(spark):
    return tox.language_model(table(spark, SF, "documents"))


@pytest.fixture(scope="module")
def lexicon(spark, logp):
    return tox.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), logp)


def plain_grams(text):
    """4-grams by a walk over the characters."""
    seen, context = Counter(), (0, 0, 0)
    for c in [*map(int, tox.symbols(text)), 0]:
        if c == 0 and context[2] == 0:
            continue
        seen[(*context, c)] += 1
        context = (*context[1:], c) if c else (0, 0, 0)
    return {((a * 32 + b) * 32 + c) * 32 + d: n for (a, b, c, d), n in seen.items()}


def test_grams_are_counted_as_by_hand_in_pieces_of_any_size():
    text = "Ein  naïver Text, 12 Straßen;\n\nдом 🎉x"
    for piece in (1, 2, 5, 1000):
        got = tox.gram_counts(text, piece)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == plain_grams(text)


def test_all_documents_are_counted(spark, sf_dir):
    texts = [r[0] for r in table(spark, sf_dir, "documents").select("text").collect()]
    want = Counter()
    for t in texts:
        want.update(plain_grams(t or ""))
    assert {r["gram"]: r["n"] for r in tox.count_grams(table(spark, sf_dir, "documents").repartition(5)).collect()} == want


def test_probabilities_sum_to_one(logp):
    p = np.exp(np.array(logp)).reshape(-1, tox.SYMBOLS)
    assert len(logp) == tox.SYMBOLS**4 and np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_viterbi_finds_the_best_of_all_ways(logp):
    channel = tox.Channel(logp)

    def value(parts):
        state, total = 0, 0.0
        for text, cost in parts:
            state, gain = channel._read(state, text)
            total += gain - cost
        return total + (logp[state * tox.SYMBOLS] if state else 0.0)

    for shown in [*DISGUISED, "a$$$", "b00k--shop", "x*y", "1337 5", "äöü00ss"]:
        units = tox.lattice(shown.lower())
        best = max(value(parts) for parts in itertools.product(*units))
        way, rest = [], channel.decode(units)
        got = [parts for parts in itertools.product(*units) if "".join(t for t, _ in parts) == rest]
        assert max(map(value, got)) == pytest.approx(best, abs=1e-6), (shown, way, rest)


def test_pairs_of_letters_are_judged_as_by_the_whole_search(logp):
    channel, rng, judged = tox.Channel(logp), np.random.default_rng(4), 0
    for _ in range(4000):
        word = "".join(rng.choice(list("aeioulrstnéß"), rng.integers(2, 14)))
        got = channel._undoubled(word)
        if got is not None:
            judged += got != word
            assert got == channel.decode(tox.lattice(word)), word
    assert judged > 100


def test_disguised_words_are_restored(logp):
    channel = tox.Channel(logp)
    assert [channel.restore(w) for w in DISGUISED] == PLAIN
    assert channel.restore("This IS  plain,\ntext: a/b 2024 (see 10)") .startswith("This IS  plain,\ntext")


def test_restored_texts_keep_the_rest(spark, logp):
    docs = spark.createDataFrame([(1, "The M0R0N sat. 12:30"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["restored"] for r in tox.restore_texts(docs, logp).collect()} == {1: "The moron sat. 12:30", 2: "", 3: ""}


def test_held_out_labels_and_disguises(spark, logp, lexicon):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    docs = table(spark, SF, "documents").join(table(spark, SF, "labels").select("doc_id"), "doc_id")
    rows = tox.score_texts(docs, logp, lexicon).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    for held in (True, False):
        seen = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] == held and r["doc_id"] in labels]
        good, bad = [s for s, y in seen if not y], [s for s, y in seen if y]
        auc = np.mean([[(b > g) + (b == g) / 2 for g in good] for b in bad])
        assert auc > 0.94 and np.mean([s >= 0.5 for s in bad]) > 0.85 and np.mean([s >= 0.5 for s in good]) < 0.01, (held, auc)
    disguised = spark.createDataFrame([(i, f"Of the and {w} then was reer") for i, w in enumerate(DISGUISED)], "doc_id long, text string")
    clear = spark.createDataFrame([(i, f"Of the and {w} then was reer") for i, w in enumerate(PLAIN)], "doc_id long, text string")
    score = lambda d: [r["score"] for r in tox.score_texts(d.coalesce(1), logp, lexicon).orderBy("doc_id").collect()]
    assert score(disguised) == score(clear)


def test_awkward_rows(spark):
    rows = [(1, "one bad bad word"), (2, None), (3, ""), (1, "one bad bad word"), (None, "no id"), (5, "🎉 é　\u001c x"), (6, "Ein langer Text 12345. " * 3000), (7, "a b c " * 2000), (8, "x" * 50_000 + "1" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("toxic", "score", "entry", "gram", "n", "held_out")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (6, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = tox.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and {r["score"] for r in got if not r["doc_id"] or r["doc_id"] in (2, 3)} <= {r["score"] for r in got if r["evidence"] == ""}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    none = labels.limit(0)
    assert {r["score"] for r in tox.score_documents(docs, none).collect()} == {0.0}
    alike = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (6, 0)], "doc_id long, toxic int")
    assert len({r["score"] for r in tox.score_documents(docs, alike).collect()}) == 1
    assert tox.score_documents(docs.limit(0), labels).collect() == []


def test_the_query_scores_every_document(spark, sf_dir):
    assert llm_queries.op11_toxicity(spark, sf_dir).count() == table(spark, sf_dir, "documents").count()
