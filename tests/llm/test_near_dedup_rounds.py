"""Rounds of further sketches: which words they read, and which nodes go on."""

from __future__ import annotations

import random

from turnwise.llm import near_dedup
from turnwise.llm.common import Scratch


def test_a_round_reads_the_words_of_the_nodes_that_are_left(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    mixed = [f"{passage} {text(60)}" for _ in range(12)]  # share buckets, and aren't alike
    pairs = [x for _ in range(40) for x in [text(80)] for x in (x, x + " end")]
    docs = spark.createDataFrame(list(enumerate([*mixed, *pairs])), "doc_id long, text string")
    seen, sketched = [], near_dedup.further_sketches
    monkeypatch.setattr(near_dedup, "further_sketches", lambda words, *a: seen.append({r.node for r in words.select("node").collect()}) or sketched(words, *a))
    got = {r.doc_id: r.cluster_id for r in near_dedup.near_duplicates(docs).collect()}
    assert seen and all(nodes <= set(range(12)) for nodes in seen)
    assert got == {i: i if i < 12 else i - i % 2 for i in range(len(mixed) + len(pairs))}


def test_nodes_of_mixed_buckets_are_undecided(spark):
    rng = random.Random(5)
    label = {n: n - n % 3 for n in range(60)}
    members = [(n, b) for b in range(40) for n in rng.sample(range(60), rng.randrange(2, 5))] + [(n, 100) for n in (0, 1, 2)] + [(n, 200 + n // 3) for n in range(60)]
    sizes = {b: sum(x == b for _, x in members) for _, b in members}
    met = spark.createDataFrame([(n, b, sizes[b]) for n, b in members], "node long, bucket long, size long")
    labels = spark.createDataFrame([(n, x) for n, x in label.items() if n % 7], "node long, label long")  # one without is its own
    of = lambda n: label[n] if n % 7 else n
    want = {n for n, b in members if sizes[b] > 3 and len({of(m) for m, x in members if x == b}) > 1}
    with Scratch(spark) as scratch:
        got = [r.node for r in near_dedup.undecided(met, labels, scratch).collect()]
    assert sorted(got) == sorted(want) and want
