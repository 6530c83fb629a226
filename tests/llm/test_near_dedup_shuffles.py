"""Near-duplicates: how many shuffles a small job makes, that their files go, and components by contraction."""

from __future__ import annotations

import random

from turnwise.llm import near_dedup


def test_a_small_job_makes_few_shuffles_and_leaves_none(spark):
    """On small tables, each shuffle costs as much as its number of partitions, in time and on disk."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(60)
    texts = [f"{passage} {text(60)}" for _ in range(12)] + [x for _ in range(20) for x in [text(80)] for x in (x, x + " end")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sc = spark.sparkContext
    held = sc._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = {held_id for held_id in str(held.keys().toList()).strip("List()").split(", ")}
    first = sc._jsc.sc().newShuffleId()
    got = {r.doc_id: r.cluster_id for r in near_dedup.near_duplicates(docs).collect()}
    made = sc._jsc.sc().newShuffleId() - first - 1
    left = {held_id for held_id in str(held.keys().toList()).strip("List()").split(", ")} - before
    assert got == {i: i if i < 12 else i - i % 2 for i in range(len(texts))}
    assert made <= 85
    assert not [x for x in left if x and int(x) > first]


def test_components_against_plain_python(spark):
    rng = random.Random(10)
    path = rng.sample(range(10_000, 20_000), 300)
    links = [(rng.randrange(800), rng.randrange(800)) for _ in range(500)] + list(zip(path, path[1:], strict=False)) + [(-5, n) for n in range(30_000, 30_400)] + [(-7, -6)]
    top = {n: n for x in links for n in x}
    while any(top[a] != top[b] for a, b in links):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.label for r in near_dedup.components(frame).collect()} == top
    of = {r.node: r.label for r in near_dedup.grouped(frame).collect()}
    assert of.keys() == top.keys() and len({(top[n], x) for n, x in of.items()}) == len(set(top.values())) == len(set(of.values()))
    assert all(of[x] == x for x in of.values())
    assert near_dedup.components(frame.limit(0)).count() == 0
