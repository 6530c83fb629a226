from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from turnwise.functions import vectors
from turnwise.operators import dedupe, feedback, lookup, resume, search
from turnwise.plans import instructions, models, refresh, simulate
from turnwise.sources import annotations, captions, images
from turnwise.streaming import incremental


def test_annotation_readers(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"target": "t", "candidate": "c", "captions": ["a", " ", "b"]}, {"target": "u", "candidate": "d", "captions": ["", " "]}, {"target": "v", "candidate": "e", "captions": ["x", "y", "z"]}]))
    path = str(tmp_path / "f.json")
    sep = annotations.read_fashioniq(spark, path).orderBy("pos").collect()
    assert [(r.query_id, r.caption_index, r.relative_caption) for r in sep] == [("0", 0, "a"), ("1", 1, "b"), ("2", 0, "x"), ("3", 1, "y"), ("4", 2, "z")]
    assert [r.relative_caption for r in annotations.read_fashioniq(spark, path, "combined").orderBy("pos").collect()] == ["a and b", "x, y, and z"]
    assert [r.relative_caption for r in annotations.read_fashioniq(spark, path, "first_only").orderBy("pos").collect()] == ["a", "x"]
    (tmp_path / "r.json").write_text(json.dumps([{"reference": "r", "target_hard": "t", "caption": "c", "pairid": 7}, {"reference": "r", "target_hard": "t", "caption": "c"}]))
    assert [r.query_id for r in annotations.read_cirr(spark, str(tmp_path / "r.json")).orderBy("pos").collect()] == ["7", "0"]
    (tmp_path / "o.json").write_text(json.dumps([{"id": 3, "reference_img_id": 1, "target_img_id": 2, "gt_img_ids": [2, 5], "relative_caption": "c"}]))
    h = spark.createDataFrame([("1", "H1"), ("5", "H5")], "image_id string, img_hash string")
    r = annotations.read_circo(spark, str(tmp_path / "o.json"), h).first()
    assert (r.reference_image_id, r.target_image_id, r.ground_truth_ids) == ("H1", "000000000002.jpg", ["000000000002.jpg", "H5"])


def test_images(spark, tmp_path):
    for name, content in {"a/001.jpg": b"x", "a/000.png": b"y", "a/note.txt": b"z", "b/002.jpg": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed = [images.directory_images(images.hash_files(spark, str(tmp_path / d)), "circo", d) for d in "ab"]
    everything = images.collect_images(listed)
    assert sorted(r.image_id for r in everything.collect()) == ["0", "1", "2"]
    reg = {r.image_id: [p[-9:] for p in r.duplicate_paths] for r in images.registry_with_duplicates(everything).collect()}
    assert reg == {"0": [], "1": ["b/002.jpg"]}
    assert {r.image_id for r in images.id_hashes(images.registry(everything)).collect()} >= {"1", "1.jpg", "000000000001.jpg"}


def test_caption_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a/x.jpg": "one", "b/y.jpg": "two"}))
    (tmp_path / "l.json").write_text(json.dumps([{"image_id": "x", "id": "no", "caption": "three"}, {"id": "z", "caption": "four"}]))
    assert {(r.image_key, r.caption) for r in captions.read_captions(spark, str(tmp_path / "m.json")).collect()} == {("a/x.jpg", "one"), ("b/y.jpg", "two")}
    listed = captions.read_captions(spark, str(tmp_path / "l.json"))
    assert {(r.image_key, r.caption) for r in listed.collect()} == {("x", "three"), ("z", "four")}
    coco = spark.createDataFrame([(5, "c5")], "image_id long, caption string")
    merged = captions.reference_captions([listed, spark.createDataFrame([("x", "newer")], "image_key string, caption string")], coco)
    assert {r.image_key: r.caption for r in merged.collect()} == {"x": "newer", "z": "four", "000005.jpg": "c5"}
    f = spark.createDataFrame([("a/x.jpg", 0, [1.0]), ("b/x.png", 1, [2.0])], "image_key string, pos int, vec array<double>")
    assert [(r.image_key, r.vec) for r in captions.by_stem(f).select("image_key", "vec").collect()] == [("x", [2.0])]


def test_topk_ties_and_ranks(spark):
    c = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0])], "corpus_idx long, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vec array<double>")
    for f in (search.topk, search.topk_sql):
        assert [(r.rank, r.corpus_idx) for r in f(q, c, 3).orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 2)]
    gt = spark.createDataFrame([(7, 3), (7, 99)], "query_id long, gt_idx long")
    assert {(r.gt_idx, r.rank) for r in search.ground_truth_ranks(q, gt, c).collect()} == {(3, 2), (99, -1)}
    assert search.topk(q.limit(0), c).count() == 0
    small = search.topk(q.unionByName(q.withColumn("query_id", F.lit(8).cast("long"))), c, 1, block_values=2)
    assert {(r.query_id, r.corpus_idx) for r in small.collect()} == {(7, 1), (8, 1)}


def test_search_leaves_out_items_without_vectors_and_tiles_its_product(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(60, 4))
    c = spark.createDataFrame([(i, v.tolist() if i % 7 else None) for i, v in enumerate(vecs)], "corpus_idx long, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))], "query_id long, vec array<double>")
    rows = lambda df: [tuple(r)[:3] for r in df.orderBy("query_id", "rank").collect()]
    whole = rows(search.topk(q, c, 5))
    assert len(whole) == 45 and not any(r[2] % 7 == 0 for r in whole)
    assert rows(search.topk_sql(q, c, 5)) == whole
    monkeypatch.setattr(search, "TILE_VALUES", 30)
    assert rows(search.topk(q, c, 5)) == whole
    gt = spark.createDataFrame([(0, 7), (0, whole[0][2])], "query_id long, gt_idx long")
    assert {(r.gt_idx, r.rank) for r in search.ground_truth_ranks(q, gt, c).collect()} == {(7, -1), (whole[0][2], 1)}


def test_feedback_moves_as_defined(spark):
    rng = np.random.default_rng(1)
    q, t, s, m = rng.normal(size=(4, 5))
    df = spark.createDataFrame([(q.tolist(), t.tolist(), s.tolist(), m.tolist())], "q array<double>, t array<double>, s array<double>, m array<double>")
    got = df.select(vectors.feedback(*map(F.col, "qtsm"))).first()[0]
    unit = lambda v: v / np.linalg.norm(v)
    assert np.allclose(got, unit(unit(q) + 0.44 * unit(t) + 0.08 * unit(s) - 0.29 * m))


def test_lookup_order(spark):
    rows = spark.createDataFrame([("p/a.jpg",), ("b",), ("none",)], "id string")
    t = spark.createDataFrame([("a", 1), ("a.jpg", 2), ("b.jpg", 3), ("b.png", 4)], "k string, v int")
    got = lookup.first_match(rows, "id", lookup.image_spellings(F.col("id")), t, "k")
    assert {r.id: (r.matched, r.v) for r in got.collect()} == {"p/a.jpg": ("a.jpg", 2), "b": ("b.png", 4), "none": (None, None)}


def test_resume_keys(spark):
    q = spark.createDataFrame([("r", "t", "c", ["x", "y"], 1), ("r", "t", None, ["y", "x"], 2)], "reference_image_id string, target_image_id string, relative_caption string, ground_truth_ids array<string>, n int")
    left = lambda ds, done: [r.n for r in resume.remaining(q, done, resume.signature(ds)).collect()]
    assert left("circo", q.where("n = 1")) == []
    assert left("fashioniq", q.where("n = 2")) == [1]


def test_fan_out_and_priority(spark):
    g = spark.createDataFrame([("a", ["b", "c"])], "image_path string, duplicate_paths array<string>")
    c = spark.createDataFrame([("a", "x")], "image_path string, caption string")
    assert sorted(r.image_path for r in dedupe.fan_out(c, g).collect()) == ["a", "b", "c"]


def test_captioner_and_vectors(spark):
    registry = spark.createDataFrame([("d/dress/1", ["d/dress/2"]), ("x", [])], "image_path string, duplicate_paths array<string>")
    have = spark.createDataFrame([("x", "old")], "image_path string, caption string")
    make = lambda: lambda path, category: {"success": True, "caption": f"{category}:{path}", "input_tokens": 1, "output_tokens": 2}
    calls, done = refresh.caption_images(registry, have, make, per_minute=60000, tasks=2)
    assert {r.image_path: r.caption for r in done.collect()} == {"x": "old", "d/dress/1": "dress:d/dress/1", "d/dress/2": "dress:d/dress/1"}
    keyed = done.withColumnRenamed("image_path", "image_key")
    none = spark.createDataFrame([], "image_key string, feature_type string, vec array<double>")
    v = refresh.refresh_vectors(keyed, none, models.hashing_encoder, "hash")
    assert v.count() == 3
    assert refresh.refresh_vectors(keyed, v, models.hashing_encoder, "hash").count() == 3
    assert refresh.progress(keyed, v, "image_key")["remaining"] == 0


def test_retries():
    waits, answers = [], [{"success": False, "error": "Rate limit"}, {"success": True}]
    assert models.with_retries(lambda: answers.pop(0), sleep=waits.append)["success"]
    assert waits == [2.0]
    calls = []
    assert not models.with_retries(lambda: calls.append(1) or {"success": False, "error": "bad"}, sleep=waits.append)["success"]
    assert len(calls) == 1
    enc = models.hashing_encoder()
    one = lambda t: enc([t])[0]
    assert models.distinct_difference(lambda i: ["same", "same", "other"][i], [one("same")], one) == "other"
    assert models.distinct_difference(lambda i: "same", [one("same")], one) == "same"


def test_simulation_ends(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "corpus_idx long, vec array<double>")
    q = spark.createDataFrame([(i, v[i].tolist(), i, (i + 20) % 40) for i in range(3)], "query_id long, vec array<double>, reference long, target long")
    texts = lambda picked, turn: picked.join(c.toDF("target", "t_vec"), "target").select("query_id", "t_vec")
    turns = simulate.simulate(q, c, q.select("query_id", F.col("target").alias("gt_idx")), c, texts, 3, 5)
    rows = turns.collect()
    for i in range(3):
        mine = sorted((r.turn, r.found) for r in rows if r.query_id == i)
        assert [t for t, _ in mine] == list(range(len(mine)))
        assert not any(f for _, f in mine[:-1])
    assert simulate.outcomes(turns).count() == 3


def test_stream_appends_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(src)
    for _ in range(2):
        incremental.append_new(incremental.new_files(spark, src, "id long, v string"), out, "id", ck).awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").write.mode("append").parquet(src)
    incremental.append_new(incremental.new_files(spark, src, "id long, v string"), out, "id", ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_evaluation_tells_new_changes_and_lists_errors(spark):
    rng = np.random.default_rng(1)
    enc = models.hashing_encoder(16)
    words = ["red", "blue", "long", "short", "dress", "shirt", "dots", "stripes"]
    captions = [(i, " ".join(rng.choice(words, 4, replace=False))) for i in range(30)]
    captions[7] = (7, None)
    text = spark.createDataFrame(captions, "corpus_idx long, caption string")
    c = spark.createDataFrame([(i, enc([t or "none"])[0].tolist()) for i, t in captions], "corpus_idx long, vec array<double>")
    q = spark.createDataFrame([(1, 1, 20), (2, 2, 21), (3, 3, 99), (4, 98, 5), (5, 5, 7)], "query_id long, reference long, target long")
    q = q.join(c.toDF("reference", "vec"), "reference", "left").select("query_id", "vec", "reference", "target")
    tells = instructions.Instructions(text, lambda: models.hashing_encoder(16), lambda base, goal, before, i: instructions.suggest_words(base, goal, before, i) if goal else "")
    turns, errors = simulate.evaluate(q, c, q.select("query_id", F.col("target").alias("gt_idx")), c, tells, done=q.where("query_id = 2"), max_turns=2, k=5)
    wrong = {r.query_id: r.error for r in errors.collect()}
    ran = {r.query_id for r in turns.collect()}
    assert wrong[3] == "target not in the corpus" and wrong[4] == "reference not in the corpus"
    assert ran | set(wrong) == {1, 3, 4, 5} and not ran & set(wrong)
    assert 1 in ran
    assert (5 in wrong) == (5 not in ran)
    told = tells.said.where("query_id = 1").orderBy("turn").collect() if tells.said is not None else []
    changed = [set(r.instruction.split()) - {"with"} for r in told]
    goal = set(captions[20][1].split())
    assert all(x <= goal for x in changed)


def test_used_content_is_not_chosen_again(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.8, 0.2], [0.0, 1.0]]
    c = spark.createDataFrame(list(enumerate(v)), "corpus_idx long, vec array<double>")
    shown = spark.createDataFrame([(1, r + 1, i) for r, i in enumerate([0, 1, 2])], "query_id long, rank int, corpus_idx long")
    used = spark.createDataFrame([(1, 0)], "query_id long, corpus_idx long")
    target = spark.createDataFrame([(1, 0)], "query_id long, target long")
    hashes = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "corpus_idx long, img_hash string")
    pick = lambda **k: [r.selected for r in feedback.select_candidate(shown, used, target, c, **k).collect()]
    assert pick() == [1]
    assert pick(hashes=hashes) == [2]
    assert pick(hashes=hashes.where("corpus_idx = 9")) == [1]
