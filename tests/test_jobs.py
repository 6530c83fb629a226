"""Jobs that can be stopped: captions, simulations, vectors of captions and contents; and what is there on disk."""

from __future__ import annotations

import os
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import digests, runs
from turnwise.plans import contents, instructions, models, refresh, saved, simulate
from turnwise.plans.journal import Journal, recorded
from turnwise.sources import layouts
from turnwise.streaming import captions as caption_stream


def counting_captioner(folder, deadly=None, failing=()):
    """Each call leaves a file; ``deadly`` kills the worker once, before it is paid for."""

    def make():
        def ask(path, category):
            flag = f"{folder}/dies"
            if path == deadly and os.path.exists(flag):
                os.remove(flag)
                os._exit(1)
            with open(f"{folder}/{path.replace('/', '_')}.{os.getpid()}.{threading.get_ident()}.{len(os.listdir(folder))}", "w"):
                pass
            ok = path not in failing
            return {"success": ok, "caption": f"about {path}" if ok else None, "error": None if ok else "refused", "input_tokens": 3, "output_tokens": 2}

        return ask

    return make


def calls_of(folder):
    return Counter(f.split(".")[0] for f in os.listdir(folder) if f != "dies")


def test_a_caption_job_that_is_killed_asks_for_nothing_twice(spark, tmp_path):
    paid = tmp_path / "paid"
    paid.mkdir()
    (paid / "dies").touch()
    registry = spark.createDataFrame([(f"d/dress/{i}", [f"copy/{i}"] if i % 3 == 0 else []) for i in range(13)], "image_path string, duplicate_paths array<string>")
    have = spark.createDataFrame([("d/dress/0", "old")], "image_path string, caption string")
    job = lambda make: caption_stream.caption_job(registry, have, make, str(tmp_path / "store"), save_every=5, per_minute=60_000, tasks=1, concurrency=1)
    try:
        job(counting_captioner(str(paid), "d/dress/9"))
    except Exception:  # the stream stops where retries are off
        assert calls_of(paid)
    got = {r.image_path: r.caption for r in job(counting_captioner(str(paid))).collect()}
    assert got["d/dress/0"] == got["copy/0"] == "old" and got["copy/9"] == "about d/dress/9" and len(got) == 13 + 5
    assert calls_of(paid) == {f"d_dress_{i}": 1 for i in range(1, 13)}
    before = calls_of(paid)
    assert job(counting_captioner(str(paid))).count() == 18 and calls_of(paid) == before
    totals = caption_stream.job_totals(spark, str(tmp_path / "store")).first()
    assert (totals.calls, totals.successes, totals.input_tokens) == (12, 12, 36)


def test_failed_captions_are_asked_for_again_by_the_next_run(spark, tmp_path):
    paid = tmp_path / "paid"
    paid.mkdir()
    registry = spark.createDataFrame([("a", []), ("b", [])], "image_path string, duplicate_paths array<string>")
    none = spark.createDataFrame([], "image_path string, caption string")
    job = lambda failing: caption_stream.caption_job(registry, none, counting_captioner(str(paid), failing=failing), str(tmp_path / "store"), per_minute=60_000, tasks=1)
    assert [r.image_path for r in job(("b",)).collect()] == ["a"]
    assert sorted(r.image_path for r in job(()).collect()) == ["a", "b"]
    assert calls_of(paid) == {"a": 1, "b": 2}


def test_calls_are_made_once_though_both_results_are_read(spark, tmp_path):
    registry = spark.createDataFrame([("a", ["c"]), ("b", [])], "image_path string, duplicate_paths array<string>")
    calls, done = refresh.caption_images(registry, spark.createDataFrame([], "image_path string, caption string"), counting_captioner(str(tmp_path)), per_minute=60_000, tasks=2)
    assert calls.count() == 2 and done.count() == 3 and done.collect() and calls_of(tmp_path) == {"a": 1, "b": 1}


def test_journal_keeps_successes(tmp_path):
    asked = []
    ask = recorded(lambda path, category: asked.append(path) or {"success": path != "bad", "caption": path}, Journal(str(tmp_path)))
    for _ in range(2):
        assert ask("ä/ö", "x")["caption"] == "ä/ö" and not ask("bad", "x")["success"]
    assert asked == ["ä/ö", "bad", "bad"]


def test_rate_limit_is_shared_by_threads():
    now, slept, lock = [0.0], [], threading.Lock()

    def sleep(seconds):
        with lock:
            slept.append(round(seconds, 6))

    limit = models.RateLimit(60, clock=lambda: now[0], sleep=sleep, first=0.25)
    threads = [threading.Thread(target=limit.wait) for _ in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(slept) == [0.25 + i for i in range(20)]


def session_tables(spark, n=60):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 8))
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "corpus_idx long, vec array<double>")
    queries = spark.createDataFrame([(i, v[i].tolist(), i, (i * 7 + 30) % n) for i in range(8)], "query_id long, vec array<double>, reference long, target long")
    truths = queries.select("query_id", F.col("target").alias("gt_idx"))
    words = spark.createDataFrame([(i, f"item {i} colour{i % 5} shape{i % 7}") for i in range(n)], "corpus_idx long, caption string")
    return queries, corpus, truths, words


class Stopped(RuntimeError):
    pass


class StoppingInstructions(instructions.Instructions):
    """Stops the run at one turn, once; counts the turns that it is asked for."""

    def __init__(self, *args, stop_at=None):
        super().__init__(*args)
        self.stop_at, self.asked = stop_at, []

    def __call__(self, picked, turn):
        self.asked.append(turn)
        if turn == self.stop_at:
            raise Stopped
        return super().__call__(picked, turn)


def test_a_simulation_goes_on_after_its_last_full_turn(spark, tmp_path):
    queries, corpus, truths, words = session_tables(spark)
    encoder = lambda: models.hashing_encoder(8)
    run = lambda texts, store=None: sorted(map(tuple, simulate.simulate(queries, corpus, truths, corpus, texts, max_turns=2, k=3, store=store).collect()), key=str)
    whole = run(instructions.Instructions(words, encoder))
    store = saved.TurnStore(spark, str(tmp_path), "r1")
    with pytest.raises(Stopped):
        run(StoppingInstructions(words, encoder, stop_at=1), store)
    assert store.last() == (0, False)
    again = StoppingInstructions(words, encoder)
    assert run(again, store) == whole and again.asked == [1] and max(r[1] for r in whole) == 2
    assert store.last() == (2, True)
    ended = StoppingInstructions(words, encoder)
    assert run(ended, store) == whole and ended.asked == []
    assert saved.TurnStore(spark, str(tmp_path), "r2").last() is None


def test_suggestions_are_encoded_together_and_told_apart():
    sizes = []
    plain = models.hashing_encoder(64)
    encode = lambda texts: sizes.append(len(texts)) or plain(texts)
    said = [["red", "red", "blue"], ["", "", ""], ["", "old", "old"], ["new", "", ""]]
    got = models.distinct_differences(lambda i, n: said[i][n], [[plain(["red"])[0]], [], [plain(["old"])[0]], []], encode)
    assert [g and g[0] for g in got] == ["blue", None, "old", "new"] and sizes == [2, 2, 2]


def test_tokens_are_those_of_a_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["A red dress, with 12 buttons.", "", None, "naïve café 🎉"]
    made = models.bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = models.count_tokens(spark.createDataFrame(list(enumerate(texts)), "i int, caption string"), "caption", made)
    assert {r.i: r.tokens for r in got.collect()} == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_contents_become_vectors(spark, tmp_path):
    for name, data in {"a/1.jpg": b"abc", "a/2.jpg": b"", "b/3.png": bytes(range(256)) * 40}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = [("x", "train", f"file:{tmp_path}/a/1.jpg", "h1"), ("x", "val", f"file:{tmp_path}/a/2.jpg", "h2"), ("y", None, f"file:{tmp_path}/b/3.png", "h3"), ("y", "val", f"file:{tmp_path}/gone.png", "h4")]
    images = spark.createDataFrame(listed, "dataset string, split string, image_path string, img_hash string")
    out = str(tmp_path / "features")
    made = contents.encode_datasets(spark, images, str(tmp_path), "histogram", lambda: contents.histogram_encoder(16), out, batch_bytes=5)
    assert {r.dataset: (r.images, r.failed, r.feature_dim, r.splits) for r in made.collect()} == {"x": (2, 1, 16, {"train": 1, "val": 1}), "y": (2, 1, 16, {"": 1, "val": 1})}
    rows = {r.img_hash: r for r in spark.read.parquet(out).collect()}
    assert rows["h2"].vec is None and not rows["h2"].decode_ok and np.allclose(rows["h3"].vec, 0.25)
    # another dataset's run leaves this one's partition alone
    contents.encode_datasets(spark, images.where("dataset = 'x'"), str(tmp_path), "histogram", lambda: contents.histogram_encoder(8), out)
    assert {r.dataset: r.n for r in spark.read.parquet(out).groupBy("dataset").agg(F.max(F.size("vec")).alias("n")).collect()} == {"x": 8, "y": 16}


def test_batches_of_contents_are_bounded():
    assert list(contents.bounded([3, 3, 9, 1, 1, 1], 2, 6)) == [slice(0, 2), slice(2, 3), slice(3, 5), slice(5, 6)]
    assert list(contents.bounded([], 2, 6)) == []
    seen = []

    def picky(items):
        seen.append(len(items))
        if b"bad" in items:
            raise ValueError
        return np.ones((len(items), 2))

    assert [v is not None for v in contents.readable(picky, [b"a", b"bad", b"c", b"d"])] == [True, False, True, True]


def test_saved_vectors_are_made_only_where_needed(spark, tmp_path):
    made = []
    path = str(tmp_path / "vectors")

    def captions(*keys):
        return spark.createDataFrame([(i, k, f"text {k}") for i, k in enumerate(keys)], "pos long, image_key string, caption string")

    def run(df, **options):
        made.append(refresh.refresh_saved(df, path, models.hashing_encoder, "hash", **options))
        return [r.image_key for r in spark.read.parquet(path).orderBy("pos").collect()]

    assert run(captions("a", "b", "c")) == ["a", "b", "c"]
    assert run(captions("a", "b", "c")) == ["a", "b", "c"]
    assert run(captions("b", "a", "c")) == ["a", "b", "c"]  # another order, nothing missing
    assert run(captions("a", "d")) == ["a", "b", "c", "d"]  # what isn't asked for stays
    assert run(captions("a", "d"), force=True) == ["a", "d"]
    for root, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(root, n), "wb") as f:
                    f.write(b"no parquet")
                os.remove(os.path.join(root, f".{n}.crc"))
    assert run(captions("x", "y")) == ["x", "y"]
    assert made == ["made", "complete", "kept", "extended", "made", "made anew"]


def test_digests_tell_lists_apart(spark):
    def digest(*ids):
        rows = spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
        return digests.ordered_digest(rows.repartition(3), "pos", "id")

    assert digest("a", "b", "c") == digest("a", "b", "c")
    assert len({digest(*x) for x in (("a", "b"), ("b", "a"), ("a",), ("ab", ""), ("a", None), ("a", "-"), ("a", ""))}) == 7
    assert digest() == (0, "0" * 60)


def test_copies_in_chunks(spark):
    rows = [(h, f"{h}{i}", i) for h, n in (("a", 1), ("b", 8), ("c", 3)) for i in range(n)] + [(None, "x", 0)]
    items = spark.createDataFrame(rows, "img_hash string, image_path string, pos long").repartition(6)
    chunks = runs.duplicate_chunks(items, chunk=3)
    got = sorted((r.img_hash, r.chunk, r.image_path, r.duplicate_paths) for r in chunks.collect())
    assert got == [("a", 0, "a0", []), ("b", 0, "b0", ["b1", "b2", "b3"]), ("b", 1, "b0", ["b4", "b5", "b6"]), ("b", 2, "b0", ["b7"]), ("c", 0, "c0", ["c1", "c2"])]
    said = spark.createDataFrame([("a0", "A"), ("b0", "B"), ("z", "Z")], "image_path string, caption string")
    out = runs.fan_out_chunks(said, chunks, salts=2)
    assert sorted((r.image_path, r.caption) for r in out.collect()) == sorted([("a0", "A"), ("z", "Z"), *[(f"b{i}", "B") for i in range(8)]])


def test_a_content_with_a_million_copies(spark):
    items = spark.range(1_000_000).select(F.lit("h").alias("img_hash"), F.concat(F.lit("p"), "id").alias("image_path"), F.col("id").alias("pos"))
    chunks = runs.duplicate_chunks(items, chunk=1000)
    assert chunks.agg(F.count("*"), F.max(F.size("duplicate_paths")), F.sum(F.size("duplicate_paths"))).first() == (1000, 1000, 999_999)
    said = spark.createDataFrame([("p0", "C")], "image_path string, caption string")
    assert runs.fan_out_chunks(said, chunks).agg(F.count_distinct("image_path")).first()[0] == 1_000_000


def test_runs_and_numbers_within_keys(spark):
    rows = [("a", i) for i in (1, 2, 3, 7, 9, 10, 10)] + [(None, 5), ("b", None)]
    got = runs.index_runs(spark.createDataFrame(rows, "lang string, doc_id long").repartition(4), "lang", "doc_id")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 0, 1, 3), ("a", 1, 7, 7), ("a", 2, 9, 10), (None, 0, 5, 5)]
    numbered = runs.numbered_within(spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")), ["k"], ["v"])
    assert numbered.where("nth <> v DIV 3").count() == 0


def test_layouts_find_what_trials_would_find(spark):
    root = "file:/data/images"
    names = ["dress/A.jpg", "toptee/A.jpg", "shirt/B.png", "train/0/T1.png", "train/0/T1.jpg", "train/99/T2.jpeg", "train/100/T3.jpg", "train/07/T4.jpg", "dev/T2.jpg", "dev/D.jpg", "test1/D.png", "val/deep/V.png", "000000000012.jpg", "12.jpg"]
    files = spark.createDataFrame([(f"{root}/{n}",) for n in names], "path string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id string")

    def found(dataset, *x, **more):
        return {r.image_id: r.found and r.found.removeprefix(root + "/") for r in layouts.existing_images(ids(*x), files, root, dataset, **more).collect()}

    assert found("fashioniq_dress", "A", "B", "C") == {"A": "dress/A.jpg", "B": None, "C": None}
    assert found("cirr_train", "T1", "T2", "T3", "T4", "D", "V") == {"T1": "train/0/T1.jpg", "T2": "train/99/T2.jpeg", "T3": None, "T4": None, "D": "dev/D.jpg", "V": None}
    assert found("CIRCO", "12", "000000000012.jpg", "13") == {"12": "000000000012.jpg", "000000000012.jpg": "000000000012.jpg", "13": None}
    known = spark.createDataFrame([("12", f"{root}/dress/A.jpg"), ("13", f"{root}/gone.jpg")], "image_id string, image_path string")
    assert found("circo", "12", "13", known=known) == {"12": "dress/A.jpg", "13": None}
