from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnwise import queries
from turnwise.functions import ranks
from turnwise.operators import export, filters, stats
from turnwise.plans import cli, curate
from turnwise.sources import sessions as files
from turnwise.sources.schemas import SESSIONS


def turn(i, rank=None, selected=None, caption=None):
    return (i, f"q{i}", [], selected, None, caption, {}, rank)


def session(spark, rows):
    full = [("d", pos, qid, ref, "t", ["t"], original, ok, st, turns) for pos, (qid, ref, original, ok, st, turns) in enumerate(rows)]
    return spark.createDataFrame(full, SESSIONS)


def simple(spark, *specs):
    return session(spark, [(qid, "r", "look", st >= 0, st, [turn(i, r) for i, r in enumerate(rs)]) for qid, st, rs in specs])


def ids(df):
    return sorted(r[0] for r in df.select("query_id").collect())


def margin(spark, rs):
    s = simple(spark, ("1", 1, rs))
    t = stats.turn_table(s).select("query_id", "turn", "pos", F.col("best_gt_rank").alias("rank"))
    return ids(filters.rank_consistent(t, s.select("query_id", "pos")))


def test_rank_margin(spark):
    assert margin(spark, [50, 80]) == ["1"]
    assert margin(spark, [50, 81]) == []
    assert margin(spark, [40, -1, 29]) == ["1"]
    assert margin(spark, [40, -1, 30]) == []
    assert margin(spark, [50, None, 81]) == []
    assert margin(spark, [50]) == []
    assert margin(spark, [50, None]) == []


def test_ids_without_turns_stay(spark):
    t = spark.createDataFrame([("1", 0, 0, 5.0), ("1", 1, 0, 4.0)], "query_id string, turn int, pos long, rank double")
    given = spark.createDataFrame([("1", 0), ("9", 1)], "query_id string, pos long")
    assert ids(filters.rank_consistent(t, given)) == ["1", "9"]


def test_numeric_ids(spark):
    s = simple(spark, ("12", 1, [5]), (" 12 ", 1, [5]), ("abc", 1, [5]), (None, 1, [5]))
    assert ids(filters.succeeded(s)) == [" 12 ", "12"]


def test_last_row_decides(spark):
    s = simple(spark, ("1", 2, [50, 20, 3]), ("1", 0, [4]))
    kept, _ = curate.curate(s)
    assert kept.count() == 0
    s = simple(spark, ("1", 0, [4]), ("1", 2, [20, 15, 3]))
    kept, _ = curate.curate(s)
    assert [(r.query_id, r.success_turn) for r in kept.collect()] == [("1", 2)]


def test_equal_ids_pool_their_turns(spark):
    s = simple(spark, ("1", 0, [4]), ("1", 2, [50, 15, 3]))
    assert curate.curate(s)[0].count() == 0  # 4 and 50 are both ranks of turn 0
    assert curate.curate(s, options=curate.Options(rank_margin=False))[0].count() == 1


def test_toggles_cannot_widen(spark):
    s = simple(spark, ("1", -1, [50, 20]), ("2", 0, [3]))
    off = curate.Options(False, False, False, False, False, False)
    kept, log = curate.curate(s, options=off)
    assert kept.count() == 0
    assert log.count() == 0


def test_similarity(spark):
    rows = [("1", "r", "a", True, 2, [turn(0), turn(1, 5, "x", "b"), turn(2, 5, "y", "a")]), ("2", "r", "a", True, 2, [turn(0), turn(1, 5, "x", "b"), turn(2, 5, "y", "")]), ("3", "r", "a", True, 2, [turn(0), turn(1, 5, "x", "c")])]
    s = session(spark, rows)
    enc = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.8, 0.6])], "text string, vec array<double>")
    assert ids(filters.diverse(s, s.select("query_id", "pos"), enc)) == ["2"]


def test_image_repeats(spark):
    rows = [
        ("1", "r", "a", True, 2, [turn(0), turn(1, 5, "same_as_r", "b")]),
        ("2", "r", "a", True, 2, [turn(0), turn(1, 5, "x", "b"), turn(2, 5, "copy_of_x", "c")]),
        ("3", "r", "a", True, 2, [turn(0), turn(1, 5, "u", "b"), turn(2, 5, "u", "c")]),
    ]
    s = session(spark, rows)
    h = spark.createDataFrame([("r", "1"), ("same_as_r", "1"), ("x", "2"), ("copy_of_x", "2")], "image_id string, img_hash string")
    assert ids(filters.without_repeats(s, s.select("query_id", "pos"), h)) == ["3"]


def test_best_rank(spark):
    df = spark.createDataFrame([({"a": -1, "b": 4},), ({"a": -1},), ({},)], "m map<string,int>")
    assert [r[0] for r in df.select(ranks.best_rank(F.col("m"))).collect()] == [4, -1, -1]


def test_jumps_over(spark):
    df = spark.createDataFrame([([50, 80],), ([50, 81],), ([50],), ([],)], "r array<int>")
    assert [r[0] for r in df.select(ranks.jumps_over(F.col("r"), 30)).collect()] == [False, True, False, False]


def test_hits(spark):
    df = spark.createDataFrame([(10,), (11,), (-1,), (None,)], "r int")
    assert [r[0] for r in df.select(ranks.is_hit(F.col("r"))).collect()] == [True, False, False, False]


def test_public_turns_keep_gaps(spark):
    s = session(spark, [("1", "r", "a", True, 2, [turn(0), turn(1, 5, "x", None), turn(2, 5, "y", "c")])])
    got = export.public_sessions(s, "sub").first()
    assert (got.session_id, got.num_turns) == ("sub_0000", 2)
    assert [(t.turn, t.reference_image_id, t.relative_caption) for t in got.turns] == [(1, "r", "a"), (3, "y", "c")]


def test_breakdown_sorts_as_text(spark):
    s = simple(spark, ("1", 2, [1]), ("2", 10, [1]), ("3", -1, [1]))
    assert [r.outcome for r in stats.success_breakdown(s).collect()] == ["no_success", "turn_10", "turn_2"]


def test_recall_leaves_out_unevaluated_turns(spark):
    s = simple(spark, ("1", 0, [3, -1]), ("2", -1, [20, None]))
    assert [(r.turn, r.hits, r.evaluated) for r in stats.recall_per_turn(s).collect()] == [(0, 1, 2)]


def test_empty_sessions(spark):
    s = spark.createDataFrame([], SESSIONS)
    assert stats.success_rate(s).first().success_pct == 0.0
    assert stats.hits_at_turn(s, 3).count() == 3
    kept, log = curate.curate(s)
    assert (kept.count(), log.count()) == (0, 1)
    assert export.public_sessions(s, "x").count() == 0
    assert curate.report(s, kept)["comparison"]["retention_pct"] == 0.0


def test_files(spark, tmp_path):
    one = {"query_id": "5", "reference_image_id": "h1", "target_image_id": "h2", "ground_truth_ids": ["h2"], "original_query": "o", "success": True, "success_turn": 1}
    one["turns"] = [{"turn": 0, "query_text": "q", "search_results": [["h1", 0.5]], "selected_image": None, "gt_rankings": {"h2": 12}, "best_gt_rank": 12}]
    (tmp_path / "r.json").write_text(json.dumps({"dataset_name": "circo", "config": {}, "results": [one]}))
    s = files.read_sessions(spark, str(tmp_path / "r.json"))
    r = s.first()
    assert (r.dataset, r.pos, r.turns[0].search_results[0].score, r.turns[0].gt_rankings) == ("circo", 0, 0.5, {"h2": 12})
    h = spark.createDataFrame([("h1", "000000000001.jpg")], "img_hash string, image_id string")
    t = files.translate_ids(s, h).first()
    assert (t.reference_image_id, t.target_image_id, t.turns[0].search_results[0].id) == ("000000000001.jpg", "h2", "000000000001.jpg")
    files.write_sessions(s, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("longest", [3, 11])
def test_hits_up_to_the_longest_conversation(spark, tmp_path, longest):
    """The number of turns is the longest conversation's, not a constant."""
    rows = [(c, t, f"text {t}") for c in range(40) for t in range(longest - c % 2)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hits = sorted(queries.hits_at_t(spark, str(tmp_path)).collect())
    assert [r.turn for r in hits] == list(range(longest))
    first = [r.success_turn for r in queries.sessions(spark, str(tmp_path)).where("success").collect()]
    assert hits[-1].cum_hits == len(first) and [r.new_hits for r in hits] == [first.count(t) for t in range(longest)]
    assert queries.auc_hits(spark, str(tmp_path)).collect()[0].auc == pytest.approx(sum(r.hit_rate for r in hits) / longest, abs=1e-5)


def test_commands_read_what_the_filter_writes(spark, tmp_path, capsys):
    turns = [{"turn": i, "query_text": f"q{i}", "search_results": [], "selected_image": f"s{i}", "selected_image_caption": None, "relative_caption": c, "gt_rankings": {"t": r}, "best_gt_rank": r} for i, (r, c) in enumerate([(20, None), (5, "more red")])]
    made = [{"query_id": q, "reference_image_id": "r", "target_image_id": "t", "ground_truth_ids": ["t"], "original_query": "look", "success": ok > 0, "success_turn": ok, "turns": turns} for q, ok in (("1", 1), ("2", -1))]
    (tmp_path / "r.json").write_text(json.dumps({"dataset_name": "circo", "config": {}, "results": made}))
    spark.createDataFrame([("r", "h0"), ("s0", "h1"), ("s1", "h2")], "image_id string, img_hash string").write.parquet(str(tmp_path / "hashes"))
    for _ in range(2):  # a second run replaces the first one's rows
        cli.main(["filter", str(tmp_path / "r.json"), str(tmp_path / "kept"), "--hashes", str(tmp_path / "hashes")], spark)
    assert "left out" not in capsys.readouterr().out
    assert [r.query_id for r in files.read_written(spark, str(tmp_path / "kept")).collect()] == ["1"]
    cli.main(["export", str(tmp_path / "kept"), str(tmp_path / "public"), "--subset", "circo"], spark)
    cli.main(["report", str(tmp_path / "kept")], spark)
    assert capsys.readouterr().out


def test_translated_ids_of_two_datasets(spark):
    turn = lambda ranks: (0, "q", None, "a", None, None, ranks, 1)
    rows = [("x", 0, "1", "a", "b", ["a", "c"], "q", True, 0, [turn(None), turn({"a": 1, "b": 2, "c": 3})]), ("y", 0, "1", "b", None, None, "q", True, 0, [turn({"c": 4})])]
    names = spark.createDataFrame([("a", "A"), ("b", "A"), ("a", "A")], "img_hash string, image_id string")
    got = {r.dataset: r for r in files.translate_ids(spark.createDataFrame(rows, SESSIONS), names).collect()}
    assert (got["x"].reference_image_id, got["x"].target_image_id, got["x"].ground_truth_ids) == ("A", "A", ["A", "c"])
    # two contents with one name: the last rank stays
    assert [t.gt_rankings for t in got["x"].turns] == [None, {"A": 2, "c": 3}]
    assert (got["y"].reference_image_id, got["y"].turns[0].selected_image, got["y"].turns[0].gt_rankings) == ("A", "A", {"c": 4})


def test_hash_lookups_without_sessions(spark):
    none = spark.createDataFrame([], SESSIONS)
    assert tuple(filters.hash_lookups(none, spark.createDataFrame([("a", "h")], "image_id string, img_hash string")).first()) == (0, 0, 0)
