"""The commands end to end, result folders, reports, and lookups that must match."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import lookup
from turnwise.plans import cli, curate, models
from turnwise.sources import captions
from turnwise.sources import sessions as files


def session(query_id, ok, ranks=(20, 5)):
    turns = [{"turn": i, "query_text": f"q{i}", "search_results": [["s1", 0.5], ["s2", 0.25]], "selected_image": f"s{i}" if i else None, "selected_image_caption": None, "relative_caption": "more red" if i else None, "gt_rankings": {"t": r}, "best_gt_rank": r} for i, r in enumerate(ranks)]
    return {"query_id": query_id, "reference_image_id": "r", "target_image_id": "t", "ground_truth_ids": ["t"], "original_query": "look", "success": ok > 0, "success_turn": ok, "turns": turns}


def result_file(path, *rows, name="circo"):
    path.write_text(json.dumps({"dataset_name": name, "config": {}, "results": list(rows)}))


def said(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_all_subsets_are_exported_and_missing_ones_skipped(spark, tmp_path, capsys):
    result_file(tmp_path / "filtered_multiturn_cir_circo.json", session("1", 1), session("2", -1))
    result_file(tmp_path / "filtered_multiturn_cir_cirr_val.json", session("3", 1))
    cli.main(["export-all", str(tmp_path), str(tmp_path / "out")], spark)
    out = capsys.readouterr().out
    assert out.count("warning:") == 7 and "cirr_train is skipped" in out
    totals = json.loads(out.splitlines()[-1])
    assert {d["subset"]: d["output_sessions"] for d in totals["subsets"]} == {"circo_val": 2, "cirr_val": 1} and totals["sessions"] == 3
    rows = spark.read.json(str(tmp_path / "out" / "circo_val")).orderBy("session_id").collect()
    assert [(r.session_id, r.num_turns) for r in rows] == [("circo_val_0000", 2), ("circo_val_0001", 2)] or [r.subset for r in rows] == ["circo_val"] * 2
    cli.main(["export-all", str(tmp_path), str(tmp_path / "some"), "--subsets", "cirr_val"], spark)
    assert "warning" not in capsys.readouterr().out


def test_result_folders_are_read_back(spark, tmp_path):
    result_file(tmp_path / "r.json", session("1", 1), session("2", -1))
    rows = files.read_sessions(spark, str(tmp_path / "r.json"))
    files.write_results(rows.repartition(2), str(tmp_path / "folder"), "circo", {"k": 10}, {"missing": 0})
    back = files.read_any(spark, str(tmp_path / "folder"))
    assert back.select(*rows.columns).orderBy("pos").collect() == rows.orderBy("pos").collect()
    head = json.loads(spark.read.text(str(tmp_path / "folder" / "envelope")).first()[0])
    assert (head["dataset_name"], head["total_results"], head["config"], head["data_completeness"]) == ("circo", 2, {"k": 10}, {"missing": 0})


def test_captions_and_their_vectors(spark, tmp_path, capsys):
    registry = str(tmp_path / "registry")
    spark.createDataFrame([("a/dress/1.jpg", ["b/1.jpg"]), ("cirr/2.png", [])], "image_path string, duplicate_paths array<string>").write.parquet(registry)
    run = lambda *more: cli.main(["captions", registry, str(tmp_path / "captions"), "--store", str(tmp_path / "store"), "--tasks", "1", "--requests-per-minute", "60000", *more], spark)
    run("--check-progress")
    assert said(capsys) == [{"total": 2, "done": 0, "remaining": 2, "done_pct": 0.0}]
    with pytest.raises(SystemExit):
        run()
    run("--captioner", "turnwise.plans.models:echo_captioner")
    assert said(capsys)[-1]["calls"] == 2
    made = captions.read_captions(spark, str(tmp_path / "captions"))
    assert {(r.image_key, r.caption) for r in made.collect()} == {("a/dress/1.jpg", "dress 1.jpg"), ("b/1.jpg", "dress 1.jpg"), ("cirr/2.png", "general 2.png")}
    run("--captioner", "turnwise.plans.models:echo_captioner")
    assert said(capsys)[-1]["calls"] == 2  # nothing was left to ask for
    run("--captioner", "turnwise.plans.models:echo_captioner", "--force-restart")
    assert said(capsys)[-1]["calls"] == 2
    for want in ("made", "complete"):
        cli.main(["caption-features", str(tmp_path / "captions"), str(tmp_path / "vectors")], spark)
        assert said(capsys) == [{"done": want}]
    cli.main(["clean", str(tmp_path / "captions"), str(tmp_path / "clean")], spark)
    assert said(capsys)[0]["total"] == 3


def test_features_of_a_folder(spark, tmp_path, capsys):
    root = tmp_path / "images"
    root.mkdir()
    for i in range(3):
        (root / f"{i}.jpg").write_bytes(bytes([i]) * 9)
    cli.main(["features", str(root), str(tmp_path / "features"), "--dataset", "mine"], spark)
    (got,) = said(capsys)
    assert (got["dataset"], got["images"], got["failed"], got["feature_dim"]) == ("mine", 3, 0, 64)


def test_simulated_runs(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    encode = models.hashing_encoder()
    words = [f"item {i} colour{i % 5} shape{i % 7}" for i in range(40)]
    rows = [(i, (v / np.linalg.norm(v)).tolist(), w, encode([w])[0].tolist()) for i, (v, w) in enumerate(zip(rng.normal(size=(40, 64)), words, strict=True))]
    spark.createDataFrame(rows, "corpus_idx long, vec array<double>, caption string, caption_vec array<double>").write.parquet(str(tmp_path / "corpus"))
    asked = [(i, rows[i][1], i, 39 - i) for i in range(3)] + [(9, rows[9][1], 9, 999)]
    spark.createDataFrame(asked, "query_id long, vec array<double>, reference long, target long").write.parquet(str(tmp_path / "queries"))
    run = lambda *more: cli.main(["simulate", str(tmp_path / "queries"), str(tmp_path / "corpus"), str(tmp_path / "out"), "--store", str(tmp_path / "store"), "--max-turns", "1", *more], spark)
    run("--test", "2")
    assert said(capsys)[-1]["sessions"] == 2
    run("--test", "2")
    assert said(capsys)[-1]["done"] == 2
    run("--run", "rest")
    assert said(capsys)[-1]["sessions"] == 1
    assert spark.read.parquet(str(tmp_path / "out" / "turns")).select("query_id").distinct().count() == 3
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "errors")).collect()] == [(9, "target not in the corpus")]


def test_the_detailed_report(spark, tmp_path):
    result_file(tmp_path / "r.json", session("1", 1), session("2", -1), session("x", 1), session("3", 1, (20, 90)))
    rows = files.read_sessions(spark, str(tmp_path / "r.json"))
    kept, log = curate.curate(rows, options=curate.Options(text_similarity=False, image_duplication=False))
    got = curate.detailed_report("circo", rows, kept, log, spark.range(8))
    assert got["dataset_info"]["experiment_stats"] == {"total_processed_queries": 4, "processing_coverage": 50.0}
    assert got["original_analysis"]["summary"] == {"successful_queries": 2, "unsuccessful_queries": 1, "success_rate": pytest.approx(200 / 3)}
    stages = got["filtering_analysis"]["stages"]
    assert stages[0]["input_count"] == 4 and all(a["output_count"] == b["input_count"] for a, b in zip(stages, stages[1:], strict=False))
    assert got["final_analysis"]["total_queries"] == kept.count() and got["filtering_analysis"]["overall_summary"]["initial_count"] == 3
    assert got["comparison"]["quality_improvement"]["final_success_rate"] == 100.0
    total = curate.coverage_rollup([got, curate.detailed_report("none", rows.limit(0), kept.limit(0), log.limit(0), spark.range(2))])
    assert total["datasets"] == {"circo": 50.0, "none": 0.0} and total["processing_coverage"] == 40.0 and total["final_count"] == kept.count()


def test_lookups_that_must_match(spark):
    rows = spark.createDataFrame([("a.jpg",), ("b",)], "id string")
    table = spark.createDataFrame([("a", "one")], "key string, caption string")
    spelt = lookup.image_spellings(F.col("id"))
    got = lookup.first_match(rows, "id", spelt, table, "key")
    assert tuple(lookup.unmatched(got, "id").first()) == (2, 1, "b")
    with pytest.raises(lookup.Unmatched, match="1 of 2 keys.*'b'"):
        lookup.all_matched(rows, "id", spelt, table, "key")
    assert lookup.all_matched(rows.limit(1), "id", spelt, table, "key").first().caption == "one"
