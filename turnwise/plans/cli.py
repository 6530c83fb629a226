"""Command line: ``python -m turnwise.plans.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators import export, resume, stats
from turnwise.operators.durable import exists
from turnwise.plans import contents, curate, instructions, models, refresh, reports, saved, simulate
from turnwise.sources import captions, images, sessions
from turnwise.streaming import captions as caption_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turnwise")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean", help="clean captions")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--dry-run", action="store_true")
    f = sub.add_parser("filter", help="filter sessions")
    f.add_argument("input")
    f.add_argument("output")
    f.add_argument("--analyze-only", action="store_true")
    f.add_argument("--annotations", help="Parquet table of the dataset's queries, for the report's coverage")
    f.add_argument("--hashes", help="Parquet table of image_id and img_hash; without it the image stage is left out")
    f.add_argument("--rank-margin", type=float, default=30)
    f.add_argument("--similarity-threshold", type=float, default=0.8)
    for stage in curate.STAGES:
        f.add_argument(f"--no-{stage.replace('_', '-')}-filter", dest=stage, action="store_false")
    e = sub.add_parser("export", help="export sessions in their public form")
    e.add_argument("input")
    e.add_argument("output")
    e.add_argument("--subset", required=True)
    a = sub.add_parser("export-all", help="export the filtered files of all public subsets; missing ones are skipped with a warning")
    a.add_argument("input_dir")
    a.add_argument("output_dir")
    a.add_argument("--subsets", nargs="+", choices=sorted(sessions.SUBSET_FILES))
    k = sub.add_parser("captions", help="caption the images of a registry; goes on where a stopped run left off")
    k.add_argument("registry", help="Parquet table of image_path and duplicate_paths")
    k.add_argument("output", help="folder of the captions, a JSON object a line")
    k.add_argument("--store", required=True, help="folder of calls and progress, shared by all nodes")
    k.add_argument("--have", help="captions that are there already")
    k.add_argument("--captioner", metavar="MODULE:FUNCTION", help="gives a function of path and category, called once per task")
    k.add_argument("--requests-per-minute", type=float, default=1500)
    k.add_argument("--max-concurrent", type=int, default=100)
    k.add_argument("--tasks", type=int, default=4)
    k.add_argument("--save-every", type=int, default=100)
    k.add_argument("--force-restart", action="store_true", help="leave captions that are there out of account")
    k.add_argument("--check-progress", action="store_true", help="only say how many are missing")
    v = sub.add_parser("features", help="vectors of the images below a folder")
    v.add_argument("root")
    v.add_argument("output")
    v.add_argument("--dataset", required=True)
    v.add_argument("--split", default="all")
    v.add_argument("--model", default="histogram")
    v.add_argument("--encoder", metavar="MODULE:FUNCTION", default="turnwise.plans.contents:histogram_encoder")
    v.add_argument("--batch-size", type=int, default=32)
    w = sub.add_parser("caption-features", help="vectors of captions; only what is missing is made")
    w.add_argument("input")
    w.add_argument("output")
    w.add_argument("--feature-type", default="hash")
    w.add_argument("--encoder", metavar="MODULE:FUNCTION", default="turnwise.plans.models:hashing_encoder")
    w.add_argument("--force", action="store_true")
    m = sub.add_parser("simulate", help="simulate sessions; a run of the same name goes on after its last full turn")
    m.add_argument("queries", help="Parquet table of query_id, vec, reference, target")
    m.add_argument("corpus", help="Parquet table of corpus_idx, vec, caption, caption_vec")
    m.add_argument("output")
    m.add_argument("--truths", help="Parquet table of query_id, gt_idx; by default each query's target")
    m.add_argument("--store", required=True)
    m.add_argument("--run", default="run")
    m.add_argument("--encoder", metavar="MODULE:FUNCTION", default="turnwise.plans.models:hashing_encoder")
    m.add_argument("--max-turns", type=int, default=5)
    m.add_argument("--test", type=int, metavar="N", help="only the N first queries that aren't done")
    r = sub.add_parser("report", help="print statistics")
    r.add_argument("input")
    r.add_argument("--max-turns", type=int, default=5)
    return p


def named(reference: str) -> Callable:
    """The function that ``MODULE:FUNCTION`` names."""
    module, _, function = reference.partition(":")
    return getattr(importlib.import_module(module), function)


def export_all(spark: SparkSession, input_dir: str, output_dir: str, names: list[str] | None = None) -> list[dict]:
    """Export every subset whose file is there; gives its totals. The others are told of and skipped."""
    done = []
    for subset, file in sessions.subsets(names).items():
        if not exists(spark, path := f"{input_dir}/{file}"):
            print(f"warning: {path} isn't there, {subset} is skipped")
            continue
        rows = sessions.read_sessions(spark, path)
        public = export.public_sessions(rows, subset)
        sessions.write_public(public, f"{output_dir}/{subset}")
        done.append({"subset": subset, "input_sessions": rows.count(), "output_sessions": (t := export.export_totals(public).first())["sessions"], "turns": t["turns"] or 0})
    print(json.dumps({"subsets": done, "sessions": sum(d["output_sessions"] for d in done)}))
    return done


def caption_command(spark: SparkSession, a: argparse.Namespace) -> None:
    registry = spark.read.parquet(a.registry)
    none = spark.createDataFrame([], "image_path string, caption string")
    have = captions.read_captions(spark, a.have).select(F.col("image_key").alias("image_path"), "caption") if a.have and not a.force_restart else none
    store = f"{a.store}/again-{len(_tries(spark, a.store))}" if a.force_restart else _latest(spark, a.store)
    known = have.unionByName(caption_stream.stored_captions(spark, store))
    print(json.dumps(refresh.progress(registry, known, "image_path")))
    if a.check_progress:
        return
    if not a.captioner:
        raise SystemExit("captions: --captioner is needed")
    limits = {"per_minute": a.requests_per_minute, "tasks": a.tasks, "concurrency": max(1, a.max_concurrent // a.tasks)}
    got = caption_stream.caption_job(registry, have, named(a.captioner), store, a.save_every, **limits)
    captions.export_caption_map(got.withColumnRenamed("image_path", "image_key"), a.output)
    calls = caption_stream.stored_calls(spark, store)
    print(json.dumps(caption_stream.job_totals(spark, store).first().asDict() | stats.token_costs(calls.where("success"), image_tokens=0).select("cost", "cost_per_call").first().asDict()))


def _tries(spark: SparkSession, store: str) -> list[str]:
    found = []
    while exists(spark, f"{store}/again-{len(found)}"):
        found.append(f"{store}/again-{len(found)}")
    return found


def _latest(spark: SparkSession, store: str) -> str:
    """The store of the last forced restart, or the first one."""
    return (_tries(spark, store) or [f"{store}/first"])[-1]


def simulate_command(spark: SparkSession, a: argparse.Namespace) -> None:
    queries, corpus = spark.read.parquet(a.queries), spark.read.parquet(a.corpus)
    truths = spark.read.parquet(a.truths) if a.truths else queries.select("query_id", F.col("target").alias("gt_idx"))
    done: DataFrame | None = spark.read.parquet(f"{a.output}/turns").select("query_id") if exists(spark, f"{a.output}/turns") else None
    store = saved.TurnStore(spark, a.store, a.run)
    if done is not None and store.last() is not None and store.last()[1]:
        print(json.dumps({"done": done.distinct().count(), "left": "this run has ended; give --run another name for the rest"}))
        return
    if a.test:
        queries = resume.first_n(queries.withColumn("pos", F.col("query_id")) if done is None else queries.join(done.distinct(), "query_id", "left_anti").withColumn("pos", F.col("query_id")), a.test).drop("pos")
    texts = instructions.Instructions(corpus.select("corpus_idx", "caption"), named(a.encoder))
    turns, errors = simulate.evaluate(queries, corpus.select("corpus_idx", "vec"), truths, corpus.select("corpus_idx", F.col("caption_vec").alias("vec")).where("vec IS NOT NULL"), texts, done, max_turns=a.max_turns, store=store)
    turns.write.mode("append").parquet(f"{a.output}/turns")
    errors.write.mode("append").parquet(f"{a.output}/errors")
    got = simulate.outcomes(turns)
    print(json.dumps(got.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("success")).alias("successes")).first().asDict() | {"errors": errors.count()}))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "clean":
        pairs = captions.read_captions(spark, a.input).select("image_key", F.col("caption").alias("old"), text.clean_caption(F.col("caption")).alias("new"))
        print(json.dumps(stats.cleaning_stats(pairs).first().asDict()))
        if not a.dry_run:
            captions.export_caption_map(pairs.select("image_key", F.col("new").alias("caption")), a.output)
        return
    if a.command == "export-all":
        export_all(spark, a.input_dir, a.output_dir, a.subsets)
        return
    if a.command == "captions":
        caption_command(spark, a)
        return
    if a.command == "features":
        listed = images.directory_images(images.hash_files(spark, a.root), a.dataset, a.split)
        made = contents.encode_datasets(spark, images.registry(listed), a.root, a.model, named(a.encoder), a.output, batch=a.batch_size)
        for row in made.collect():
            print(json.dumps(row.asDict()))
        return
    if a.command == "caption-features":
        print(json.dumps({"done": refresh.refresh_saved(captions.read_captions(spark, a.input), a.output, named(a.encoder), a.feature_type, a.force)}))
        return
    if a.command == "simulate":
        simulate_command(spark, a)
        return
    # a results file or folder, or what "filter" has written
    rows = sessions.read_any(spark, a.input)
    if a.command == "filter":
        options = curate.Options(**{s: getattr(a, s) for s in curate.STAGES}, margin=a.rank_margin, similarity=a.similarity_threshold)
        hashes = spark.read.parquet(a.hashes) if a.hashes else None
        if hashes is None and options.image_duplication:
            print("image_duplication is left out: no --hashes")
        kept, log = curate.curate(rows, encoded=lambda said: models.encode_column(said, "text", models.hashing_encoder), hashes=hashes, options=options)
        log.show(truncate=False)
        queries = spark.read.parquet(a.annotations) if a.annotations else None
        name = (rows.select("dataset").first() or [""])[0]
        report = curate.envelope(rows, kept, options) | curate.report(rows, kept) | {"details": curate.detailed_report(name, rows, kept, log, queries)}
        print(json.dumps(report))
        sessions.write_report(spark, report, f"{a.output}-report")
        if not a.analyze_only:
            sessions.write_sessions(kept, a.output, "overwrite")
    elif a.command == "export":
        public = export.public_sessions(rows, a.subset)
        sessions.write_public(public, a.output)
        print(json.dumps(export.export_totals(public).first().asDict()))
    else:
        print(reports.statistics(rows, a.max_turns))


if __name__ == "__main__":
    main()
