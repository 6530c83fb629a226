"""Session files: the result envelope, the optional flat tables, and the sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import stats
from turnwise.operators.durable import exists
from turnwise.sources.schemas import DETAIL_CSV, SESSION_FILE, SESSION_LINE, SUMMARY_CSV


def read_sessions(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The canonical ``sessions`` of a result file; ``pos`` is the place in its list."""
    whole = spark.read.schema(SESSION_FILE).option("multiLine", True).json(path)
    rows = whole.select(F.coalesce(F.lit(dataset), "dataset_name").alias("dataset"), F.posexplode("results").alias("pos", "r")).select("dataset", F.col("pos").cast("long").alias("pos"), "r.*")
    return _with_hits(rows)


def write_results(sessions: DataFrame, path: str, dataset: str, config: dict, completeness: dict | None = None) -> None:
    """A result folder: ``envelope`` (one JSON object: dataset, config, completeness, number of results) and ``results`` (a session a line).

    Sessions are written by all tasks; hits are pairs of id and score, as result files have them.
    """
    spark = sessions.sparkSession
    pair = lambda h: F.array(h["id"], h["score"].cast("string"))
    lines = sessions.withColumn("turns", F.transform("turns", lambda t: t.withField("search_results", F.transform(t["search_results"], pair))))
    lines.drop("dataset").write.mode("overwrite").json(f"{path}/results")
    total = spark.read.text(f"{path}/results").count()
    write_report(spark, {"dataset_name": dataset, "config": config, "data_completeness": completeness or {}, "total_results": total}, f"{path}/envelope")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The canonical ``sessions`` of a folder that :func:`write_results` has written; lines are read by many tasks."""
    name = json.loads(spark.read.text(f"{path}/envelope").first()[0])["dataset_name"]
    rows = spark.read.schema(SESSION_LINE).json(f"{path}/results")
    return _with_hits(rows.select(F.lit(name).alias("dataset"), "*"))


def _with_hits(rows: DataFrame) -> DataFrame:
    hit = lambda h: F.struct(F.get(h, F.lit(0)).alias("id"), F.get(h, F.lit(1)).cast("double").alias("score"))
    return rows.withColumn("turns", F.transform("turns", lambda t: t.withField("search_results", F.transform(t["search_results"], hit))))


def flat_tables(spark: SparkSession, sessions: DataFrame, summary_csv: str | None = None, detail_csv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, turns): read from the two CSV files if both are given, else derived from the sessions."""
    if summary_csv and detail_csv:
        read = lambda schema, path: spark.read.schema(schema).option("header", True).csv(path)
        return read(SUMMARY_CSV, summary_csv), read(DETAIL_CSV, detail_csv)
    return stats.session_summary(sessions), stats.turn_table(sessions)


def write_sessions(sessions: DataFrame, path: str, mode: str = "append") -> None:
    """Write finished sessions. By default they are appended: nothing that is written is rewritten."""
    sessions.write.mode(mode).partitionBy("dataset").parquet(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Sessions as :func:`write_sessions` has written them."""
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a result file, a result folder, or a table of sessions."""
    if path.endswith((".json", ".json.gz")):
        return read_sessions(spark, path)
    return read_results(spark, path) if exists(spark, f"{path}/envelope") else read_written(spark, path)


def translate_ids(sessions: DataFrame, hashes: DataFrame) -> DataFrame:
    """Content hashes as file ids in all six places of a session; unknown ones stay. ``hashes`` (img_hash, image_id).

    The ids of a session become rows, meet the table in one join and return as one small map per session. Sessions are told
    apart by dataset and ``pos``; of several hashes with one file id, the last ranking of a turn stays.
    """
    strings = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    of_turn = lambda t: F.concat(F.array(t["selected_image"]), strings(F.transform(t["search_results"], lambda h: h["id"])), strings(F.map_keys(t["gt_rankings"])))
    in_turns = strings(F.flatten(F.transform("turns", of_turn)))
    ids = F.array_distinct(F.array_compact(F.concat(F.array("reference_image_id", "target_image_id"), strings(F.col("ground_truth_ids")), in_turns)))
    used = sessions.select("dataset", "pos", F.explode(ids).alias("img_hash")).distinct().join(hashes.select("img_hash", "image_id").dropDuplicates(["img_hash"]), "img_hash")
    maps = used.groupBy(F.col("dataset").alias("__dataset"), F.col("pos").alias("__pos")).agg(F.map_from_entries(F.collect_list(F.struct("img_hash", "image_id"))).alias("__m"))
    same = F.col("dataset").eqNullSafe(F.col("__dataset")) & (F.col("pos") == F.col("__pos"))
    got = sessions.join(maps, same, "left").drop("__dataset", "__pos").withColumn("__m", F.coalesce("__m", F.create_map().cast("map<string,string>")))
    named = lambda x: F.coalesce(F.try_element_at(F.col("__m"), x), x)

    def rankings(ranks):
        told = F.transform(F.map_entries(ranks), lambda e: F.struct(named(e["key"]).alias("key"), e["value"].alias("value")))
        later = lambda e, i: F.exists(F.slice(told, i + 2, F.size(told)), lambda x: x["key"] == e["key"])
        return F.map_from_entries(F.filter(told, lambda e, i: ~later(e, i)))

    def turn(t):
        t = t.withField("selected_image", named(t["selected_image"]))
        t = t.withField("search_results", F.transform(t["search_results"], lambda h: h.withField("id", named(h["id"]))))
        return t.withField("gt_rankings", rankings(t["gt_rankings"]))

    return got.withColumns(
        {
            "reference_image_id": named(F.col("reference_image_id")),
            "target_image_id": named(F.col("target_image_id")),
            "ground_truth_ids": F.transform("ground_truth_ids", named),
            "turns": F.transform("turns", turn),
        }
    ).drop("__m")


def write_public(public: DataFrame, path: str) -> None:
    """One JSON object a line."""
    public.write.mode("overwrite").json(path)


# Names of the public subsets and of the files that they come from.
SUBSET_FILES = {
    "fashioniq_dress_train": "filtered_multiturn_cir_fashioniq_dress_train.json",
    "fashioniq_dress_val": "filtered_multiturn_cir_fashioniq_dress_val.json",
    "fashioniq_shirt_train": "filtered_multiturn_cir_fashioniq_shirt_train.json",
    "fashioniq_shirt_val": "filtered_multiturn_cir_fashioniq_shirt_val.json",
    "fashioniq_toptee_train": "filtered_multiturn_cir_fashioniq_toptee_train.json",
    "fashioniq_toptee_val": "filtered_multiturn_cir_fashioniq_toptee_val.json",
    "cirr_train": "filtered_multiturn_cir_cirr_train.json",
    "cirr_val": "filtered_multiturn_cir_cirr_val.json",
    "circo_val": "filtered_multiturn_cir_circo.json",
}


def subsets(names: list[str] | None = None) -> dict[str, str]:
    """The subsets asked for, or all."""
    return {k: v for k, v in SUBSET_FILES.items() if names is None or k in names}


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON object."""
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
