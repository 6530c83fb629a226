"""Captions as a job that can be stopped at any time: small batches of calls, each appended to a table when it is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import resume
from turnwise.operators.durable import exists
from turnwise.plans import models, refresh
from turnwise.plans.journal import Journal

TODO_SCHEMA = "image_path string, category string, image_index long"


def stored_calls(spark: SparkSession, store: str) -> DataFrame:
    """All calls that the job has made, with the number of their batch."""
    schema = models.CALL_SCHEMA + ", batch long"
    if not exists(spark, f"{store}/calls"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{store}/calls").parquet(f"{store}/calls")


def stored_captions(spark: SparkSession, store: str) -> DataFrame:
    """(image_path, caption): of several successes the one of the last batch."""
    good = stored_calls(spark, store).where("success")
    return good.groupBy("image_path").agg(F.max_by("caption", F.struct("batch", "image_index")).alias("caption"))


def _work_off(spark: SparkSession, store: str, make: Callable[[], Callable[[str, str], dict]], **limits) -> None:
    """Call for the files of ``todo`` that the stream's log doesn't list as done, one file a batch."""
    journal = Journal(f"{store}/journal")

    def each(batch: DataFrame, number: int) -> None:
        # A batch that was stopped runs again under its number and replaces what it had written
        models.call_captioner(batch, make, journal=journal, **limits).write.mode("overwrite").parquet(f"{store}/calls/batch={number}")

    todo = spark.readStream.schema(TODO_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{store}/todo")
    stream = todo.writeStream.foreachBatch(each).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
    stream.awaitTermination()


def caption_job(registry: DataFrame, have: DataFrame, make: Callable[[], Callable[[str, str], dict]], store: str, save_every: int = 100, **limits) -> DataFrame:
    """(image_path, caption) of all paths, copies included; what was made is kept in the folder ``store``, which all nodes share.

    What an earlier run left is worked off first, then what neither ``have`` nor ``store`` has a caption for is written in
    files of ``save_every`` items and worked off as a stream: each file's calls are a batch that is appended to the table of
    calls, and the stream's log says which are done. Within a batch each successful call has a record of its own
    (:class:`Journal`): a task that runs again, or a run after a stop, asks for none of them twice. Items whose calls failed are asked for again by the
    next run. ``limits`` are those of :func:`turnwise.plans.models.call_captioner`.
    """
    spark = registry.sparkSession
    if exists(spark, f"{store}/todo"):
        _work_off(spark, store, make, **limits)
    known = have.select("image_path", "caption").unionByName(stored_captions(spark, store))
    todo = refresh.to_caption(registry, known)
    files = max(1, -(-todo.count() // save_every))
    if not todo.isEmpty():
        todo.repartition(files).write.option("maxRecordsPerFile", save_every).mode("append").parquet(f"{store}/todo")
        _work_off(spark, store, make, **limits)
    fresh = stored_captions(spark, store).join(have.select("image_path"), "image_path", "left_anti")
    return resume.finish_captions(have.select("image_path", "caption").unionByName(fresh), registry)


def job_totals(spark: SparkSession, store: str) -> DataFrame:
    """(calls, successes, failures, input_tokens, output_tokens) of all batches so far."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return stored_calls(spark, store).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"), *sums)
