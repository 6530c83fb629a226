"""Datasets by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnwise.sources import annotations


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's files are and how its annotations read."""

    name: str
    kind: str
    annotations: str
    images: str = ""
    splits: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    caption_mode: str = "separate"


def load_queries(spark: SparkSession, dataset: Dataset, hashes: DataFrame | None = None) -> DataFrame:
    """The canonical ``queries`` of a dataset."""
    readers: dict[str, Callable[[], DataFrame]] = {
        "circo": lambda: annotations.read_circo(spark, dataset.annotations, hashes if hashes is not None else spark.createDataFrame([], "image_id string, img_hash string")),
        "cirr": lambda: annotations.read_cirr(spark, dataset.annotations),
        "fashioniq": lambda: annotations.read_fashioniq(spark, dataset.annotations, dataset.caption_mode),
    }
    if dataset.kind not in readers:
        raise ValueError(f"unknown dataset {dataset.kind!r}")
    return readers[dataset.kind]()
