"""Which images are there, by the folder layouts of the datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators.dedupe import first_by


@dataclass(frozen=True)
class Folder:
    """Files in one of ``names``, tried in that order, and in each by extension, tried in order; with ``numbered`` a folder has
    that many subfolders 0, 1, ..., tried before the next name."""

    names: tuple[str, ...]
    extensions: tuple[str, ...]
    numbered: int = 0


# The folders and extensions of the datasets, in the order in which they are tried.
FASHION = (Folder(("dress", "shirt", "toptee"), (".jpg",)),)
CIRR = (Folder(("train",), (".jpg", ".jpeg", ".png"), 100), Folder(("val", "dev", "test1"), (".png", ".jpg", ".jpeg")))
CIRCO = (Folder(("",), (".jpg",)),)
LAYOUTS = {"fashioniq": FASHION, "cirr": CIRR, "circo": CIRCO}


def layout_of(dataset: str) -> tuple[Folder, ...]:
    """By the dataset's name or a part of it; the last layout is everybody else's."""
    name = dataset.lower().replace("-", "")
    return next((LAYOUTS[k] for k in ("fashioniq", "cirr") if k in name), CIRCO)


def _placed(relative: Column, folders: tuple[Folder, ...]) -> tuple[Column, Column]:
    """(file stem, place in the order of trials) of a path below the dataset's root; null where no folder has such files."""
    parts = F.split(relative, "/")
    stem = text.stem(relative)
    end = F.lower(F.regexp_extract(relative, r"(\.[^./]*)$", 1))
    at, place = 0, F.lit(None).cast("int")
    for folder in folders:
        depth = (1 if folder.names != ("",) else 0) + (1 if folder.numbered else 0)
        inner = folder.numbered or 1
        name = F.array_position(F.array(*[F.lit(n) for n in folder.names]), F.get(parts, F.lit(0))) - 1 if folder.names != ("",) else F.lit(0)
        number = F.get(parts, F.lit(depth - 1)).try_cast("int") if folder.numbered else F.lit(0)
        plain = F.get(parts, F.lit(depth - 1)) == number.cast("string") if folder.numbered else F.lit(True)  # 07 is no folder 7
        kind = F.array_position(F.array(*[F.lit(e) for e in folder.extensions]), end) - 1
        fits = (F.size(parts) == depth + 1) & (name >= 0) & plain & number.between(0, inner - 1) & (kind >= 0)
        place = F.coalesce(place, F.when(fits, F.lit(at) + (name * inner + number) * len(folder.extensions) + kind).cast("int"))
        at += len(folder.names) * inner * len(folder.extensions)
    return stem, place


def layout_files(files: DataFrame, root: str, dataset: str) -> DataFrame:
    """(image_id, path, place) of the files (path) below ``root`` that the dataset's layout knows; the first place of each id.

    Every file says by its own path which id it is for and when it would be tried: one row a file instead of
    hundreds of candidate paths an id. Ids are stems; for datasets of twelve-digit names also the number without its zeros.
    """
    folders = layout_of(dataset)
    base = root.rstrip("/") + "/"
    inside = files.where(F.col("path").contains(base))
    relative = F.substr(F.col("path"), F.locate(base, F.col("path")) + F.lit(len(base)))
    stem, place = _placed(relative, folders)
    found = inside.select(stem.alias("image_id"), "path", place.alias("place")).where("place IS NOT NULL")
    if folders is CIRCO:
        bare = F.regexp_replace("image_id", "^0+(?=.)", "")
        found = found.where("length(image_id) = 12").withColumn("image_id", F.explode(F.array_distinct(F.array("image_id", F.concat("image_id", F.lit(".jpg")), bare))))
    return first_by(found, "image_id", ["place", "path"])


def existing_images(ids: DataFrame, files: DataFrame, root: str, dataset: str, known: DataFrame | None = None) -> DataFrame:
    """``ids`` (image_id, ...) with ``found``, the path of the image's file, null if there is none.

    ``known`` (image_id, image_path), paths of a registry, comes before the layout. Each lookup is one equi-join.
    """
    at = layout_files(files, root, dataset).select("image_id", F.col("path").alias("__at"))
    got = ids.join(at, "image_id", "left")
    if known is None:
        return got.withColumnRenamed("__at", "found")
    there = known.select("image_id", F.col("image_path").alias("path")).join(files.select("path"), "path", "left_semi")
    first = there.groupBy("image_id").agg(F.min("path").alias("__known"))
    return got.join(first, "image_id", "left").withColumn("found", F.coalesce("__known", "__at")).drop("__known", "__at")
