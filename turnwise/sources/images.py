"""Image listings with content hashes. Contents are hashed inside the JVM and never leave the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.operators.dedupe import dedupe_content, dedupe_with_duplicates
from turnwise.sources.annotations import running_number


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of the files below ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def hash_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, img_hash); unreadable files have no row when ``spark.sql.files.ignoreCorruptFiles`` is on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.md5("content").alias("img_hash"))


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, image_id) of a split file that is a list of ids."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "image_id"))


def split_map(spark: SparkSession, path: str) -> DataFrame:
    """(pos, image_id, relative_path) of a split file that maps ids to paths; leading dots and slashes go."""
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    got = spark.read.text(path, wholetext=True).select(F.posexplode(entries).alias("pos", "e"))
    return got.select("pos", F.col("e.key").alias("image_id"), text.lstrip_dots_and_slashes(F.col("e.value")).alias("relative_path"))


def listed_images(ids: DataFrame, files: DataFrame, dataset: str, split: str, category: str | None, relative: Column) -> DataFrame:
    """Those of ``ids`` (pos, image_id, ...) whose file ``relative`` ends a path of ``files`` (path, img_hash).

    Paths are met by their whole relative part, cut to as many parts as ``relative`` has, so the join is an equi-join.
    """
    wanted = ids.withColumn("__rel", relative).withColumn("__n", F.size(F.split("__rel", "/")))
    depths = [r[0] for r in wanted.select("__n").distinct().collect()]  # the few depths of a layout
    tails = files.withColumn("__rel", F.explode(F.array(*[F.array_join(F.slice(F.split("path", "/"), -d, d), "/") for d in depths] or [F.lit(None)])))
    got = wanted.join(tails, "__rel")
    return got.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(category).cast("string").alias("category"), F.col("pos").cast("long").alias("pos"), "image_id", F.col("path").alias("image_path"), "img_hash"
    )


def directory_images(files: DataFrame, dataset: str, split: str, keep_extension: bool = False) -> DataFrame:
    """All image files of a directory; ids are stems without leading zeros, or names with ``keep_extension``."""
    name = text.basename(F.col("path"))
    id_ = name if keep_extension else text.strip_zeros(text.drop_extension(name))
    images = files.where(text.has_image_extension(F.col("path"))).withColumn("image_id", id_)
    numbered = running_number(images, ["path"], "pos")
    return numbered.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(None).cast("string").alias("category"), "pos", "image_id", F.col("path").alias("image_path"), "img_hash"
    )


def collect_images(parts: list[DataFrame]) -> DataFrame:
    """The union of listings in order; ``pos`` runs through all of them: earlier listings come first."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("pos", F.col("pos") + F.lit(i).cast("long") * F.lit(1 << 40))
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no listing")
    return out


def registry(images: DataFrame) -> DataFrame:
    """One row per content: its first listing."""
    return dedupe_content(images)


def registry_with_duplicates(images: DataFrame) -> DataFrame:
    """As :func:`registry`, with the paths of later copies in ``duplicate_paths``."""
    return registry(images).join(dedupe_with_duplicates(images).select("img_hash", "duplicate_paths"), "img_hash")


def counts(images: DataFrame) -> DataFrame:
    return images.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("images")).orderBy("dataset", "split")


def found_and_missing(ids: DataFrame, images: DataFrame) -> DataFrame:
    """(found, missing) of the listed ids."""
    there = images.select("image_id", F.lit(True).alias("__there")).distinct()
    return ids.join(there, "image_id", "left").agg(F.count_if(F.col("__there")).alias("found"), F.count_if(F.col("__there").isNull()).alias("missing"))


def existing_ids(files: DataFrame) -> DataFrame:
    """(image_id) of every stem that has an image file: what existence tests join with."""
    return files.where(text.has_image_extension(F.col("path"))).select(text.stem(F.col("path")).alias("image_id")).distinct()


def id_hashes(images: DataFrame) -> DataFrame:
    """(image_id, img_hash) under every spelling that callers use: the id, with ``.jpg``, and as 12 digits with it."""
    number = F.col("image_id").try_cast("bigint")
    spellings = F.array_compact(F.array("image_id", F.concat("image_id", F.lit(".jpg")), F.when(number.isNotNull(), text.padded_id(number, 12, ".jpg"))))
    return images.select(F.explode(F.array_distinct(spellings)).alias("image_id"), "img_hash").distinct()


def as_base64(files: DataFrame) -> DataFrame:
    """(path, encoded) from (path, content)."""
    return files.select("path", F.base64("content").alias("encoded"))


def reencode(files: DataFrame, size: int = 512, quality: int = 75) -> DataFrame:
    """(path, encoded, decode_ok): pictures on white, at most ``size`` wide and high, as JPEG in base 64.

    A picture that can't be decoded has a null ``encoded`` and a false ``decode_ok``. Needs Pillow on the executors.
    """
    import pandas as pd

    def run(batches):
        import base64
        import io

        from PIL import Image

        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    picture = Image.open(io.BytesIO(content)).convert("RGBA")
                except (OSError, SyntaxError, ValueError):  # what Pillow raises for broken files
                    out.append(None)
                    continue
                flat = Image.new("RGB", picture.size, (255, 255, 255))
                flat.paste(picture, mask=picture.getchannel("A"))
                flat.thumbnail((size, size), Image.LANCZOS)
                buffer = io.BytesIO()
                flat.save(buffer, "JPEG", quality=quality)
                out.append(base64.b64encode(buffer.getvalue()).decode())
            yield pd.DataFrame({"path": batch["path"], "encoded": out, "decode_ok": [x is not None for x in out]})

    return files.select("path", "content").mapInPandas(run, "path string, encoded string, decode_ok boolean")
