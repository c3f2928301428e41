"""Image and audio files by folder, flat with a manifest, or by layout.  record_id is <source>/<relative path>."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generation import join_by_order, join_labels
from ..operators.media import decode_spark_image, decode_wav
from ..session import ship
from .readers import layout_pattern, manifest

IMAGES = ("png", "jpg", "jpeg")
SOUNDS = ("wav",)


def _glob(suffixes: tuple[str, ...]) -> str:
    return "*.{" + ",".join(suffixes) + "}"


def relative(spark: SparkSession, path: Column, root: str) -> Column:
    """The part of a path below root, whatever the scheme in front of either."""
    whole = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    return F.regexp_replace(plain, "^" + re.escape(base) + "/", "")


def _scan(spark: SparkSession, source: dict, root: str, sound: bool, deep: bool) -> DataFrame:
    """path, relative, and image or content; images are decoded in the JVM."""
    suffixes = SOUNDS if sound else IMAGES
    reader = spark.read.format("binaryFile" if sound else "image").option("pathGlobFilter", _glob(suffixes))
    if deep:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(root if deep else f"{root.rstrip('/')}/*")
    path = F.col("path") if sound else F.col("image.origin")
    df = df.select(path.alias("path"), F.col("content") if sound else F.col("image"))
    return df.withColumn("relative", relative(spark, F.col("path"), root))


def _finish(df: DataFrame, source: dict, sound: bool) -> DataFrame:
    ship(df.sparkSession)
    df = df.withColumn("record_id", F.concat(F.lit(source["name"] + "/"), F.col("relative")))
    if source.get("partition"):
        df = df.withColumn("partition", F.lit(source["partition"]))
    df = df.withColumn("_unlabeled", F.lit(bool(source.get("unlabeled"))))
    return decode_wav(df, "content", source["target_sample_rate"]) if sound else df.withColumn("image", decode_spark_image())


def _labelled(df: DataFrame, source: dict, root: str, base: str) -> DataFrame:
    """Labels of a manifest, by file name or relative path, or by the order of relative paths."""
    m = source.get("label_from")
    if not m:
        return df.withColumn("label", F.lit(None).cast("string"))
    spark = df.sparkSession
    rows = manifest(spark, m["path"] if ":" in m["path"] or m["path"].startswith("/") else f"{base}/{m['path']}", m.get("header"))
    if m["join"] == "by_row_order":
        rows = rows.select(F.monotonically_increasing_id().alias("_order"), F.col(m["label_field"]).alias("label"))
        return join_by_order(df, rows, "relative", "_order").drop("_order")
    named = rows.select(F.col(m["id_field"]).alias("_key"), F.col(m["label_field"]).alias("label"))
    whole = not named.where(F.col("_key").contains("/")).isEmpty()
    key = F.col("relative") if whole else F.regexp_extract("relative", r"([^/]+)$", 1)
    return join_labels(df.withColumn("_key", key), named, "_key", "label").drop("_key")


def folder(spark: SparkSession, source: dict, root: str, sound: bool = False) -> DataFrame:
    """One folder per class.  Images lie directly in it, sounds at any depth."""
    df = _scan(spark, source, root, sound, deep=sound).where(F.col("relative").contains("/"))
    return _finish(df.withColumn("label", F.substring_index("relative", "/", 1)), source, sound)


def flat(spark: SparkSession, source: dict, root: str, sound: bool = False, base: str = ".") -> DataFrame:
    """Files at any depth, with labels of a manifest or none."""
    return _finish(_labelled(_scan(spark, source, root, sound, deep=True), source, root, base), source, sound)


def tree(spark: SparkSession, source: dict, root: str, sound: bool = False, base: str = ".") -> DataFrame:
    """Files that fit a layout; its names are columns, {label} and {split} the label and the partition."""
    layout = source["layout"]
    pattern, names = layout_pattern(layout), re.findall(r"\{(\w+)\}", layout)
    df = _scan(spark, source, root, sound, deep=True).where(F.col("relative").rlike(pattern))
    for i, n in enumerate(names):
        if n != "file":
            df = df.withColumn("partition" if n == "split" else n, F.regexp_extract("relative", pattern, i + 1))
    return _finish(df if "label" in names else _labelled(df, source, root, base), source, sound)
