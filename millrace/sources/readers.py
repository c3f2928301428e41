"""Sources: tables, files by layout, manifests, content hashes."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """csv, json, parquet, orc or text."""
    if kind not in ("csv", "json", "parquet", "orc", "text"):
        raise ValueError(f"unknown source {kind}")
    return getattr(spark.read.options(**options), kind)(path)


def manifest(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """A CSV manifest of strings; with header the file has none.  Blank lines go, ragged rows are an error."""
    if header:
        return spark.read.schema(", ".join(f"`{h}` string" for h in header)).csv(path, mode="FAILFAST")
    return spark.read.csv(path, header=True, mode="FAILFAST")


def layout_pattern(layout: str) -> str:
    """A path template ({label}, {split}, {file}, *, **) as one anchored regular expression."""
    out = ""
    for part in re.findall(r"\{\w+\}|\*\*/?|\*|[^{}*]+", layout):
        if part.startswith("{"):
            out += "([^/]+)"
        elif part.startswith("**"):
            out += "(?:.*/)?" if part.endswith("/") else ".*"
        else:
            out += "[^/]*" if part == "*" else re.escape(part)
    return f"^{out}$"


def files(spark: SparkSession, root: str, layout: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """path, relative, content and one column per name in the layout, of files that fit it.

    Names come from the path alone, so filters on them go before any decoding.
    """
    pattern = layout_pattern(layout)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.split(":", 1)[-1].rstrip("/")) + "/", "")
    df = df.withColumn("relative", relative).where(F.col("relative").rlike(pattern) & F.lower(F.regexp_extract("relative", r"\.([^.]+)$", 1)).isin(list(suffixes)))
    names = re.findall(r"\{(\w+)\}", layout)
    return df.select("path", "relative", "content", *[F.regexp_extract("relative", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def content_hash(spark: SparkSession, root: str) -> str:
    """SHA-256 over the sorted relative path and SHA-256 of every file; the bytes are hashed where they are."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    total = hashlib.sha256()
    for r in df.select("path", F.sha2("content", 256).alias("h")).orderBy("path").toLocalIterator():
        total.update(f"{r['path'].split(root.split(':', 1)[-1].rstrip('/'), 1)[-1]}:{r['h']};".encode())
    return total.hexdigest()
