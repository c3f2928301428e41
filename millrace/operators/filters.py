"""Filters and samplers: DataFrame -> DataFrame.  Samples are exact in size and depend on record ids and seeds only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import positions, rank

TAGS = "sample_per_class_tags"
_COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}


def filter_by_label(df: DataFrame, field: str, labels: list, action: str) -> DataFrame:
    """include keeps rows whose label is listed, exclude the others; a null label is in no list."""
    listed = F.coalesce(F.col(field).isin(labels), F.lit(False))
    if action not in ("include", "exclude"):
        raise ValueError(f"action: {action}")
    return df.where(listed if action == "include" else ~listed)


def filter_by_value(df: DataFrame, field: str, op: str, value: object) -> DataFrame:
    """eq, ne, lt, le, gt, ge against one value, or in against a list; nulls don't pass."""
    c = F.col(field)
    return df.where(c.isin(list(value)) if op == "in" else getattr(c, _COMPARE[op])(F.lit(value)))


def drop_nulls(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.na.drop(subset=fields)


def filter_by_length(df: DataFrame, tokens: Column, min_tokens: int | None = None, max_tokens: int | None = None) -> DataFrame:
    if min_tokens is not None:
        df = df.where(tokens >= min_tokens)
    return df if max_tokens is None else df.where(tokens <= max_tokens)


def random_sample(df: DataFrame, record_id: str, seed: int, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """Exactly n rows, or the whole part of fraction of them."""
    if (n is None) == (fraction is None):
        raise ValueError("one of n and fraction is needed")
    placed = positions(df, rank(seed, record_id), [record_id])
    target = F.lit(n) if n is not None else F.floor(F.col("_of") * F.lit(float(fraction)))
    return placed.where(F.col("_at") < target).drop("_at", "_of")


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    old = F.col(TAGS) if TAGS in df.columns else F.array().cast("array<string>")
    new = F.array_append(F.coalesce(old, F.array().cast("array<string>")), F.lit(tag))
    return df.withColumn(TAGS, F.when(F.col("_chosen"), new).otherwise(old))


def sample_per_class(df: DataFrame, record_id: str, field: str, n: int | Column, seed: int, tag: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The n rows of least rank of each class; with a tag all rows stay and the chosen are tagged.

    exclude: rows with one of these tags are no candidates.
    """
    out = F.coalesce(F.arrays_overlap(TAGS, F.array(*[F.lit(x) for x in exclude])), F.lit(False)) if exclude else F.lit(False)
    if tag is None:
        here = Window.partitionBy(field).orderBy(rank(seed, record_id), record_id)
        return df.where(~out).withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= n).drop("_r")
    placed = positions(df.withColumn("_out", out), rank(seed, record_id), [record_id], [F.col("_out"), F.col(field)])
    return _tagged(placed.withColumn("_chosen", ~F.col("_out") & (F.col("_at") < n)), tag).drop("_chosen", "_out", "_at", "_of")


def sample_per_class_fractional(df: DataFrame, record_id: str, field: str, base: int, fractions: dict[str, float], seed: int, **options: object) -> DataFrame:
    """As sample_per_class with base times the class's fraction (1 where none is given), rounded down."""
    n = F.lit(base)
    for label, f in fractions.items():
        n = F.when(F.col(field) == label, F.lit(math.floor(base * f))).otherwise(n)
    return sample_per_class(df, record_id, field, n, seed, **options)


def drop_by_label(df: DataFrame, labels: list[str]) -> DataFrame:
    """Drops rows with one of these tags; rows without tags stay."""
    return df.where(~F.coalesce(F.arrays_overlap(TAGS, F.array(*[F.lit(x) for x in labels])), F.lit(False)))


def emptied_classes(before: DataFrame, after: DataFrame, field: str) -> DataFrame:
    """Classes that a filter has left without rows, and their counts before."""
    old = before.groupBy(F.col(field).alias("class")).agg(F.count("*").alias("n_before"))
    new = after.select(F.col(field).alias("class")).distinct()
    return old.join(new, old["class"].eqNullSafe(new["class"]), "left_anti")
