"""Splits: DataFrame -> DataFrame with _split (null: in no split)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import positions, rank

SPLIT = "_split"


def _by_ratio(ratios: dict[str, float]) -> Column:
    """The split of a place: boundaries are the whole parts of cumulative ratio times count, in double arithmetic."""
    out = F.lit(None).cast("string")
    for name, edge in reversed(list(zip(ratios, accumulate(ratios.values()), strict=True))):
        out = F.when(F.col("_at") < F.floor(F.lit(float(edge)) * F.col("_of")), F.lit(name)).otherwise(out)
    return out


def split_by_ratios(df: DataFrame, record_id: str, ratios: dict[str, float], seed: int, stratify_by: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Ratios of all rows, or of each class; what they leave is in no split."""
    if min(ratios.values()) < 0 or sum(ratios.values()) > 1 + 1e-9:
        raise ValueError("ratios must not be negative nor exceed 1 together")
    by = [F.col(stratify_by)] if stratify_by else None
    return positions(df, rank(seed, record_id), [record_id, *(ties or [])], by).withColumn(SPLIT, _by_ratio(ratios)).drop("_at", "_of")


def sparse_classes(df: DataFrame, field: str, ratios: dict[str, float]) -> DataFrame:
    """Classes with fewer rows than there are splits of a positive ratio."""
    return df.groupBy(F.col(field).alias("class")).agg(F.count("*").alias("n")).where(F.col("n") < sum(r > 0 for r in ratios.values()))


def split_by_key(df: DataFrame, field: str, mapping: dict[str, str], strict: bool = True) -> DataFrame:
    """mapping gives the split of each value (as text); other values are an error when rows are read."""
    text = F.when(F.lit(dict(df.dtypes)[field] == "boolean"), F.initcap(F.col(field).cast("string"))).otherwise(F.col(field).cast("string"))
    found = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[text]
    other = F.raise_error(F.concat(F.lit(f"{field}: no split for "), F.coalesce(text, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return df.withColumn(SPLIT, F.coalesce(found, other))


def split_by_partition(df: DataFrame, partition: str, record_id: str | None = None, applies_to: str | None = None, ratios: dict[str, float] | None = None, seed: int = 0, stratify_by: str | None = None) -> DataFrame:
    """The source's partitions as splits; with applies_to, that one is divided by ratios (of each class, if stratified) and the others pass."""
    if applies_to is None:
        return df.withColumn(SPLIT, F.col(partition))
    inside = F.coalesce(F.col(partition) == applies_to, F.lit(False))
    placed = positions(df.withColumn("_in", inside), rank(seed, record_id), [record_id], [F.col("_in"), *([F.col(stratify_by)] if stratify_by else [])])
    return placed.withColumn(SPLIT, F.when(F.col("_in"), _by_ratio(ratios)).otherwise(F.col(partition))).drop("_in", "_at", "_of")


def split_by_tag(df: DataFrame, tags: str, record_id: str, applies_to: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """Rows with the tag are divided by ratios; others go to their one tag, if any; several are an error."""
    has = F.coalesce(F.array_contains(tags, applies_to), F.lit(False))
    others = F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>")))
    own = F.when(F.size(others) > 1, F.raise_error(F.lit("several tags")).cast("string")).otherwise(F.get(others, 0))
    placed = positions(df.withColumn("_in", has), rank(seed, record_id), [record_id], [F.col("_in")])
    return placed.withColumn(SPLIT, F.when(F.col("_in"), _by_ratio(ratios)).otherwise(own)).drop("_in", "_at", "_of")


def sample_data(df: DataFrame, record_id: str, seed: int, n: int | None = None, fraction: float | None = None, by: list[str] | None = None) -> DataFrame:
    """The n rows (or that fraction, rounded down) of least rank of each split, or of each class of each split."""
    keys = [F.col(c) for c in (by or [SPLIT])]
    placed = positions(df, rank(seed, record_id), [record_id], keys)
    target = F.lit(n) if n is not None else F.floor(F.col("_of") * F.lit(float(fraction)))
    return placed.where(F.col("_at") < target).drop("_at", "_of")
