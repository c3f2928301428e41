"""Aggregates for reports: counts, class distributions, histograms, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import tokens
from .splits import SPLIT


def class_distribution(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.col(field).alias("class")).agg(F.count("*").alias("n"))


def record_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col(SPLIT).isNotNull()).groupBy(SPLIT).agg(F.count("*").alias("n"))


def drift(df: DataFrame, field: str) -> DataFrame:
    """Rows of each class of each split; a null class is 'None'."""
    return df.where(F.col(SPLIT).isNotNull()).groupBy(SPLIT, F.coalesce(F.col(field).cast("string"), F.lit("None")).alias("class")).agg(F.count("*").alias("n"))


def label_classes(df: DataFrame, field: str) -> DataFrame:
    """Distinct labels as text, null left out."""
    return df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("class")).distinct()


def histogram(df: DataFrame, field: str, low: float, high: float, bins: int) -> DataFrame:
    """Values of an array column in equal bins; the last is closed, values outside are left out."""
    x = df.select(F.explode(field).alias("x")).select(F.col("x").cast("double").alias("x")).where((F.col("x") >= low) & (F.col("x") <= high))
    place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return x.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """Count, nulls, distinct values, minimum, maximum, mean and deviation of numeric fields, one row each, in one aggregation."""
    aggs = []
    for c in fields:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("field"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")))
    return df.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def token_lengths(df: DataFrame, field: str, width: int = 10) -> DataFrame:
    """bin (its first length), n: rows by number of tokens."""
    n = F.size(tokens(field))
    return df.where(F.col(field).isNotNull()).groupBy((F.floor(n / width) * width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def peek(df: DataFrame, record_id: str = "record_id", n: int = 3) -> DataFrame:
    """The first n rows of each split by id."""
    here = Window.partitionBy(SPLIT).orderBy(record_id)
    return df.where(F.col(SPLIT).isNotNull()).withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= n).drop("_r")
