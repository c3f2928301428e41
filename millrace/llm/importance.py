"""Quality selection by importance resampling.

Hashed word 1- and 2-grams of target texts and of all raw texts give two generative (bag of
n-grams) models; a document's importance weight is the ratio of its likelihoods.  Gumbel noise
seeded by the document's id and a top-k by noisy log weight sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import Scratch
from ._text import _STEP, lean, mix, slices, span_hash, words

BUCKETS = 10_000
LABELLED = 20_000
BINS = 4096


def _features(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, row of each feature) for some rows at a time; rows count from the column's start."""
    for lo, _, data, off in slices(column):
        start, end, counts = words(data, off)
        h = span_hash(data, start, end)
        row = np.repeat(np.arange(len(counts)), counts) + lo
        pair = np.flatnonzero(row[1:] == row[:-1])
        two = mix(mix(h[pair] + _STEP[0]) * _STEP[1] + mix(h[pair + 1] + _STEP[2]) * _STEP[3])
        yield (np.concatenate([h, two]) % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[pair]])


def fit(docs: DataFrame, targets: list[int], buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target's to the raw probability of each bucket, counts plus one.  docs: doc_id, text."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.array(sorted(targets), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.isin(np.array([-1 if d is None else d for d in batch.column(0).to_pylist()], np.int64), wanted.value)
            for at, row in _features(batch.column(1), buckets):
                raw += np.bincount(at, minlength=buckets)
                target += np.bincount(at[good[row]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    got = docs.mapInArrow(lean(run), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    counts = np.ones((2, buckets))
    for r in got:
        counts[:, r["bucket"]] += (r["target"], r["raw"])
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def cut_off(keys: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """keys (doc_id, key, ...) with kept: true for the k rows of largest key, ties by smaller doc_id, null ids last.

    The k-th key is bracketed by counts in BINS bins, again and again, until its bin is small;
    only that bin's rows are ranked.  Nothing but counts reaches the driver.
    """
    row = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    low, high, n = row
    if k <= 0 or n == 0 or k >= n:
        return keys.withColumn("kept", F.lit(k > 0))
    above, inside = 0, n
    while inside > 50_000 and high > low:
        step = (high - low) / BINS
        if low + step == low:
            break
        place = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(BINS - 1))
        bins = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b["n"] >= k:
                if b["n"] == inside:
                    step = 0.0
                low, high, inside = b["lo"], b["hi"], b["n"]
                break
            above += b["n"]
        if step == 0.0:
            break
    order = Window.orderBy(F.desc("key"), F.asc_nulls_last("doc_id"))
    edge = keys.where((F.col("key") >= low) & (F.col("key") <= high)).withColumn("kept", F.row_number().over(order) <= k - above)
    rest = keys.where((F.col("key") < low) | (F.col("key") > high)).withColumn("kept", F.col("key") > high)
    return rest.unionByName(edge)


def resample(docs: DataFrame, targets: list[int], share: float, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, n_features, log_weight, key (with Gumbel noise), kept (the share of rows with the largest keys).

    targets: ids of the documents that the target model learns from; all documents make the raw
    model.  Null and empty texts have no feature and weight 0.  Rows with equal ids have equal noise.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "importance")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ratio = fit(docs, targets, buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, row in _features(batch.column(1), buckets):
                n += np.bincount(row, minlength=len(n))
                total += np.bincount(row, ratio[at], len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total)], ["doc_id", "n_features", "log_weight"])

    rows = docs.mapInArrow(lean(weigh), "doc_id long, n_features long, log_weight double")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    uniform = (draw + 0.5) / F.lit(float(1 << 52))
    rows = scratch.save(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    return cut_off(rows, round(share * rows.count()), scratch)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: at most LABELLED documents labelled good and not toxic, by hash of their ids; kept: as large a share as the good ones have among the labelled."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL")
    good = F.col("quality").eqNullSafe(1) & ~F.col("toxic").eqNullSafe(1)
    share = labels.agg(F.coalesce(F.avg(F.col("quality").eqNullSafe(1).cast("int")), F.lit(1.0))).first()[0]
    targets = [r[0] for r in labels.where(good).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()]
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), targets, share)
