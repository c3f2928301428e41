"""Near-duplicate documents by bottom-k MinHash sketches of one hash function.

The k smallest shingle hashes of a document are its sketch.  Inverted lists of the retained
values propose pairs, an estimate from the bottom k of the union drops most false ones, and
the Jaccard similarity of the full shingle sets decides.

Which values are listed: two documents at the threshold share at least ``share`` of the
smaller sketch (at 0.85 and k = 64, 0.53; fewer has a probability under 1e-8), so with all values put in one global order, rarest first, two such sketches have a common value
among their first ``s - ceil(share * s) + 1``.  Only these prefixes are listed, so values of
common passages make no long lists, and values found in one document make none at all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._cluster import link
from ._store import Scratch

from ._text import lean, shingle_rows

K = 64
MISS = 1e-8


def safe_share(threshold: float, k: int, miss: float = MISS) -> float:
    """The share of k retained values that two sets at the threshold have in common but for a probability of miss (a binomial tail)."""
    tail = 0.0
    for m in range(k + 1):
        tail += math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
        if tail > miss:
            return m / k
    return 1.0


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, k: int = K) -> DataFrame:
    """id, n_shingles (distinct), print (of the whole set), sketch (its k smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, flat, off = [], [], [], [0]
            for _, h in shingle_rows(batch.column(1), shingle):
                h = np.unique(h)
                n.append(len(h))
                prints.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                flat.append(h[:k])
                off.append(off[-1] + len(flat[-1]))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), lists], ["id", "n_shingles", "print", "sketch"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), "id long, n_shingles long, print binary, sketch array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents with 100 * |A & B| >= percent * |A | B| over distinct shingle sets are linked;
    component_id is the smallest id reachable, kept is doc_id = component_id.  Null or blank
    texts have an empty set and no link.  Texts shorter than a shingle are one shingle.  Rows
    that share an id count as one document with several texts (all linked).  A row with a null
    id is compared with nothing: component_id null, kept true.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    share = safe_share(percent / 100, k)
    rows = scratch.save(sketches(docs, id_col, text_col, shingle, k), "sketches")
    live = rows.where("id IS NOT NULL AND n_shingles > 0")
    # equal sets are one class; its smallest id stands for it
    classes = live.groupBy("print").agg(F.min(F.struct("id", "n_shingles", "sketch")).alias("f"))
    classes = scratch.save(classes.select("print", F.col("f.id").alias("node"), F.col("f.n_shingles").alias("n"), F.col("f.sketch").alias("sketch")), "classes", rows.rows_, 20_000)
    repeated = scratch.save(live.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated", rows.rows_)
    single = not repeated.rows_

    values = classes.select("node", F.size("sketch").cast("short").alias("s"), F.explode("sketch").alias("key"))
    common = values.groupBy("key").agg(F.count("*").alias("found")).where("found > 1")
    # a share of s is at least ceil(share * s) values; of these, each that one document alone has takes a place in the prefix
    listed = values.join(common, "key")
    here = Window.partitionBy("node")
    listed = listed.withColumn("place", F.row_number().over(here.orderBy("found", "key"))).withColumn("many", F.count("*").over(here)).withColumn("weight", F.sum("found").over(here))
    given = None
    if not single:  # rows of one id are one node
        owners = live.join(classes.select("print", "node"), "print").select("id", "node")
        several = owners.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
        given = owners.join(several, "id").where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()
        listed = listed.join(repeated.withColumnRenamed("id", "node"), "node", "left")
    prefix = listed.where(("" if single else "rows IS NOT NULL OR ") + f"place <= s - ceil({share}D * s) + 1 - (s - many)")
    postings = scratch.save(prefix.select("key", "node", "weight"), "postings", classes.rows_ * k)

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(postings.select("node").distinct(), "node", "left_semi")
    texts = scratch.save(texts, "texts", classes.rows_ if single else None, 5_000)
    scratch.drop()
    found = link(postings, texts, shingle, percent, scratch, given, (k, share), single)
    scratch.clear(rows, classes, found)

    out = rows.select("id", "n_shingles", "print").join(classes.select("print", "node"), "print", "left").join(found, "node", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "node", "id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.coalesce(F.col("id") == component, F.lit(True))).alias("kept"))
    out = scratch.save(out, "groups", rows.rows_)
    scratch.clear(out)
    return out


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates over 3-word shingles at 0.85; odd input as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


ORACLE_MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
   AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL
), l AS (
  SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 100 * shared >= 85 * (len(x.sh) + len(y.sh) - shared)
), r AS (
  SELECT doc_id, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id WHERE r.m < l.b
), k AS (SELECT doc_id, min(m) AS m FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, k.m AS component_id, s.doc_id = k.m AS kept FROM s JOIN k USING (doc_id)
"""


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs with all columns, one row for each group of near duplicates (that of the smallest id); rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.where("NOT kept").select("doc_id").distinct()
    gone = gone.select(F.col("doc_id").alias(next(f"_gone{i}" for i in range(len(docs.columns) + 1) if f"_gone{i}" not in docs.columns)))
    left = docs.join(gone, docs[id_col].cast("long") == gone[gone.columns[0]], "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where(F.col(id_col).isNull()).unionByName(left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
