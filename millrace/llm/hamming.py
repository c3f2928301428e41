"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments.  If the first j + 1 segments have been looked up to radius r and
the others to r - 1, every code within distance m * r + j has been met.  Radii grow by one, one
segment after the other, until the k-th verified distance is covered; nothing else ends the
search.  Only values that occur are looked up: a segment's directory of them is sorted by their
distance from the query's value.  Only distinct codes are indexed, each with at most its k
smallest ids, so a code that a third of all rows share costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import Scratch
from ._text import lean

BITS = 64
SEGMENTS = 4
SHARD, LEAST_SHARD = 1 << 18, 1 << 13  # distinct codes of a shard; small tables make up to 32 shards
QUERIES = 1024


def sign_code(column: str, bits: int = BITS) -> Column:
    """Bit i is set where element i is over 0; missing and null elements give 0, a null array gives null."""
    parts = [F.expr(f"shiftleft(CAST(coalesce(get(`{column}`, {i}) > 0, false) AS bigint), {i})") for i in range(bits)]
    return F.when(F.col(column).isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), parts))


class Index:
    """Segment directories of distinct 64-bit codes; weights are the rows of a code.  compared counts verified distances."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bits: int = BITS, segments: int = SEGMENTS):
        self.codes, self.weights, self.bits, self.segments, self.compared = codes, weights, bits, segments, 0
        self.width = bits // segments
        mask = np.uint64((1 << self.width) - 1)
        self.parts = [(np.uint64(s * self.width), mask) for s in range(segments)]
        self.lists, self.values, self.edges = [], [], []
        for shift, mask in self.parts:
            v = (codes >> shift) & mask
            order = np.argsort(v, kind="stable")
            values, first = np.unique(v[order], return_index=True)
            self.lists.append(order)
            self.values.append(values)
            self.edges.append(np.append(first, len(codes)))

    def nearest(self, query: np.uint64, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes up to the distance at which k rows are reached, none beyond bound."""
        rings = []
        for (shift, mask), values in zip(self.parts, self.values, strict=True):
            apart = np.bitwise_count(values ^ ((query >> shift) & mask))
            rings.append((np.argsort(apart, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(apart, minlength=self.width + 1))])))
        met = np.zeros(len(self.codes), bool)
        rows = np.zeros(self.bits + 1, np.int64)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for radius in range(self.width + 1):
            for s, (order, ring) in enumerate(rings):
                at = order[ring[radius] : ring[radius + 1]]
                if len(at):
                    first = self.edges[s][at]
                    size = self.edges[s][at + 1] - first
                    stop = np.cumsum(size)
                    found = self.lists[s][np.arange(stop[-1]) + np.repeat(first - stop + size, size)]
                    found = found[~met[found]]
                    met[found] = True
                    self.compared += len(found)
                    d = np.bitwise_count(self.codes[found] ^ query).astype(np.int64)
                    found, d = found[d <= bound], d[d <= bound]
                    rows += np.bincount(d, self.weights[found], self.bits + 1).astype(np.int64)
                    kept.append((found, d))
                covered = self.segments * radius + s
                if covered >= bound or rows[: covered + 1].sum() >= k:
                    break
            else:
                continue
            break
        reached = np.flatnonzero(np.cumsum(rows) >= k)
        last = min(bound, int(reached[0])) if len(reached) else bound
        place, d = (np.concatenate(z) for z in zip(*kept, strict=True))
        return place[d <= last], d[d <= last]


def _blocks(queries: DataFrame, n: int) -> DataFrame:
    """queries (q, bound) in n blocks: block, q and bound as arrays."""
    packed = queries.groupBy(F.pmod(F.xxhash64("q"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("q", "bound")).alias("all"))
    return packed.select("block", F.col("all.q").alias("code"), F.col("all.bound").cast("array<long>").alias("n"))


def _search(shards: DataFrame, blocks: DataFrame, k: int, bits: int, segments: int, parts: int) -> DataFrame:
    """q, code, n, distance.  shards: part and arrays code, n.  blocks: part, block and arrays code, n (bounds).  A shard's queries come to it one block after the other."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = own = None
        for batch in batches:
            for i in range(batch.num_rows):
                part, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                code, n = (batch.column(j).slice(i, 1).flatten().to_numpy() for j in (2, 3))
                if block < 0:
                    index, own = Index(code.view(np.uint64), n, bits, segments), part
                elif part == own:
                    found = [index.nearest(q, k, b) for q, b in zip(code.view(np.uint64), n.tolist(), strict=True)]
                    place, apart = (np.concatenate(z) for z in zip(*found, strict=True))
                    q = np.repeat(code, [len(x) for x, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(index.codes[place].view(np.int64)), pa.array(index.weights[place]), pa.array(apart)], ["q", "code", "n", "distance"])

    both = shards.select("part", F.lit(-1).cast("long").alias("block"), "code", "n").unionByName(blocks.select("part", "block", "code", "n"))
    both = both.repartition(parts, "part").sortWithinPartitions("part", "block")
    return both.mapInArrow(lean(look), "q long, code long, n long, distance long")


def search(rows: DataFrame, queries: DataFrame, k: int, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """query_id, rank (from 1), id, distance: each query's k nearest rows by Hamming distance, ties by id.

    rows and queries: id, code (long).  Rows with a null id or code are left out; rows equal in
    both are one, an id may have several codes, and a query id with several codes has a ranking
    for each.  A query that is itself a row finds itself.  Fewer than k rows give fewer results,
    no rows none.

    The codes are dealt into shards of at most about SHARD by their hash, each with an own index.
    Each query first asks one shard; the k-th distance there is a bound, and the others return
    only what can still be among the k nearest.  Queries come to the shards in blocks of about
    QUERIES; codes are never copied.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hamming")
    rows = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code")
    queries = scratch.save(queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct(), "queries")
    first = Window.partitionBy("code").orderBy("id")
    members = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k).select("code", "id").distinct()
    members = scratch.save(members, "members")
    codes = scratch.save(members.groupBy("code").agg(F.count("*").alias("n")), "codes", members.rows_)
    asked = scratch.save(queries.select("q").distinct(), "asked", queries.rows_)
    parts = max(-(-codes.rows_ // SHARD), min(32, -(-codes.rows_ // LEAST_SHARD)), 1)
    n_blocks = max(-(-asked.rows_ // QUERIES), 1)
    shards = codes.groupBy(F.pmod(F.xxhash64("code"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("code", "n")).alias("all"))
    shards = scratch.save(shards.select("part", F.col("all.code").alias("code"), F.col("all.n").alias("n")), "shards")

    free = _blocks(asked.withColumn("bound", F.lit(bits)), n_blocks * min(parts, 32)).withColumn("part", F.pmod("block", F.lit(parts)))
    near = _search(shards, free, k, bits, segments, parts)
    totals = near.groupBy("q", "distance").agg(F.sum("n").alias("n"))
    upto = totals.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy("distance")))
    bounds = upto.groupBy("q").agg(F.min(F.when(F.col("upto") >= k, F.col("distance"))).alias("bound"))
    bounded = asked.join(bounds, "q", "left").select("q", F.coalesce("bound", F.lit(bits)).alias("bound"))
    blocks = scratch.save(_blocks(bounded, n_blocks), "blocks")
    blocks = blocks.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    kept = scratch.save(_search(shards, blocks, k, bits, segments, parts), "met")
    # codes at the distance where k rows are reached all stay, as ids decide between them
    totals = kept.groupBy("q", "distance").agg(F.sum("n").alias("n"))
    nearer = F.sum("n").over(Window.partitionBy("q").orderBy("distance")) - F.col("n")
    wanted = totals.withColumn("nearer", nearer).where(F.col("nearer") < k).select("q", "distance")
    hits = kept.join(wanted, ["q", "distance"]).join(members, "code")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return queries.join(ranked, "q").select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.col("distance").cast("long").alias("distance"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 rows nearest to each row whose id is divisible by 100, itself among them, by the signs of 64 dimensions."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    rows = Scratch(spark, "codes").save(rows, "codes")
    return search(rows, rows.where("id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


ORACLE_HAMMING = r"""
WITH b AS (
  SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS s FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.s[i] <> r.s[i] THEN 1 ELSE 0 END))::BIGINT AS distance
  FROM b q, b r WHERE q.vec_id % 100 = 0
), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank::BIGINT AS rank, vec_id, distance FROM x WHERE rank <= 10
"""
