"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document longer than a window fills windows of its own, and what is left of it is cut into
pieces; a shorter one stays whole.  These items are gathered into blocks; in a block, partial
partitions into k windows are merged, the two with the largest spread first and the fullest
window of one with the emptiest of the other.  k is the least number that could hold the block,
and rises until no window exceeds the capacity.  Blocks lie within one input partition, so
nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._text import lean
from ._tokens import encoder, vocabulary

CAPACITY = 1024
_sum = itemgetter(0)
BLOCK = 64  # windows
PIECE = 128
OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k near-equal windows.

    A partial partition is a descending list of (sum, items) of its windows, empty ones left out.
    """
    heap = [(-size, i, [(size, (i, None))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        p, q = len(a), len(b)
        if p + q <= k:
            both = a + b
        else:  # window j of a meets window k - 1 - j of b
            both = a[: k - q] + [(a[j][0] + b[k - 1 - j][0], (a[j][1], b[k - 1 - j][1])) for j in range(k - q, p)] + b[: k - p]
        both.sort(key=_sum, reverse=True)
        least = both[-1][0] if len(both) == k else 0
        heapq.heappush(heap, (least - both[0][0], order, both))
        order += 1
    found = [_items(tree) for _, tree in heap[0][2]] if heap else []
    return found + [[] for _ in range(k - len(found))]


def _items(tree: tuple | None) -> list[int]:
    out, left = [], [tree] if tree else []
    while left:
        x, y = left.pop()
        if y is None:
            out.append(x)
        else:
            left += [x, y]
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of near-equal windows, none over capacity; an item over the capacity is an error."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    found = difference(sizes, k)
    while max(sum(sizes[i] for i in g) for g in found) > capacity:
        k += 1
        found = difference(sizes, k)
    return [g for g in found if g]


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: empty) and end_id; each id lies in one piece, and
    pieces lie in their sequence without a gap.  Only documents longer than capacity are cut:
    into whole windows, and the rest into pieces of at most ``piece`` ids.  Ids may be null or
    repeat; each row is packed by itself.  sequence_id is unique; sequences follow the input
    partitions.  No rows, no pieces.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sequence = encoder(path), TaskContext.get().partitionId() << 38
        rows: list[tuple] = []
        block: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal sequence, held
            for window in windows([len(x[2]) for x in block], capacity):
                at = 0
                for i in window:
                    doc, first, ids, total = block[i]
                    rows.append((doc, first, len(ids), ids.tobytes(), total, sequence, at))
                    at += len(ids)
                sequence += 1
            block.clear()
            held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1).to_pylist(), end_id), strict=True):
                total, full = len(ids), len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, ids[start : start + capacity].tobytes(), total, sequence, 0))
                    sequence += 1
                step = piece if full else capacity
                for start in range(full, total, step):
                    part = ids[start : start + step]
                    if held + len(part) > BLOCK * capacity:
                        flush()
                    block.append((doc, start, part, total))
                    held += len(part)
                if len(rows) >= 2000:
                    yield out()
        if block:
            flush()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), OUT)


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024; odd input as in ``pack``."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
