"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A data set is a folder: dictionary/ (one file) and ids/ (files in ascending id order).  A file
is a run of shards.  A shard is a header (magic, width of an id in bytes, hash of the
dictionary, number of the file in id order, number of documents, length of the frames), the index (document ids, a null mark
each, token counts, frame offsets) and one zstandard frame for each document, so that one short
document is read by decompressing its frame alone.  All writing and reading of files goes
through Spark, so any file system that Spark knows will do.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._store import Scratch
from ._text import lean
from ._tokens import encoder, vocabulary

MAGIC = b"MRTOKEN2"
HEADER = "<8sB16sQQQ"
DICTIONARY = 65536
SAMPLE = 1000
SHARD = 16_000_000
LEVEL = 3


def _write(df: DataFrame, path: str) -> None:
    """One binary column to files; each row is followed by a line feed, which readers skip."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.text(path)


def _frames(docs: DataFrame, path: str, end_id: int, width: int, dictionary: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        shared = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstd.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        for batch in batches:
            ids = tokens.ids(batch.column(1).to_pylist(), end_id)
            if any(int(x.max()) >> 8 * width for x in ids if len(x)):
                raise ValueError(f"an id doesn't fit into {width} bytes")
            frames = [press.compress(x.astype(f"<u{width}").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, frame binary")


def train(docs: DataFrame, path: str, end_id: int, width: int, sample: int = SAMPLE) -> bytes:
    """A dictionary from the id arrays of at most ``sample`` documents, those with the smallest hashes of their ids; b"" if they are too few.

    At most 16 pieces of 4 KiB, evenly spread over each, are learned from: this shapes
    compression only, never what is stored.
    """
    # only rows of small hashes are ordered, so tasks don't send ``sample`` rows each
    ids = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("h")).where("doc_id IS NOT NULL")
    share = 4 * sample / max(1, docs.count())
    while len(chosen := ids.where(F.col("h") < int(share * (1 << 32))).orderBy("h", "doc_id").limit(sample).collect()) < sample and share < 1:
        share *= 4
    chosen = [r["doc_id"] for r in chosen]
    frames = _frames(docs.where(F.col("doc_id").isin(chosen)), path, end_id, width, b"").orderBy("doc_id", "n", "frame").limit(sample).select("frame").toLocalIterator()
    parts = []
    for r in frames:
        raw = zstd.ZstdDecompressor().decompress(r[0])
        parts += [raw[i : i + 4096] for i in range(0, len(raw), max(4096, -(-len(raw) // 16)))]
    try:
        return zstd.train_dictionary(DICTIONARY, parts).as_bytes() if len(parts) >= 20 else b""
    except zstd.ZstdError:
        return b""


def write_ids(docs: DataFrame, target: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> None:
    """Encodes each whole text (null: empty), appends end_id and writes the ids in ascending id order, null ids first.

    Ids are stored in width bytes (by default 2 if the vocabulary and end_id fit, else 4); an id
    that doesn't fit is an error.  Rows with equal ids are
    ordered by length and content, so reruns give the same order.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "tokens")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = width or (2 if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
    dictionary = train(docs, path, end_id, width)
    frames = scratch.save(_frames(docs, path, end_id, width, dictionary), "frames")
    size = frames.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0))).first()[0]
    mark = hashlib.blake2b(dictionary, digest_size=16).digest()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list = []
        n: list[int] = []
        held: list[bytes] = []
        room, number = SHARD, TaskContext.get().partitionId()  # ranges of ids are numbered in their order

        def out() -> pa.RecordBatch:
            off = np.cumsum([0, *map(len, held)]).astype("<u8")
            head = struct.pack(HEADER, MAGIC, width, mark, number, len(doc), int(off[-1]))
            index = [np.array([x or 0 for x in doc], "<i8").tobytes(), np.array([x is None for x in doc], "u1").tobytes(), np.array(n, "<u8").tobytes(), off.tobytes()]
            blob = b"".join([head, *index, *held])
            for x in (doc, n, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and len(c) > room:
                    yield out()
                    room = SHARD
                doc.append(a)
                n.append(b)
                held.append(c)
                room -= len(c)
        if held:
            yield out()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("frame")]
    ordered = frames.repartitionByRange(max(1, -(-size // SHARD)), *keys).sortWithinPartitions(*keys)
    _write(ordered.mapInArrow(lean(shards), "blob binary"), f"{target}/ids")
    _write(spark.createDataFrame([(bytearray(dictionary),)], "blob binary").coalesce(1), f"{target}/dictionary")
    scratch.drop(frames)


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """part (number of the file), doc_id, start (ids of all documents before it in its file; see ``starts``), n_tokens, ids (little-endian unsigned 32 bit) of each document in the files."""
    ship(spark)
    found = spark.read.format("binaryFile").load(f"{source}/dictionary").select("content").collect()
    dictionary = max((bytes(r[0])[:-1] for r in found), key=len)
    mark = hashlib.blake2b(dictionary, digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstd.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            for file, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = memoryview(blob.as_buffer())
                at, before = 0, 0
                while at < len(blob):
                    magic, width, own, number, docs, length = struct.unpack_from(HEADER, blob, at)
                    if magic != MAGIC or own != mark:
                        raise ValueError(f"{file}: not a token file of this dictionary")
                    at += struct.calcsize(HEADER)
                    doc = np.frombuffer(blob, "<i8", docs, at)
                    null = np.frombuffer(blob, "u1", docs, at + 8 * docs).astype(bool)
                    n = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
                    off = np.frombuffer(blob, "<u8", docs + 1, at + 17 * docs).astype(np.int64)
                    at += 25 * docs + 8
                    starts = before + np.cumsum(n) - n
                    for lo in range(0, docs, 1000):
                        hi = min(docs, lo + 1000)
                        ids = [np.frombuffer(press.decompress(blob[at + off[i] : at + off[i + 1]]), f"<u{width}").astype("<u4").tobytes() for i in range(lo, hi)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(hi - lo, number, np.int64)), pa.array(doc[lo:hi], pa.int64(), mask=null[lo:hi]), pa.array(starts[lo:hi]), pa.array(n[lo:hi]), pa.array(ids, pa.binary())],
                            ["part", "doc_id", "start", "n_tokens", "ids"],
                        )
                    before += int(n.sum())
                    at += length + 1

    files = spark.read.format("binaryFile").load(f"{source}/ids").select("path", "content")
    docs = files.mapInArrow(lean(run), "part long, doc_id long, start long, n_tokens long, ids binary")
    return docs


def starts(docs: DataFrame) -> DataFrame:
    """Turns starts within files into starts within the data set, by the files' own numbers.  One row per file is gathered."""
    files = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return docs.join(files, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), *[c for c in docs.columns if c not in ("doc_id", "start", "part")])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents, reads them back and gives what was read; odd input as in ``write_ids``."""
    target = Scratch(spark, "token-files").path("set")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, vocabulary("word_bpe_49k.json"), 1)
    digest = read_ids(spark, target).select("part", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return starts(Scratch(spark, "token-files").save(digest, "digest"))
