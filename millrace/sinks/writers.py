"""Sinks: one folder per split, or one file per record.  Executors write; the driver gets counts only."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.generation import path_template
from ..operators.splits import SPLIT
from ..session import ship


def write_dataset(df: DataFrame, path: str, form: str = "json") -> None:
    """dataset by split, columns in alphabetical order; rows in no split are left out.  json leaves arrays and bytes out."""
    left_out = {c for c, t in df.dtypes if form == "json" and (t.startswith("array") or t == "binary")}
    names = sorted(c for c in df.columns if c not in left_out | {SPLIT})
    df.where(F.col(SPLIT).isNotNull()).select(*names, SPLIT).write.partitionBy(SPLIT).format(form).save(path)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of height x width (gray) or height x width x 1, 3 or 4."""
    if pixels.dtype != np.uint8 or pixels.ndim not in (2, 3) or (pixels.ndim == 3 and pixels.shape[2] not in (1, 3, 4)):
        raise ValueError(f"no image: {pixels.dtype} {pixels.shape}")
    high, wide = pixels.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[pixels.shape[2] if pixels.ndim == 3 else 1]
    rows = np.concatenate([np.zeros((high, 1), np.uint8), pixels.reshape(high, -1)], axis=1)  # filter 0 before each row

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", wide, high, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def npy(values: np.ndarray) -> bytes:
    """A float32 .npy file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(values, np.float32))
    return out.getvalue()


def _per_record(df: DataFrame, root: str, template: str, data: str, shape: str, splits: list[str] | None, make: Callable[[bytes, list[int]], bytes]) -> dict:
    rows = df.where(F.col(SPLIT).isNotNull() if splits is None else F.col(SPLIT).isin(splits))
    rows = rows.select(path_template(template, F.col(SPLIT)).alias("path"), F.col(data).alias("data"), F.col(shape).alias("shape"))
    bad = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1 OR path IS NULL").orderBy("path").limit(3).collect()
    if bad:
        raise ValueError(f"paths that repeat or are null: {[r['path'] for r in bad]}")
    ship(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        files = size = 0
        for batch in batches:
            for path, raw, dims in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw is None or dims is None:
                    raise ValueError(f"{path}: no data")
                body, target = make(raw, dims), f"{base}/{path}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(target) as f:  # a task that runs again writes the same bytes
                    f.write(body)
                files, size = files + 1, size + len(body)
        yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([size])], ["files", "bytes"])

    got = rows.mapInArrow(write, "files long, bytes long").agg(F.sum("files"), F.sum("bytes")).first()
    return {"root": root, "files": got[0] or 0, "bytes": got[1] or 0}


def png_per_record(df: DataFrame, root: str, template: str, data: str = "data", shape: str = "shape", splits: list[str] | None = None) -> dict:
    """One PNG per row of these splits (all by default) at the template's path under root (a URI or absolute path): root, files, bytes.

    data: uint8 bytes, row by row; shape: array.  Paths that repeat or are null, and null data, are errors.
    """
    return _per_record(df, root, template, data, shape, splits, lambda raw, dims: png(np.frombuffer(raw, np.uint8).reshape(dims)))


def npy_per_record(df: DataFrame, root: str, template: str, data: str = "data", shape: str = "shape", splits: list[str] | None = None, dtype: str = "<f4") -> dict:
    """As png_per_record, one float32 .npy per row; dtype is that of the bytes."""
    return _per_record(df, root, template, data, shape, splits, lambda raw, dims: npy(np.frombuffer(raw, dtype).reshape(dims)))
