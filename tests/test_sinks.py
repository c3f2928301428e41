"""Sinks: read back what was written."""

import json
import zlib

import numpy as np
import pytest

from millrace.sinks import writers


def frame(spark):
    rows = [(f"r{i}", bytes(range(i, i + 12)), [2, 2, 3], "train" if i % 2 else None if i == 4 else "val") for i in range(6)]
    return spark.createDataFrame(rows, "record_id string, data binary, shape array<int>, _split string")


def test_png_per_record(spark, tmp_path):
    got = writers.png_per_record(frame(spark), str(tmp_path), "{split}/{record_id|upper}.png")
    files = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.png"))
    assert files == ["train/R1.png", "train/R3.png", "train/R5.png", "val/R0.png", "val/R2.png"] and got["files"] == 5
    body = (tmp_path / "train/R3.png").read_bytes()
    at = body.index(b"IDAT")
    raw = zlib.decompress(body[at + 4 : at + 4 + int.from_bytes(body[at - 4 : at])])
    assert np.frombuffer(raw, np.uint8).reshape(2, 7)[:, 1:].tobytes() == bytes(range(3, 15))
    assert got["bytes"] == sum(p.stat().st_size for p in tmp_path.rglob("*.png"))


def test_npy_per_record_and_collisions(spark, tmp_path):
    assert writers.npy_per_record(frame(spark), str(tmp_path), "{record_id}.npy", splits=["val"], dtype="u1")["files"] == 2
    assert np.load(tmp_path / "r2.npy").tolist() == np.arange(2, 14, dtype=np.float32).reshape(2, 2, 3).tolist()
    assert writers.npy_per_record(frame(spark).limit(0), str(tmp_path), "{record_id}.npy")["files"] == 0
    with pytest.raises(ValueError, match="repeat"):
        writers.png_per_record(frame(spark), str(tmp_path), "{split}.png")


def test_write_dataset(spark, tmp_path):
    writers.write_dataset(frame(spark), str(tmp_path / "d"))
    rows = [json.loads(x) for p in (tmp_path / "d").rglob("*.json") for x in p.read_text().splitlines()]
    assert sorted(r["record_id"] for r in rows) == ["r0", "r1", "r2", "r3", "r5"] and all(set(r) == {"record_id"} for r in rows)
