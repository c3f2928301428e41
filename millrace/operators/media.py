"""Image and audio operators over tensor columns struct<dtype, shape, data>; pixels and samples go through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import as_number, rank, variant_rank
from ..media import audio, corruptions, pixels
from ..media.augment import AUGMENTATIONS
from ..session import ship

TENSOR = "struct<dtype:string,shape:array<int>,data:binary>"
_NUMBERS = {"int8": "b", "int16": "h", "int32": "i", "int64": "q", "uint8": "B", "uint16": "H", "uint32": "I", "uint64": "Q", "float16": "e", "float32": "f", "float64": "d"}


def unpack(t: dict | pd.Series) -> np.ndarray:
    return np.frombuffer(t["data"], np.dtype(t["dtype"]).newbyteorder("<")).reshape([int(n) for n in t["shape"]])


def pack(x: np.ndarray) -> dict:
    return {"dtype": x.dtype.name, "shape": [int(n) for n in x.shape], "data": np.ascontiguousarray(x, x.dtype.newbyteorder("<")).tobytes()}


def _rows(frame: pd.DataFrame) -> list[dict | None]:
    return [None if d is None else {"dtype": t, "shape": s, "data": d} for t, s, d in zip(frame["dtype"], frame["shape"], frame["data"], strict=True)]


def _frame(found: list[np.ndarray | None]) -> pd.DataFrame:
    none = {"dtype": None, "shape": None, "data": None}
    return pd.DataFrame([none if x is None else pack(x) for x in found], columns=["dtype", "shape", "data"])


def mapped(field: str | Column, change: Callable[[np.ndarray], np.ndarray]) -> Column:
    """A tensor column changed value by value; null stays null."""

    @F.pandas_udf(TENSOR)
    def run(t: pd.DataFrame) -> pd.DataFrame:
        return _frame([None if x is None else change(unpack(x)) for x in _rows(t)])

    return run(field)


def seeded(field: str, seed: Column, change: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> Column:
    """As mapped, with a generator seeded by 16 hex digits; null stays null."""

    @F.pandas_udf(TENSOR)
    def run(t: pd.DataFrame, s: pd.Series) -> pd.DataFrame:
        return _frame([None if x is None else change(unpack(x), np.random.default_rng(int(h, 16))) for x, h in zip(_rows(t), s, strict=True)])

    return run(F.col(field), seed)


def decode_spark_image(field: str = "image") -> Column:
    """The image source's struct (decoded in the JVM, blue first) as a tensor: height x width, or height x width x 3 red first; alpha goes."""

    @F.pandas_udf(TENSOR)
    def run(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        for high, wide, n, data in zip(t["height"], t["width"], t["nChannels"], t["data"], strict=True):
            if data is None or high is None or high < 1:
                raise ValueError("a file is no image")
            x = np.frombuffer(data, np.uint8).reshape(int(high), int(wide), int(n))
            out.append(x[:, :, 0] if n == 1 else np.ascontiguousarray(x[:, :, 2::-1]))
        return _frame(out)

    return run(field)


def resize(field: str, size: int, kernel: str = "bilinear") -> Column:
    """size x size; nearest, bilinear, bicubic or lanczos, antialiased."""
    return mapped(field, lambda x: pixels.resize(x, size, size, kernel))


def cast(field: str, dtype: str, scale: float | None = None) -> Column:
    """Whole numbers wrap around, as arrays do; then times scale in the new type."""
    if dtype not in _NUMBERS:
        raise ValueError(f"unknown dtype {dtype}")

    def change(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            y = x.astype(dtype)
            return y if scale is None else (y * np.asarray(scale).astype(dtype)).astype(dtype)

    return mapped(field, change)


def flatten(field: str) -> Column:
    """All values in one row, row by row: array<double>."""

    @F.pandas_udf("array<double>")
    def run(t: pd.DataFrame) -> pd.Series:
        return pd.Series([None if x is None else unpack(x).reshape(-1).astype(float) for x in _rows(t)])

    return run(field)


def shape(field: str) -> Column:
    return F.col(field)["shape"]


def fit_axis(df: DataFrame, field: str, axis: int) -> dict[str, list[float]]:
    """Mean and population deviation at each place of an axis (-1: channels) over all tensors, which must have one shape.

    Workers add up counts, sums and squares about a shift taken from the first tensor, so
    nothing but these partial sums is sent.
    """
    shapes = df.where(F.col(field).isNotNull()).select(F.col(field)["shape"].alias("s")).distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError(f"{field}: {'several shapes' if shapes else 'no rows'}")
    ndim = len(shapes[0]["s"])
    axis = axis % ndim if ndim > 2 or axis >= 0 else None  # a gray image has one channel
    ship(df.sparkSession)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for t in batch[field]:
                x = unpack(t).astype(float)
                x = x.reshape(1, -1) if axis is None else np.moveaxis(x, axis, 0).reshape(x.shape[axis], -1)
                mean = x.mean(1)
                yield pd.DataFrame({"pos": np.arange(len(x)), "n": x.shape[1], "m": mean, "q": ((x - mean[:, None]) ** 2).sum(1)})

    parts = df.where(F.col(field).isNotNull()).select(field).mapInPandas(run, "pos int, n long, m double, q double")
    total = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("m") * F.col("n")).alias("s"), F.sum("q").alias("q"), F.var_pop("m").alias("v"), F.count("*").alias("k"))
    # every tensor has as many values at a place, so the variance is that within plus that of the means
    rows = total.select("pos", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.col("q") / F.col("n") + F.col("v")).alias("std")).orderBy("pos").collect()
    return {"mean": [r["mean"] for r in rows], "std": [r["std"] for r in rows]}


def normalize(field: str, mean: list[float], std: list[float] | None, axis: int = -1) -> Column:
    """(x - mean) / std along an axis, float64; a deviation of 0 divides by 1; without std the mean only goes."""

    def change(x: np.ndarray) -> np.ndarray:
        dims = [1] * x.ndim
        if len(mean) > 1:
            dims[axis] = len(mean)
        m, s = np.reshape(mean, dims if len(mean) > 1 else 1), np.reshape([v or 1.0 for v in std or [1.0] * len(mean)], dims if len(mean) > 1 else 1)
        return (x.astype(float) - m) / s

    return mapped(field, change)


def corrupt(df: DataFrame, names: list[str], severities: list[int], seed: int, op: str, image: str = "image", preserve_original: bool = False, tags: dict[str, str] | None = None) -> DataFrame:
    """Each row for each corruption and severity, with corruption, severity, source_path, <op>_seed and a record_id of its own.

    One generator a record, used in the order of names and severities, so the pixels don't
    depend on partitions.  tags renames the added columns.  With preserve_original the rows
    themselves come too, corruption null and severity 0.
    """
    for n in names:
        if n not in corruptions.CORRUPTIONS:
            raise ValueError(f"no corruption {n}")
    ship(df.sparkSession)
    kind = f"array<struct<corruption:string,severity:int,image:{TENSOR}>>"

    @F.pandas_udf(kind)
    def run(t: pd.DataFrame, s: pd.Series) -> pd.Series:
        out = []
        for x, h in zip(_rows(t), s, strict=True):
            rng = np.random.default_rng(int(h, 16))
            out.append([] if x is None else [{"corruption": n, "severity": v, "image": pack(corruptions.corrupt(unpack(x), n, v, rng))} for n in names for v in severities])
        return pd.Series(out)

    hexed = rank(seed, "record_id")
    rows = df.withColumn("_c", F.explode(run(F.col(image), hexed))).withColumn(f"{op}_seed", as_number(hexed))
    stem = F.format_string("%s_%s_s%d", F.col("record_id"), F.col("_c.corruption"), F.col("_c.severity"))
    path = F.col("path") if "path" in df.columns else F.col("record_id")
    added = {"corruption": F.col("_c.corruption"), "severity": F.col("_c.severity"), "source_path": path}
    rows = rows.withColumns({**added, image: F.col("_c.image"), "record_id": F.concat(stem, F.lit("_"), F.substring(F.sha2(stem, 256), 1, 8))}).drop("_c")
    if preserve_original:
        own = df.withColumns({"corruption": F.lit(None).cast("string"), "severity": F.lit(0), "source_path": path, f"{op}_seed": as_number(hexed)})
        rows = rows.unionByName(own)
    return rows.withColumnsRenamed(tags or {})


def augment(df: DataFrame, kind: str, params: dict, seed: int, op: str, expansion: int = 1, image: str = "image") -> DataFrame:
    """Each row expansion times, its pixels changed: source_record_id, root_record_id, variant_index, <op>_seed, record_id <id>__v000."""
    change = AUGMENTATIONS[kind]
    ship(df.sparkSession)
    root = F.col("root_record_id") if "root_record_id" in df.columns else F.col("record_id")
    out = df.withColumn("root_record_id", root).withColumn("source_record_id", F.col("record_id")).withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(expansion - 1))))
    out = out.withColumn("_seed", variant_rank(seed, op, "source_record_id", F.col("variant_index")))
    out = out.withColumn(image, seeded(image, F.col("_seed"), lambda x, rng: change(x, rng, **params)))
    return out.withColumn(f"{op}_seed", as_number(F.col("_seed"))).withColumn("record_id", F.format_string("%s__v%03d", "source_record_id", "variant_index")).drop("_seed")


def decode_wav(df: DataFrame, content: str, rate: int) -> DataFrame:
    """sample_array (mono, float32) at this rate, and sample_rate; the content goes."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(body: pd.Series) -> pd.Series:
        return pd.Series([audio.resample(*audio.decode_wav(bytes(b)), rate) for b in body])

    return df.withColumn("sample_array", run(content)).withColumn("sample_rate", F.lit(rate)).drop(content)


def log_mel(samples: str, rate: str, n_fft: int, hop_length: int, n_mels: int, f_min: float, power: float, f_max: float | None = None) -> Column:
    """float32 tensor n_mels x frames in dB."""

    @F.pandas_udf(TENSOR)
    def run(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        return _frame([None if a is None else audio.log_mel(np.asarray(a), int(b), n_fft, hop_length, n_mels, f_min, f_max, power) for a, b in zip(x, r, strict=True)])

    return run(samples, rate)


def mean_images(df: DataFrame, field: str, label: str, size: int = 32) -> DataFrame:
    """class, pos, mean: the mean thumbnail of each class, pixel by pixel; gray counts as three equal channels."""

    @F.pandas_udf("array<double>")
    def thumbnails(t: pd.DataFrame) -> pd.Series:
        small = [None if x is None else pixels.resize(unpack(x), size, size) for x in _rows(t)]
        return pd.Series([None if x is None else np.broadcast_to(x.reshape(size, size, -1), (size, size, 3)).reshape(-1).astype(float) for x in small])

    return df.select(F.col(label).alias("class"), F.posexplode(thumbnails(field)).alias("pos", "x")).groupBy("class", "pos").agg(F.avg("x").alias("mean"))


def pixel_histogram(df: DataFrame, field: str, by: list[str], bins: int = 32) -> DataFrame:
    """by..., channel, bin, n over 0..255; the last bin is closed, other values are left out.  Counted in the workers."""
    keys = df.select(*by).schema
    ship(df.sparkSession)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for i, t in enumerate(_rows(pd.DataFrame(list(batch["_t"])) if len(batch) else pd.DataFrame(columns=["dtype", "shape", "data"]))):
                if t is None:
                    continue
                x = unpack(t)
                x = x.reshape(*x.shape[:2], -1)
                for c in range(x.shape[2]):
                    n, _ = np.histogram(x[:, :, c], bins, (0, 255))
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({**{k: [batch[k].iloc[i]] * len(at) for k in by}, "channel": c, "bin": at.astype(np.int32), "n": n[at]})

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "channel int, bin int, n long"])
    return df.select(*by, F.col(field).alias("_t")).mapInPandas(run, kinds).groupBy(*by, "channel", "bin").agg(F.sum("n").alias("n"))
