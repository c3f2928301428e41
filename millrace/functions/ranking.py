"""Deterministic randomness: ranks and seeds are hashes of a seed and a record id, never of a place in a partition."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 3  # leading hex digits: 4096 bins


def _hex(n: int, digits: int) -> str:
    if n < 0:
        raise ValueError("seeds must not be negative")
    return f"{n:0{digits}x}"


def rank(seed: int, record_id: Column | str) -> Column:
    """16 hex digits of sha256(seed as 8 bytes, id as text); their order is that of the unsigned 64-bit seed."""
    record_id = F.col(record_id) if isinstance(record_id, str) else record_id
    text = F.encode(F.coalesce(record_id.cast("string"), F.lit("None")), "UTF-8")
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(_hex(seed, 16))), text), 256), 1, 16)


def variant_rank(seed: int, op: str, record_id: Column | str, variant: Column) -> Column:
    """16 hex digits of sha256(seed, operation, id, variant number as 4 bytes)."""
    record_id = F.col(record_id) if isinstance(record_id, str) else record_id
    number = F.unhex(F.lpad(F.hex(variant.cast("long")), 8, "0"))
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(_hex(seed, 16))), F.encode(F.lit(op), "UTF-8"), F.encode(record_id.cast("string"), "UTF-8"), number), 256), 1, 16)


def as_number(hex16: Column) -> Column:
    """The unsigned 64-bit number as decimal(20,0)."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def derive_seed(master: int, name: str) -> int:
    return int.from_bytes(hashlib.sha256((master % 2**64).to_bytes(8, "big") + name.encode()).digest()[:8], "big")


def resolve_seed(own: int | dict | None, recipe: int, name: str) -> int:
    """An operation's seed: its own number, one derived from the recipe's ({"from": "master"}), or the recipe's."""
    if own is None:
        return recipe
    if isinstance(own, dict):
        return derive_seed(recipe, name)
    return own


def positions(df: DataFrame, order: Column, ties: list[str], by: list[Column] | None = None, name: str = "_at", total: str = "_of") -> DataFrame:
    """Adds each row's place from 0 in hash order within its group, and the group's size.

    order is a hex rank.  Rows are counted by group and leading digits, and only rows of equal
    leading digits are sorted together, so neither the whole table nor one large group has to
    fit in one task.
    """
    keys = by or []
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumns({**dict(zip(names, keys, strict=True)), "_rank": order}).withColumn("_bin", F.substring("_rank", 1, BINS))
    counts = df.groupBy(*names, "_bin").agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*[F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in names] or [F.lit(0)])
    counts = counts.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("_bin").alias("_bin_"), (F.sum("_n").over(part.orderBy("_bin")) - F.col("_n")).alias("_before"), F.sum("_n").over(part).alias(total))
    here = Window.partitionBy(*names, "_bin").orderBy("_rank", *ties)
    df = df.withColumn("_row", F.row_number().over(here))
    same = F.col("_bin") == F.col("_bin_")
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}_"))
    df = df.join(counts if names else F.broadcast(counts), same)
    return df.withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop(*names, *[f"{n}_" for n in names], "_rank", "_bin", "_bin_", "_before", "_row")
