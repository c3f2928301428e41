"""Operators that make rows: resampling, windows, variants, joins and unions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import rank, variant_rank


def duplicate_minority_class(df: DataFrame, record_id: str, field: str, seed: int) -> DataFrame:
    """The rows that each class needs to reach the largest: picks with replacement by a hash of the pick's number.

    New rows keep their record ids; copy tells the picks of one class apart.
    """
    sizes = df.groupBy(field).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    need = sizes.join(F.broadcast(most)).where("_n < _most").select(field, "_n", F.explode(F.expr("sequence(1L, _most - _n)")).alias("copy"))
    pick = F.conv(F.substring(rank(seed, F.concat_ws(":", F.col(field).cast("string"), F.col("copy").cast("string"))), 1, 12), 16, 10).cast("long")
    need = need.withColumn("_pick", F.pmod(pick, F.col("_n"))).drop("_n")
    here = Window.partitionBy(field).orderBy(rank(seed, record_id), record_id)
    minority = df.join(F.broadcast(sizes.join(F.broadcast(most)).where("_n < _most").select(F.col(field).alias("_f"))), F.col(field).eqNullSafe(F.col("_f")), "left_semi")
    rows = minority.withColumn("_pick", (F.row_number().over(here) - 1).cast("long"))
    return need.withColumnRenamed(field, "_f").join(rows.withColumnRenamed("_pick", "_p"), (F.col("_f").eqNullSafe(F.col(field))) & (F.col("_pick") == F.col("_p"))).select(*df.columns, "copy")


def windows(df: DataFrame, record_id: str, field: str, length: int, hop: int, pad: bool) -> DataFrame:
    """Hopping windows over an array: source_record_id, window_index (over all starts), record_id, the window.

    A trailing part is dropped, or padded with zeros.  Empty arrays give none.
    """
    start = F.explode(F.when(F.size(field) > 0, F.sequence(F.lit(0), F.size(field) - 1, F.lit(hop))).otherwise(F.array().cast("array<int>")))
    out = df.select(F.col(record_id).alias("source_record_id"), F.col(field).alias("_a"), start.alias("_s"))
    part = F.slice("_a", F.col("_s") + 1, F.lit(length))
    if pad:
        part = F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.size(part)))
    else:
        out = out.where(F.col("_s") + length <= F.size("_a"))
    index = (F.col("_s") / hop).cast("int")
    return out.select("source_record_id", index.alias("window_index"), F.format_string("%s__w%04d", F.col("source_record_id").cast("string"), index).alias("record_id"), part.alias(field))


def variants(df: DataFrame, record_id: str, op: str, expansion: int, seed: int) -> DataFrame:
    """Each row expansion times: source_record_id, variant_index, record_id, and the variant's own seed."""
    out = df.withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(expansion - 1)))).withColumn("source_record_id", F.col(record_id).cast("string"))
    out = out.withColumn(f"{op}_seed", variant_rank(seed, op, "source_record_id", F.col("variant_index")))
    return out.withColumn("record_id", F.format_string("%s__v%03d", "source_record_id", "variant_index"))


def corruption_grid(df: DataFrame, record_id: str, names: list[str], severities: list[int]) -> DataFrame:
    """Each row for each corruption and severity: corruption, severity, source_record_id, record_id."""
    grid = F.array(*[F.struct(F.lit(n).alias("corruption"), F.lit(s).alias("severity")) for n in names for s in severities])
    out = df.withColumn("_g", F.explode(grid)).withColumn("source_record_id", F.col(record_id).cast("string"))
    out = out.withColumns({"corruption": F.col("_g.corruption"), "severity": F.col("_g.severity")}).drop("_g")
    stem = F.format_string("%s_%s_s%d", "source_record_id", "corruption", "severity")
    return out.withColumn("record_id", F.concat(stem, F.lit("_"), F.substring(F.sha2(stem, 256), 1, 8)))


def join_labels(df: DataFrame, manifest: DataFrame, key: str, label: str) -> DataFrame:
    """Every row with its label from a manifest; ids that repeat there, and rows without an entry, are errors."""
    if not manifest.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats in the manifest")
    out = df.join(manifest.select(key, F.col(label).alias("label"), F.lit(True).alias("_found")), key, "left")
    return out.withColumn("label", F.when(F.col("_found"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no label for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(manifest.dtypes)[label]))).drop("_found")


def join_by_order(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Row i of one with row i of the other, in their orders; unequal counts are an error.  For small manifests: each side is numbered in one task."""
    if left.count() != right.count():
        raise ValueError("the numbers of rows differ")
    a = left.withColumn("_i", F.row_number().over(Window.orderBy(left_order)))
    return a.join(right.withColumn("_i", F.row_number().over(Window.orderBy(right_order))), "_i").drop("_i")


def union_sources(sources: dict[str, DataFrame], record_id: str) -> DataFrame:
    """All rows of all sources with their source's name; missing columns are null."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source_name", F.lit(name)).withColumn("record_id", F.concat_ws("/", F.lit(name), F.col(record_id).cast("string")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def repeated_ids(df: DataFrame, record_id: str = "record_id") -> DataFrame:
    return df.groupBy(record_id).agg(F.count("*").alias("n")).where("n > 1")


def path_template(template: str, split: Column | None = None) -> Column:
    """{field}, {field|stem|lower|upper|str} and {split} filled in, as one expression."""


    if template.startswith("/") or ".." in template.split("/"):
        raise ValueError("the template leaves its folder")
    parts = []
    for field, filters, text in re.findall(r"\{(\w+)((?:\|\w+)*)\}|([^{}]+)", template):
        if text:
            parts.append(F.lit(text))
            continue
        c = split if field == "split" and split is not None else F.col(field).cast("string")
        for f in filters.split("|")[1:]:
            if f == "stem":
                name = F.regexp_extract(c, r"([^/]*)$", 1)
                c = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
            elif f in ("lower", "upper"):
                c = getattr(F, f)(c)
            elif f != "str":
                raise ValueError(f"unknown filter {f}")
        parts.append(c)
    return F.concat(*parts)
