"""Fit-and-apply operators over columns and arrays, and text features.

fit_* return plain values (small, from one aggregation); the appliers turn them into expressions.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import SPLIT

PUNCTUATION = r"[!-/:-@\[-`{-~]"
SPACE = r"[ \t\n\r\f]+"


def training(df: DataFrame, split: str | None = "train") -> DataFrame:
    return df if split is None else df.where(F.col(SPLIT) == split)


def fit_standardize(df: DataFrame, fields: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each field, in one pass."""
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in fields for f in (F.avg, F.stddev_pop)]).first()
    return {c: (row[f"avg_{c}"], row[f"stddev_pop_{c}"]) for c in fields}


def standardize(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores; a deviation of 0 divides by 1."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in fitted.items()})


def fit_min_max(df: DataFrame, fields: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in fields for f in (F.min, F.max)]).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in fields}


def min_max_scale(df: DataFrame, fitted: dict[str, tuple[float, float]], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high]; a constant column gives low."""
    return df.withColumns({c: F.lit(low) if b == a else F.lit(low) + (F.col(c) - F.lit(a)) / F.lit(float(b - a)) * F.lit(high - low) for c, (a, b) in fitted.items()})


def fit_vocabulary(df: DataFrame, field: str, order: str = "alphabetical", position: str | None = None) -> list:
    """Distinct values, null left out, alphabetically or by first position."""
    groups = df.where(F.col(field).isNotNull()).groupBy(field)
    if order == "alphabetical":
        return [r[0] for r in groups.agg(F.lit(1)).orderBy(field).collect()]
    return [r[0] for r in groups.agg(F.min(position).alias("p")).orderBy("p", field).collect()]


def encode(field: str, vocabulary: list, dtype: str = "int") -> Column:
    """The value's place in the vocabulary; a value outside it is an error when rows are read."""
    place = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col(field)) - 1
    return F.when(place >= 0, place.cast(dtype)).otherwise(F.raise_error(F.concat(F.lit(f"{field}: not in the vocabulary: "), F.coalesce(F.col(field).cast("string"), F.lit("null")))).cast(dtype))


def one_hot(field: str, vocabulary: list) -> dict[str, Column]:
    return {f"{field}_{v}": F.coalesce((F.col(field) == F.lit(v)).cast("int"), F.lit(0)) for v in vocabulary}


def polynomial(inputs: list[str], degree: int) -> dict[str, Column]:
    """Monomials up to the degree, in the order of combinations with replacement."""
    out = {}
    for d in range(1, degree + 1):
        for names in combinations_with_replacement(inputs, d):
            value = F.col(names[0])
            for n in names[1:]:
                value = value * F.col(n)
            out["_x_".join(names)] = value
    return out


def fit_positions(df: DataFrame, field: str) -> list[tuple[float, float]]:
    """Mean and population deviation at each place of an array column."""
    rows = df.select(F.posexplode(field).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
    return [(r["m"], r["s"]) for r in rows]


def normalize_positions(field: str, fitted: list[tuple[float, float]], scale: bool = True) -> Column:
    """(x - mean) / deviation at each place; without scale, x - mean."""
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s) or 1.0).alias("s")) for m, s in fitted])
    one = (lambda x, p: (x.cast("double") - p["m"]) / p["s"]) if scale else (lambda x, p: x.cast("double") - p["m"])
    return F.zip_with(F.col(field), pairs, one)


def cast_scaled(field: str, scale: float) -> Column:
    return F.transform(field, lambda x: x.cast("double") * F.lit(scale))


def tokens(field: str) -> Column:
    """Whitespace tokens, none empty."""
    return F.filter(F.split(field, SPACE), lambda x: x != "")


def strip_punctuation(field: str) -> Column:
    return F.regexp_replace(field, PUNCTUATION, "")


def remove_stopwords(words: Column, stopwords: list[str]) -> Column:
    return F.filter(words, lambda x: ~x.isin(stopwords))


def tfidf(df: DataFrame, record_id: str, words: Column, max_features: int | None = None) -> DataFrame:
    """record id, term, tf, df, tfidf with idf = ln((1 + N) / (1 + df)) + 1; the most frequent terms by df, then term."""
    rows = df.select(record_id, words.alias("w"))
    n = rows.count()
    tf = rows.select(record_id, F.explode("w").alias("term")).groupBy(record_id, "term").agg(F.count("*").alias("tf"))
    terms = tf.groupBy("term").agg(F.count("*").alias("df"))
    if max_features is not None:
        terms = terms.orderBy(F.desc("df"), "term").limit(max_features)
    return tf.join(terms, "term").withColumn("tfidf", F.col("tf") * (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0))


def path_part(field: str, part: str) -> Column:
    """parent (directory name), name or stem of a path; a leading dot belongs to the stem, only the last suffix goes."""
    parts = F.split(field, "/")
    name = F.get(parts, F.size(parts) - 1)
    if part == "parent":
        return F.get(parts, F.size(parts) - 2)
    return name if part == "name" else F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def cast_dtype(field: str, dtype: str) -> Column:
    """To a Spark type by its name or that of an array type (float32, int64); what can't be cast is null."""
    kind = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "str": "string", "bool": "boolean"}.get(dtype, dtype)
    return F.col(field).try_cast(kind)


def fit_tfidf(df: DataFrame, words: Column, max_features: int) -> dict[str, list]:
    """The max_features terms found in most rows, ties by term, and their idf = ln((1 + N) / (1 + df)) + 1."""
    rows = df.select(F.array_distinct(words).alias("w"))
    n = rows.count()
    top = rows.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(max_features).collect()
    from math import log

    return {"terms": [r["term"] for r in top], "idf": [log((1 + n) / (1 + r["df"])) + 1 for r in top]}


def tfidf_vector(words: Column, terms: list[str], idf: list[float]) -> Column:
    """term -> count * idf of the fitted terms that occur."""
    table = F.create_map(*[F.lit(x) for pair in zip(terms, map(float, idf), strict=True) for x in pair])
    kept = F.filter(F.array_distinct(words), lambda t: table[t].isNotNull())
    return F.map_from_arrays(kept, F.transform(kept, lambda t: F.size(F.filter(words, lambda w: w == t)) * table[t]))
