"""Assertions about a frame.  All flat kinds run in one aggregation, group kinds share one per set of keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import SPLIT

_TAGS = {
    "str": {"string"}, "int": {"tinyint", "smallint", "int", "bigint"}, "float": {"float", "double", "tinyint", "smallint", "int", "bigint"}, "bool": {"boolean"}, "bytes": {"binary"},
    "int8": {"tinyint"}, "int16": {"smallint"}, "int32": {"int"}, "int64": {"bigint"}, "float32": {"float"}, "float64": {"double"},
}


@dataclass(frozen=True)
class Assertion:
    kind: str
    params: dict = field(default_factory=dict)
    severity: str = "error"


def _flat(a: Assertion, df: DataFrame) -> Column | bool:
    """The number of rows against the assertion, or a verdict that needs no data."""
    p = a.params
    kinds = dict(df.dtypes)
    if a.kind == "record_count_in_range":
        n, low, high = F.count("*"), p.get("min"), p.get("max")
        bad = F.lit(False)
        if low is not None:
            bad |= n < low
        if high is not None:
            bad |= n > high
        return bad.cast("long")
    if a.kind == "distributional":
        return True
    c = F.col(p["field"])
    if a.kind == "required_field":
        skip = F.coalesce(F.col(p["unlabeled"]), F.lit(False)) if p.get("unlabeled") else F.lit(False)
        return F.count_if(c.isNull() & ~skip)
    if a.kind == "dtype_equals":
        if kinds[p["field"]].startswith("struct<dtype"):
            return F.count_if(c["dtype"] != p["dtype"])
        return kinds[p["field"]] in _TAGS[p["dtype"]]
    if a.kind == "value_range":
        low, high = p.get("min"), p.get("max")
        if low is None and high is None:
            raise ValueError("value_range needs a bound")
        array = kinds[p["field"]].startswith("array")
        lo, hi = (F.array_min(c), F.array_max(c)) if array else (c, c)
        bad = F.lit(False)
        if low is not None:
            bad |= lo < low
        if high is not None:
            bad |= (hi > high) & ~F.isnan(hi.cast("double"))  # NaN passes
        return F.count_if(bad)
    if a.kind == "value_in_set":
        return F.count_if(~c.isin(p["values"]))
    if a.kind == "shape_equals":
        want = F.array(*[F.lit(int(n)) for n in p["shape"]])
        if kinds[p["field"]].startswith("struct<dtype"):
            got = c["shape"]
        else:  # nested arrays: the length of each axis, by its first element
            axis, got, depth = c, F.array(F.size(c)), kinds[p["field"]].count("array<")
            for _ in range(depth - 1):
                axis = F.get(axis, F.lit(0))
                got = F.concat(got, F.array(F.size(axis)))
        return F.count_if(~F.coalesce(got == want, F.lit(False)))
    raise ValueError(f"unknown assertion {a.kind}")


def _grouped(a: Assertion, counts: DataFrame) -> DataFrame:
    """Groups against the assertion; counts has the keys and n."""
    p, n = a.params, F.col("n")
    if a.kind == "per_class_count_per_split":
        return counts.where(F.abs(n - p["per_class"]) > p.get("tolerance", 1))
    if a.kind == "per_class_count_equals":
        return counts.where(n != p["count"])
    return counts.where(n != p["value_per_key"])


_GROUPS = {
    "split_record_counts": lambda p: [SPLIT],
    "per_class_count_per_split": lambda p: [SPLIT, p["field"]],
    "count_by_field": lambda p: [p["field"]],
    "count_by_fields": lambda p: list(p["fields"]),
    "per_class_count_equals": lambda p: [p["field"]],
}


def check(df: DataFrame, assertions: list[Assertion]) -> list[dict]:
    """One dict per assertion: kind, field, severity, passed, n_bad.  Nothing is short-circuited; an assertion that can't be evaluated fails."""
    out: list[dict] = [{"kind": a.kind, "field": a.params.get("field"), "severity": a.severity, "passed": False, "n_bad": 0} for a in assertions]
    flat: list[Column] = []
    for i, a in enumerate(assertions):
        if a.kind in _GROUPS:
            continue
        try:
            found = _flat(a, df)
        except (ValueError, KeyError) as e:
            out[i] |= {"n_bad": 1, "error": str(e)}
            continue
        if isinstance(found, bool):
            out[i] |= {"passed": found, "n_bad": int(not found)}
        else:
            flat.append(found.alias(str(i)))
    if flat:
        for i, n in df.agg(*flat).first().asDict().items():
            out[int(i)] |= {"passed": not n, "n_bad": int(n or 0)}
    shared: dict[tuple, DataFrame] = {}
    for i, a in enumerate(assertions):
        if a.kind in _GROUPS:
            keys = tuple(_GROUPS[a.kind](a.params))
            if keys not in shared:
                shared[keys] = df.groupBy(*keys).agg(F.count("*").alias("n"))
            if a.kind == "split_record_counts":
                got = {r[0]: r["n"] for r in shared[keys].collect()}
                n = sum(got.get(s) != want for s, want in a.params["counts"].items())
            else:
                n = _grouped(a, shared[keys]).count()
            out[i] |= {"passed": not n, "n_bad": n}
    return out


def check_frame(df: DataFrame, assertions: list[Assertion]) -> DataFrame:
    rows = [(i, r["kind"], r["passed"], r["n_bad"]) for i, r in enumerate(check(df, assertions))]
    return df.sparkSession.createDataFrame(rows, "i int, kind string, passed boolean, n_bad long")
