import hashlib

import pytest

from millrace.functions.ranking import derive_seed, rank, resolve_seed
from millrace.operators import contracts as C
from millrace.operators import features as X
from millrace.operators import filters as L
from millrace.operators import generation as G
from millrace.operators import splits as S
from millrace.sources.readers import layout_pattern


def test_rank_equals_hashlib(spark):
    got = spark.createDataFrame([("é1",), ("2",), (None,)], "id string").select("id", rank(7, "id").alias("r")).collect()
    for r in got:
        assert r["r"] == hashlib.sha256((7).to_bytes(8, "big") + (r["id"] or "None").encode()).hexdigest()[:16]
    with pytest.raises(ValueError):
        rank(-1, "id")


def test_seeds():
    assert resolve_seed(None, 5, "Splits") == 5 and resolve_seed(3, 5, "x") == 3
    assert resolve_seed({"from": "master"}, 5, "Splits") == derive_seed(5, "Splits") != derive_seed(5, "Other")


def test_null_labels_stay_on_exclude(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r[0] for r in L.filter_by_label(df, "x", ["a"], "exclude").collect()} == {"b", None}


def test_ratio_boundaries_leave_rows_out(spark):
    df = spark.range(50).withColumnRenamed("id", "record_id")
    got = {r[0]: r[1] for r in S.split_by_ratios(df, "record_id", {"a": 0.7, "b": 0.2, "c": 0.1}, 1).groupBy("_split").count().collect()}
    assert got == {"a": 35, "b": 9, "c": 5, None: 1}  # 0.7 + 0.2 + 0.1 is under 1 in doubles


def test_stratified_split_with_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x") for i in range(30)], "record_id long, c string")
    got = {(r[0], r[1]): r[2] for r in S.split_by_ratios(df, "record_id", {"a": 0.5, "b": 0.5}, 1, "c").groupBy("c", "_split").count().collect()}
    assert got == {(None, "a"): 5, (None, "b"): 5, ("x", "a"): 10, ("x", "b"): 10}


def test_unmapped_key_is_an_error(spark):
    with pytest.raises(Exception, match="no split for"):
        S.split_by_key(spark.createDataFrame([("z",)], "k string"), "k", {"a": "train"}).collect()


def test_windows_of_empty_array(spark):
    df = spark.createDataFrame([("a", []), ("b", [1.0] * 5)], "id string, x array<float>")
    assert [r["record_id"] for r in G.windows(df, "id", "x", 2, 2, pad=True).orderBy("record_id").collect()] == ["b__w0000", "b__w0001", "b__w0002"]
    assert G.windows(df, "id", "x", 2, 2, pad=False).count() == 2


def test_constant_column_scales_to_low(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r[0] for r in X.min_max_scale(df, X.fit_min_max(df, ["x"]), 2.0, 3.0).collect()] == [2.0, 2.0]


def test_stem():
    assert layout_pattern("{label}/**/{file}") == "^([^/]+)/(?:.*/)?([^/]+)$"


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), (".env",), ("d/.hid",)], "p string")
    assert [r[0] for r in df.select(X.path_part("p", "stem")).collect()] == ["b.tar", ".env", ".hid"]


def test_nan_passes_and_unknown_fails(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    got = C.check(df, [C.Assertion("value_range", {"field": "x", "max": 2}), C.Assertion("nonsense", {"field": "x"}), C.Assertion("required_field", {"field": "x"})])
    assert [r["passed"] for r in got] == [True, False, False]


def test_template_escape():
    with pytest.raises(ValueError):
        G.path_template("../{x}")


def test_manifest_duplicates(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b")], "k int, l string")
    with pytest.raises(ValueError):
        G.join_labels(spark.createDataFrame([(1,)], "k int"), m, "k", "l")
