import pytest

from millrace import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, same, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["split_ratios", "split_stratified", "sample_per_class_tag", "duplicate_minority_class", "random_sample_n"])
def test_partitions_do_not_matter(spark, name):
    rows = []
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows[0] == rows[1] == rows[2]
