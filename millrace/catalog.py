"""Queries over the operators, each next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ranking import rank
from .operators import contracts as C
from .operators import features as X
from .operators import filters as L
from .operators import generation as G
from .operators import reports as R
from .operators import splits as S
from .operators.contracts import Assertion as A
from .sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "standardized_split_summary"
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
LINE_TIES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
RATIOS = {"train": 0.7, "val": 0.2, "test": 0.1}


def _rank(column: str, seed: int = 42) -> str:
    return f"substr(sha256(unhex('{seed:016x}') || encode(({column})::VARCHAR)), 1, 16)"


def query(sql: str | None = None) -> Callable:
    """Registers a function (t, spark) -> DataFrame, where t reads a table by name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(lambda name: table(spark, folder, name), spark)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# filters


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def filter_by_label_include(t, spark):
    return L.filter_by_label(t("documents").select("doc_id", "lang"), "lang", ["fr", "de"], "include")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality IN (0), false)")
def filter_by_label_exclude(t, spark):
    df = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return L.filter_by_label(df, "quality", [0], "exclude")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_linenumber IN (1, 2)")
def filter_by_value(t, spark):
    df = L.filter_by_value(L.filter_by_value(t("lineitem"), "l_returnflag", "eq", "R"), "l_quantity", "gt", 45)
    return L.filter_by_value(df, "l_linenumber", "in", [1, 2]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_nulls(t, spark):
    return L.drop_nulls(t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select("doc_id", "quality", "toxic"), ["quality", "toxic"])


TOKENS_SQL = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({TOKENS_SQL})::INT AS n FROM documents WHERE len({TOKENS_SQL}) BETWEEN 100 AND 300")
def filter_by_length(t, spark):
    n = F.size(X.tokens("text"))
    return L.filter_by_length(t("documents"), n, 100, 300).select("doc_id", n.alias("n"))


@query(f"SELECT o_orderkey FROM orders ORDER BY {_rank('o_orderkey')}, o_orderkey LIMIT 500")
def random_sample_n(t, spark):
    return L.random_sample(t("orders").select("o_orderkey"), "o_orderkey", 42, n=500)


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_rank('o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= floor(n * 0.03::DOUBLE)")
def random_sample_fraction(t, spark):
    return L.random_sample(t("orders").select("o_orderkey"), "o_orderkey", 42, fraction=0.03)


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_rank('event_id')}, event_id) AS r FROM events) WHERE r <= 50")
def sample_per_class(t, spark):
    return L.sample_per_class(t("events").select("event_id", "event_type"), "event_id", "event_type", 50, 42)


POOLS = f"""WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_rank('event_id')}, event_id) <= 40 AS t1 FROM events),
b AS (SELECT *, NOT t1 AND row_number() OVER (PARTITION BY t1, event_type ORDER BY {_rank('event_id', 7)}, event_id) <= 30 AS t2 FROM a)"""


def _pools(t) -> DataFrame:
    df = L.sample_per_class(t("events").select("event_id", "event_type"), "event_id", "event_type", 40, 42, tag="dev")
    return L.sample_per_class(df, "event_id", "event_type", 30, 7, tag="holdout", exclude=["dev"])


@query(f"{POOLS} SELECT event_id, t1::INT AS dev FROM b")
def sample_per_class_tag(t, spark):
    df = L.sample_per_class(t("events").select("event_id", "event_type"), "event_id", "event_type", 40, 42, tag="dev")
    return df.select("event_id", F.array_contains(L.TAGS, "dev").cast("int").alias("dev"))


@query(f"{POOLS} SELECT event_id, CASE WHEN t1 THEN 'dev' WHEN t2 THEN 'holdout' ELSE '' END AS tag FROM b")
def sample_exclude_labeled(t, spark):
    return _pools(t).select("event_id", F.array_join(L.TAGS, ",").alias("tag"))


@query(f"{POOLS} SELECT event_id FROM b WHERE NOT t1")
def drop_by_label(t, spark):
    return L.drop_by_label(_pools(t), ["dev"]).select("event_id")


@query(f"""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_rank('event_id')}, event_id) AS r FROM events)
WHERE r <= CASE event_type WHEN 'click' THEN 25 WHEN 'view' THEN 75 ELSE 100 END""")
def sample_per_class_fractional(t, spark):
    return L.sample_per_class_fractional(t("events").select("event_id", "event_type"), "event_id", "event_type", 100, {"click": 0.25, "view": 0.75}, 42)


@query("SELECT p_brand AS class, count(*) AS n_before FROM part GROUP BY 1 HAVING max(p_size) < 50")
def emptied_classes(t, spark):
    df = t("part").select("p_brand", "p_size")
    return L.emptied_classes(df, df.where("p_size >= 50"), "p_brand")


# splits

_PLACE = "row_number() OVER ({by} ORDER BY {rank}, {ties}) - 1 AS a, count(*) OVER ({by}) AS n"


def _place(key: str, by: str = "", ties: str | None = None) -> str:
    return _PLACE.format(by=f"PARTITION BY {by}" if by else "", rank=_rank(key), ties=ties or key).replace("OVER ( ORDER", "OVER (ORDER")


def _case(edges: list[tuple[str, float]]) -> str:
    return "CASE " + " ".join(f"WHEN a < floor({e!r}::DOUBLE * n) THEN '{s}'" for s, e in edges) + " END"


_EDGES = [("train", 0.7), ("val", 0.7 + 0.2), ("test", 0.7 + 0.2 + 0.1)]
ORDERS_SPLIT = f"SELECT o_orderkey, o_orderpriority, {_case(_EDGES)} AS _split FROM (SELECT *, {_place('o_orderkey')} FROM orders)"


@query(f"SELECT o_orderkey, _split FROM ({ORDERS_SPLIT})")
def split_ratios(t, spark):
    return S.split_by_ratios(t("orders").select("o_orderkey"), "o_orderkey", RATIOS, 42)


@query(f"SELECT o_orderkey, {_case([('train', 0.5), ('val', 0.75)])} AS _split FROM (SELECT *, {_place('o_orderkey')} FROM orders)")
def split_ratios_remainder(t, spark):
    return S.split_by_ratios(t("orders").select("o_orderkey"), "o_orderkey", {"train": 0.5, "val": 0.25}, 42)


LINE_SPLIT = f"SELECT *, {_case([('train', 0.8), ('val', 1.0)])} AS _split FROM (SELECT *, {_place(LINE_ID, 'l_returnflag', LINE_ID + ', ' + ', '.join(LINE_TIES))} FROM lineitem WHERE l_quantity IS NOT NULL)"


def _line_split(t, columns: list[str] | None = None) -> DataFrame:
    df = L.drop_nulls(t("lineitem"), ["l_quantity"]).withColumn("record_id", F.expr(LINE_ID))
    return S.split_by_ratios(df, "record_id", {"train": 0.8, "val": 0.2}, 42, "l_returnflag", LINE_TIES)


@query(f"SELECT l_returnflag, _split, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM ({LINE_SPLIT}) GROUP BY ALL")
def split_stratified(t, spark):
    return _line_split(t).groupBy("l_returnflag", "_split").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"""WITH s AS ({LINE_SPLIT}), f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM s WHERE _split = 'train')
SELECT _split, l_returnflag, count(*) AS n, round(avg((l_quantity - m) / CASE WHEN d = 0 THEN 1 ELSE d END), 6) AS mean_z FROM s, f GROUP BY ALL""")
def standardized_split_summary(t, spark):
    df = _line_split(t)
    df = X.standardize(df, X.fit_standardize(X.training(df), ["l_quantity"]))
    return df.groupBy("_split", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_z"))


@query("SELECT p_brand || ' ' || p_size AS class, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < 3")
def sparse_classes(t, spark):
    return S.sparse_classes(t("part").select(F.concat_ws(" ", "p_brand", "p_size").alias("kind")), "kind", RATIOS)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'val' WHEN '3-MEDIUM' THEN 'train' WHEN '4-NOT SPECIFIED' THEN 'train' WHEN '5-LOW' THEN 'train' END AS _split FROM orders")
def split_key_assignment(t, spark):
    mapping = {"1-URGENT": "test", "2-HIGH": "val", "3-MEDIUM": "train", "4-NOT SPECIFIED": "train", "5-LOW": "train"}
    return S.split_by_key(t("orders"), "o_orderpriority", mapping, strict=False).select("o_orderkey", "_split")


@query("SELECT o_orderkey, o_orderstatus AS _split FROM orders")
def split_source_partitions(t, spark):
    return S.split_by_partition(t("orders"), "o_orderstatus").select("o_orderkey", "_split")


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE {_case(_EDGES)} END AS _split FROM (SELECT *, {_place('o_orderkey', chr(111) + '_orderstatus')} FROM orders)")
def split_applies_to(t, spark):
    return S.split_by_partition(t("orders"), "o_orderstatus", "o_orderkey", "O", RATIOS, 42).select("o_orderkey", "_split")


@query(f"""{POOLS}, c AS (SELECT *, row_number() OVER (PARTITION BY t1 ORDER BY {_rank('event_id')}, event_id) - 1 AS a, count(*) OVER (PARTITION BY t1) AS n FROM b)
SELECT event_id, CASE WHEN t1 THEN {_case([('train', 0.8), ('val', 1.0)])} WHEN t2 THEN 'holdout' END AS _split FROM c""")
def split_by_tag(t, spark):
    return S.split_by_tag(_pools(t), L.TAGS, "event_id", "dev", {"train": 0.8, "val": 0.2}, 42).select("event_id", "_split")


@query(f"""SELECT c_custkey, _split FROM (SELECT *, row_number() OVER (PARTITION BY _split, c_mktsegment ORDER BY {_rank('c_custkey', 5)}, c_custkey) AS r
FROM (SELECT c_custkey, c_mktsegment, {_case(_EDGES)} AS _split FROM (SELECT *, {_place('c_custkey')} FROM customer))) WHERE r <= 5""")
def sample_data_per_class(t, spark):
    df = S.split_by_ratios(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", RATIOS, 42)
    return S.sample_data(df, "c_custkey", 5, n=5, by=["_split", "c_mktsegment"]).select("c_custkey", "_split")


@query(f"""SELECT c_custkey, _split FROM (SELECT *, row_number() OVER (PARTITION BY _split ORDER BY {_rank('c_custkey', 5)}, c_custkey) AS r, count(*) OVER (PARTITION BY _split) AS m
FROM (SELECT c_custkey, {_case(_EDGES)} AS _split FROM (SELECT *, {_place('c_custkey')} FROM customer))) WHERE r <= floor(m * 0.1::DOUBLE)""")
def sample_data_uniform(t, spark):
    df = S.split_by_ratios(t("customer").select("c_custkey"), "c_custkey", RATIOS, 42)
    return S.sample_data(df, "c_custkey", 5, fraction=0.1).select("c_custkey", "_split")


# fit and apply


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def min_max_scale(t, spark):
    df = t("part").select("p_partkey", "p_retailprice")
    return X.min_max_scale(df, X.fit_min_max(df, ["p_retailprice"])).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building, (c_mktsegment = 'MACHINERY')::INT AS machinery FROM customer")
def one_hot_encode(t, spark):
    df = t("customer")
    found = X.one_hot("c_mktsegment", X.fit_vocabulary(df, "c_mktsegment"))
    zero = F.lit(0)
    return df.select("c_custkey", found.get("c_mktsegment_BUILDING", zero).alias("building"), found.get("c_mktsegment_MACHINERY", zero).alias("machinery"))


@query("SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")
def cast_dtype(t, spark):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))


@query("""SELECT l_orderkey, round(sum(l_quantity * l_quantity), 4) AS q2, round(sum(l_quantity * l_discount), 4) AS qd, round(sum(l_discount * l_discount), 4) AS d2 FROM lineitem GROUP BY 1""")
def polynomial_features(t, spark):
    f = X.polynomial(["l_quantity", "l_discount"], 2)
    df = t("lineitem").select("l_orderkey", *[c.alias(n) for n, c in f.items()])
    return df.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity_x_l_quantity"), 4).alias("q2"), F.round(F.sum("l_quantity_x_l_discount"), 4).alias("qd"), F.round(F.sum("l_discount_x_l_discount"), 4).alias("d2"))


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def categorical_encode(t, spark):
    df = t("orders")
    return df.select("o_orderkey", X.encode("o_orderpriority", X.fit_vocabulary(df, "o_orderpriority")).alias("code"))


@query("SELECT event_id, r::INT AS code FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS r FROM events GROUP BY 1) USING (event_type)")
def categorical_encode_first_seen(t, spark):
    df = t("events")
    return df.select("event_id", X.encode("event_type", X.fit_vocabulary(df, "event_type", "first_seen", "event_id")).alias("code"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END AS code FROM orders")
def categorical_encode_pinned(t, spark):
    return t("orders").select("o_orderkey", X.encode("o_orderstatus", ["O", "F", "P"]).alias("code"))


_EACH = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings"


@query(f"""WITH e AS ({_EACH}), f AS (SELECT p, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY 1)
SELECT vec_id, round(sum((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 5) AS total FROM e JOIN f USING (p) GROUP BY 1""")
def normalize_positions(t, spark):
    df = t("embeddings")
    z = X.normalize_positions("embedding", X.fit_positions(df, "embedding"))
    return df.select("vec_id", F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH e AS ({_EACH}), f AS (SELECT p, avg(x) AS m FROM e GROUP BY 1) SELECT vec_id, round(sum((x - m) * p), 5) AS total FROM e JOIN f USING (p) GROUP BY 1")
def mean_subtract(t, spark):
    df = t("embeddings")
    z = X.normalize_positions("embedding", X.fit_positions(df, "embedding"), scale=False)
    weighted = F.transform(z, lambda x, i: x * (i + 1))
    return df.select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 255)), 4) AS total FROM embeddings")
def cast_scaled(t, spark):
    return t("embeddings").select("vec_id", F.round(F.aggregate(X.cast_scaled("embedding", 255.0), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def shape_stats(t, spark):
    return t("embeddings").select("vec_id", F.size("embedding").alias("n"))


@query(r"""SELECT page_id, list_extract(p, -2) AS parent, list_extract(p, -1) AS name, CASE WHEN regexp_matches(list_extract(p, -1), '^.+\.[^.]+$') THEN regexp_extract(list_extract(p, -1), '^(.+)\.[^.]+$', 1) ELSE list_extract(p, -1) END AS stem
FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages)""")
def label_from_path(t, spark):
    df = t("pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return df.select("page_id", *[X.path_part("path", k).alias(k) for k in ("parent", "name", "stem")])


@query(r"SELECT item_id, regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g') AS text FROM benchmark")
def lowercase_strip_punctuation(t, spark):
    return t("benchmark").select("item_id", F.lower("text").alias("text")).select("item_id", X.strip_punctuation("text").alias("text"))


@query(f"SELECT doc_id, len({TOKENS_SQL})::INT AS n, list_extract({TOKENS_SQL}, 1) AS first FROM documents")
def tokenize_count(t, spark):
    return t("documents").select("doc_id", X.tokens("text").alias("w")).select("doc_id", F.size("w").alias("n"), F.get("w", 0).alias("first"))


@query(f"SELECT item_id, array_to_string(list_filter({TOKENS_SQL}, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in')), ' ') AS text FROM benchmark")
def remove_stopwords(t, spark):
    return t("benchmark").select("item_id", F.array_join(X.remove_stopwords(X.tokens("text"), ["the", "of", "and", "to", "in"]), " ").alias("text"))


@query(f"""WITH tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS_SQL.replace('text', 'lower(text)')}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY df DESC, term LIMIT 100)
SELECT item_id, term, tf, df, round(tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1), 6) AS tfidf FROM tf JOIN d USING (term)""")
def tfidf(t, spark):
    df = t("benchmark").select("item_id", F.lower("text").alias("text"))
    return X.tfidf(df, "item_id", X.tokens("text"), 100).select("item_id", "term", "tf", "df", F.round("tfidf", 6).alias("tfidf"))


@query("SELECT l_orderkey, round(sum((l_quantity - 25) / 14.5), 6) AS z FROM lineitem GROUP BY 1")
def standardize_pinned(t, spark):
    df = X.standardize(t("lineitem").select("l_orderkey", "l_quantity"), {"l_quantity": (25.0, 14.5)})
    return df.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 6).alias("z"))


@query("SELECT n_nationkey, 0.0::DOUBLE AS z FROM nation")
def standardize_constant(t, spark):
    df = t("nation").select("n_nationkey", F.lit(3.0).alias("z"))
    return X.standardize(df, X.fit_standardize(df, ["z"]))


# generation and joins


@query(f"""WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS most FROM s),
need AS (SELECT quality, n, unnest(range(1, most - n + 1)) AS copy FROM s, m WHERE n < most),
pick AS (SELECT quality, copy, (('0x' || substr({_rank("quality || ':' || copy")}, 1, 12))::BIGINT % n) AS p FROM need),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_rank('doc_id')}, doc_id) - 1 AS p FROM labels)
SELECT doc_id, r.quality, copy FROM pick JOIN r ON pick.quality IS NOT DISTINCT FROM r.quality AND pick.p = r.p""")
def duplicate_minority_class(t, spark):
    return G.duplicate_minority_class(t("labels"), "doc_id", "quality", 42).select("doc_id", "quality", "copy")


_STARTS = "SELECT vec_id, embedding, unnest(range(0, len(embedding), 24)) AS s FROM embeddings"


@query(f"SELECT vec_id::VARCHAR || '__w' || lpad((s // 24)::VARCHAR, 4, '0') AS record_id, (s // 24)::INT AS window_index, round(list_sum(list_transform(embedding[s + 1:s + 32], lambda x: x::DOUBLE)), 4) AS total FROM ({_STARTS}) WHERE s + 32 <= len(embedding)")
def window_drop(t, spark):
    df = G.windows(t("embeddings"), "vec_id", "embedding", 32, 24, pad=False)
    return df.select("record_id", "window_index", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query(f"SELECT vec_id::VARCHAR || '__w' || lpad((s // 24)::VARCHAR, 4, '0') AS record_id, 32 AS n, round(list_sum(list_transform(embedding[s + 1:s + 32], lambda x: x::DOUBLE)), 4) AS total FROM ({_STARTS})")
def window_pad(t, spark):
    df = G.windows(t("embeddings"), "vec_id", "embedding", 32, 24, pad=True)
    return df.select("record_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("""SELECT p_partkey::VARCHAR || '__v' || lpad(v::VARCHAR, 3, '0') AS record_id, substr(sha256(unhex('000000000000002a') || encode('flip' || p_partkey::VARCHAR) || unhex('0000000' || v)), 1, 16) AS flip_seed
FROM part, range(0, 3) r(v)""")
def variant_fan_out(t, spark):
    return G.variants(t("part").select("p_partkey"), "p_partkey", "flip", 3, 42).select("record_id", "flip_seed")


@query("""WITH g AS (SELECT p_partkey || '_' || c || '_s' || s AS stem, c AS corruption, s AS severity FROM part, (SELECT unnest(['fog', 'snow']) AS c), (SELECT unnest([1, 3])::INT AS s))
SELECT stem || '_' || substr(sha256(stem), 1, 8) AS record_id, corruption, severity FROM g""")
def corruption_grid(t, spark):
    return G.corruption_grid(t("part").select("p_partkey"), "p_partkey", ["fog", "snow"], [1, 3]).select("record_id", "corruption", "severity")


@query("SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id)")
def label_join_by_id(t, spark):
    df = t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return G.join_labels(df, t("labels"), "doc_id", "quality").select("doc_id", "label")


@query("SELECT a.item_id, b.item_id AS other FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS i FROM benchmark) a JOIN (SELECT *, row_number() OVER (ORDER BY text) AS i FROM benchmark) b USING (i)")
def label_join_by_order(t, spark):
    right = t("benchmark").select(F.col("item_id").alias("other"), F.col("text").alias("t"))
    return G.join_by_order(t("benchmark").select("item_id"), right, "item_id", "t").select("item_id", "other")


@query("""SELECT 'customer/' || c_custkey AS record_id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, s_acctbal FROM supplier""")
def union_sources(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return G.union_sources({"customer": a, "supplier": b}, "id").select("record_id", "balance")


@query("SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS record_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(t, spark):
    return G.repeated_ids(t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def export_semi_join(t, spark):
    return t("orders").select("o_orderkey").join(t("lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("SELECT doc_id, upper(lang) || '/' || lower(source) || '/' || doc_id || '.txt' AS path FROM documents")
def sink_path_template(t, spark):
    return t("documents").select("doc_id", G.path_template("{lang|upper}/{source|lower}/{doc_id}.txt").alias("path"))


# assertions and reports


@query("""SELECT 0 AS i, 'required_field' AS kind, count(*) FILTER (l_quantity IS NULL) = 0 AS passed, count(*) FILTER (l_quantity IS NULL) AS n_bad FROM lineitem
UNION ALL SELECT 1, 'value_range', count(*) FILTER (l_quantity < 2 OR l_quantity > 49) = 0, count(*) FILTER (l_quantity < 2 OR l_quantity > 49) FROM lineitem
UNION ALL SELECT 2, 'value_in_set', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) = 0, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 3, 'dtype_equals', true, 0
UNION ALL SELECT 4, 'record_count_in_range', (SELECT count(*) FROM lineitem) BETWEEN 1 AND 100, ((SELECT count(*) FROM lineitem) NOT BETWEEN 1 AND 100)::BIGINT""")
def contracts_flat(t, spark):
    return C.check_frame(t("lineitem"), [A("required_field", {"field": "l_quantity"}), A("value_range", {"field": "l_quantity", "min": 2, "max": 49}), A("value_in_set", {"field": "l_returnflag", "values": ["A", "N"]}), A("dtype_equals", {"field": "l_quantity", "dtype": "float64"}), A("record_count_in_range", {"min": 1, "max": 100})])


@query("""WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events), b AS (SELECT count(*) FILTER (v < 10 OR (v > 50 AND NOT isnan(v))) AS n FROM e)
SELECT 0 AS i, 'value_range' AS kind, n = 0 AS passed, n AS n_bad FROM b""")
def contracts_nan_and_null(t, spark):
    v = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return C.check_frame(t("events").select(v.alias("v")), [A("value_range", {"field": "v", "min": 10, "max": 50})])


@query(f"""WITH s AS ({ORDERS_SPLIT}), c AS (SELECT _split, o_orderpriority, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 0 AS i, 'per_class_count_per_split' AS kind, (SELECT count(*) FROM c WHERE abs(n - 300) > 20) = 0 AS passed, (SELECT count(*) FROM c WHERE abs(n - 300) > 20) AS n_bad
UNION ALL SELECT 1, 'count_by_fields', (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY o_orderkey HAVING count(*) <> 1)) = 0, (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY o_orderkey HAVING count(*) <> 1))
UNION ALL SELECT 2, 'per_class_count_equals', (SELECT count(*) FROM (SELECT o_orderpriority FROM s GROUP BY 1 HAVING count(*) <> 3000)) = 0, (SELECT count(*) FROM (SELECT o_orderpriority FROM s GROUP BY 1 HAVING count(*) <> 3000))""")
def contracts_grouped(t, spark):
    df = S.split_by_ratios(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", RATIOS, 42)
    return C.check_frame(df, [A("per_class_count_per_split", {"field": "o_orderpriority", "per_class": 300, "tolerance": 20}), A("count_by_fields", {"fields": ["o_orderkey"], "value_per_key": 1}), A("per_class_count_equals", {"field": "o_orderpriority", "count": 3000})])


@query("SELECT 0 AS i, 'shape_equals' AS kind, count(*) FILTER (len(embedding) <> 64) = 0 AS passed, count(*) FILTER (len(embedding) <> 64) AS n_bad FROM embeddings")
def contracts_shape(t, spark):
    return C.check_frame(t("embeddings"), [A("shape_equals", {"field": "embedding", "shape": [64]})])


@query("SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1")
def class_distribution(t, spark):
    return R.class_distribution(t("events"), "event_type")


@query(f"SELECT _split, coalesce(o_orderpriority, 'None') AS class, count(*) AS n FROM ({ORDERS_SPLIT}) WHERE _split IS NOT NULL GROUP BY ALL")
def drift_distribution(t, spark):
    return R.drift(S.split_by_ratios(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", RATIOS, 42), "o_orderpriority")


@query(f"SELECT _split, count(*) AS n FROM ({ORDERS_SPLIT}) WHERE _split IS NOT NULL GROUP BY 1")
def record_counts(t, spark):
    return R.record_counts(S.split_by_ratios(t("orders").select("o_orderkey"), "o_orderkey", RATIOS, 42))


@query("SELECT DISTINCT quality::VARCHAR AS class FROM labels WHERE quality IS NOT NULL")
def label_classes(t, spark):
    return R.label_classes(t("labels"), "quality")


@query("SELECT least(floor((x + 1) / 0.125), 15)::INT AS bin, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE x BETWEEN -1 AND 1 GROUP BY 1")
def value_histogram(t, spark):
    return R.histogram(t("embeddings"), "embedding", -1.0, 1.0, 16)


@query("""SELECT 'n_chars' AS field, count(n_chars) AS n, count(*) - count(n_chars) AS n_null, count(DISTINCT n_chars) AS n_distinct, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM documents""")
def field_summary(t, spark):
    df = R.summary(t("documents"), ["n_chars"])
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"SELECT len({TOKENS_SQL})::INT AS tokens, count(*) AS n FROM documents GROUP BY 1")
def token_length_histogram(t, spark):
    return t("documents").groupBy(F.size(X.tokens("text")).alias("tokens")).agg(F.count("*").alias("n"))


@query(f"SELECT r_regionkey, {_rank('r_regionkey')} AS rank FROM region")
def per_record_seed(t, spark):
    df = t("region").select("r_regionkey", rank(42, "r_regionkey").alias("rank"))
    return df
