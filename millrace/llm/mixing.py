"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  Each
pattern can send its tokens once for nothing and again at a rising price; each source has a
quota.  The flow over patterns and sources is solved on the driver; its size depends on the
number of distinct patterns, which is checked, never on documents.  Then each pattern's
documents are taken in a seeded order until its flow is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch

BUCKETS = 65536
MAX_PATTERNS = 200_000  # rows on the driver, about 100 MB


def quotas(weights: list[float], limits: list[float], total: float) -> list[float]:
    """Shares of total by weight, none above its limit; what a limit cuts off goes to the others by weight."""
    out, open_ = [0.0] * len(weights), [i for i, x in enumerate(limits) if x > 0]
    order = sorted(open_, key=lambda i: (limits[i] / weights[i], i))
    rest, weight = total, sum(weights[i] for i in order)
    for n, i in enumerate(order):
        if rest * weights[i] >= limits[i] * weight:
            out[i] = limits[i]
            rest, weight = rest - limits[i], sum(weights[j] for j in order[n + 1 :])
        else:
            for j in order[n:]:
                out[j] = rest * weights[j] / weight
            break
    return out


def flow(sizes: list[int], members: list[list[int]], wanted: list[int], prices: list[int]) -> list[dict[int, int]]:
    """Tokens by source of each pattern in a cheapest flow that fills wanted as far as possible.

    A pattern's k-th use costs prices[k] a token (convex: ascending), so each use is an arc of
    the pattern's size.  Only these arcs cost, and each path has one of them, so the cheapest
    augmenting paths come in the order of prices: the arcs of one price are opened at a time,
    and a maximum flow (level graphs, blocking flows) is carried on from the one before.
    Patterns and sources that are linked to nothing else need no search.
    """
    n, m = len(sizes), len(wanted)
    got: list[dict[int, int]] = [{} for _ in range(n)]
    want, spare = list(wanted), [0] * n
    of: list[list[int]] = [[] for _ in range(m)]
    for i, own in enumerate(members):
        for j in own:
            of[j].append(i)
    for _ in prices:
        spare = [x + size for x, size in zip(spare, sizes, strict=True)]
        while True:
            # levels from patterns with spare tokens to sources that want some; a source sends back what a pattern gave it
            level, side, free = [0 if x else -1 for x in spare], [-1] * m, False
            layer, depth = [i for i in range(n) if spare[i]], 0
            while layer and not free:
                depth += 1
                sources = []
                for i in layer:
                    for j in members[i]:
                        if side[j] < 0:
                            side[j] = depth
                            sources.append(j)
                            free = free or want[j] > 0
                layer = []
                for j in sources:
                    for i in of[j]:
                        if level[i] < 0 and got[i].get(j):
                            level[i] = depth
                            layer.append(i)
            if not free:
                break
            seen_out, seen_back = [0] * n, [0] * m
            for i in range(n):
                while spare[i] and (path := _path(i, members, of, got, want, level, side, seen_out, seen_back)):
                    room = min([spare[i], want[path[-1]], *(got[path[x + 1]][path[x]] for x in range(1, len(path) - 1, 2))])
                    spare[i] -= room
                    want[path[-1]] -= room
                    for x in range(0, len(path), 2):
                        got[path[x]][path[x + 1]] = got[path[x]].get(path[x + 1], 0) + room
                        if x:
                            got[path[x]][path[x - 1]] -= room
    return got


def _path(i: int, members: list, of: list, got: list, want: list, level: list, side: list, seen_out: list, seen_back: list) -> list[int]:
    """Pattern, source, pattern, ..., source along rising levels, the last source wanting some; [] if none is left."""
    path = [i]
    while path:
        at, last = path[-1], len(path)
        if last % 2:
            own = members[at]
            while seen_out[at] < len(own) and side[own[seen_out[at]]] != level[at] + 1:
                seen_out[at] += 1
            if seen_out[at] < len(own):
                path.append(own[seen_out[at]])
                continue
        else:
            if want[at]:
                return path
            own = of[at]
            while seen_back[at] < len(own) and (level[own[seen_back[at]]] != side[at] or not got[own[seen_back[at]]].get(at)):
                seen_back[at] += 1
            if seen_back[at] < len(own):
                path.append(own[seen_back[at]])
                continue
        path.pop()
        if path:
            (seen_back if last % 2 else seen_out)[path[-1]] += 1
    return []


def measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs and _size (words), _rank (seeded), _key (of the membership pattern), _pattern."""
    many = dict(docs.dtypes)[source_col].startswith("array")
    pattern = F.array_sort(F.array_distinct(F.coalesce(source_col, F.array(F.lit(None).cast("string"))))) if many else F.array(source_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    gaps = F.size(F.split(text, r"[\x20\x09-\x0D]+")) - text.rlike(r"^[\x20\x09-\x0D]").cast("int") - text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    size = F.when(text.rlike(r"[^\x20\x09-\x0D]"), gaps).otherwise(0).cast("long")
    rank = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    key = F.concat_ws("\x00", F.transform(pattern, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))))
    return docs.withColumns({"_size": size, "_rank": rank, "_key": key, "_pattern": pattern})


def plan(rows: DataFrame, weights: list[float], share: float, most: int) -> DataFrame:
    """_key, _own (source size), _target, _times (whole uses of each document), _last: the place (rank, id, size) up to which a document is used once more.

    rows: doc_id and what measured() adds, without texts.
    """
    spark = rows.sparkSession
    found = rows.groupBy("_key").agg(F.first("_pattern").alias("pattern"), F.sum("_size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    names = sorted({s for r in found for s in r["pattern"]}, key=lambda s: (s is None, s or ""))
    place = {s: j for j, s in enumerate(names)}
    own = [sum(r["size"] for r in found if s in r["pattern"]) for s in names]
    weight = [weights[j % len(weights)] for j in range(len(names))]
    target = quotas(weight, [float(most * x) for x in own], share * sum(r["size"] for r in found))
    got = flow([r["size"] for r in found], [[place[s] for s in r["pattern"]] for r in found], [round(x) for x in target], list(range(most)))
    first = [place[r["pattern"][0]] for r in found]
    table = [(r["_key"], own[j], float(target[j]), *divmod(sum(got[i].values()), max(1, r["size"]))) for i, (r, j) in enumerate(zip(found, first, strict=True))]
    table = spark.createDataFrame(table, "_key string, _own long, _target double, _times long, rest long")
    # words before each document in its pattern's seeded order: sums of rank buckets first, then single documents in the one bucket where the rest ends
    bucket = F.expr(f"CAST(shiftright(_rank, {60 - BUCKETS.bit_length() + 1}) AS int)")
    rows = rows.select("_key", "doc_id", "_size", "_rank", bucket.alias("bucket"))
    sums = rows.groupBy("_key", "bucket").agg(F.sum("_size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("_key").orderBy("bucket")) - F.col("n"))
    edge = sums.join(F.broadcast(table), "_key").where("before <= rest AND rest < before + n").select("_key", F.col("bucket").alias("edge"), "before", "rest")
    inner = Window.partitionBy("_key").orderBy("_rank", "doc_id", "_size")
    near = rows.join(F.broadcast(edge), "_key").where("bucket = edge")
    near = near.withColumn("prior", F.sum("_size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size") + F.col("before"))
    near = near.where("2 * (rest - prior) >= _size AND rest > prior").groupBy("_key").agg(F.max(F.struct("_rank", "doc_id", "_size")).alias("t"))
    start = F.struct(F.expr(f"shiftleft(CAST(edge AS bigint), {60 - BUCKETS.bit_length() + 1}) - 1L").alias("_rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("_size"))
    last = edge.join(near, "_key", "left").select("_key", F.coalesce("t", start).alias("_last"))
    last = last.collect()  # one row a pattern
    last = spark.createDataFrame([(r["_key"], r["_last"]) for r in last], "_key string, _last struct<_rank:long,doc_id:long,_size:long>")
    return table.drop("rest").join(last, "_key", "left")


def used(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (as measured, id in doc_id) with source_size, target and times (uses of each document)."""
    more = F.expr("coalesce(struct(_rank, CAST(doc_id AS bigint) AS doc_id, _size) <= _last, false)").cast("long")
    more = F.when(F.col("_size") > 0, F.col("_times") + more).otherwise(0)
    return rows.join(F.broadcast(table), "_key").select(*rows.columns, F.col("_own").alias("_source_size"), F.col("_target"), more.alias("_uses"))


def mix(docs: DataFrame, weights: list[float], share: float, most: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    size is the number of words (null text: 0).  source_col is a string, or an array of the
    sources a document belongs to.  Sources in code-point order, null last, have the weights in
    turn, repeating.  All targets add up to share times all sizes where the limits (most times
    a source's size) allow it.  Taken is size times a whole number from 0 to most; each
    pattern's flow is met to within half of one document, the one in which it ends.
    source_size and target are those of the document's (first) source.  The seeded order is
    that of a hash of the id, then id and size; rows equal in these are taken alike.  No rows,
    no result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    rows = measured(rows, seed, "doc_id", "text", "source").drop("text", "source")
    rows = Scratch(docs.sparkSession, "mix").save(rows, "sizes")
    out = used(rows, plan(rows, weights, share, most))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_uses")).alias("taken"))


def repeat(docs: DataFrame, weights: list[float], share: float, most: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs with all columns, each row as often as it is used.  Texts aren't shuffled; those without words go."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    rows = measured(packed, seed, "doc_id", "text", "source").drop("text", "source")
    sizes = Scratch(docs.sparkSession, "mix").save(rows.drop("_row"), "sizes")
    out = used(rows, plan(sizes, weights, share, most)).where("_uses > 0")
    return out.select("_row", F.explode(F.expr("sequence(1L, _uses)")).alias("_use")).select("_row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; odd input as in ``mix``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), [5, 2, 1], 1.5, 2)


ORACLE_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS own, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS j FROM d GROUP BY source),
w AS (SELECT *, (CASE j % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS wt, 2.0::DOUBLE * own AS lim FROM o),
c AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(own) FROM w)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / wt, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(wt) OVER (ORDER BY lim / wt, j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM w WHERE own > 0
), f AS (SELECT *, rest * wt >= lim * weight AS capped, row_number() OVER (ORDER BY lim / wt, j) AS r FROM c),
u AS (SELECT min(r) FILTER (NOT capped) AS first FROM f),
v AS (SELECT a.rest, a.weight FROM f a, u WHERE a.r = u.first),
t AS (
  SELECT f.source, f.own, CASE WHEN u.first IS NULL OR f.r < u.first THEN f.lim ELSE (SELECT rest FROM v) * f.wt / (SELECT weight FROM v) END AS target FROM f, u
  UNION ALL SELECT source, own, 0 FROM w WHERE own = 0
), p AS (SELECT *, CASE WHEN own > 0 THEN round_even(target, 0)::BIGINT // own ELSE 0 END AS times, CASE WHEN own > 0 THEN round_even(target, 0)::BIGINT % own ELSE 0 END AS rest FROM t),
x AS (
  SELECT d.*, p.own, p.target, p.times, p.rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('0:' || d.doc_id), 1, 15), d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_words
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, own AS source_size, target, (size * (times + CASE WHEN 2 * (rest - prior_words) >= size AND rest > prior_words THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
