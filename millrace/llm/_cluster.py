"""Connected components, and exact linking of what shares an inverted list without pairing every list with itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import lean, shingle_rows

EDGES = 200_000  # edges of a task; under 100 MB in a Python worker
PAIRS = 2_000  # comparisons of a task


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> each node and the smallest one it reaches in this task, loops left out, by union-find; starts anew beyond most nodes."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(above) if (r := root(x)) != x]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            above[high] = low
            if len(above) > most:
                yield out()
    yield out()


def components(edges: DataFrame, scratch: Scratch, most: int, per_task: int = EDGES) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    most: a bound of the number of edges; as many tasks as hold per_task of them merge their
    edges by union-find.  If there is one task, it has merged all.  Else a large star and a small
    star, which are joins and partial aggregations, contract across tasks, and the rounds go on
    until each node names one root; no node's neighbours are ever gathered.  Nulls and loops are
    ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    last = None
    while True:
        tasks = max(1, -(-most // per_task))
        e = scratch.save(e.coalesce(tasks).mapInArrow(lean(partial(_forest, most=2 * per_task)), "u long, v long"), "edges")
        if last is not None:
            scratch.drop(last)
        roots = e.select(F.col("u").alias("node"), "v").unionAll(e.select(F.col("v").alias("node"), "v")).groupBy("node").agg(F.min("v").alias("component"), F.max("v").alias("other"))
        roots = scratch.save(roots, "roots", 2 * e.rows_)
        if tasks == 1 or roots.where("component <> other").isEmpty():
            out = roots.select("node", "component")
            out.rows_, out._scratch_path = roots.rows_, roots._scratch_path
            return out
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        most, last, e = 2 * e.rows_, e, small


def verifier(texts: DataFrame, shingle: int, percent: int, sketch: tuple[int, float] | None = None) -> Callable[[DataFrame], DataFrame]:
    """pairs (a, b) -> those with 100 * intersection >= percent * union of their full shingle sets.

    sketch (k, share): pairs whose k smallest hashes of the union hold less than this share of common ones are dropped first.
    Only texts of nodes in pairs go further than the first join; if pairs are few, no text is
    shuffled for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            right = batch.column(3).to_pylist()
            for i, (_, x) in enumerate(shingle_rows(batch.column(2), shingle)):
                if last[0] != right[i]:  # pairs come sorted by b
                    last = (right[i], np.unique(next(shingle_rows(pa.array([right[i]], pa.string()), shingle))[1]))
                x, y = np.unique(x), last[1]
                if sketch:
                    k, share = sketch
                    u = np.union1d(x[:k], y[:k])[:k]
                    if np.isin(u, np.intersect1d(x[:k], y[:k], assume_unique=True), assume_unique=True).sum() < share * len(u):
                        continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = texts.join(nodes, "node", "left_semi")
        one = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        two = one.join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return two.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")

    return verify


def exact_lists(texts: DataFrame, shingle: int, percent: int, single: bool) -> DataFrame:
    """key, node, n, at: inverted lists of full shingle sets in which every linked pair meets.

    Values stand in one order, rarest first.  Of two sets that are linked, the first common value
    is among the first n - ceil(percent * n / 100) + 1 of either; a set with many values of its
    own has few or none there, so it stands in no long list.  at is a value's place, by which
    ``_meets`` bounds the intersection.  A node with several texts (possible if not single) has
    all its values, n null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(h) for _, h in shingle_rows(batch.column(1), shingle)]
            off = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, flat)], ["node", "keys"])

    sets = texts.select("node", "text").mapInArrow(lean(run), "node long, keys array<long>")
    values = sets.select("node", F.size("keys").cast("long").alias("n"), F.explode("keys").alias("key"))
    shared = values.groupBy("key").agg(F.count("*").alias("found")).where("found > 1")
    here = Window.partitionBy("node")
    placed = values.join(shared, "key").withColumn("at", F.col("n") - F.count("*").over(here) + F.row_number().over(here.orderBy("found", "key")))
    if single:
        placed = placed.withColumn("texts", F.lit(None).cast("long"))
    else:
        placed = placed.join(texts.groupBy("node").agg(F.count("*").alias("texts")).where("texts > 1"), "node", "left")
    placed = placed.where(f"texts IS NOT NULL OR at <= n - ceil({percent} * n / 100D - 1e-9D) + 1")
    return placed.select("key", "node", F.when(F.col("texts").isNull(), F.col("n")).alias("n"), "at")


def link(postings: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch, given: DataFrame | None = None, sketch: tuple[int, float] | None = None, single: bool = True, pivots: int = 16, grow: int = 16) -> DataFrame:
    """Components (node, component) of all links between nodes that share a key, and of the given links (a, b).

    postings: key, node, weight (of the node), as Scratch saved it.  texts: node, text, one a
    node if single.  Nodes are linked if 100 * intersection >= percent * union of their shingle
    sets.

    A list is not paired with itself.  First each node is compared with one pivot only: of its
    lists' heaviest nodes the one that most of them name.  Nodes of lists that are then all in
    one component are done.  The others are listed anew by their full sets (``exact_lists``),
    which keeps apart those that can't be linked.  In each of these lists, pivots in a hashed
    order, so most of them from its largest component, are compared with the nodes of other
    components and leave the list; their number grows by a factor each round, until one
    component or one node is left.  So no link between components is missed, and a group of m
    near copies costs about m comparisons.
    """
    verify = verifier(texts, shingle, percent, sketch)
    heads = postings.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("p"))
    near = postings.join(heads, "key").where("node <> p.node").select("node", F.col("p.node").alias("p"))
    # both aggregations by the shuffle on node
    seed = near.repartition("node").groupBy("node", "p").agg(F.count("*").alias("shared")).groupBy("node").agg(F.max(F.struct("shared", "p")).alias("best"))
    tested = scratch.save(seed.select(F.least("node", "best.p").alias("a"), F.greatest("node", "best.p").alias("b")), "pairs", postings.rows_)
    links = verify(tested)
    links = scratch.save(links if given is None else links.unionAll(given), "links", tested.rows_, PAIRS)
    found = components(links, scratch, links.rows_)

    open_nodes = _open(postings, found).select("node").distinct()
    left = scratch.save(texts.join(open_nodes, "node", "left_semi"), "texts", texts.rows_, 10 * PAIRS)
    left = scratch.save(exact_lists(left, shingle, percent, single), "lists")
    scratch.drop()
    turn = 0
    while True:
        now = scratch.save(_open(left, found), "open", left.rows_)
        if not now.rows_:
            break
        order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        heads = now.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots)
        heads = scratch.save(heads.select("key", F.col("node").alias("p"), F.col("c").alias("pc"), F.col("n").alias("pn"), F.col("at").alias("pat")), "pivots", now.rows_)
        pairs = now.join(heads, "key").where("c <> pc").where(_meets(percent)).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        fresh = scratch.save(pairs.join(tested, ["a", "b"], "left_anti"), "pairs", pivots * now.rows_)
        new = scratch.save(verify(fresh), "links", fresh.rows_, PAIRS)
        left = now.join(heads.select("key", F.col("p").alias("node")), ["key", "node"], "left_anti").select("key", "node", "n", "at")
        left.rows_ = now.rows_
        if new.rows_:
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(new), scratch, found.rows_ + new.rows_)
        tested = tested.unionAll(fresh)
        pivots, turn = pivots * grow, turn + 1
    return found


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """What stands in lists of more than one component, with its component c."""
    of = lists.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    several = of.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return of.join(several, "key", "left_semi")


def _meets(percent: int) -> str:
    """Whether what follows a common value's places leaves room for enough of an intersection; true where a size isn't known."""
    return f"coalesce((1 + least(n - at, pn - pat)) * {100 + percent} >= {percent} * (n + pn), true)"
