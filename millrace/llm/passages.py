"""Repeated passages: near copies of paragraphs by MinHash banding, and equal runs of words wherever they stand.

A text is cut at line feeds, and within a line after sentences chosen by their own content, so
that a passage is cut alike wherever it stands.  Paragraphs of LEAST words or more are hashed
into bands tuned for recall, colliding ones are compared by exact Jaccard similarity of their
shingle sets, and all but the first occurrence in each connected component are removable.

Runs of SPAN or more equal words are found whatever lines and sentences they begin in or cross
(``spans``).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._cluster import link
from ._store import Scratch
from ._text import _STEP, U, lean, mix, slices, span_hash, words

LEAST = 16
SPAN = 50
SHINGLE = 5
PERCENT = 80
RECALL = 0.999
STRIDE = 4
_BLANK = " \t\n\v\f\r"
_SENTENCE = re.compile(r"[.!?][\"')\]]*[ \t]+")


def tune(threshold: float, recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of so many rows that find a pair at the threshold with this probability.

    Three rows keep paragraphs that share a tenth of their shingles apart (1 in 1000 a band).
    """
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans, in code points, of a text's paragraphs; they cover it but for line feeds."""
    out, at = [], 0
    for line in text.split("\n"):
        start, end = at, at + len(line)
        for m in _SENTENCE.finditer(line):
            if zlib.crc32(line[max(0, m.start() - 12) : m.start()].encode()) % STRIDE == 0:
                out.append((start, at + m.end()))
                start = at + m.end()
        if start < end:
            out.append((start, end))
        at = end + 1
    return out


def signatures(texts: list[str], bands: int, rows: int) -> tuple[list[bytes], np.ndarray]:
    """A print of the word sequence, and bands (48-bit keys), of paragraphs of at least SHINGLE words."""
    prints, keys = [], []
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    for _, _, data, off in slices(pa.array(texts, pa.string())):
        start, end, counts = words(data, off)
        h = span_hash(data, start, end)
        at = np.concatenate([[0], np.cumsum(counts)])
        prints += [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        flat = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            flat += mix(h[j : j + len(flat)] + _STEP[j]) * _STEP[j + 1]
        flat = mix(flat)
        row = np.repeat(np.arange(len(counts)), counts)
        flat = flat[row[: len(flat)] == row[SHINGLE - 1 :]]
        first = np.concatenate([[0], np.cumsum(counts - SHINGLE + 1)[:-1]])
        out = np.zeros((len(counts), bands), np.uint64)
        for b in range(bands):
            for r in range(rows):
                out[:, b] = mix(out[:, b] * U(31) + np.minimum.reduceat(mix(flat ^ seeds[b * rows + r]), first))
            out[:, b] = mix(out[:, b] + U(b))
        keys.append((out >> U(16)).astype(np.int64))
    return prints, np.concatenate(keys) if keys else np.zeros((0, bands), np.int64)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """One row per paragraph that has a copy or near copy: doc_id, print (of the text), paragraph (number), start, end (code points), n_words, first_doc_id, first_paragraph, removed.

    Paragraphs of ``least`` words or more whose 5-word shingle sets have a Jaccard similarity of
    percent or more are linked; the first of a component by (doc_id, print, paragraph) stays.
    Null or blank texts have no paragraphs; rows with a null id are not compared.  Rows that
    share an id are told apart by their texts' prints; rows equal in both are one.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "passages")
    bands, rows = tune(percent / 100)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = []
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for n, (s, e) in enumerate(paragraphs(text or "")):
                    part = text[s:e]
                    size = len(part.encode().split())
                    if size >= max(least, SHINGLE):
                        out.append((doc, mark, n, s, e, size))
                        texts.append(part)
            prints, keys = signatures(texts, bands, rows)
            cols = list(zip(*out, strict=True)) or [()] * 6
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(prints, pa.binary()), lists], ["doc_id", "print", "paragraph", "start", "end", "n_words", "words", "bands"])

    found = scratch.save(docs.mapInArrow(lean(cut), "doc_id long, print long, paragraph long, start long, end long, n_words long, words binary, bands array<long>"), "paragraphs")
    # equal word sequences are one class; its first paragraph stands for it
    classes = found.groupBy("words").agg(F.min(F.struct("doc_id", "print", "paragraph", "start", "end", "bands")).alias("f"), F.count("*").alias("copies"))
    classes = scratch.save(classes.select("words", "copies", "f.*").withColumn("node", F.monotonically_increasing_id()), "classes", found.rows_, 50_000)
    listed = classes.select("node", F.explode("bands").alias("key"), F.col("copies").alias("weight"))
    shared = listed.groupBy("key").agg(F.count("*").alias("found")).where("found > 1").select("key")
    postings = scratch.save(listed.join(shared, "key").select("key", "node", "weight"), "postings", classes.rows_ * bands)
    wanted = classes.join(postings.select("node").distinct(), "node").select("node", "doc_id", "print", "start", "end")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = [], []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes += [s["node"] for s in spans]
                texts += [(text or "")[s["start"] : s["end"]] for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], ["node", "text"])

    spans = wanted.groupBy("doc_id", "print").agg(F.collect_list(F.struct("node", "start", "end")).alias("spans"))
    texts = scratch.save(docs.join(spans, ["doc_id", "print"]).select("text", "spans").mapInArrow(lean(pick), "node long, text string"), "texts", classes.rows_, 20_000)
    scratch.drop()
    linked = link(postings, texts, SHINGLE, percent, scratch)
    scratch.drop(postings, texts)

    of = classes.select("words", "copies", "node", "doc_id", "print", "paragraph").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = of.groupBy("component").agg(F.min(F.struct("doc_id", "print", "paragraph")).alias("first"), F.sum("copies").alias("members")).where("members > 1")
    of = of.select("words", "component").join(heads, "component").select("words", "first")
    out = found.select("doc_id", "print", "paragraph", "start", "end", "n_words", "words").join(of, "words")
    removed = F.expr("NOT (doc_id = first.doc_id AND print = first.print AND paragraph = first.paragraph)")
    out = out.select("doc_id", "print", "paragraph", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"), removed.alias("removed"))
    out = scratch.save(out, "repeats", found.rows_)
    scratch.clear(out)
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    part, width, out, done = h, 1, None, 0
    while True:
        if n & width:
            m = len(h) - done - width + 1
            out = part if out is None else mix(out[:m] * _STEP[0] + part[done : done + m])
            done += width
        if done == n:
            return out
        part = mix(part[:-width] * _STEP[1] + part[width:])
        width *= 2


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the n values from each place on."""
    m, width = max(0, len(x) - n + 1), 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:m], x[n - width : n - width + m])


def _windows(h: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word; hash of the grams of span / 2 words; the smallest of them in each window of span words; whether the window is in one row."""
    row = np.repeat(np.arange(len(counts)), counts)
    g = grams(h, span // 2)
    return row, g, lowest(g, span - span // 2 + 1), row[: max(0, len(h) - span + 1)] == row[span - 1 :]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per run of ``span`` or more words that stands, word for word, elsewhere: doc_id, print (of the text), start, end (code points), n_words, first_doc_id, first_start, removed.

    Each window of span words is looked at, so the result is exact but for 64-bit hashes.  Equal
    windows have the same smallest gram of span / 2 words; only windows whose smallest gram
    occurs twice are hashed whole.  They are sent in blocks of neighbours with one smallest gram,
    once for each class of equal blocks; where all blocks of a gram are equal and no window stands
    twice in them, their windows stand nowhere else, and only the others are compared one by one.  The first window by doc_id, text
    and place stays; runs of others are removed, but for words they share with a window that stays.
    Case of A-Z and kind of white space don't count.  Ids as in ``repeats``.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "spans")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print")).where("doc_id IS NOT NULL")
    ref = F.xxhash64("doc_id", "print").alias("ref")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, off in slices(batch.column(1)):
                start, end, counts = words(data, off)
                if len(start) < span:
                    continue
                row, g, least, inside = _windows(span_hash(data, start, end), counts, span)
                room = span - span // 2
                around = np.full(len(least) + 2 * room, ~U(0))
                around[room : room + len(least)] = np.where(inside, ~least, ~U(0))
                chosen = np.flatnonzero(~lowest(around, room + 1) == g)
                yield pa.RecordBatch.from_arrays([pa.array(refs[lo + row[chosen]], pa.int64()), pa.array(g[chosen].view(np.int64))], ["ref", "key"])

    listed = scratch.save(docs.select(ref, "text").mapInArrow(lean(anchors), "ref long, key long"), "anchors")
    shared = listed.groupBy("key").agg(F.count("*").alias("found")).where("found > 1").select("key")
    keys = listed.join(shared, "key").groupBy("ref").agg(F.collect_set("key").alias("keys"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            wanted = batch.column(3)
            for lo, hi, data, off in slices(batch.column(1)):
                start, end, counts = words(data, off)
                if len(start) < span:
                    continue
                h = span_hash(data, start, end)
                row, _, least, inside = _windows(h, counts, span)
                first = np.concatenate([[0], np.cumsum(counts)])
                picked = [np.zeros(0, np.int64)]
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1] - span + 1
                    if a < b:
                        picked.append(a + np.flatnonzero(np.isin(least[a:b], wanted[lo + i].values.to_numpy(zero_copy_only=False).view(np.uint64))))
                at = np.concatenate(picked)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[off[row[at]]]
                h = grams(h, span)[at]
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (np.diff(row[at]) != 0) | (least[at[1:]] != least[at[:-1]])
                block = np.flatnonzero(new)
                sizes = np.diff(np.append(block, len(at)))
                within = np.arange(len(at)) - np.repeat(block, sizes)
                whole_hash = np.add.reduceat(mix(h ^ mix(within.astype(np.uint64))), block) if len(block) else h
                lists = [h.view(np.int64)]
                for places in (points[start[at]] - base, points[end[at + span - 1]] - base):  # the first, then steps, which are small
                    steps = places.copy()
                    steps[1:] -= places[:-1]
                    steps[block] = places[block]
                    lists.append(steps.astype(np.int32))
                of, edges = at[block], pa.array(np.append(block, len(at)), pa.int32())
                cols = [mix(whole_hash + sizes.astype(np.uint64)).view(np.int64), least[of].view(np.int64), ids[lo + row[of]], prints[lo + row[of]], of - first[row[of]]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *(pa.ListArray.from_arrays(edges, pa.array(c)) for c in lists)], ["block", "gram", "doc_id", "print", "w", "h", "s", "e"])

    found = docs.join(keys.withColumnRenamed("ref", "_ref"), F.xxhash64("doc_id", "print") == F.col("_ref")).select("doc_id", "text", "print", "keys")
    found = scratch.save(found.mapInArrow(lean(whole), "block long, gram long, doc_id long, print long, w long, h array<long>, s array<int>, e array<int>"), "blocks")
    scratch.drop(listed)
    # equal blocks have equal windows; the first stands for all
    blocks = found.groupBy("block").agg(F.min(F.struct("doc_id", "print", "w", "h", "s")).alias("b"), F.min("gram").alias("gram"), F.count("*").alias("copies"))
    blocks = blocks.select("block", "gram", (F.col("copies") > 1).alias("many"), "b.*").withColumn("b", F.monotonically_increasing_id())
    blocks = scratch.save(blocks, "classes", found.rows_)
    scratch.drop()
    tag = F.pmod("print", F.lit(1 << 15)).cast("short").alias("tag")
    kinds = blocks.groupBy("gram").agg(F.count("*").alias("kinds"), F.max(F.size(F.array_distinct("h")) < F.size("h")).alias("within")).where("kinds > 1 OR within").select("gram")
    alone = blocks.join(kinds, "gram", "left_anti").where("many").select("b", F.lit(0).alias("o1"), (F.size("h") - 1).alias("o2"), F.col("doc_id").alias("fd"), tag.alias("ft"), F.col("w").alias("shift"), F.struct(F.col("b").alias("b"), F.lit(0).alias("o")).alias("f"))
    each = blocks.join(kinds, "gram", "left_semi").select("b", "many", "doc_id", tag, "w", F.posexplode("h").alias("o", "key"))
    heads = each.groupBy("key").agg(F.min(F.struct("doc_id", "tag", (F.col("w") + F.col("o")).alias("w"), "b", "o")).alias("f"), F.max("many").alias("many"), F.count("*").alias("n")).where("many OR n > 1").select("key", "f")
    twice = each.select("b", "o", "key").join(heads, "key").select("b", "o", F.col("f.doc_id").alias("fd"), F.col("f.tag").alias("ft"), (F.col("f.w") - F.col("o")).alias("shift"), F.struct("f.b", "f.o").alias("f"))
    # windows that follow each other in their firsts too
    twice = twice.withColumn("r", F.col("o") - F.row_number().over(Window.partitionBy("b", "fd", "ft", "shift").orderBy("o")))
    parts = twice.groupBy("b", "fd", "ft", "shift", "r").agg(F.min("o").alias("o1"), F.max("o").alias("o2"), F.min_by("f", "o").alias("f")).drop("r")
    parts = scratch.save(parts.unionByName(alone), "runs", found.rows_)
    scratch.drop()
    upto = "aggregate(slice({0}, 1, {1} + 1), 0L, (a, x) -> a + x)"  # the place after so many steps
    firsts = blocks.select(F.col("b").alias("fb"), F.col("s").alias("fs"))
    parts = parts.join(firsts, F.col("f.b") == F.col("fb")).withColumn("fs", F.expr(upto.format("fs", "f.o"))).drop("f", "fb").join(blocks.select("b", "block"), "b").drop("b")
    parts = scratch.save(parts, "parts", scratch.tables[-1].rows_)
    scratch.drop(blocks)
    copy = ~(F.expr("fd = doc_id AND shift = w") & (F.col("ft") == tag))
    of = found.select("block", "doc_id", "print", "w", "s", "e").join(parts, "block")
    of = of.select("doc_id", "print", F.expr("w + o1").alias("w1"), F.expr("w + o2").alias("w2"), F.expr(upto.format("s", "o1")).alias("s"), F.expr(upto.format("e", "o2")).alias("e"), "fd", "fs", copy.alias("copy"))
    here = Window.partitionBy("doc_id", "print").orderBy("w1")
    new = (F.col("w1") > F.lag("w2").over(here) + 1) | (F.col("copy") != F.lag("copy").over(here)) | (F.col("fd") != F.lag("fd").over(here))
    runs = of.withColumn("new", F.coalesce(new, F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(here))
    out = runs.groupBy("doc_id", "print", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), (F.max("w2") - F.min("w1") + span).alias("n_words"), F.min("fd").alias("first_doc_id"), F.min_by("fs", "w1").alias("first_start"), F.first("copy").alias("removed"))
    out = scratch.save(out.drop("run"), "spans", found.rows_)
    scratch.clear(out)
    return out


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, **options: int) -> DataFrame:
    """docs with all columns, removable paragraphs cut out of the texts (with their line feed where a whole line goes), then removable runs of span words out of what is left; a text of which nothing is left goes."""
    cuts = repeats(docs, id_col, text_col, **options).where("removed").groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "end")).alias("_cuts"))
    scratch = Scratch(docs.sparkSession, "strip")
    docs = scratch.save(_cut(docs, cuts, _without, id_col, text_col), "stripped")
    cuts = spans(docs, id_col, text_col, span).groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "end", "removed")).alias("_cuts"))
    return _cut(docs, cuts, _outside, id_col, text_col)


def _cut(docs: DataFrame, cuts: DataFrame, without: Callable, id_col: str, text_col: str) -> DataFrame:
    names = docs.columns
    on = [c for c in cuts.columns if c != "_cuts"]
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("print"))
    joined = packed.join(cuts, on, "left")

    @F.pandas_udf("string")
    def cleaned(text, spans):  # noqa: ANN001, ANN202
        return text.combine(spans, lambda t, s: t if s is None else without(t, s))

    new = F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(cleaned("_text", "_cuts"))
    done = joined.withColumn("_new", new).where(F.col("_cuts").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    return done.select(*[F.col("_new").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names])


def _without(text: str, spans) -> str:  # noqa: ANN001
    out, at = [], 0
    for s, e in sorted({(x["start"], x["end"]) for x in spans}):
        whole = (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n"
        out.append(text[at:s])
        at = e + 1 if whole else e
    return "".join([*out, text[at:]])


def _outside(text: str, spans) -> str:  # noqa: ANN001
    """text without removed spans but for what they share with others; where it closes up, the white space with more line feeds stays."""
    gone = np.zeros(len(text) + 2, bool)
    for removed in (True, False):
        for x in spans:
            if bool(x["removed"]) == removed:
                gone[x["start"] + 1 : x["end"] + 1] = removed
    edges = [0, *np.flatnonzero(gone[1:] != gone[:-1]).tolist(), len(text)]
    out = text[: edges[1]]
    for s, e in zip(edges[2::2], edges[3::2], strict=True):
        left, right = out.rstrip(_BLANK), text[s:e].lstrip(_BLANK)
        gaps = out[len(left) :], text[s : e - len(right)]
        out = left + (max(*gaps, key=lambda g: (g.count("\n"), len(g) == 1)) or " " if left and right else "") + right
    return out


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of paragraphs (first_start null) and runs of equal words (paragraph and first_paragraph null)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = repeats(docs).drop("print").withColumn("first_start", F.lit(None).cast("long"))
    return near.unionByName(spans(docs).drop("print"), allowMissingColumns=True)
