"""Language-model scoring by the marginal likelihood of a subword lattice.

The pieces of an existing vocabulary weigh all segmentations of a text; a log-space forward
recursion adds them up.  No piece spans two words, so a text's probability is the product of
its words' marginals and of the end's, and each distinct word is computed once, however often
it occurs.  The vocabulary is never trained; its piece probabilities start from its own order
and are fitted by expectation-maximisation on the word counts of the training documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._store import Scratch
from ._text import _BASE, _BYTE, U, lean, mix

COMMON = 100_000
ROUNDS = 3
MARK = 0xFF  # stands for the word-start mark; no byte of UTF-8
LOG10 = np.log(10)
LONG = 1 << 15  # bytes from which a word is gone through in parts, so memory grows with 16 bytes a byte of it


def pieces(path: str) -> list[bytes]:
    """Byte strings of the vocabulary's pieces in its order, word-start mark first in those that begin a word; then each byte; then the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i)
        start = raw.startswith("▁")
        raw = raw[1:] if start else raw
        if "▁" not in raw and raw == raw.lower():
            found[(bytes([MARK]) if start else b"") + raw.encode()] = None
    for b in (*range(256),):
        found.setdefault(bytes([b]))
    return [*found, b""]


class Lattice:
    """Marginals and expected piece counts of words under piece log probabilities."""

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.longest = max(map(len, names))
        keys = np.array([self._key(np.frombuffer(x, np.uint8)) for x in names[:-1]], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.logp = keys[order], order, np.append(logp, -np.inf)
        self.none = len(logp)

    @staticmethod
    def _key(x: np.ndarray) -> np.uint64:
        up = np.cumprod(np.concatenate([[U(1)], np.full(len(x), _BASE, np.uint64)]), dtype=np.uint64)
        return mix(np.array([(_RAW[x] * up[:-1]).sum(dtype=np.uint64)]) + U(len(x)))[0]

    def _edges(self, data: np.ndarray) -> list[np.ndarray]:
        """data: words of one length L.  For each end j the piece ids (words x starts) of starts max(0, j - longest) to j - 1."""
        n, length = data.shape
        up = np.cumprod(np.concatenate([[U(1)], np.full(length, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[U(1)], np.full(length, pow(_BASE, -1, 2**64), np.uint64)]), dtype=np.uint64)
        total = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(_RAW[data] * up[:-1], axis=1, dtype=np.uint64)], axis=1)
        out = []
        for j in range(1, length + 1):
            i = np.arange(max(0, j - self.longest), j)
            h = mix((total[:, j : j + 1] - total[:, i]) * down[i] + (j - i).astype(np.uint64))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out.append(np.where(self.keys[at] == h, self.ids[at], self.none))
        return out

    def _forward(self, edges: list[np.ndarray], n: int) -> np.ndarray:
        alpha = np.zeros((n, len(edges) + 1))
        for j, ids in enumerate(edges, 1):
            lo = j - ids.shape[1]
            alpha[:, j] = np.logaddexp.reduce(alpha[:, lo:j] + self.logp[ids], axis=1)
        return alpha

    def _chunks(self, data: np.ndarray, backward: bool = False) -> Iterator[tuple[int, list[np.ndarray]]]:
        """One long word LONG ends at a time: the place before the first end, and each end's piece ids as in ``_edges``."""
        cuts = range(0, len(data), LONG)
        for lo in reversed(cuts) if backward else cuts:
            first = max(0, lo - self.longest)
            yield lo, self._edges(data[None, first : lo + LONG])[lo - first :]

    def _forward_long(self, data: np.ndarray) -> np.ndarray:
        alpha = np.zeros(len(data) + 1)
        for lo, edges in self._chunks(data):
            for j, ids in enumerate(edges, lo + 1):
                alpha[j] = np.logaddexp.reduce(alpha[j - ids.shape[1] : j] + self.logp[ids[0]])
        return alpha

    @staticmethod
    def _marked(word: bytes) -> np.ndarray:
        return np.frombuffer(bytes([MARK]) + word, np.uint8)

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and bytes (word-start mark first) of words of equal length under LONG, at most about 2 MB at a time."""
        size = np.array([len(w) for w in words], np.int64)
        for length in np.unique(size[size < LONG]):
            rows = np.flatnonzero(size == length)
            step = max(1, 200_000 // int(length + 1))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                data = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)
                yield part, np.concatenate([np.full((len(part), 1), MARK, np.uint8), data], axis=1)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for rows, data in self.groups(words):
            out[rows] = self._forward(self._edges(data), len(rows))[:, -1]
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self._forward_long(self._marked(w))[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all words, counts times each."""
        out = np.zeros(self.none + 1)
        for rows, data in self.groups(words):
            edges = self._edges(data)
            alpha = self._forward(edges, len(rows))
            beta = np.full(alpha.shape, -np.inf)
            beta[:, -1] = 0
            for j in range(len(edges), 0, -1):
                ids = edges[j - 1]
                lo = j - ids.shape[1]
                through = self.logp[ids] + beta[:, j : j + 1]
                beta[:, lo:j] = np.logaddexp(beta[:, lo:j], through)
                share = np.exp(alpha[:, lo:j] + through - alpha[:, -1:]) * counts[rows][:, None]
                out += np.bincount(ids.ravel(), share.ravel(), len(out))
        for w, n in zip(words, counts, strict=True):
            if len(w) < LONG:
                continue
            data = self._marked(w)
            alpha = self._forward_long(data)
            beta = np.full(len(alpha), -np.inf)
            beta[-1] = 0
            for lo, edges in self._chunks(data, backward=True):
                for j in range(lo + len(edges), lo, -1):
                    ids = edges[j - lo - 1][0]
                    at = slice(j - len(ids), j)
                    through = self.logp[ids] + beta[j]
                    beta[at] = np.logaddexp(beta[at], through)
                    np.add.at(out, ids, np.exp(alpha[at] + through - alpha[-1]) * n)
        return out[:-1]


_RAW = _BYTE.copy()
_RAW[65:91] = mix(np.arange(65, 91, dtype=np.uint64)) | U(1)


def _held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c (in training documents), t (in all), over whole texts; documents and tokens of training in the row with a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest, ends = Counter(), Counter(), 0

        def out() -> pa.RecordBatch:
            nonlocal ends
            both = list({**train, **rest})
            c = [train[w] for w in both]
            got = pa.RecordBatch.from_arrays([pa.array([*both, None], pa.binary()), pa.array([*c, ends], pa.int64()), pa.array([*map(lambda w, x: x + rest[w], both, c), 0], pa.int64())], ["word", "c", "t"])
            train.clear()
            rest.clear()
            ends = 0
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _held_out(doc):
                    rest.update(_words(text))
                else:
                    train.update(_words(text))
                    ends += 1
            if len(train) + len(rest) > 200_000:
                yield out()
        yield out()

    return docs.mapInArrow(lean(run), "word binary, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fit(words: DataFrame, names: list[bytes], ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log piece probabilities.  words: word, c.  The end counts once for each training document.

    What comes back from a round is one number for each piece of the vocabulary.
    """
    start = 1.0 / (np.arange(len(names)) + 100.0)
    p = start / start.sum()
    for _ in range(rounds):
        logp = np.log(p)

        def run(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(names, logp), np.zeros(len(names))
            for t in _gathered(batches):
                total += lattice.expected(t.column(0).to_pylist(), t.column(1).to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

        got = words.where("c > 0").select("word", "c").mapInArrow(lean(run), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(len(names))
        for r in got:
            uses[r["piece"]] = r["uses"]
        uses[-1] = ends
        p = (uses + 0.1) / (uses + 0.1).sum()
    return np.log(p)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the whole texts of documents whose crc32(id as text) mod 5 is not 1 (null id:
    empty text).  Words are split at ASCII white space, A-Z folded, and the end is one token.
    base_score adds one half to each training count; score is log10 of the lattice model's
    probability.  Words among the ``common`` most frequent at most are scored where the text
    is, all others by a join; both are exact.  Repeated ids give a row each.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lattice")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = scratch.save(word_counts(docs), "counts")
    scratch.drop()
    total = counted.agg(F.sum("c"), F.coalesce(F.sum(F.expr("CASE WHEN word IS NULL THEN c END")), F.lit(0)), F.sum(F.expr("CASE WHEN c > 0 AND word IS NOT NULL THEN 1 ELSE 0 END"))).first()
    tokens, ends = int(total[0] or 0), int(total[1])
    kinds = int(total[2] or 0) + (ends > 0)
    below = tokens + 0.5 * (kinds + 1)
    words = counted.where("word IS NOT NULL")
    names = pieces(path)
    logp = fit(words, names, ends, rounds)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names, logp)
        for t in _gathered(batches):
            c = t.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [t.column(0).combine_chunks(), pa.array(c > 0), pa.array(np.log10((c + 0.5) / below)), pa.array(lattice.marginals(t.column(0).to_pylist()) / LOG10), t.column(2).combine_chunks()],
                ["word", "known", "base", "model", "t"],
            )

    weighed = scratch.save(words.select("word", "c", "t").mapInArrow(lean(weigh), "word binary, known boolean, base double, model double, t long"), "weights")
    scratch.drop(counted)
    # the most frequent words: the largest whole classes of frequency that hold no more than ``common``
    level = F.floor(32 * F.log2("t")).alias("level")
    room, least = common, None
    for r in weighed.groupBy(level).count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    top = weighed.where(level >= least).collect() if least is not None else []
    shared = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([(r["known"], r["base"], r["model"]) for r in top] or np.zeros((0, 3)))))
    end_base, end_model = float(np.log10((ends + 0.5) / below)), float(logp[-1] / LOG10)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, values = shared.value
        get, row = place.get, TaskContext.get().partitionId() << 33
        rare = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = _words(text)
                at = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
                known, base, model = values[at[at >= 0]].sum(axis=0) if len(values) else (0, 0, 0)
                other = Counter(ws[i] for i in np.flatnonzero(at < 0).tolist())
                new = (row, doc, _held_out(doc), len(ws) + 1, int(known) + (ends > 0), base + end_base, model + end_model, [{"word": w, "n": n} for w, n in other.items()])
                for c, x in zip(cols, new, strict=True):
                    c.append(x)
                row += 1
            kinds_ = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"])

    rows = scratch.save(docs.mapInArrow(lean(local), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word:binary,n:long>>"), "rows")
    spread = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    part = spread.join(weighed.select("word", "known", "base", "model"), "word")
    sums = part.groupBy("row").agg(F.sum(F.expr("CASE WHEN known THEN n ELSE 0 END")).alias("k"), F.sum(F.expr("n * base")).alias("b"), F.sum(F.expr("n * model")).alias("m"))
    zero = F.lit(0)
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("m", zero)).alias("score"),
    )


def op8_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; odd input as in ``score``."""
    from ._tokens import vocabulary

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))
