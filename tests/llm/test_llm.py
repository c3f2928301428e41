import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hamming, importance, lattice, licenses, minhash, mixing, packing, passages, quality_rules, token_files
from millrace.llm._cluster import components
from millrace.llm._store import Scratch
from millrace.llm._tokens import Encoder, vocabulary
from millrace.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, key string, size long, words int"
ODD = ["", None, " \n\t ", "one", "one two", "x " * 3000, "Ünïcode wörds hier. " * 30, "a\tb\nc", "same text here to see " * 9, "same text here to see " * 9, "zero\x00byte", "cc by cc by, all rights  reserved"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None if i % 3 else "s", None, 1, "k", 2, 3) for i, t in enumerate(ODD)]
    rows += [(None, "null id text", "en", "b", 3, None, None, None, None), (4, ODD[4], "en", "b", 3, 1, "k", 2, 3), (4, "another text of this id", "en", "b", 3, 1, "k", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, same, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def operators(spark):
    return {
        "near": lambda d: minhash.near_duplicates(d),
        "one": lambda d: minhash.one_of_each(d),
        "rules": lambda d: quality_rules.assess(d),
        "keep": lambda d: quality_rules.keep(d),
        "repeats": lambda d: passages.repeats(d),
        "strip": lambda d: passages.strip(d),
        "mix": lambda d: mixing.mix(d, [5, 2, 1], 1.5, 2),
        "repeat": lambda d: mixing.repeat(d, [5, 2, 1], 1.5, 2),
        "pack": lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json"), 0),
        "scan": lambda d: licenses.scan(d),
        "resample": lambda d: importance.resample(d, [1, 2], 0.5),
        "score": lambda d: lattice.score(d, vocabulary("piece_bpe_32k.model")),
    }


ONE_ROW_EACH = {"near", "rules", "mix", "scan", "resample", "score"}
SAME_COLUMNS = {"one", "keep", "strip", "repeat"}


@pytest.mark.parametrize("name", ["near", "one", "rules", "keep", "repeats", "strip", "mix", "repeat", "pack", "scan", "resample", "score"])
def test_odd_and_empty_tables(spark, odd, name):
    f = operators(spark)[name]
    got = f(odd).collect()
    if name in ONE_ROW_EACH:
        assert len(got) == odd.count()
    empty = f(odd.limit(0))
    assert empty.count() == 0
    if name in SAME_COLUMNS:
        assert empty.columns == odd.columns


@pytest.mark.parametrize("per_task", [9, 40, 200_000])
def test_components_against_union_find(spark, per_task):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(12), Scratch(spark, "t"), len(edges), per_task).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def _sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def test_hot_group_of_near_copies(spark):
    """A large group whose members differ by many, few or no words: same components as brute force."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle=3, percent=85).collect()}
    sets, comp = _sets(texts, 3), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert got == dict(enumerate(comp))


def test_quality_counts(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.assess(docs).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = collections.Counter(windows)
        cover = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[d][k] for k in quality_rules.BASE) == want
        assert got[d]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = quality_rules.assess(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = found.agg(F.avg(F.expr("int(kept = (quality = 1))")), F.avg(F.expr("CASE WHEN quality = 1 AND NOT base_failed THEN int(kept) END"))).first()
    assert r[0] > 0.95 and r[1] > 0.98


def test_passages_against_brute_force(spark, docs):
    got = {(r["doc_id"], r["paragraph"], r["first_doc_id"], r["first_paragraph"]) for r in passages.repeats(docs).collect()}
    units = [(d, n, t[s:e]) for d, t in docs.select("doc_id", "text").collect() for n, (s, e) in enumerate(passages.paragraphs(t or "")) if len(t[s:e].encode().split()) >= passages.LEAST]
    sets, comp = _sets([u[2] for u in units], 5), list(range(len(units)))
    for i in range(len(units)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    groups = collections.defaultdict(list)
    for u, c in zip(units, comp, strict=True):
        groups[c].append(u[:2])
    assert got == {(*u, *min(g)) for g in groups.values() if len(g) > 1 for u in g}


def _hosts(n, seed):
    rng = random.Random(seed)
    return [[f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 90))] for _ in range(n)]


PASSAGE = [f"p{i}" for i in range(60)]


@pytest.mark.parametrize("size", [50, 55, 60])
def test_passages_in_mid_line(spark, size):
    """A passage without sentence marks inside lines of unlike words."""
    rows = [(i, " ".join([*a, *PASSAGE[:size], *b])) for i, (a, b) in enumerate(zip(_hosts(6, 1), _hosts(6, 2), strict=True))]
    docs = spark.createDataFrame([*rows, (9, " ".join(_hosts(1, 3)[0]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.spans(docs).collect()}
    assert {d: (rows[d][1][r["start"] : r["end"]].split(), r["n_words"], r["first_doc_id"], r["removed"]) for d, r in got.items()} == {d: (PASSAGE[:size], size, 0, d > 0) for d in range(6)}
    assert all(r["first_start"] == got[0]["start"] for r in got.values())
    left = {r["doc_id"]: r["text"] for r in passages.strip(docs).collect()}
    assert left[0] == rows[0][1] and left[3] == rows[3][1].replace(" ".join(PASSAGE[:size]) + " ", "")


def test_passages_in_short_lines(spark):
    """60 words in lines of 8, 7 and 11 words."""
    rows = []
    for i, (n, a, b) in enumerate(zip([8, 7, 11], _hosts(3, 4), _hosts(3, 5), strict=True)):
        lines = [" ".join(PASSAGE[k : k + n]) for k in range(0, 60, n)]
        rows.append((i, "\n".join([" ".join(a), *lines, " ".join(b)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: rows[r["doc_id"]][1][r["start"] : r["end"]].split() for r in passages.spans(docs).collect()}
    assert got == {i: PASSAGE for i in range(3)}
    left = {r["doc_id"]: r["text"] for r in passages.strip(docs).collect()}
    assert left[0] == rows[0][1] and left[1].split("\n") == [rows[1][1].split("\n")[k] for k in (0, -1)]


def test_spans_against_brute_force(spark, docs, odd):
    for table in (docs, odd):
        rows = [r for r in table.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
        places = collections.defaultdict(set)
        low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        for d, t in rows:
            w = [x.translate(low) for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
            for i in range(len(w) - 49):
                places[tuple(w[i : i + 50])].add((d, t, i))
        want = collections.defaultdict(set)
        for where in places.values():
            if len(where) > 1:
                for d, t, i in where:
                    want[d, t] |= set(range(i, i + 50))
        got = collections.defaultdict(set)
        for r in passages.spans(table).collect():
            for d, t in rows:
                if d == r["doc_id"] and t and r["end"] <= len(t):
                    a = len(re.findall(r"[^\x20\x09-\x0D]+", t[: r["start"]]))
                    if len(re.findall(r"[^\x20\x09-\x0D]+", t[r["start"] : r["end"]])) == r["n_words"]:
                        got[d, t] |= set(range(a, a + r["n_words"]))
        assert got == want


def test_repeated_ids_keep_their_own_texts(spark):
    """Two rows of one id: only the one that repeats another document's paragraph loses it."""
    line = " ".join(f"a{i}" for i in range(30))
    rows = [(1, f"{line}\n{_hosts(1, 6)[0][0]}"), (2, f"{line}\nown words here"), (2, " ".join(_hosts(1, 7)[0])), (2, "short")]
    got = sorted(r["text"] for r in passages.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[0][1], "own words here", rows[2][1], "short"])


def test_paragraphs_cover_the_text():
    t = "A b. C d!  E f\n\ng h. "
    assert "".join(t[s:e] for s, e in passages.paragraphs(t)) == t.replace("\n", "")


def test_encoder_equals_library():
    texts = [*ODD, "a  b", " lead", "trail ", "x <|endoftext|> y", "it's Σας ΟΔΟΣ 3rd", "one\x1ctwo \x85 z"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(vocabulary(name))
        for got, want in zip(e.ids(texts, 7), e.raw([t or "" for t in texts]), strict=True):
            assert got.tolist() == [*want, 7]


def test_encoder_joins_words():
    rng = random.Random(5)
    letters = "abcXYZéüßİŉ'_-–.,!?#$%0123²\n\t\u0301😀日Ж\u1112"
    words = ["".join(rng.choices(letters if rng.random() < 0.5 else "abcxyÀé.,\n", k=rng.randint(1, 9))) for _ in range(1500)]
    words += ["don't", "x<|endoftext|>y", "a" * 5000, "'s"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 60]))) for _ in range(300)]
    texts += [" ".join(rng.choices([w for w in words if w.strip() == w], k=60)) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(vocabulary(name))
        for i in range(0, len(texts), 100):
            for got, want in zip(e.ids(texts[i : i + 100], 7), e.raw(texts[i : i + 100]), strict=True):
                assert got.tolist() == [*want, 7]


def test_windows():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(200)]
    found = packing.windows(sizes, 128)
    assert sorted(i for w in found for i in w) == list(range(200))
    assert all(sum(sizes[i] for i in w) <= 128 for w in found)
    assert len(found) <= 1.1 * sum(sizes) / 128
    with pytest.raises(ValueError):
        packing.windows([129], 128)


def test_sequences(spark, docs):
    """No gap, no overlap, no sequence over the capacity, digests of what was stored, little padding."""
    rows = packing.pack(docs.coalesce(1), vocabulary("byte_bpe_50k.json"), 0, capacity=256, piece=64).collect()
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]] and r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 256 and sum(at.values()) > 0.95 * 256 * len(at)
    totals = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(totals.values()) == sum(at.values())


def test_difference_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 1000) for _ in range(400)]
    sums = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 10)]
    assert max(sums) - min(sums) < 30 and sum(sums) == sum(sizes)


def test_pack_and_token_files_round_trip(spark, docs, tmp_path):
    texts = {d: t or "" for d, t in docs.select("doc_id", "text").collect()}
    raw = Encoder(vocabulary("byte_bpe_50k.json")).raw
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0).collect()
    whole = collections.defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] * 4 == len(whole[r["doc_id"]])
        whole[r["doc_id"]] += bytes(r["ids"])
    assert {d: np.frombuffer(b, "<u4").tolist() for d, b in whole.items()} == {d: [*raw([t])[0], 0] for d, t in texts.items()}
    raw = Encoder(vocabulary("word_bpe_49k.json")).raw
    target = f"file://{tmp_path}/set"
    token_files.write_ids(docs, target, vocabulary("word_bpe_49k.json"), 1)
    at = 0
    for r in token_files.starts(token_files.read_ids(spark, target)).orderBy("doc_id").collect():
        want = [*raw([texts[r["doc_id"]]])[0], 1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["start"] == at
        at += len(want)


def test_token_files_keep_all_bytes_and_order(spark, tmp_path):
    blobs = [(bytes([i, 255 - i, 10, 13, 0]) * 3,) for i in range(256)]
    token_files._write(spark.createDataFrame(blobs, "b binary").coalesce(1), f"file://{tmp_path}/raw")
    got = spark.read.format("binaryFile").load(f"file://{tmp_path}/raw").first()["content"]
    assert bytes(got) == b"".join(b + b"\n" for b, in blobs)
    rows = [(n, n * 10 + i, i, 1) for n in (5, 100_000, 99_999) for i in range(2)]  # by number, not by name
    found = token_files.starts(spark.createDataFrame(rows, "part long, doc_id long, start long, n_tokens long")).orderBy("doc_id").collect()
    assert [r["start"] for r in found] == list(range(6))
    with pytest.raises(Exception, match="doesn't fit"):
        token_files.write_ids(spark.createDataFrame([(1, "word")], "doc_id long, text string"), f"file://{tmp_path}/w", vocabulary("word_bpe_49k.json"), 1, width=1)


def test_token_files_of_odd_tables(spark, odd, tmp_path):
    for n, df in enumerate((odd, odd.limit(0))):
        target = f"file://{tmp_path}/{n}"
        token_files.write_ids(df, target, vocabulary("word_bpe_49k.json"), 1)
        if n == 0:
            assert token_files.starts(token_files.read_ids(spark, target)).count() == df.count()


def test_flow_prefers_first_uses_and_fills_quotas():
    got = mixing.flow([100, 50, 10], [[0], [0, 1], [1]], [120, 60], [0, 1])
    assert [sum(g.get(j, 0) for g in got) for j in (0, 1)] == [120, 60]
    assert sum(max(0, sum(g.values()) - s) for g, s in zip(got, [100, 50, 10], strict=True)) == 20  # only what is wanted beyond all sizes is repeated


def test_flow_against_brute_force():
    """Flow and cost equal those of cheapest augmenting paths, found token by token."""
    rng = random.Random(8)
    for _ in range(60):
        n, m = rng.randrange(1, 6), rng.randrange(1, 4)
        sizes = [rng.randrange(0, 5) for _ in range(n)]
        members = [sorted(rng.sample(range(m), rng.randrange(1, m + 1))) for _ in range(n)]
        wanted = [rng.randrange(0, 9) for _ in range(m)]
        got = mixing.flow(sizes, members, wanted, [0, 1])
        for i, g in enumerate(got):
            assert sum(g.values()) <= 2 * sizes[i] and set(g) <= set(members[i]) and min(g.values(), default=0) >= 0
        assert all(sum(g.get(j, 0) for g in got) <= w for j, w in enumerate(wanted))
        best = []
        for uses in (1, 2):  # most tokens that so many uses can bring, over all sets of sources
            best.append(min(sum(wanted[j] for j in range(m) if not (cut >> j) & 1) + sum(uses * s for s, own in zip(sizes, members, strict=True) if any((cut >> j) & 1 for j in own)) for cut in range(1 << m)))
        assert sum(sum(g.values()) for g in got) == best[1]
        assert sum(max(0, sum(g.values()) - s) for g, s in zip(got, sizes, strict=True)) == best[1] - best[0]


def test_mix_meets_targets_with_overlapping_sources(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice([["a"], ["b"], ["a", "b"], [None]])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), [5, 2, 1], 1.5, 2)
    assert got.where("taken > 2 * size").isEmpty()
    r = got.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(r[0] - 1.5 * r[1]) < 100


def test_lattice_against_brute_force():
    names = [b"\xffa", b"ab", b"\xffab", b"c", b"bc", *[bytes([i]) for i in range(256) if i != 99], b""]
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(len(names))))
    p = dict(zip(names[:-1], np.exp(logp), strict=False))
    model = lattice.Lattice(names, logp)
    for word in (b"a", b"abc", b"abcabc", b"zz"):
        x = b"\xff" + word
        ways = [1.0] + [0.0] * len(x)
        for j in range(1, len(x) + 1):
            ways[j] = sum(ways[i] * p.get(x[i:j], 0) for i in range(j))
        assert math.isclose(model.marginals([word])[0], math.log(ways[-1]), rel_tol=1e-9)
    uses = model.expected([b"abc", b"ab"], np.array([2.0, 1.0]))
    length = np.array([len(n) for n in names])
    assert math.isclose((uses * length).sum(), 2 * 4 + 3)  # every byte is covered once


def test_lattice_of_long_words(monkeypatch):
    """Gone through in parts or at once: the same marginals and expected uses; a blank-free text of 300 KB goes through."""
    names = [b"\xffa", b"ab", b"abab", b"\xffab", b"c", b"bc", b"cab", *[bytes([i]) for i in range(256) if i != 99], b""]
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(names))))
    model = lattice.Lattice(names, logp)
    words, counts = [b"ab" * 30 + b"c", b"abcab" * 21, b"cc"], np.array([1.0, 3.0, 2.0])
    whole = model.marginals(words), model.expected(words, counts)
    monkeypatch.setattr(lattice, "LONG", 7)
    parts = model.marginals(words), model.expected(words, counts)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
    monkeypatch.undo()
    assert model.marginals([b"abc" * 100_000])[0] < -1000


def test_quality_model_against_numpy(spark, docs):
    """Rules vote, expectation-maximisation and posterior, written a second time without Spark's expressions."""
    rows = quality_rules.features(docs.select("doc_id", "text")).select("doc_id", *quality_rules.PARTS).toPandas()
    env = rows.astype({c: float for c in quality_rules.PARTS})

    def holds(rule):
        rule = re.sub(r"(\w+) BETWEEN (.+) AND (.+)", r"((\1 >= \2) & (\1 <= \3))", rule)
        parts = [f"({x.replace(' = ', ' == ')})" for x in re.split(r" AND | OR ", rule)]
        return env.eval((" & " if " AND " in rule else " | ").join(parts)).to_numpy()

    votes = np.stack([np.where(holds(bad), -1, np.where(holds(good), 1, 0)) for bad, good in quality_rules.RULES.values()], 1)
    k = votes.shape[1]
    p, g, b = 0.8, np.full(k, 0.998), np.full(k, 0.3)

    def posterior():
        odds = np.log(p / (1 - p)) + np.where(votes == 1, np.log(g / (1 - b)), np.where(votes == -1, np.log((1 - g) / b), 0)).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(quality_rules.ITERATIONS):
        q = posterior()
        p = np.clip(q.mean(), *quality_rules.PRIOR_RANGE)
        g, b = (np.array([np.clip((1 + w[votes[:, j] == hit].sum()) / (2 + w[votes[:, j] != 0].sum()), *fence) for j in range(k)]) for hit, w, fence in ((1, q, quality_rules.GOOD_RANGE), (-1, 1 - q, quality_rules.BAD_RANGE)))
    want = dict(zip(rows["doc_id"], posterior(), strict=True))
    got = quality_rules.assess(docs).collect()
    assert all(abs(r["p_quality"] - want[r["doc_id"]]) < 2e-6 for r in got)
    assert all(r["kept"] == (not r["base_failed"] and want[r["doc_id"]] >= quality_rules.LEAST) for r in got)


def test_importance_against_counters(spark, docs):
    """Bucket counts, log ratios, weights and the chosen rows from Counters of words and word pairs."""
    targets, buckets = [d for d in range(0, 120, 3)], 512
    texts = {r["doc_id"]: [w.decode("utf-8", "surrogateescape") for w in (r["text"] or "").encode().lower().split()] for r in docs.select("doc_id", "text").collect()}

    def bucket(text):
        return int(next(importance._features(importance.pa.array([text]), buckets))[0][-1])

    known = {}
    bags = {}
    for d, ws in texts.items():
        grams = [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]
        bags[d] = collections.Counter(known.setdefault(x, bucket(x)) if x not in known else known[x] for x in grams)
    raw, good = collections.Counter(), collections.Counter()
    for d, bag in bags.items():
        raw.update(bag)
        if d in targets:
            good.update(bag)
    n, m = sum(raw.values()) + buckets, sum(good.values()) + buckets
    weight = {d: sum(c * (math.log((good[x] + 1) / m) - math.log((raw[x] + 1) / n)) for x, c in bag.items()) for d, bag in bags.items()}
    got = {r["doc_id"]: r for r in importance.resample(docs, targets, 0.3, buckets=buckets).collect()}
    for d, bag in bags.items():
        assert got[d]["n_features"] == sum(bag.values()) and math.isclose(got[d]["log_weight"], weight[d], rel_tol=1e-9, abs_tol=1e-9)
    order = sorted(got.values(), key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["kept"] for r in order] == [i < round(0.3 * len(order)) for i in range(len(order))]
    noise = np.array([r["key"] - r["log_weight"] for r in got.values()])
    assert abs(noise.mean() - 0.5772) < 0.4 and abs(noise.std() - 1.2825) < 0.4  # as of a Gumbel variable


def test_license_base_against_regex(spark):
    rng = random.Random(12)
    bits = ["CC", "by", "-", "general", "Public", "license", "all", "rights", "reserved", " ", "\n", ",", "x1", "Ü"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randrange(60)))) for i in range(400)]
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
        want = sorted((n, label) for phrase, label in base.items() for n in range(len(ws)) if ws[n : n + len(phrase.split())] == phrase.split())
        assert got[i]["n_words"] == len(ws) and [(p["start"], p["label"]) for p in got[i]["places"]] == want


def test_lattice_base_scores(spark, docs):
    rows = [(d, (t or "").encode().lower().split()) for d, t in docs.select("doc_id", "text").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = collections.Counter(w for d, ws in rows if not held[d] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    for common in (0, 10, 100_000):
        got = {r["doc_id"]: r for r in lattice.score(docs, vocabulary("piece_bpe_32k.model"), common=common, rounds=1).collect()}
        for d, ws in rows:
            want = sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[w] for w in ws), ends])
            assert math.isclose(got[d]["base_score"], want, rel_tol=1e-9)
            assert got[d]["n_known"] == sum(c[w] > 0 for w in ws) + 1 and got[d]["held_out"] == held[d] and got[d]["train_tokens"] == n


def test_license_templates():
    def labels(text):
        return {a.label for a in map(lambda t: licenses.Automaton(*t), licenses.TEMPLATES) if a.matches(licenses.split_words(text))}

    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("released under the terms of some MIT-like license") == set()
    assert labels("Licensed under the Apache License, Version 2.0") == {"apache-2.0"}
    assert labels("Licensed under the Apache License, Version 3.0") == set()
    assert "cc-by-nc-4.0" in labels("LICENSED under CC-BY-NC 4.0!")
    assert labels("This is free and unencumbered software released into the public domain.") == {"unlicense"}


def test_license_places(spark):
    df = spark.createDataFrame([(1, "CC-BY, cc by. All rights\nreserved; cc  byx"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [(p["label"], p["start"]) for p in got[1]["places"]] == [("cc-by", 0), ("cc-by", 2), ("reserved", 4)] and got[1]["n_words"] == 9 and got[2]["n_words"] == 0


def test_importance_cut_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0.5, 1.0, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    for k in (0, 1, 700, 2999, 3000):
        got = {r["doc_id"] for r in importance.cut_off(df, k, None).where("kept").collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_importance_finds_labelled_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = importance.op1_importance_resampling(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = {r[0]: r[1] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert r[1] > 0.95 and r[0] < 0.1


def test_hamming_odd_rows(spark):
    rows = [(i, [1.0 if (i >> b) & 1 else -1.0 for b in range(64)]) for i in range(40)] + [(None, [1.0] * 64), (41, None), (42, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select(F.col("vec_id").alias("id"), hamming.sign_code("e").alias("code"))
    got = hamming.search(df, df.where("id % 10 = 0"), 3).collect()
    codes = {i: i for i in range(40)} | {42: 0}
    want = {(q, n + 1, i, d) for q in (0, 10, 20, 30) for n, (d, i) in enumerate(sorted((bin(codes[q] ^ c).count("1"), i) for i, c in codes.items())[:3])}
    assert {tuple(r) for r in got} == want
    assert hamming.search(df.limit(0), df.limit(0), 3).count() == 0


def test_hamming_compares_what_coverage_asks_for():
    """Over clustered codes few are compared; over random ones, where the k nearest are far, still not all."""
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 1 << 63, 200, np.uint64)
    near = np.unique(np.repeat(heads, 20) ^ (np.uint64(1) << rng.integers(0, 64, 4000, np.uint64)))
    for codes, most in ((near, 0.02), (np.unique(rng.integers(0, 1 << 64, 4000, np.uint64)), 0.6)):
        index = hamming.Index(codes, np.ones(len(codes), np.int64))
        for q in codes[:50]:
            place, apart = index.nearest(q, 5, 64)
            d = np.bitwise_count(codes ^ q)
            last = np.sort(d)[4]
            assert sorted(place) == np.flatnonzero(d <= last).tolist() and (apart == d[place]).all()
            assert sorted(index.nearest(q, 5, 3)[0]) == np.flatnonzero(d <= min(3, last)).tolist()
        assert index.compared < most * 50 * 2 * len(codes)


def test_hamming_blocks(spark, monkeypatch):
    """Many shards and query blocks, hot codes, near clusters and far strays: same as brute force."""
    monkeypatch.setattr(hamming, "SHARD", 50)
    monkeypatch.setattr(hamming, "LEAST_SHARD", 20)
    monkeypatch.setattr(hamming, "QUERIES", 7)
    rng = random.Random(9)
    heads = [rng.getrandbits(64) for _ in range(6)]
    codes = [heads[0]] * 60 + [rng.choice(heads) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)] + [rng.getrandbits(64) for _ in range(240)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {tuple(r) for r in hamming.search(df, df.where("id % 10 = 0"), 5).collect()}
    want = {(q, n + 1, i, d) for q in range(0, 600, 10) for n, (d, i) in enumerate(sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:5])}
    assert got == want


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = Scratch(spark, "t").save(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.select("doc_id").distinct().count() <= ids
    assert p.STAGES[-1][1](spark, docs, SF).count() > 0
