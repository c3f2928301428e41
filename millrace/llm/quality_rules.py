"""Quality rules as weak supervision, in DataFrame and SQL functions only.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the counts
of vote patterns (at most 3 to the number of rules, whatever the corpus) estimates each
rule's accuracy on good and on bad documents; the posterior probability of good decides.
Nothing but these counts is shuffled, and texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch

WINDOW = 8
ITERATIONS = 25
LEAST = 0.5
#: A rule is written to fire on few good documents; the bound keeps the two classes from turning into, say, long and short texts.
GOOD_RANGE, BAD_RANGE, PRIOR_RANGE = (0.996, 0.9999), (0.02, 0.98), (0.05, 0.95)
#: name: (bad if, good if); ratios in whole numbers so that every engine agrees
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "duplicate_lines": ("n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "runs": ("5 * n_runs > n_words", "100 * n_runs <= 3 * n_words"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    "capitals": ("2 * n_upper > word_chars", "5 * n_upper <= word_chars"),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PARTS = [*BASE, "n_lines", "n_runs", "n_upper"]


def _repeat_words(h: str) -> str:
    """Words covered by windows whose hash occurs twice or more: sort (hash, place), mark equal neighbours, add up uncovered words."""
    return f"""
    aggregate(
      array_sort(transform(filter(element_at(transform(array(array_sort(transform({h}, (x, i) -> struct(x AS x, i AS i)))), s ->
        zip_with(
          zip_with(s, concat(array(CAST(NULL AS struct<x: bigint, i: int>)), slice(s, 1, size(s) - 1)), (a, b) -> struct(a.x AS x, a.i AS i, b.x AS before)),
          slice(s, 2, size(s)), (a, b) -> struct(a.i AS i, coalesce(a.x = a.before, false) OR coalesce(a.x = b.x, false) AS twice))
      ), 1), t -> t.twice), t -> t.i)),
      struct(0L AS n, -{WINDOW} AS last),
      (acc, i) -> struct(acc.n + least({WINDOW}, i - acc.last) AS n, i AS last),
      acc -> acc.n)"""


def features(texts: DataFrame) -> DataFrame:
    """Adds the counts in PARTS to a frame with a column text; other columns of these names are replaced.

    8-word windows are compared by 64-bit hashes within one text.
    """
    without = "text"
    for symbol in "#*$%&|<>":
        without = f"replace({without}, '{symbol}', '')"
    df = texts.withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("_words", F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)"))
    df = df.withColumn("_lines", F.expr(r"filter(split(text, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"))
    df = df.withColumn("_h", F.expr(f"CASE WHEN size(_words) > {WINDOW} THEN transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) ELSE array() END"))
    return df.withColumns(
        {
            "n_words": F.expr("CAST(size(_words) AS bigint)"),
            "word_chars": F.expr("CAST(length(array_join(_words, '')) AS bigint)"),
            "n_symbols": F.expr(f"CAST(length(text) - length({without}) AS bigint)"),
            "n_dup_lines": F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS bigint)"),
            "n_repeat_words": F.expr(f"CASE WHEN size(array_distinct(_h)) < size(_h) THEN {_repeat_words('_h')} ELSE 0L END"),
            "n_lines": F.expr("CAST(size(_lines) AS bigint)"),
            "n_runs": F.expr("CAST(size(filter(zip_with(slice(_words, 1, greatest(size(_words) - 1, 0)), slice(_words, 2, size(_words)), (a, b) -> a = b), x -> x)) AS bigint)"),
            "n_upper": F.expr(r"CAST(length(text) - length(regexp_replace(text, r'[A-Z\u00C0-\u00DE\u0391-\u03A9\u0410-\u042F]', '')) AS bigint)"),
        }
    ).drop("_words", "_lines", "_h")


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
VOTES = "array(" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values()) + ")"


def _posterior(m: str, v: str) -> str:
    return f"""(1D / (1D + exp(-aggregate(
      zip_with({v}, zip_with({m}.g, {m}.b, (g, b) -> struct(g AS g, b AS b)), (x, a) -> CASE x WHEN 1 THEN ln(a.g / (1D - a.b)) WHEN -1 THEN ln((1D - a.g) / a.b) ELSE 0D END),
      ln({m}.p / (1D - {m}.p)), (s, x) -> s + x))))"""


def fit(df: DataFrame, iterations: int = ITERATIONS) -> str:
    """The model as a SQL struct literal: prior p, accuracies g on good and b on bad documents.

    df has the columns PARTS.  An empty frame gives the prior model.
    """
    n = len(RULES)
    total = lambda x: f"aggregate(w, 0D, (s, t) -> s + {x})"
    rate = lambda hit, weight, low, high: f"least({high}D, greatest({low}D, (1D + {total(f'CASE WHEN t.v[j] = {hit} THEN {weight} ELSE 0D END')}) / (2D + {total(f'CASE WHEN t.v[j] <> 0 THEN {weight} ELSE 0D END')})))"
    step = f"""element_at(transform(array(transform(patterns, t -> struct(t.v AS v, CAST(t.n AS double) AS n, t.n * {_posterior('m', 't.v')} AS q))), w -> named_struct(
      'p', CASE WHEN size(w) = 0 THEN m.p ELSE least({PRIOR_RANGE[1]}D, greatest({PRIOR_RANGE[0]}D, {total('t.q')} / {total('t.n')})) END,
      'g', transform(sequence(0, {n - 1}), j -> {rate(1, 't.q', *GOOD_RANGE)}),
      'b', transform(sequence(0, {n - 1}), j -> {rate(-1, '(t.n - t.q)', *BAD_RANGE)}))), 1)"""
    start = f"named_struct('p', 0.8D, 'g', array_repeat(0.998D, {n}), 'b', array_repeat(0.3D, {n}))"
    patterns = df.select(F.expr(VOTES).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    row = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns")).select(F.expr(f"aggregate(sequence(1, {iterations}), {start}, (m, k) -> {step})").alias("m")).first()["m"]
    numbers = lambda x: "array(" + ", ".join(f"{v!r}D" for v in x) + ")"
    return f"named_struct('p', {row['p']!r}D, 'g', {numbers(row['g'])}, 'b', {numbers(row['b'])})"


def verdict(df: DataFrame, model: str) -> DataFrame:
    """Adds base_failed, p_quality (posterior probability of good) and kept to a frame with PARTS."""
    p = _posterior(model, VOTES)
    return df.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("p_quality", F.expr(p)).withColumn("kept", F.expr(f"NOT base_failed AND p_quality >= {LEAST}D"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, p_quality (rounded to 6 places), kept.

    Null and empty texts count as no words (base_failed).  Ids may be null or repeat; each row is judged by itself.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", *PARTS)
    rows = scratch.save(rows, "counts")
    out = verdict(rows, fit(rows))
    return out.select("doc_id", *BASE, "base_failed", F.round("p_quality", 6).alias("p_quality"), "kept")


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Rows and their counts are written once to the shared folder, so counts aren't taken twice
    and texts are never shuffled.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("text"))
    rows = Scratch(docs.sparkSession, "quality").save(features(packed).select("_row", *PARTS), "rows")
    return verdict(rows, fit(rows)).where("kept").select("_row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; odd input as in ``assess``."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
