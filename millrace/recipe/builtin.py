"""The built-in plugins: images, audio, tables, texts."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import rank
from ..media import corruptions, pixels
from ..operators import features, filters, generation, media, reports
from ..operators.splits import SPLIT
from ..sinks.writers import png
from ..sources import media as media_sources
from ..sources import readers
from .registry import OpSpec, Param, Plugin, by_name

_NUM = (int, float)
STOPWORDS = {"english": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with"]}


def opt(kinds: type | tuple = object) -> Param:
    return Param(kinds, needed=False)


# filters ------------------------------------------------------------------------------------


def _per_class(df, p, ctx, n):  # noqa: ANN001, ANN202
    return filters.sample_per_class(df, "record_id", ctx.label, n, ctx.seed, p.get("label"), p.get("exclude_already_labeled"))


def _fractional(df, p, ctx):  # noqa: ANN001, ANN202
    return filters.sample_per_class_fractional(df, "record_id", ctx.label, p["n_per_class_base"], p.get("fractions") or {}, ctx.seed, tag=p.get("label"), exclude=p.get("exclude_already_labeled"))


LABEL = OpSpec("filter_by_label", "Filters", lambda df, p, ctx: filters.filter_by_label(df, ctx.label, p["labels"], p["action"]), {"labels": Param(list), "action": Param(str)})
SAMPLE = OpSpec("random_sample", "Filters", lambda df, p, ctx: filters.random_sample(df, "record_id", ctx.seed, p.get("n"), p.get("fraction")), {"n": opt(int), "fraction": opt(_NUM)})
FILTERS = [
    LABEL,
    SAMPLE,
    OpSpec("sample_per_class", "Filters", lambda df, p, ctx: _per_class(df, p, ctx, p["n_per_class"]), {"n_per_class": Param(int), "label": opt(str), "exclude_already_labeled": opt(list)}),
    OpSpec("sample_per_class_fractional", "Filters", _fractional, {"n_per_class_base": Param(int), "fractions": opt(dict), "label": opt(str), "exclude_already_labeled": opt(list)}),
    OpSpec("drop_by_label", "Filters", lambda df, p, ctx: filters.drop_by_label(df, p["labels"]), {"labels": Param(list)}),
]
TABLE_FILTERS = [
    SAMPLE,
    OpSpec("filter_by_value", "Filters", lambda df, p, ctx: filters.filter_by_value(df, p["field"], p["op"], p["value"]), {"field": Param(str), "op": Param(str), "value": Param()}),
    OpSpec("drop_nulls", "Filters", lambda df, p, ctx: filters.drop_nulls(df, p["fields"]), {"fields": Param(list)}),
]
TEXT_FILTERS = [
    LABEL,
    OpSpec("filter_by_length", "Filters", lambda df, p, ctx: filters.filter_by_length(df, F.size(features.tokens(p["field"])), p.get("min_tokens"), p.get("max_tokens")), {"field": Param(str), "min_tokens": opt(int), "max_tokens": opt(int)}),
]

# generation ---------------------------------------------------------------------------------


def _window(df, p, ctx):  # noqa: ANN001, ANN202
    field = ctx.op["inputs"][0]
    parts = generation.windows(df, "record_id", field, p["window_length_samples"], p["hop_samples"], p["remainder"] == "pad")
    rest = df.drop(field, "source_record_id", "window_index").withColumnRenamed("record_id", "source_record_id")
    return parts.join(rest, "source_record_id")


def _corrupted(df, p, ctx):  # noqa: ANN001, ANN202
    tags = p.get("tag_fields")
    return media.corrupt(df, p["corruption_types"], p["severities"], ctx.seed, ctx.op["name"], preserve_original=p["preserve_original"], tags=tags if isinstance(tags, dict) else None)


MINORITY = OpSpec("duplicate_minority_class", "Generation", lambda df, p, ctx: generation.duplicate_minority_class(df, "record_id", ctx.label, ctx.seed).drop("copy"))
CORRUPT = OpSpec("imagecorruptions_apply", "Generation", _corrupted, {"corruption_types": Param(list), "severities": Param(list), "preserve_original": Param(bool), "tag_fields": opt((list, dict))}, pixel_altering=True, fan_out=True)
WINDOW = OpSpec("window", "Generation", _window, {"window_length_samples": Param(int), "hop_samples": Param(int), "remainder": Param(str)}, fan_out=True)

# transformations ----------------------------------------------------------------------------


def _field(p: dict) -> str:
    return p.get("field", "image")


def _pinned(p: dict) -> dict | None:
    return {"mean": p["mean"], "std": p["std"]} if p.get("mean") and p.get("std") else None


def _fit_image(df, p, ctx):  # noqa: ANN001, ANN202
    return _pinned(p) or media.fit_axis(df, _field(p), -1)


def _fit_standardize(df, p, ctx):  # noqa: ANN001, ANN202
    if _pinned(p):
        return {c: [p["mean"][c], p["std"][c]] for c in p["fields"]}
    return {c: list(v) for c, v in features.fit_standardize(df, p["fields"]).items()}


IMAGE_TRANSFORMS = [
    OpSpec("resize", "Transformations", lambda df, p, ctx, _: df.withColumn(_field(p), media.resize(_field(p), p["size"], p.get("interpolation", "bilinear"))), {"size": Param(int), "interpolation": opt(str), "field": opt(str)}, pixel_altering=True),
    OpSpec("normalize", "Transformations", lambda df, p, ctx, fit: df.withColumn(_field(p), media.normalize(_field(p), fit["mean"], fit["std"])), {"mean": opt(list), "std": opt(list), "field": opt(str)}, fit=_fit_image, dtype_altering=True),
    OpSpec("mean_subtract", "Transformations", lambda df, p, ctx, fit: df.withColumn(_field(p), media.normalize(_field(p), fit["mean"], None)), {"field": opt(str)}, fit=lambda df, p, ctx: {"mean": media.fit_axis(df, _field(p), -1)["mean"]}, dtype_altering=True),
    OpSpec("cast", "Transformations", lambda df, p, ctx, _: df.withColumn(_field(p), media.cast(_field(p), p["dtype"], p.get("scale"))), {"dtype": Param(str), "scale": opt(_NUM), "field": opt(str)}, dtype_altering=True),
]
TABLE_TRANSFORMS = [
    OpSpec("standardize", "Transformations", lambda df, p, ctx, fit: features.standardize(df, {k: tuple(v) for k, v in fit.items()}), {"fields": Param(list), "mean": opt(dict), "std": opt(dict)}, fit=_fit_standardize),
    OpSpec("min_max_scale", "Transformations", lambda df, p, ctx, fit: features.min_max_scale(df, {k: tuple(v) for k, v in fit.items()}, p.get("low", 0.0), p.get("high", 1.0)), {"fields": Param(list), "low": opt(_NUM), "high": opt(_NUM)}, fit=lambda df, p, ctx: {c: list(v) for c, v in features.fit_min_max(df, p["fields"]).items()}),
    OpSpec("cast_dtype", "Transformations", lambda df, p, ctx, _: df.withColumn(p["field"], features.cast_dtype(p["field"], p["dtype"])), {"field": Param(str), "dtype": Param(str)}),
    OpSpec("one_hot_encode", "Transformations", lambda df, p, ctx, fit: df.withColumns(features.one_hot(p["field"], fit["vocabulary"])), {"field": Param(str)}, fit=lambda df, p, ctx: {"vocabulary": features.fit_vocabulary(df, p["field"])}),
]
TEXT_TRANSFORMS = [
    OpSpec("lowercase", "Transformations", lambda df, p, ctx, _: df.withColumn(p["field"], F.lower(p["field"])), {"field": Param(str)}),
    OpSpec("strip_punctuation", "Transformations", lambda df, p, ctx, _: df.withColumn(p["field"], features.strip_punctuation(p["field"])), {"field": Param(str)}),
]

# featurizations -----------------------------------------------------------------------------


def _out(ctx) -> str:  # noqa: ANN001
    return ctx.op["output_field"]


def _in(ctx) -> str:  # noqa: ANN001
    return ctx.op["inputs"][0]


def _from_path(df, p, ctx, _):  # noqa: ANN001, ANN202
    part = {"parent_directory_name": "parent", "filename": "name", "stem": "stem"}[p["source"]]
    path = F.col(_in(ctx))
    found = features.path_part(_in(ctx), part)
    return df.withColumn(_out(ctx), F.when(path.isNull(), F.raise_error(F.lit("a path is null")).cast("string")).otherwise(found))


def _fit_vocabulary(df, p, ctx):  # noqa: ANN001, ANN202
    return {"vocabulary": p.get("vocabulary") or features.fit_vocabulary(df, _in(ctx), p.get("order", "alphabetical"), "record_id")}


def _fit_mel(df, p, ctx):  # noqa: ANN001, ANN202
    return _pinned(p) or media.fit_axis(df, _in(ctx), 0)


LABEL_FROM_PATH = OpSpec("label_from_path", "Featurizations", _from_path, {"source": Param(str)})
ENCODE = OpSpec("categorical_encode", "Featurizations", lambda df, p, ctx, fit: df.withColumn(_out(ctx), features.encode(_in(ctx), fit["vocabulary"], {"int64": "long", "int32": "int", "int16": "short", "int8": "byte"}.get(p.get("output_dtype", "int64"), "long"))), {"vocabulary": opt(list), "order": opt(str), "output_dtype": opt(str)}, fit=_fit_vocabulary)
IMAGE_FEATURES = [
    LABEL_FROM_PATH,
    ENCODE,
    OpSpec("image_size_stats", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), media.shape(_in(ctx)))),
    OpSpec("flatten", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), media.flatten(_in(ctx)))),
]
AUDIO_FEATURES = [
    LABEL_FROM_PATH,
    ENCODE,
    OpSpec("log_mel_spectrogram", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), media.log_mel(_in(ctx), "sample_rate", **p)), {"n_fft": Param(int), "hop_length": Param(int), "n_mels": Param(int), "f_min": Param(_NUM), "power": Param(_NUM), "f_max": opt(_NUM)}),
    OpSpec("audio_normalize", "Featurizations", lambda df, p, ctx, fit: df.withColumn(_out(ctx), media.normalize(_in(ctx), fit["mean"], fit["std"], 0)), {"mean": opt(list), "std": opt(list)}, fit=_fit_mel),
]
TABLE_FEATURES = [
    ENCODE,
    OpSpec("polynomial_features", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), F.struct(*[c.alias(n) for n, c in features.polynomial(ctx.op["inputs"], p["degree"]).items()])), {"degree": Param(int)}),
]
TEXT_FEATURES = [
    OpSpec("tokenize", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), features.tokens(_in(ctx)))),
    OpSpec("remove_stopwords", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), features.remove_stopwords(F.col(_in(ctx)), p.get("stopwords") or STOPWORDS[p.get("language", "english")])), {"stopwords": opt(list), "language": opt(str)}),
    OpSpec("token_count", "Featurizations", lambda df, p, ctx, _: df.withColumn(_out(ctx), F.size(features.tokens(_in(ctx))))),
    OpSpec("tfidf", "Featurizations", lambda df, p, ctx, fit: df.withColumn(_out(ctx), features.tfidf_vector(features.tokens(_in(ctx)), fit["terms"], fit["idf"])), {"max_features": opt(int)}, fit=lambda df, p, ctx: features.fit_tfidf(df, features.tokens(_in(ctx)), p.get("max_features", 10_000))),
]

# augmentations ------------------------------------------------------------------------------


def _augment(name: str, params: dict[str, Param]) -> OpSpec:
    return OpSpec(name, "Augmentations", lambda df, p, ctx: media.augment(df, name, p, ctx.seed, ctx.op["name"], ctx.op["expansion"]), params, pixel_altering=True, fan_out=True)


AUGMENT = [
    _augment("random_crop", {"size": Param(int), "padding": opt(int), "padding_mode": opt(str)}),
    _augment("horizontal_flip", {"p": Param(_NUM)}),
    _augment("color_jitter", {k: opt(_NUM) for k in ("brightness", "contrast", "saturation", "hue")}),
    _augment("random_erasing", {"p": Param(_NUM), "area": opt(list), "aspect": opt(list)}),
]

# plots: what is drawn is small, as it is counted or limited in Spark first --------------------


def _first(df: DataFrame, n: int, by: str | None, *columns: str) -> list:
    """The first n rows by record id, of each class if by is given."""
    if by is None:
        return df.orderBy("record_id").select(*columns).limit(n).collect()
    here = Window.partitionBy(by).orderBy("record_id")
    return df.withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= n).orderBy(by, "record_id").select(*columns).collect()


def _class_bars(df, p, ctx):  # noqa: ANN001, ANN202
    by = p.get("group_by") or ctx.label
    return png(pixels.bars([r["n"] for r in reports.class_distribution(df, SPLIT if by == "split" else by).orderBy("class").collect()]))


def _sample_grid(df, p, ctx):  # noqa: ANN001, ANN202
    by = ctx.label if p.get("per_class") else None
    rows = _first(df, p["n"], by, "image")
    return png(pixels.grid([media.unpack(r["image"]) for r in rows], p["n"] if by else max(1, int(np.ceil(np.sqrt(p["n"]))))))


def _mean_images(df, p, ctx):  # noqa: ANN001, ANN202
    found: dict = {}
    for r in media.mean_images(df, "image", ctx.label).orderBy("class", "pos").collect():  # 3,072 numbers a class
        found.setdefault(r["class"], []).append(r["mean"])
    return png(pixels.grid([pixels.to_uint8(np.reshape(v, (32, 32, 3))) for v in found.values()], max(1, len(found))))


def _pixel_bars(df, p, ctx):  # noqa: ANN001, ANN202
    bins = p.get("bins", 32)
    out: dict[str, list] = {}
    for r in media.pixel_histogram(df, "image", [SPLIT], bins).collect():
        out.setdefault(f"{r[SPLIT]}_{r['channel']}", [0] * bins)[r["bin"]] = r["n"]
    return {k: png(pixels.bars(v, wide=3)) for k, v in sorted(out.items())}


def _variants(df, p, ctx):  # noqa: ANN001, ANN202
    aug = next(a for a in ctx.recipe["Augmentations"] if a["name"] == p["augmentation"])
    base = df.where(F.col(SPLIT) == "train").orderBy("record_id").limit(p["n_base"])
    if aug["materialization"] == "aggressive":
        roots = df.where(F.col("variant_index").isNotNull()).select("source_record_id").distinct().orderBy("source_record_id").limit(p["n_base"])
        rows = df.join(roots, "source_record_id").where(F.col("variant_index") < p["n_variants"]).orderBy("source_record_id", "variant_index").select("image").collect()
    else:
        made = media.augment(base, aug["op"], aug["params"], ctx.seed_of(aug), aug["name"], p["n_variants"])
        rows = made.orderBy("source_record_id", "variant_index").select("image").collect()
    return png(pixels.grid([media.unpack(r["image"]) for r in rows], p["n_variants"]))


def _severities(df, p, ctx, names, severities):  # noqa: ANN001, ANN202
    base = df.where(F.col(SPLIT) == "train").orderBy("record_id").limit(p.get("n", 1)).select("record_id", "image")
    rows = media.corrupt(base, names, severities, ctx.seed, ctx.op["name"]).select("source_path", "corruption", "severity", "image").collect()
    rows.sort(key=lambda r: (r["source_path"], names.index(r["corruption"]), r["severity"]))
    return png(pixels.grid([media.unpack(r["image"]) for r in rows], len(severities)))


BARS = OpSpec("class_distribution_histogram", "Visualizations", _class_bars, {"group_by": opt(str)})
IMAGE_VIEWS = [
    BARS,
    OpSpec("sample_grid", "Visualizations", _sample_grid, {"n": Param(int), "per_class": opt(bool)}),
    OpSpec("mean_image_per_class", "Visualizations", _mean_images),
    OpSpec("pixel_distribution", "Visualizations", _pixel_bars, {"bins": opt(int)}),
    OpSpec("augmented_sample_grid", "Visualizations", _variants, {"augmentation": Param(str), "n_base": Param(int), "n_variants": Param(int)}),
    OpSpec("corruption_severity_grid", "Visualizations", lambda df, p, ctx: _severities(df, p, ctx, p.get("corruption_types") or [n for n in corruptions.names() if n != "frost"], p.get("severities") or [1, 2, 3, 4, 5]), {"corruption_types": opt(list), "severities": opt(list), "n": opt(int)}),
    OpSpec("severity_ladder", "Visualizations", lambda df, p, ctx: _severities(df, p, ctx, [p["corruption"]], [1, 2, 3, 4, 5]), {"corruption": Param(str), "n": opt(int)}),
]
TABLE_VIEWS = [BARS, OpSpec("field_summary_table", "Visualizations", lambda df, p, ctx: png(pixels.bars([r["n_distinct"] for r in reports.summary(df, p["fields"]).collect()])), {"fields": Param(list)})]
TEXT_VIEWS = [BARS, OpSpec("token_length_histogram", "Visualizations", lambda df, p, ctx: png(pixels.bars([r["n"] for r in reports.token_lengths(df, p["field"], p.get("bin", 10)).orderBy("bin").collect()])), {"field": Param(str), "bin": opt(int)})]

# sources ------------------------------------------------------------------------------------


def _table(kind: str):  # noqa: ANN202
    def read(spark, source: dict, root: str) -> DataFrame:  # noqa: ANN001
        options = {"header": "true", "inferSchema": "true"} if kind == "csv" else {}
        df = readers.read(spark, kind, root, **{**options, **{k: str(v) for k, v in (source["options"] or {}).items() if k != "id"}})
        key = (source["options"] or {}).get("id")
        own = F.col(key).cast("string") if key else F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
        df = df.withColumn("record_id", F.concat(F.lit(source["name"] + "/"), own)).withColumn("_unlabeled", F.lit(bool(source["unlabeled"])))
        return df.withColumn("partition", F.lit(source["partition"])) if source["partition"] else df

    return read


def _base(source: dict) -> str:
    return str(source.get("_base") or Path())


TABLES = {k: _table(k) for k in ("csv", "parquet", "json", "orc", "text")}
IMAGE_SOURCES = {
    "image_folder": lambda spark, s, root: media_sources.folder(spark, s, root),
    "image_flat": lambda spark, s, root: media_sources.flat(spark, s, root, base=_base(s)),
    "image_tree": lambda spark, s, root: media_sources.tree(spark, s, root, base=_base(s)),
}
AUDIO_SOURCES = {
    "audio_folder": lambda spark, s, root: media_sources.folder(spark, s, root, sound=True),
    "audio_flat": lambda spark, s, root: media_sources.flat(spark, s, root, sound=True, base=_base(s)),
    "audio_tree": lambda spark, s, root: media_sources.tree(spark, s, root, sound=True, base=_base(s)),
}


def _plugin(name: str, ops: list[OpSpec], sources: dict, stamped: set[str]) -> Plugin:
    return Plugin(name, by_name(ops), sources, frozenset(s.section for s in ops), frozenset({"record_id", "path", "partition", "sample_per_class_tags"} | stamped))


PLUGINS = [
    _plugin("image_classification", [*FILTERS, MINORITY, CORRUPT, *IMAGE_TRANSFORMS, *IMAGE_FEATURES, *AUGMENT, *IMAGE_VIEWS], IMAGE_SOURCES, {"image"}),
    _plugin("audio_classification", [*FILTERS, MINORITY, WINDOW, *AUDIO_FEATURES, BARS], AUDIO_SOURCES, {"sample_array", "sample_rate"}),
    _plugin("tabular", [LABEL, *TABLE_FILTERS, MINORITY, *TABLE_TRANSFORMS, *TABLE_FEATURES, *TABLE_VIEWS], TABLES, set()),
    _plugin("text", [*TEXT_FILTERS, SAMPLE, MINORITY, *TEXT_TRANSFORMS, *TEXT_FEATURES, ENCODE, *TEXT_VIEWS], TABLES, set()),
]
