"""Recipes end to end over synthesised folders and tables."""

import copy
import io
import json
import wave

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from millrace import cli
from millrace.engine import Config, Engine, Instance
from millrace.errors import CacheError, ContractError, MaterializeError, PluginError, RecipeError, SinkCardinalityError
from millrace.media import pixels
from millrace.operators import media
from millrace.recipe import identity, model, registry
from millrace.recipe.validate import CHECKS, validate
from millrace.sinks.writers import png

ALL = ["train", "val", "test"]


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(2026)
    for c in range(4):
        (root / "set" / f"class{c}").mkdir(parents=True)
        for i in range(6):
            (root / "set" / f"class{c}" / f"i_{c}_{i}.png").write_bytes(png(rng.integers(0, 256, (32, 32, 3), np.uint8)))
    (root / "bare").mkdir()
    for i in range(3):
        (root / "bare" / f"u{i}.png").write_bytes(png(rng.integers(0, 256, (32, 32), np.uint8)))
    (root / "labels.csv").write_text("filename,class\n" + "".join(f"u{i}.png,class{i}\n" for i in range(3)))
    return root


def recipe(images, **changes):
    body = {
        "schema_version": 3,
        "plugin": "image_classification",
        "seed": 7,
        "Input": {"sources": [{"name": "set", "type": "image_folder", "path": str(images / "set")}]},
        "Output": {"record_schema": {"image": {"dtype": "uint8"}, "label": {"dtype": "str"}}},
        "Labels": {"field": "label", "source": {"kind": "direct"}},
        "InputContracts": [{"field": "label", "assertion": {"kind": "required_field"}}, {"assertion": {"kind": "record_count_in_range", "min": 24, "max": 24}}, {"field": "image", "assertion": {"kind": "shape_equals", "shape": [32, 32, 3]}}],
        "Filters": [{"name": "no3", "op": "filter_by_label", "params": {"labels": ["class3"], "action": "exclude"}}],
        "Splits": {"ratios": {"train": 0.5, "val": 0.5}, "stratify_by": "label"},
        "Generation": [{"name": "bad", "op": "imagecorruptions_apply", "inputs": ["image"], "output_schema": "matches_input", "seed": 1, "splits": ["val"], "replace_input_records": True, "params": {"corruption_types": ["contrast", "fog"], "severities": [1, 5], "preserve_original": True}}],
        "Transformations": [{"name": "small", "op": "resize", "params": {"size": 8}, "splits": ["train", "val"]}],
        "Augmentations": [{"name": "flip", "op": "horizontal_flip", "params": {"p": 0.5}, "materialization": "aggressive", "expansion": 2}],
        "Featurizations": [
            {"name": "size", "op": "image_size_stats", "inputs": ["image"], "output_field": "size", "splits": ["train", "val"]},
            {"name": "code", "op": "categorical_encode", "inputs": ["label"], "output_field": "code", "splits": ["train", "val"], "fit_source": "train"},
            {"name": "flat", "op": "flatten", "inputs": ["image"], "output_field": "flat", "splits": ["train", "val"]},
        ],
        "OutputExpectations": [{"field": "code", "assertion": {"kind": "value_in_set", "values": [0, 1, 2]}}, {"assertion": {"kind": "split_record_counts", "counts": {"train": 18, "val": 45}}}],
        "SampleData": {"selector": {"n": 2}},
        "Visualizations": [
            {"name": "classes", "op": "class_distribution_histogram", "stage": "post_pipeline", "mode": "reporting"},
            {"name": "means", "op": "mean_image_per_class", "stage": "post_Splits", "mode": "reporting"},
            {"name": "pixels", "op": "pixel_distribution", "stage": "post_Splits", "mode": "reporting"},
            {"name": "grid", "op": "sample_grid", "params": {"n": 2, "per_class": True}, "stage": "post_Splits", "mode": "reporting"},
            {"name": "variants", "op": "augmented_sample_grid", "params": {"augmentation": "flip", "n_base": 2, "n_variants": 2}, "stage": "post_Augmentations", "mode": "reporting"},
            {"name": "ladder", "op": "severity_ladder", "params": {"corruption": "contrast"}, "stage": "post_Splits", "mode": "reporting"},
            {"name": "panel", "op": "corruption_severity_grid", "params": {"corruption_types": ["fog"], "severities": [1, 3]}, "stage": "post_Splits", "mode": "reporting"},
        ],
        "Sinks": [{"name": "png", "stage": "post_Augmentations", "field": "image", "format": "png_per_record", "path_template": "{split}/{record_id}.png"}],
    }
    return {**body, **changes}


def engine(spark, tmp_path, body, **options):
    path = tmp_path / "recipe.yaml"
    path.write_text(yaml.safe_dump(body, sort_keys=False))
    return Engine.from_recipe(spark, path, Config(cache_root=str(tmp_path / "cache"), **options))


def test_image_recipe_end_to_end(spark, images, tmp_path):
    e = engine(spark, tmp_path, recipe(images))
    assert e.validate().passed and e.status()["status"] == "miss" and e.resolve() is None
    seen = []
    got = e.materialize(progress=seen.append)
    assert seen[0] == "InputContracts" and seen[-1] == "Visualizations"
    assert got.manifest["record_counts"] == {"train": 18, "val": 45} and got.manifest["label_classes"] == ["class0", "class1", "class2"]
    df = got.dataset(spark)
    assert df.where("size(size) = 3 AND size[0] = 8").count() == 63 and df.where("size(flat) = 192").count() == 63
    assert df.where("_split = 'val' AND corruption IS NOT NULL").count() == 36
    assert df.where("_split = 'train'").select("record_id").distinct().count() == 18
    assert got.fitted_statistics.get_vector("code", "vocabulary") == ["class0", "class1", "class2"]
    assert got.sample(spark).groupBy("_split").count().collect()[0]["count"] == 2
    sink = got.manifest["sinks"][0]
    assert sink["files"] == 63 and df.where("path LIKE 'sinks/png/%'").count() == 63
    files = sorted((got.path / "sinks/png").rglob("*.png"))
    assert len(files) == 63 and pixels.decode_png(files[0].read_bytes()).shape == (8, 8, 3)
    assert {"classes.png", "means.png", "grid.png", "variants.png", "ladder.png", "panel.png"} < set(got.manifest["plots"])
    assert any("class3" in w for w in got.manifest["warnings"]) and "| class0 |" in (got.path / "report.md").read_text()
    # again: from the cache, and equal when computed anew
    assert e.materialize().manifest["created_at"] == got.manifest["created_at"] and e.status()["status"] == "hit"
    key = lambda d: {r["record_id"]: (r["_split"], bytes(r["image"]["data"])) for r in d.select("record_id", "_split", "image").collect()}
    before = key(df)
    assert e.clean(by_recipe=got.manifest["recipe_hash"])["removed"]
    assert key(e.materialize().dataset(spark)) == before
    found = e.inspect(view="classes")
    assert found["png"][:4] == b"\x89PNG" and len(found["peek"]["train"]) == 3
    assert e.report(got.path).startswith("# Instance")


def test_export_rebuilds_from_the_instance(spark, images, tmp_path):
    final = {"name": "late", "stage": "post_Visualizations", "field": "image", "format": "png_per_record", "path_template": "{record_id}.png"}
    made = {"name": "made", "stage": "post_Generation", "field": "image", "format": "npy_per_record", "path_template": "{record_id}.npy", "splits": ["val"]}
    body = recipe(images, Augmentations=[], Transformations=[], Visualizations=[], OutputExpectations=[], SampleData=None, Sinks=[final, made])
    body = {k: v for k, v in body.items() if v is not None}
    e = engine(spark, tmp_path, body)
    e.materialize()
    got = {r["name"]: r for r in e.export(root=tmp_path / "out")}
    assert got["late"]["files"] == 9 + 45 and got["made"]["files"] == 45
    assert np.load(next((tmp_path / "out/made").rglob("*.npy"))).shape == (32, 32, 3)
    with pytest.raises(MaterializeError):
        e.export(["none"])


def test_failures_leave_no_cache_entry(spark, images, tmp_path):
    body = recipe(images, InputContracts=[{"assertion": {"kind": "record_count_in_range", "min": 100}}])
    e = engine(spark, tmp_path, body)
    with pytest.raises(ContractError):
        e.materialize()
    assert e.status()["status"] == "miss" and list((tmp_path / "cache/tmp").glob("*/FAILED"))
    assert e.clean(orphans=True)["removed"]
    partial = engine(spark, tmp_path, recipe(images, Sinks=[], Generation=[], Transformations=[], Augmentations=[], Visualizations=[])).materialize(stop_after="Splits")
    assert partial.manifest["partial"] == "Splits"
    with pytest.raises(SinkCardinalityError):
        engine(spark, tmp_path, recipe(images, Sinks=[{"name": "png", "stage": "post_Augmentations", "field": "image", "format": "png_per_record", "path_template": "{label}.png"}])).materialize()
    with pytest.raises(PluginError):
        engine(spark, tmp_path, recipe(images, plugin="none"))


def test_flat_and_tree_sources(spark, images, tmp_path):
    flat = {"name": "bare", "type": "image_flat", "path": str(images / "bare"), "label_from": {"path": str(images / "labels.csv"), "join": "by_id", "id_field": "filename", "label_field": "class"}}
    tree = {"name": "tree", "type": "image_tree", "path": str(images / "set"), "layout": "{label}/{file}.png"}
    e = engine(spark, tmp_path, recipe(images, Input={"sources": [flat, tree]}))
    rows = e.records().select("record_id", "label", "image.shape", "path").collect()
    assert len(rows) == 27 and {r["label"] for r in rows if r["record_id"].startswith("bare/")} == {"class0", "class1", "class2"}
    assert {tuple(r["shape"]) for r in rows} == {(32, 32), (32, 32, 3)}
    whole = spark.read.format("binaryFile").load(str(images / "set/class1")).first()
    got = e.records().where(F.col("record_id") == "tree/class1/" + whole["path"].rsplit("/", 1)[1]).first()
    assert bytes(got["image"]["data"]) == pixels.decode_png(bytes(whole["content"])).tobytes()
    by_order = {**flat, "label_from": {"path": str(images / "labels.csv"), "join": "by_row_order", "label_field": "class"}}
    rows = engine(spark, tmp_path, recipe(images, Input={"sources": [by_order]})).records().orderBy("record_id").collect()
    assert [r["label"] for r in rows] == ["class0", "class1", "class2"]
    # an unlabeled partition passes; the other one is divided
    sources = [{"name": "set", "type": "image_folder", "path": str(images / "set"), "partition": "train"}, {"name": "bare", "type": "image_flat", "path": str(images / "bare"), "partition": "test", "unlabeled": True}]
    keep = {k: [] for k in ("Generation", "Transformations", "Augmentations", "Featurizations", "OutputExpectations", "Visualizations", "Sinks", "InputContracts", "Filters")}
    body = recipe(images, Input={"sources": sources}, Splits={"ratios": {"train": 0.5, "val": 0.5}, "applies_to": "train", "stratify_by": "label"}, **keep)
    got = engine(spark, tmp_path, {**body, "InputContracts": [{"field": "label", "assertion": {"kind": "required_field"}}]}).materialize()
    assert got.manifest["record_counts"] == {"test": 3, "train": 12, "val": 12}
    assert json.loads((got.path / "drift.json").read_text())["splits"]["test"]["note"] == "unlabeled"


def test_normalize_cast_and_sibling_statistics(spark, images, tmp_path):
    keep = {k: [] for k in ("Generation", "Augmentations", "Featurizations", "OutputExpectations", "Visualizations", "Sinks", "Filters")}
    first = recipe(images, Transformations=[{"name": "z", "op": "normalize", "fit_source": "train", "splits": ["train", "val"]}], **keep)
    (tmp_path / "a").mkdir()
    e = engine(spark, tmp_path / "a", first)
    got = e.materialize()
    train = np.stack([media.unpack(r["image"]) for r in got.dataset(spark, "train").collect()])
    assert train.dtype == np.float64 and np.allclose(train.mean((0, 1, 2)), 0) and np.allclose(train.std((0, 1, 2)), 1)
    stats = got.fitted_statistics.get_vector("z", "mean")
    with pytest.raises(CacheError):
        got.fitted_statistics.get_scalar("z", "mean")
    second = recipe(images, Transformations=[{"name": "c", "op": "mean_subtract", "params": {"stats_from_instance": {"recipe": str(tmp_path / "a/recipe.yaml"), "op_id": "z"}}, "splits": ["train", "val"]}, {"name": "t", "op": "cast", "params": {"dtype": "uint8", "scale": 2}, "splits": ["val"]}], **keep)
    e2 = Engine(spark, model.parse(second), e.plugin, e.config)
    rows = e2.materialize().dataset(spark).collect()
    raw = {r["record_id"]: media.unpack(r["image"]) for r in e2.records().collect()}
    for r in rows:
        want = raw[r["record_id"]] - np.array(stats)
        want = want.astype("uint8") * np.uint8(2) if r["_split"] == "val" else want
        assert np.array_equal(media.unpack(r["image"]), want)


def _wav(rate, seconds, hz):
    x = (np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate) * 20000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, len(x), "NONE", ""))
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_audio_recipe_end_to_end(spark, tmp_path):
    for i, label in enumerate(("low", "high")):
        (tmp_path / "train" / label).mkdir(parents=True)
        for j, rate in enumerate((22050, 16000, 8000, 16000)):
            (tmp_path / "train" / label / f"c{j}.wav").write_bytes(_wav(rate, 0.5, 300 + 1500 * i))
    (tmp_path / "test").mkdir()
    (tmp_path / "test" / "u.wav").write_bytes(_wav(11025, 0.4, 500))
    body = {
        "schema_version": 3, "plugin": "audio_classification", "seed": 0,
        "Input": {"sources": [{"name": "labeled", "type": "audio_folder", "path": "train", "partition": "train", "target_sample_rate": 16000}, {"name": "heldout", "type": "audio_flat", "path": "test", "partition": "test", "unlabeled": True, "target_sample_rate": 16000}]},
        "Output": {"record_schema": {"sample_array": {"dtype": "float32"}, "label": {"dtype": "str"}}},
        "Labels": {"field": "label"},
        "Splits": {"ratios": {"train": 0.5, "val": 0.5}, "applies_to": "train", "stratify_by": "label", "seed": 7},
        "Generation": [{"name": "win", "op": "window", "inputs": ["sample_array"], "output_schema": "matches_input", "seed": 0, "splits": ALL, "replace_input_records": True, "params": {"window_length_samples": 1600, "hop_samples": 1600, "remainder": "drop"}}],
        "Featurizations": [
            {"name": "logmel", "op": "log_mel_spectrogram", "inputs": ["sample_array"], "output_field": "mel", "params": {"n_fft": 512, "hop_length": 256, "n_mels": 32, "f_min": 0.0, "power": 2.0}, "splits": ALL},
            {"name": "norm", "op": "audio_normalize", "inputs": ["mel"], "output_field": "feature", "fit_source": "train", "splits": ALL},
        ],
    }
    e = engine(spark, tmp_path, body)
    assert e.validate().failures == {}
    got = e.materialize()
    assert got.manifest["record_counts"] == {"test": 4, "train": 20, "val": 20}
    rows = got.dataset(spark, "train").collect()
    feature = np.stack([media.unpack(r["feature"]) for r in rows])
    assert feature.shape == (20, 32, 7) and np.allclose(feature.mean((0, 2)), 0, atol=1e-6) and feature.dtype == np.float64
    peak = {r["label"]: int(media.unpack(r["mel"]).mean(1).argmax()) for r in rows}
    assert peak["high"] > peak["low"] and rows[0]["record_id"].startswith(rows[0]["source_record_id"] + "__w")


def test_table_and_text_recipes(spark, tmp_path):
    rows = [(i, float(i % 7), "ab"[i % 2], f"Some words, here {i % 5}!") for i in range(40)]
    spark.createDataFrame(rows, "id long, x double, y string, t string").write.parquet(str(tmp_path / "t"))
    base = {"schema_version": 3, "seed": 1, "Input": {"sources": [{"name": "t", "type": "parquet", "path": "t", "options": {"id": "id"}}]}, "Output": {"record_schema": {"x": {"dtype": "float64"}, "y": {"dtype": "str"}, "t": {"dtype": "str"}}}, "Labels": {"field": "y"}, "Splits": {"ratios": {"train": 0.5, "val": 0.5}}}
    table = {**base, "plugin": "tabular", "Transformations": [{"name": "z", "op": "standardize", "params": {"fields": ["x"]}, "fit_source": "train", "splits": ["train"]}], "Featurizations": [{"name": "p", "op": "polynomial_features", "inputs": ["x"], "output_field": "p", "params": {"degree": 2}, "splits": ["train", "val"]}]}
    e = engine(spark, tmp_path, table)
    assert e.validate().failures == {}
    df = e.materialize().dataset(spark)
    assert abs(df.where("_split = 'train'").agg(F.avg("x")).first()[0]) < 1e-9 and df.where("_split = 'val' AND x = floor(x)").count() == 20
    text = {**base, "plugin": "text", "Transformations": [{"name": "low", "op": "lowercase", "params": {"field": "t"}, "splits": ["train", "val"]}, {"name": "strip", "op": "strip_punctuation", "params": {"field": "t"}, "splits": ["train", "val"]}], "Featurizations": [{"name": "n", "op": "token_count", "inputs": ["t"], "output_field": "n", "splits": ["train", "val"]}, {"name": "v", "op": "tfidf", "inputs": ["t"], "output_field": "v", "fit_source": "train", "splits": ["train", "val"]}]}
    e = engine(spark, tmp_path, text)
    assert e.validate().failures == {}
    row = e.materialize().dataset(spark).first()
    assert row["n"] == 4 and row["t"].startswith("some words here") and abs(row["v"]["some"] - 1.0) < 1e-9


BROKEN = {
    2: lambda b: b.update(plugin="text"),
    3: lambda b: b.update(plugin="audio_classification"),
    4: lambda b: b["Featurizations"][0].pop("splits"),
    5: lambda b: b["Augmentations"][0].update(splits=["train", "val"]),
    6: lambda b: b["Transformations"].append({"name": "z", "op": "normalize", "fit_source": "val", "splits": ["train"]}),
    7: lambda b: b["Featurizations"][0].update(inputs=["none"]),
    8: lambda b: b["Splits"].update(ratios={"train": 0.9, "val": 0.9}),
    9: lambda b: b["Splits"].update(stratify_by="none"),
    10: lambda b: (b["Splits"].update(class_balance={"x": 1})),
    11: lambda b: (b.update(Transformations=[]), b["Visualizations"][0].update(stage="post_Transformations")),
    12: lambda b: b.update(overlays={"o": {"Nonsense": {}}}),
    13: lambda b: b["Output"]["record_schema"].pop("label"),
    14: lambda b: b["Generation"][0].update(output_schema={"label": {"dtype": "int32"}}),
    15: lambda b: b["Generation"][0].update(splits=["dev"]),
    16: lambda b: b["SampleData"]["selector"].update(fraction=0.5),
    17: lambda b: b["InputContracts"][0].update(field="none"),
    18: lambda b: b["Transformations"][0].update(params={"sizes": 8}),
    19: lambda b: b["Input"]["sources"][0].update(type="image_flat", label_from={"path": "gone.csv", "join": "by_id", "id_field": "a", "label_field": "b"}),
    20: lambda b: b["Input"]["sources"][0].update(partition="train"),
    21: lambda b: b["Input"]["sources"][0].update(unlabeled=True),
    22: lambda b: b["Transformations"].append({"name": "z", "op": "normalize", "fit_source": "train", "splits": ["train"], "params": {"stats_from_instance": {"recipe": "a", "op_id": "b"}}}),
    23: lambda b: b["Featurizations"][0].update(output_field="path"),
    24: lambda b: b["Sinks"][0].update(path_template="../{record_id}.png"),
    25: lambda b: b["Visualizations"][0].update(params={"group_by": "none"}),
    26: lambda b: b.update(Sinks=[]),
    27: lambda b: b["Transformations"].append({"name": "t", "op": "cast", "params": {"dtype": "float32"}, "splits": ["train"]}),
    28: lambda b: b.update(extensions={"x": {"y": 1}}),
    29: lambda b: b["Splits"].update(stratify_by="source_record_id"),
    30: lambda b: (b["Transformations"].append({"name": "z", "op": "normalize", "fit_source": "train", "splits": ["val"]}), b["Sinks"].append({"name": "n", "stage": "post_Transformations", "field": "image", "format": "npy_per_record", "path_template": "{record_id}.npy"})),
    31: lambda b: b["Input"]["sources"][0].update(type="image_tree"),
}


def test_every_check_passes_and_fails(images):
    plugins = registry.discover()
    good = recipe(images)
    assert validate(model.parse(good), plugins["image_classification"]).failures == {}
    for number, change in BROKEN.items():
        body = copy.deepcopy(good)
        change(body)
        plugin = plugins["audio_classification" if number == 3 else "image_classification"]
        assert any(k.startswith(f"{number:02d} ") for k in validate(model.parse(body), plugin).failures), (number, CHECKS[number - 1].__name__)
    odd = model.Recipe({**model.parse(good).body, "schema_version": 9})
    assert any(k.startswith("01 ") for k in validate(odd, plugins["image_classification"]).failures)


def test_recipe_language(images):
    old = {"schema_version": 1, **{k: v for k, v in recipe(images).items() if k in ("plugin", "Input", "Output", "Labels", "Splits")}}
    old["Filters"] = [{"name": "f", "predicate": {"op": "random_sample", "n": 3, "seed": 4}}]
    old["Generation"] = [{"name": "duplicate_minority_class", "inputs": ["image"], "applies_at": ["train"], "seed": 0, "output_schema_matches_input": True, "output_schema": {}}]
    old["InputContracts"] = [{"field": "label", "assertion": {"kind": "dtype", "dtype": "str"}}]
    old["variants"] = {"v": {"Splits": {"ratios": {"train": 1.0}}}}
    got = model.parse(old)
    assert got["Filters"][0]["op"] == "random_sample" and got["Filters"][0]["params"] == {"n": 3} and got["Filters"][0]["seed"] == 4
    assert got["Generation"][0]["splits"] == ["train"] and got["Generation"][0]["output_schema"] == "matches_input"
    assert got["InputContracts"][0]["assertion"]["kind"] == "dtype_equals"
    laid = model.overlaid(got, ["v"])
    assert laid["Splits"]["ratios"] == {"train": 1.0} and laid["overlays"] == {}
    a = model.parse(recipe(images))
    b = model.parse(dict(reversed(list(recipe(images).items()))))
    assert identity.recipe_hash(a) == identity.recipe_hash(b) != identity.recipe_hash(laid)
    changed = recipe(images)
    changed["Filters"][0]["params"]["action"] = "include"
    one, two = identity.segments(a), identity.segments(model.parse(changed))
    assert one["core"] == two["core"] and one["plugin"] != two["plugin"]
    for bad in ({**recipe(images), "Nonsense": 1}, {**recipe(images), "schema_version": 4}, {"plugin": "x"}, {**recipe(images), "Splits": {"ratio": {}}}):
        with pytest.raises(RecipeError):
            model.parse(bad)


def test_plugins_are_discovered(tmp_path):
    own = tmp_path / "own.py"
    own.write_text("from millrace.recipe.registry import *\nPLUGIN = Plugin('own', by_name([OpSpec('noop', 'Filters', lambda df, p, ctx: df)]), {}, frozenset({'Filters'}), extension_keys={'x': frozenset({'y'})})\n")
    found = registry.discover([str(own)])
    assert found["own"].op("Filters", "noop") and found["own"].op("Filters", "none") is None
    with pytest.raises(PluginError):
        registry.discover([str(own), str(own)])
    with pytest.raises(PluginError):
        registry.discover([str(tmp_path / "none.py")])


def test_cache_is_cleaned_by_what_is_asked_for(tmp_path):
    for r, i, s in (("a" * 16, "b" * 16, "1"), ("c" * 16, "b" * 16, "2")):
        p = tmp_path / "instances" / r / i / s
        p.mkdir(parents=True)
        (p / "manifest.json").write_text("{}")
    assert len(identity.clean(tmp_path, by_seed=2)["removed"]) == 1 and len(identity.instances(tmp_path)) == 1
    assert identity.clean(tmp_path, older_than=10_000)["removed"] == []
    with pytest.raises(CacheError):
        identity.clean(tmp_path, everything=True)
    with pytest.raises(CacheError):
        identity.clean(tmp_path)
    assert identity.clean(tmp_path, everything=True, force=True)["removed"]


def test_command_line(spark, images, tmp_path, capsys):
    path = str(tmp_path / "r.yaml")
    root = ["--cache-root", str(tmp_path / "cache")]
    assert cli.main(["init", str(images / "set"), path]) == 0
    assert cli.main([*root, "validate", path], spark) == 0
    assert cli.main([*root, "--quiet", "materialize", path], spark) == 0
    capsys.readouterr()
    assert cli.main([*root, "status", path], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["status"] == "hit" and Instance.load(found["path"]).manifest["record_counts"]["train"] > 0
    assert cli.main([*root, "report", found["path"]], spark) == 0
    assert cli.main([*root, "clean", "--all"], spark) == 1 and cli.main([*root, "clean", "--all", "--yes"], spark) == 0
    assert cli.main([*root, "check"], spark) == 0
    assert cli.main([*root, "validate", str(tmp_path / "none.yaml")], spark) == 2 and cli.main(["nonsense"]) == 2
