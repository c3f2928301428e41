"""A recipe from sources to a stored instance.

Each section is a function from DataFrame to DataFrame over one frame with _split; Catalyst sees
all of a stretch between two fits.  What fits and plots read again is written once per stretch
under the cache's tmp folder.  The cache root must be a folder that the driver and all executors
share.
"""

from __future__ import annotations

import hashlib
import json
import logging
import platform
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CacheError, ContractError, MaterializeError, PluginError, SinkCardinalityError, ValidationError
from .functions.ranking import resolve_seed
from .operators import contracts, filters, media, reports, splits
from .operators.generation import path_template
from .operators.splits import SPLIT
from .recipe import identity
from .recipe.model import STAGES, Recipe, load
from .recipe.registry import OpSpec, Plugin, discover
from .recipe.validate import Report, validate
from .session import ship
from .sinks import writers
from .sources.readers import content_hash

log = logging.getLogger("millrace")
REBUILT = ("post_OutputExpectations", "post_Visualizations", "post_Generation")  # stages that an export can go back to


@dataclass
class Config:
    """Runtime settings; explicit values go before MILLRACE_* variables, and these before defaults."""

    cache_root: str = "data-cache"
    plugin_paths: list[str] = field(default_factory=list)
    seed: int | None = None

    @classmethod
    def resolve(cls, env: dict[str, str], **given: object) -> Config:
        paths = [p for p in env.get("MILLRACE_PLUGIN_PATH", "").split(":") if p]
        own = {"cache_root": env.get("MILLRACE_CACHE_ROOT", "data-cache"), "plugin_paths": paths, "seed": int(env["MILLRACE_SEED"]) if "MILLRACE_SEED" in env else None}
        return cls(**own | {k: v for k, v in given.items() if v not in (None, [])})


@dataclass
class Context:
    spark: SparkSession
    recipe: Recipe
    seed: int
    label: str
    op: dict

    def seed_of(self, op: dict) -> int:
        return resolve_seed(op.get("seed"), self.recipe.seed, op["name"])


class FittedStatistics:
    """Fitted values of an instance, read when asked for."""

    def __init__(self, folder: Path):
        self.folder = folder

    def ids(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def _get(self, op_id: str, name: str) -> object:
        path = self.folder / f"{op_id}.json"
        if not path.exists():
            raise CacheError(f"no statistics of {op_id!r}")
        return json.loads(path.read_text())[name]

    def get_scalar(self, op_id: str, name: str) -> float:
        value = self._get(op_id, name)
        if isinstance(value, list):
            raise CacheError(f"{op_id}.{name} is a vector")
        return value

    def get_vector(self, op_id: str, name: str) -> list:
        value = self._get(op_id, name)
        if not isinstance(value, list):
            raise CacheError(f"{op_id}.{name} is a number")
        return value


@dataclass
class Instance:
    """A stored result; its hash is checked when it is loaded."""

    path: Path
    manifest: dict

    @classmethod
    def load(cls, path: str | Path) -> Instance:
        path = Path(path)
        try:
            found = json.loads((path / "manifest.json").read_text())
            recipe = (path / "recipe.json").read_text()
        except (OSError, ValueError) as e:
            raise CacheError(f"{path}: {e}") from e
        if hashlib.sha256(recipe.encode()).hexdigest() != found.get("recipe_file_hash"):
            raise CacheError(f"{path}: the recipe doesn't fit the manifest")
        if path.parent.parent.name != found["recipe_hash"][:16] and not found.get("partial"):
            raise CacheError(f"{path}: the folder doesn't fit the manifest")
        return cls(path, found)

    @property
    def fitted_statistics(self) -> FittedStatistics:
        return FittedStatistics(self.path / "fitted_statistics")

    def dataset(self, spark: SparkSession, split: str | None = None) -> DataFrame:
        df = spark.read.parquet((self.path / "dataset").as_uri())
        return df if split is None else df.where(F.col(SPLIT) == split)

    def sample(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet((self.path / "sample").as_uri())

    def render_report(self) -> str:
        return report(self.manifest, json.loads((self.path / "drift.json").read_text()))


def report(manifest: dict, drift: dict) -> str:
    """Markdown from the manifest and the class counts alone, so the same each time."""
    out = [f"# Instance {manifest['recipe_hash'][:16]}", "", f"Plugin {manifest['plugin']}, seed {manifest['seed']}.", "", "| split | records |", "|-|-|"]
    out += [f"| {k} | {v} |" for k, v in sorted(manifest["record_counts"].items())]
    classes = sorted({c for s in drift["splits"].values() for c in s["classes"]})
    if classes:
        out += ["", "| class | " + " | ".join(sorted(drift["splits"])) + " |", "|-" * (len(drift["splits"]) + 1) + "|"]
        out += [f"| {c} | " + " | ".join(str(drift["splits"][s]["classes"].get(c, 0)) for s in sorted(drift["splits"])) + " |" for c in classes]
    for title, key in (("Checks", "contracts"), ("Warnings", "warnings"), ("Sinks", "sinks"), ("Plots", "plots")):
        if manifest[key]:
            out += ["", f"## {title}", ""]
            out += [f"- {json.dumps(x, sort_keys=True, default=str) if isinstance(x, dict) else x}" for x in manifest[key]]
    return "\n".join([*out, ""])


class Engine:
    """A recipe bound to its plugin."""

    def __init__(self, spark: SparkSession, recipe: Recipe, plugin: Plugin, config: Config):
        self.spark, self.recipe, self.plugin, self.config = spark, recipe, plugin, config
        self._report: Report | None = None
        self._hashes: dict[str, str] | None = None

    @classmethod
    def from_recipe(cls, spark: SparkSession, path: str | Path, config: Config | None = None, overlays: list[str] | None = None, seed: int | None = None) -> Engine:
        config = config or Config()
        recipe = load(path, overlays)
        seed = config.seed if seed is None else seed
        if seed is not None:
            recipe = Recipe({**recipe.body, "seed": seed}, recipe.path)
        found = discover(config.plugin_paths)
        if recipe.plugin not in found:
            raise PluginError(f"no plugin {recipe.plugin!r}; there are {sorted(found)}")
        engine = cls(spark, recipe, found[recipe.plugin], config)
        engine.validate()
        return engine

    def validate(self) -> Report:
        if self._report is None:
            self._report = validate(self.recipe, self.plugin)
        return self._report

    # sources ----------------------------------------------------------------------------

    def _root(self, source: dict) -> str:
        path = str(source["path"])
        if "://" in path or path.startswith(("/", "file:")):
            return path
        return str(((self.recipe.path.parent if self.recipe.path else Path()) / path).resolve())

    def hash_inputs(self) -> dict[str, str]:
        """Content hash of each source, with its manifest's; the bytes are hashed on the executors, nothing is decoded."""
        if self._hashes is None:
            out = {}
            for s in self.recipe.sources:
                total = content_hash(self.spark, self._root(s))
                if s["label_from"]:
                    m = Path(str(s["label_from"]["path"]))
                    m = m if m.is_absolute() or not self.recipe.path else self.recipe.path.parent / m
                    total = hashlib.sha256(f"{total}+;manifest:{content_hash(self.spark, str(m))}".encode()).hexdigest()
                out[s["name"]] = total
            self._hashes = out
        return self._hashes

    def records(self) -> DataFrame:
        """All sources, by name; repeated record ids are an error when they are written."""
        out = None
        for s in self.recipe.sources:
            if s["type"] not in self.plugin.sources:
                raise MaterializeError(f"{self.plugin.name} has no source {s['type']!r}")
            base = self.recipe.path.parent.resolve() if self.recipe.path else Path()
            df = self.plugin.sources[s["type"]](self.spark, {**s, "_base": base}, self._root(s))
            if "label" in df.columns and self.recipe.label != "label":
                df = df.withColumnRenamed("label", self.recipe.label)
            if self.recipe["Labels"]["source"]["kind"] == "derived" and self.recipe.label in df.columns:
                df = df.drop(self.recipe.label)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    # keys -------------------------------------------------------------------------------

    def cache_key(self, hashes: dict[str, str] | None = None) -> identity.CacheKey:
        return identity.cache_key(self.recipe, hashes or self.hash_inputs())

    def status(self) -> dict:
        key = self.cache_key()
        return {"status": identity.status(key, self.config.cache_root), "path": str(key.folder(self.config.cache_root)), "key": key}

    def resolve(self) -> Instance | None:
        found = self.status()
        return Instance.load(found["path"]) if found["status"] == "hit" else None

    def clean(self, **selected: object) -> dict:
        return identity.clean(self.config.cache_root, **selected)

    @staticmethod
    def check(config: Config | None = None) -> dict:
        config = config or Config()
        return {"python": platform.python_version(), "spark": pyspark.__version__, "plugins": sorted(discover(config.plugin_paths)), "cache_root": config.cache_root}

    # running ----------------------------------------------------------------------------

    def materialize(self, raw_records: DataFrame | None = None, raw_input_hashes: dict[str, str] | None = None, stop_after: str | None = None, progress: Callable[[str], None] | None = None, force: bool = False) -> Instance:
        """The stored instance: from the cache if it is there, else computed and moved into place at the end.

        raw_records come with their hashes, or neither.  stop_after names a section; the partial
        result stays under tmp and is no cache entry.  force runs a recipe that breaks rules.
        """
        if not self.validate().passed and not force:
            raise ValidationError(json.dumps(self.validate().failures))
        if (raw_records is None) != (raw_input_hashes is None):
            raise MaterializeError("raw_records and raw_input_hashes come together")
        if stop_after is not None and stop_after not in STAGES:
            raise MaterializeError(f"no section {stop_after!r}")
        key = self.cache_key(raw_input_hashes)
        target = key.folder(self.config.cache_root)
        found = identity.status(key, self.config.cache_root)
        if found == "hit" and stop_after is None:
            return Instance.load(target)
        if found == "corrupt":
            raise CacheError(f"{target}: corrupt; clean it first")
        work = (Path(self.config.cache_root) / "tmp" / uuid.uuid4().hex).resolve()
        work.mkdir(parents=True)
        run = Run(self, work, key, progress or (lambda _: None))
        try:
            run.all(self.records() if raw_records is None else raw_records, stop_after)
        except BaseException as e:
            (work / "FAILED").write_text(json.dumps({"stage": run.stage, "error": str(e)[:2000]}))
            raise
        if stop_after is not None:
            return Instance.load(work)
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.rmtree(work / "steps", ignore_errors=True)
        work.replace(target)
        return Instance.load(target)

    @staticmethod
    def report(path: str | Path) -> str:
        """Renders the report of an instance anew, without running anything."""
        instance = Instance.load(path)
        text = instance.render_report()
        (instance.path / "report.md").write_text(text)
        return text

    def inspect(self, path: str | Path | None = None, view: str | None = None) -> dict:
        """Views there are, the first rows of each split, and a PNG if a view is named."""
        instance = Instance.load(path) if path else self.resolve()
        if instance is None:
            raise CacheError("not materialized")
        if instance.manifest.get("partial"):
            raise CacheError("a partial result can't be inspected")
        names = [v["name"] for v in self.recipe["Visualizations"]]
        df = instance.dataset(self.spark)
        plain = [c for c, t in df.dtypes if not t.startswith(("struct", "array", "binary"))]
        rows = reports.peek(df).select(plain).orderBy(SPLIT, "record_id").collect()
        out: dict = {"views": names, "peek": {}}
        for r in rows:
            out["peek"].setdefault(r[SPLIT], []).append(r.asDict())
        if view is not None:
            v = next((v for v in self.recipe["Visualizations"] if v["name"] == view), None)
            if v is None:
                raise CacheError(f"no view {view!r}")
            spec = self.plugin.op("Visualizations", v["op"])
            out["png"] = spec.run(df, v["params"], Context(self.spark, self.recipe, self.recipe.seed, self.recipe.label, v))
        return out

    def export(self, sink_names: list[str] | None = None, root: str | Path | None = None) -> list[dict]:
        """Writes sinks again from the stored instance of this recipe, which need not have had them.

        Rows of post_Generation are made anew from the instance's own source rows (a semi-join)
        and kept where the instance has them.
        """
        chosen = [s for s in self.recipe["Sinks"] if sink_names is None or s["name"] in sink_names]
        if sink_names and (missing := sorted(set(sink_names) - {s["name"] for s in chosen})):
            raise MaterializeError(f"no sinks {missing}")
        want = identity.recipe_hash(self.recipe.without("Sinks"))
        bound = [p for p in identity.instances(self.config.cache_root) if (p / "manifest.json").exists() and json.loads((p / "manifest.json").read_text()).get("bound_hash") == want]
        if len(bound) != 1:
            raise CacheError(f"{len(bound)} instances fit")
        instance = Instance.load(bound[0])
        done = []
        for s in chosen:
            if s["stage"] not in REBUILT:
                raise MaterializeError(f"{s['name']}: {s['stage']} can't be rebuilt")
            df = instance.dataset(self.spark)
            if s["stage"] == "post_Generation" and self.recipe["Generation"]:
                df = self._generated(df)
            staging = bound[0] / f".export-{uuid.uuid4().hex}"
            done.append(write_sink(df, s, staging, Path(root or bound[0] / "sinks") / s["name"]))
        return done

    def _generated(self, stored: DataFrame) -> DataFrame:
        inputs = self.records()
        key = "source_path" if "source_path" in stored.columns else "path"
        wanted = stored.select(F.col(key).alias("path"), SPLIT).distinct()
        rows = inputs.join(wanted, "path")
        for g in self.recipe["Generation"]:
            rows = generated(self, rows, g)
        return rows.join(stored.select("record_id").distinct(), "record_id", "left_semi")


def generated(engine: Engine, df: DataFrame, g: dict) -> DataFrame:
    """df with an operation's new rows, split by split; they are added, or stand for the old ones."""
    spec = _spec(engine, "Generation", g)
    seed = resolve_seed(g["seed"], engine.recipe.seed, g["name"])
    out = df.where(~F.col(SPLIT).isin(g["splits"])) if g["replace_input_records"] else df
    for split in g["splits"]:
        ctx = Context(engine.spark, engine.recipe, seed, engine.recipe.label, g)
        new = spec.run(df.where(F.col(SPLIT) == split), g["params"], ctx)
        fields = set(engine.recipe["Output"]["record_schema"]) if g["output_schema"] == "matches_input" else set(g["output_schema"])
        later = {f["output_field"] for f in engine.recipe["Featurizations"]}
        if missing := sorted(fields - later - set(new.columns)):
            raise MaterializeError(f"{g['name']}: rows without {missing}")
        out = out.unionByName(new.withColumn(SPLIT, F.lit(split)), allowMissingColumns=True)
    return out


def write_sink(df: DataFrame, sink: dict, staging: Path, target: Path) -> dict:
    """Files of a sink in a staging folder, moved to the target when all are there."""
    write = writers.png_per_record if sink["format"] == "png_per_record" else writers.npy_per_record
    rows = df.withColumns({"_data": F.col(sink["field"])["data"], "_shape": F.col(sink["field"])["shape"]}) if dict(df.dtypes)[sink["field"]].startswith("struct") else df.withColumns({"_data": F.col(sink["field"]), "_shape": F.array(F.size(sink["field"]))})
    more = {}
    if sink["format"] == "npy_per_record":
        rows = rows.withColumn("_data", media.cast(sink["field"], "float32")["data"])
        more = {"dtype": "<f4"}
    staging.mkdir(parents=True, exist_ok=True)
    try:
        got = write(rows, staging.as_uri(), sink["path_template"], "_data", "_shape", sink["splits"], **more)
    except ValueError as e:
        shutil.rmtree(staging)
        raise SinkCardinalityError(f"{sink['name']}: {e}") from e
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.rmtree(target, ignore_errors=True)
    staging.replace(target)
    return {"name": sink["name"], "root": str(target), "files": got["files"], "bytes": got["bytes"]}


def _spec(engine: Engine, section: str, op: dict) -> OpSpec:
    spec = engine.plugin.op(section, op["op"])
    if spec is None:
        raise PluginError(f"{engine.plugin.name} has no {section} operation {op['op']!r}")
    return spec


def assign_splits(df: DataFrame, recipe: Recipe) -> DataFrame:
    """_split by partitions if sources have them, else by tags, by a key, or by ratios."""
    s = recipe["Splits"]
    seed = resolve_seed(s["seed"], recipe.seed, "Splits")
    if "partition" in df.columns:
        if s["ratios"] is not None and not s["applies_to"]:
            raise MaterializeError("ratios need applies_to where sources have partitions")
        present = df.select("partition").distinct().collect()
        names = {r[0] for r in present}
        if None in names:
            raise MaterializeError("rows without a partition")
        if s["applies_to"] is None:
            return splits.split_by_partition(df, "partition")
        if s["applies_to"] not in names:
            raise MaterializeError(f"no partition {s['applies_to']!r}")
        if both := sorted(set(s["ratios"] or {}) & (names - {s["applies_to"]})):
            raise MaterializeError(f"splits {both} are partitions too")
        return splits.split_by_partition(df, "partition", "record_id", s["applies_to"], s["ratios"], seed, s["stratify_by"])
    if s["applies_to"] is not None:
        tagged = df.select(F.explode(filters.TAGS).alias("t")).distinct().collect() if filters.TAGS in df.columns else []
        if both := sorted(set(s["ratios"] or {}) & ({r["t"] for r in tagged} - {s["applies_to"]})):
            raise MaterializeError(f"splits {both} are tags too")
        return splits.split_by_tag(df, filters.TAGS, "record_id", s["applies_to"], s["ratios"], seed)
    if s["key_assignment"] is not None:
        return splits.split_by_key(df, s["key_assignment"]["field"], {str(k): v for k, v in s["key_assignment"]["mapping"].items()})
    return splits.split_by_ratios(df, "record_id", s["ratios"], seed, s["stratify_by"])


class Run:
    """One execution, section by section."""

    def __init__(self, engine: Engine, work: Path, key: identity.CacheKey, progress: Callable[[str], None]):
        self.engine, self.recipe, self.work, self.key, self.progress = engine, engine.recipe, work, key, progress
        self.spark, self.stage, self.began = engine.spark, "Input", time.time()
        self.snapshots: dict[str, DataFrame] = {}
        self.warnings: list[str] = []
        self.checked: list[dict] = []
        self.sinks: list[dict] = []
        self.plots: list[str] = []
        self.policies: list[dict] = []
        self.steps = 0

    def saved(self, df: DataFrame) -> DataFrame:
        """df written and read again, so no fit or plot computes what stands before it anew."""
        self.steps += 1
        path = (self.work / "steps" / str(self.steps)).as_uri()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def context(self, op: dict) -> Context:
        return Context(self.spark, self.recipe, resolve_seed(op.get("seed"), self.recipe.seed, op["name"]), self.recipe.label, op)

    def all(self, df: DataFrame, stop_after: str | None) -> None:
        ship(self.spark)
        df = self.saved(df)
        repeated = df.groupBy("record_id").count().where("count > 1").orderBy("record_id").limit(3).collect()
        if repeated:
            raise MaterializeError(f"record ids repeat: {[r['record_id'] for r in repeated]}")
        for name, step in self.sections():
            self.stage = name
            self.progress(name)
            log.info("section", extra={"section": name})
            df = step(df)
            self.snapshots[f"post_{name}"] = df
            if name not in ("OutputExpectations", "Visualizations"):
                self.snapshots["post_pipeline"] = df
            for s in self.recipe["Sinks"]:
                if s["stage"] == f"post_{name}":
                    rows = df if SPLIT in df.columns else df.withColumn(SPLIT, F.lit("all"))
                    self.sinks.append(write_sink(rows, s, self.work / "steps" / f"sink-{s['name']}", self.work / "sinks" / s["name"]))
            if name == stop_after:
                break
        self.stage = "write"
        self.write(df, stop_after)

    def sections(self) -> Iterator[tuple[str, Callable[[DataFrame], DataFrame]]]:
        yield "InputContracts", lambda df: self.assertions(df, "InputContracts")
        yield "Splits", self.split
        yield "Filters", self.post_filters
        yield "Generation", self.generation
        yield "Transformations", lambda df: self.fitted(df, "Transformations")
        yield "Augmentations", self.augmentations
        yield "Featurizations", lambda df: self.fitted(df, "Featurizations")
        yield "OutputExpectations", lambda df: self.assertions(df, "OutputExpectations")
        yield "Visualizations", self.plot

    def assertions(self, df: DataFrame, section: str) -> DataFrame:
        asked = [contracts.Assertion(a["assertion"].get("kind", "?"), {k: v for k, v in {**a["assertion"], "field": a["field"] or a["assertion"].get("field"), "unlabeled": "_unlabeled" if "_unlabeled" in df.columns and a["field"] == self.recipe.label else None}.items() if k != "kind" and v is not None}, a["severity"]) for a in self.recipe[section]]
        found = contracts.check(df, asked) if asked else []
        self.checked += [{"section": section, **f} for f in found]
        self.warnings += [f"{section}: {f['kind']} {f['field'] or ''}: {f['n_bad']}" for f in found if not f["passed"] and f["severity"] != "error"]
        if bad := [f for f in found if not f["passed"] and f["severity"] == "error"]:
            raise ContractError(f"{section}: {json.dumps(bad, default=str)}")
        return df

    def filtered(self, df: DataFrame, op: dict) -> DataFrame:
        out = _spec(self.engine, "Filters", op).run(df, op["params"], self.context(op))
        if self.recipe.label in df.columns:
            gone = filters.emptied_classes(df, out, self.recipe.label).orderBy("class").limit(100).collect()
            self.warnings += [f"{op['name']}: class {r['class']} is empty, {r['n_before']} before" for r in gone]
        return out

    def split(self, df: DataFrame) -> DataFrame:
        for op in self.recipe["Filters"]:
            if "pre_split" in op["stages"]:
                df = self.filtered(df, op)
        s = self.recipe["Splits"]
        # labels that follow from the path are there before the split that is stratified by them
        for f in self.recipe["Featurizations"]:
            if f["op"] == "label_from_path" and f["output_field"] == s["stratify_by"] and s["stratify_by"] not in df.columns:
                df = _spec(self.engine, "Featurizations", f).run(df, f["params"], self.context(f), {})
        df = self.saved(assign_splits(df, self.recipe))
        if s["stratify_by"] and s["ratios"]:
            sparse = splits.sparse_classes(df, s["stratify_by"], s["ratios"]).orderBy("class").limit(100).collect()
            self.warnings += [f"class {r['class']} has {r['n']} rows for {sum(v > 0 for v in s['ratios'].values())} splits" for r in sparse]
        lost = df.where(F.col(SPLIT).isNull()).count()
        if lost:
            self.warnings.append(f"{lost} rows are in no split")
        return df.where(F.col(SPLIT).isNotNull())

    def post_filters(self, df: DataFrame) -> DataFrame:
        for op in self.recipe["Filters"]:
            if "post_split" in op["stages"]:
                for name in op["splits"]:
                    kept = self.filtered(df.where(F.col(SPLIT) == name), op)
                    df = df.where(F.col(SPLIT) != name).unionByName(kept, allowMissingColumns=True)
        return df

    def generation(self, df: DataFrame) -> DataFrame:
        for g in self.recipe["Generation"]:
            if set(g["splits"]) != {"train"}:
                self.warnings.append(f"{g['name']} makes rows of {g['splits']}")
            df = self.saved(generated(self.engine, df, g))
        return df

    def fitted(self, df: DataFrame, section: str) -> DataFrame:
        for op in self.recipe[section]:
            spec, ctx, values = _spec(self.engine, section, op), self.context(op), {}
            if section == "Featurizations" and op["output_field"] in df.columns and spec.name != "label_from_path":
                raise MaterializeError(f"{op['name']}: {op['output_field']} is there already")
            own = op["params"].get("stats_from_instance")
            if own:
                path = Path(own["recipe"])
                path = path if path.is_absolute() or not self.recipe.path else self.recipe.path.parent / path
                values = identity.sibling_stats(self.engine.config.cache_root, load(path), own["op_id"])
            elif spec.fit:
                df = self.saved(df)
                values = spec.fit(df.where(F.col(SPLIT) == (op["fit_source"] or "train")), op["params"], ctx)
            if values:
                folder = self.work / "fitted_statistics"
                folder.mkdir(exist_ok=True)
                (folder / f"{op['name']}.json").write_text(identity.canonical(values))
            params = {k: v for k, v in op["params"].items() if k != "stats_from_instance"}
            new = spec.run(df, params, ctx, values)
            names = set(op["splits"])
            if section == "Transformations" and names < self.recipe.splits():  # other splits keep their values
                old = dict(df.dtypes)
                changed = [c for c, e in zip(df.columns, [new[c] for c in df.columns], strict=True) if c in _changed(op)]
                both = new.where(F.col(SPLIT).isin(list(names)))
                rest = df.where(~F.col(SPLIT).isin(list(names)))
                for c in changed:
                    rest = rest.withColumn(c, F.col(c).cast(dict(new.dtypes)[c])) if dict(new.dtypes)[c] != old[c] else rest
                new = both.unionByName(rest, allowMissingColumns=True)
            elif section == "Featurizations" and names < self.recipe.splits() and op["output_field"] in new.columns:
                new = new.withColumn(op["output_field"], F.when(F.col(SPLIT).isin(list(names)), F.col(op["output_field"])))
            df = new
        return df

    def augmentations(self, df: DataFrame) -> DataFrame:
        """Lazy operations go into the manifest for training to apply; aggressive ones replace rows by variants."""
        for a in self.recipe["Augmentations"]:
            ctx = self.context(a)
            self.policies.append({"name": a["name"], "op": a["op"], "params": a["params"], "splits": a["splits"], "materialization": a["materialization"], "expansion": a["expansion"], "seed": ctx.seed})
            if a["materialization"] == "aggressive":
                here = F.col(SPLIT).isin(a["splits"])
                made = _spec(self.engine, "Augmentations", a).run(df.where(here), a["params"], ctx)
                df = self.saved(made.unionByName(df.where(~here), allowMissingColumns=True))
        return df

    def plot(self, df: DataFrame) -> DataFrame:
        for v in self.recipe["Visualizations"]:
            if v["mode"] != "reporting":
                continue
            rows = self.snapshots[v["stage"]]
            got = _spec(self.engine, "Visualizations", v).run(rows, v["params"], self.context(v))
            folder = self.work / "visualizations"
            folder.mkdir(exist_ok=True)
            for name, body in (got.items() if isinstance(got, dict) else [("", got)]):
                file = f"{v['name']}{'_' + name if name else ''}.png"
                (folder / file).write_bytes(body)
                self.plots.append(file)
        return df

    def paths(self, df: DataFrame) -> DataFrame:
        """path of rows whose pixels were changed, and feature_path, as the sinks have written them."""
        altered = {s for section in ("Generation", "Transformations", "Augmentations") for op in self.recipe[section] if (spec := self.engine.plugin.op(section, op["op"])) and spec.pixel_altering and op.get("materialization") != "lazy" for s in op["splits"]}
        for form, column, only in (("png_per_record", "path", altered), ("npy_per_record", "feature_path", self.recipe.splits())):
            for split in sorted(only):
                sink = next((s for s in self.recipe["Sinks"] if s["format"] == form and (not s["splits"] or split in s["splits"])), None)
                if sink is None:
                    continue
                new = F.concat(F.lit(f"sinks/{sink['name']}/"), path_template(sink["path_template"], F.col(SPLIT)))
                old = F.col(column) if column in df.columns else F.lit(None).cast("string")
                df = df.withColumn(column, F.when(F.col(SPLIT) == split, new).otherwise(old))
        return df

    def write(self, df: DataFrame, stop_after: str | None) -> None:
        if SPLIT not in df.columns:
            df = df.withColumn(SPLIT, F.lit("all"))
        df = self.paths(df).drop("_unlabeled", "relative")
        target = (self.work / "dataset").as_uri()
        df.select(*sorted(c for c in df.columns if c != SPLIT), SPLIT).sortWithinPartitions("record_id").write.partitionBy(SPLIT).parquet(target)
        df = self.spark.read.parquet(target)
        label = self.recipe.label if self.recipe.label in df.columns else None
        counts = {r[0]: r["n"] for r in reports.record_counts(df).collect()}
        counts = {s: counts.get(s, 0) for s in sorted(self.recipe.splits() | set(counts))}
        classes: dict[str, dict] = {s: {"count": n, "classes": {}} for s, n in counts.items()}
        bare = {s["partition"] for s in self.recipe.sources if s["unlabeled"]}
        if label:
            for r in reports.drift(df, label).collect():
                if r[SPLIT] not in bare:
                    classes[r[SPLIT]]["classes"][r["class"]] = r["n"]
        for s in bare & set(classes):
            classes[s]["note"] = "unlabeled"
        drift = {"splits": classes}
        (self.work / "drift.json").write_text(identity.canonical(drift))
        if self.recipe["SampleData"]:
            self.sample(df, label)
        text = identity.canonical(self.recipe.body)
        (self.work / "recipe.json").write_text(text)
        manifest = {
            "plugin": self.recipe.plugin, "seed": self.recipe.seed, "recipe_hash": self.key.recipe, "inputs_hash": self.key.inputs, "bound_hash": identity.recipe_hash(self.recipe.without("Sinks")),
            "recipe_file_hash": hashlib.sha256(text.encode()).hexdigest(), "segments": identity.segments(self.recipe), "record_counts": counts, "label_classes": sorted({c for s in classes.values() for c in s["classes"]}) or None,
            "warnings": self.warnings, "contracts": self.checked, "sinks": self.sinks, "plots": self.plots, "augmentations": self.policies, "class_balance": self.recipe["Splits"]["class_balance"],
            "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "elapsed_seconds": round(time.time() - self.began, 3), "partial": stop_after, "failed_stage": None,
        }
        (self.work / "report.md").write_text(report(manifest, drift))
        (self.work / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1, default=str))

    def sample(self, df: DataFrame, label: str | None) -> None:
        s = self.recipe["SampleData"]["selector"]
        rows = df.where(F.col(SPLIT).isin(s["splits"])) if s.get("splits") else df
        by = [SPLIT]
        if s.get("kind") == "per_class":
            if label is None:
                raise MaterializeError("per_class needs a label")
            by.append(label)
        rows = splits.sample_data(rows, "record_id", resolve_seed(s.get("seed"), self.recipe.seed, "SampleData"), s.get("n"), s.get("fraction"), by)
        rows.write.partitionBy(SPLIT).parquet((self.work / "sample").as_uri())


def materialize(spark: SparkSession, path: str | Path, config: Config | None = None, **options: object) -> Instance:
    return Engine.from_recipe(spark, path, config).materialize(**options)


def resolve_instance(spark: SparkSession, path: str | Path, config: Config | None = None) -> Instance | None:
    return Engine.from_recipe(spark, path, config).resolve()


def resolve_status(spark: SparkSession, path: str | Path, config: Config | None = None) -> str:
    return Engine.from_recipe(spark, path, config).status()["status"]


def _changed(op: dict) -> set[str]:
    p = op["params"]
    return {*(p.get("fields") or []), p.get("field", "image")}
