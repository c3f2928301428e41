"""31 static checks of a recipe.  Each gives messages; all run, none stops the others."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from .model import STAGES, Recipe
from .registry import Plugin

SINK_STAGES = tuple(f"post_{s}" for s in STAGES)
VIEW_STAGES = (*(f"post_{s}" for s in STAGES[:7]), "post_pipeline")
_OPS = ("Transformations", "Augmentations", "Featurizations")
_FIELD = re.compile(r"\{(\w+)((?:\|\w+)*)\}")
CHECKS: list[Callable[[Recipe, Plugin], Iterator[str]]] = []


@dataclass
class Report:
    """failures: check number and name -> messages."""

    failures: dict[str, list[str]] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return not self.failures


def check(f: Callable) -> Callable:
    CHECKS.append(f)
    return f


def validate(recipe: Recipe, plugin: Plugin) -> Report:
    found = {f"{i:02d} {f.__name__}": list(f(recipe, plugin)) for i, f in enumerate(CHECKS, 1)}
    return Report({k: v for k, v in found.items() if v})


def _ops(r: Recipe, *sections: str) -> Iterator[tuple[str, dict]]:
    for s in sections:
        for op in r[s]:
            yield s, op


def _declared(r: Recipe, p: Plugin) -> set[str]:
    layouts = {n for s in r.sources for n in re.findall(r"\{(\w+)\}", s["layout"] or "")} - {"file", "split"}
    return set(r["Output"]["record_schema"]) | set(p.stamped) | {r.label} | layouts


def _all_fields(r: Recipe, p: Plugin) -> set[str]:
    made = {f["output_field"] for f in r["Featurizations"]} | {k for g in r["Generation"] if isinstance(g["output_schema"], dict) for k in g["output_schema"]}
    if any(s and s.fan_out for s in (p.op(x, o["op"]) for x, o in _ops(r, "Generation"))) or any(a["materialization"] == "aggressive" for a in r["Augmentations"]):
        made |= {"source_record_id", "window_index", "variant_index", "corruption", "severity", "source_path"}
    return _declared(r, p) | made


@check
def schema_version(r, p):  # noqa: ANN001, ANN201
    if r["schema_version"] not in (1, 2, 3):
        yield f"schema_version {r['schema_version']}"


@check
def plugin_name(r, p):  # noqa: ANN001, ANN201
    if r.plugin != p.name:
        yield f"the recipe wants {r.plugin}, this is {p.name}"


@check
def sections(r, p):  # noqa: ANN001, ANN201
    for s in ("Filters", "Generation", *_OPS, "Visualizations"):
        if r[s] and s not in p.sections:
            yield f"{p.name} has no section {s}"


@check
def splits_declared(r, p):  # noqa: ANN001, ANN201
    for s, op in _ops(r, "Filters", *_OPS):
        if not op["splits"] and (s != "Filters" or "post_split" in op["stages"]):
            yield f"{s} {op['name']}: no splits"


@check
def augmentations_train_only(r, p):  # noqa: ANN001, ANN201
    for _, op in _ops(r, "Augmentations"):
        if set(op["splits"]) != {"train"}:
            yield f"{op['name']}: splits {op['splits']}"


@check
def fit_on_train(r, p):  # noqa: ANN001, ANN201
    for s, op in _ops(r, "Transformations"):
        spec = p.op(s, op["op"])
        if spec and spec.fit_on_train and op["fit_source"] not in ("train", None):
            yield f"{op['name']}: fit_source {op['fit_source']}"
        if spec and spec.fit_on_train and op["fit_source"] is None and "stats_from_instance" not in op["params"]:
            yield f"{op['name']}: no fit_source"


@check
def featurization_inputs(r, p):  # noqa: ANN001, ANN201
    known = _all_fields(r, p) - {f["output_field"] for f in r["Featurizations"]} | set(r["Output"]["record_schema"])
    for _, op in _ops(r, "Featurizations"):
        if missing := sorted(set(op["inputs"]) - known):
            yield f"{op['name']}: {missing}"
        known.add(op["output_field"])


@check
def splits_form(r, p):  # noqa: ANN001, ANN201
    s = r["Splits"]
    partitioned = any(x["partition"] or "{split}" in (x["layout"] or "") for x in r.sources)
    n = (s["ratios"] is not None) + (s["key_assignment"] is not None)
    if n != 1 and not (partitioned and n == 0):
        yield "one of ratios and key_assignment is needed"
    if s["ratios"] is not None:
        if not s["ratios"]:
            yield "ratios are empty"
        if any(not isinstance(v, int | float) or v < 0 for v in s["ratios"].values()) or sum(s["ratios"].values()) > 1 + 1e-9:
            yield f"ratios {s['ratios']}"
    if s["key_assignment"] is not None and not (s["key_assignment"].get("field") and s["key_assignment"].get("mapping")):
        yield "key_assignment needs a field and a mapping"


@check
def stratify_declared(r, p):  # noqa: ANN001, ANN201
    by = r["Splits"]["stratify_by"]
    if by and by not in _declared(r, p):
        yield f"stratify_by {by}"


@check
def imbalance_in_one_place(r, p):  # noqa: ANN001, ANN201
    balance = r["Splits"]["class_balance"]
    if balance is not None and any(g["op"] == "duplicate_minority_class" for g in r["Generation"]):
        yield "class_balance and duplicate_minority_class"
    if isinstance(balance, dict) and not isinstance(balance.get("strategy"), str):
        yield "class_balance names no strategy"


@check
def view_stage(r, p):  # noqa: ANN001, ANN201
    for _, v in _ops(r, "Visualizations"):
        if v["stage"] not in VIEW_STAGES:
            yield f"{v['name']}: stage {v['stage']}"
        elif v["stage"] not in ("post_pipeline", "post_Splits") and not r[v["stage"].removeprefix("post_")]:
            yield f"{v['name']}: {v['stage']}, but the section is empty"
        if v["mode"] not in ("exploration", "reporting"):
            yield f"{v['name']}: mode {v['mode']}"


@check
def overlay_sections(r, p):  # noqa: ANN001, ANN201
    from .model import SHAPES

    for name, o in r["overlays"].items():
        if unknown := sorted(set(o) - (set(SHAPES) - {"overlays"} | {"seed"})):
            yield f"{name}: {unknown}"


@check
def label_declared(r, p):  # noqa: ANN001, ANN201
    if r.label not in r["Output"]["record_schema"]:
        yield f"label {r.label} is not in record_schema"


@check
def generation_schema(r, p):  # noqa: ANN001, ANN201
    schema = r["Output"]["record_schema"]
    for _, g in _ops(r, "Generation"):
        out = g["output_schema"]
        if isinstance(out, str):
            if out != "matches_input":
                yield f"{g['name']}: output_schema {out}"
            continue
        for k, spec in out.items():
            if k in schema and spec.get("dtype") != schema[k].get("dtype"):
                yield f"{g['name']}: {k} is {spec.get('dtype')}, declared {schema[k].get('dtype')}"
        if r.label not in out:
            yield f"{g['name']}: no {r.label}"


@check
def split_references(r, p):  # noqa: ANN001, ANN201
    known = r.splits()
    if any("{split}" in (s["layout"] or "") for s in r.sources):
        return
    for s, op in _ops(r, "Filters", *_OPS, "Generation"):
        for name in [*(op["splits"] or []), *([op["fit_source"]] if op.get("fit_source") else [])]:
            if name not in known:
                yield f"{s} {op['name']}: split {name}"


@check
def sample_selector(r, p):  # noqa: ANN001, ANN201
    if r["SampleData"] is None:
        return
    s = r["SampleData"]["selector"]
    if unknown := sorted(set(s) - {"n", "fraction", "seed", "kind", "splits"}):
        yield f"unknown {unknown}"
    if (s.get("n") is None) == (s.get("fraction") is None):
        yield "one of n and fraction is needed"
    if s.get("n") is not None and s["n"] <= 0:
        yield f"n {s['n']}"
    if s.get("fraction") is not None and not 0 < s["fraction"] <= 1:
        yield f"fraction {s['fraction']}"
    if s.get("kind", "uniform") not in ("uniform", "per_class"):
        yield f"kind {s['kind']}"
    if s.get("kind") == "per_class" and r["Labels"]["source"]["kind"] == "direct" and all(x["unlabeled"] for x in r.sources):
        yield "per_class without labels"
    if s.get("splits") and (unknown := sorted(set(s["splits"]) - r.splits())):
        yield f"splits {unknown}"


@check
def contract_fields(r, p):  # noqa: ANN001, ANN201
    for section, known in (("InputContracts", _declared(r, p)), ("OutputExpectations", _all_fields(r, p))):
        for a in r[section]:
            if a["field"] and a["field"] not in known:
                yield f"{section}: {a['field']}"


@check
def operations(r, p):  # noqa: ANN001, ANN201
    for s, op in _ops(r, "Filters", *_OPS, "Visualizations", "Generation"):
        spec = p.op(s, op["op"])
        if spec is None:
            yield f"{s} {op['name']}: no operation {op['op']}"
            continue
        given = set(op["params"]) - {"stats_from_instance"}
        if missing := sorted(k for k, v in spec.params.items() if v.needed and k not in given):
            yield f"{s} {op['name']}: {missing} missing"
        if unknown := sorted(given - set(spec.params)):
            yield f"{s} {op['name']}: {unknown} unknown"
        for k in given & set(spec.params):
            if not isinstance(op["params"][k], spec.params[k].kinds):
                yield f"{s} {op['name']}: {k} has the wrong kind"


def _root(r: Recipe) -> Path:
    return r.path.parent if r.path else Path()


@check
def manifests(r, p):  # noqa: ANN001, ANN201
    for s in r.sources:
        m = s["label_from"]
        if not m:
            continue
        if m.get("join") not in ("by_id", "by_row_order") or not m.get("label_field") or (m.get("join") == "by_id" and not m.get("id_field")):
            yield f"{s['name']}: label_from needs join, label_field and, by id, id_field"
            continue
        path = _root(r) / str(m.get("path", ""))
        if not path.is_file():
            yield f"{s['name']}: no file {path}"
            continue
        header = m.get("header")
        if not header:
            with path.open(newline="", encoding="utf-8") as f:
                header = next(csv.reader(f), [])
        for k in ("id_field", "label_field"):
            if m.get(k) and m[k] not in header:
                yield f"{s['name']}: {path} has no {m[k]}"


@check
def partitions(r, p):  # noqa: ANN001, ANN201
    has = [bool(s["partition"]) or "{split}" in (s["layout"] or "") for s in r.sources]
    if any(has) and not all(has):
        yield "some sources have a partition, others none"
    s = r["Splits"]
    if any(has) and s["ratios"] is not None and not s["applies_to"]:
        yield "ratios need applies_to where sources have partitions"
    if all(has) and has and s["applies_to"] and s["applies_to"] not in {x["partition"] for x in r.sources} and not any("{split}" in (x["layout"] or "") for x in r.sources):
        yield f"applies_to {s['applies_to']}"
    if any(has) and s["applies_to"] and (both := sorted(set(s["ratios"] or {}) & {x["partition"] for x in r.sources} - {s["applies_to"]})):
        yield f"splits {both} are partitions too"


@check
def unlabeled(r, p):  # noqa: ANN001, ANN201
    for s in r.sources:
        if s["unlabeled"]:
            if s["label_from"] or "{label}" in (s["layout"] or ""):
                yield f"{s['name']}: unlabeled, with a label source"
            if not (s["partition"] or "{split}" in (s["layout"] or "")):
                yield f"{s['name']}: unlabeled without a partition"
            if s["type"].endswith("_folder"):
                yield f"{s['name']}: {s['type']} has labels"


@check
def stats_source(r, p):  # noqa: ANN001, ANN201
    for _, op in _ops(r, "Transformations", "Featurizations"):
        own = op["params"].get("stats_from_instance")
        if own is not None and op["fit_source"]:
            yield f"{op['name']}: fit_source and stats_from_instance"
        if own is not None and not (isinstance(own, dict) and own.get("recipe") and own.get("op_id")):
            yield f"{op['name']}: stats_from_instance needs recipe and op_id"


@check
def featurization_outputs(r, p):  # noqa: ANN001, ANN201
    seen = set(p.stamped) if r["Labels"]["source"]["kind"] == "derived" else set(p.stamped) | {r.label}
    for _, op in _ops(r, "Featurizations"):
        if op["output_field"] in seen:
            yield f"{op['name']}: {op['output_field']} is there already"
        seen.add(op["output_field"])


@check
def sinks(r, p):  # noqa: ANN001, ANN201
    names = [s["name"] for s in r["Sinks"]]
    known = _all_fields(r, p)
    for s in r["Sinks"]:
        if names.count(s["name"]) > 1:
            yield f"{s['name']}: the name repeats"
        if s["stage"] not in SINK_STAGES or s["format"] not in ("png_per_record", "npy_per_record"):
            yield f"{s['name']}: {s['stage']}, {s['format']}"
        t = s["path_template"]
        if t.startswith("/") or ".." in t.split("/"):
            yield f"{s['name']}: the template leaves its folder"
        if re.sub(_FIELD, "", t).strip("/") != re.sub(r"\{[^}]*\}", "", t).strip("/") or "{" in re.sub(_FIELD, "", t):
            yield f"{s['name']}: can't read {t}"
        for name, filters in _FIELD.findall(t):
            if name != "split" and name not in known:
                yield f"{s['name']}: no field {name}"
            if bad := set(filters.split("|")[1:]) - {"stem", "lower", "upper", "str"}:
                yield f"{s['name']}: {sorted(bad)}"
        if s["field"] not in known:
            yield f"{s['name']}: no field {s['field']}"
        if s["splits"] and (unknown := sorted(set(s["splits"]) - r.splits())):
            yield f"{s['name']}: splits {unknown}"


@check
def view_groups(r, p):  # noqa: ANN001, ANN201
    for _, v in _ops(r, "Visualizations"):
        by = v["params"].get("group_by")
        if by and by not in _all_fields(r, p) | {"split"}:
            yield f"{v['name']}: group_by {by}"


@check
def pixels_kept(r, p):  # noqa: ANN001, ANN201
    for s, op in _ops(r, "Generation", "Transformations", "Augmentations"):
        spec = p.op(s, op["op"])
        if not spec or not spec.pixel_altering or (s == "Augmentations" and op["materialization"] == "lazy"):
            continue
        at = SINK_STAGES.index(f"post_{s}")
        for split in op["splits"]:
            if not any(k["format"] == "png_per_record" and SINK_STAGES.index(k["stage"]) >= at and (not k["splits"] or split in k["splits"]) for k in r["Sinks"] if k["stage"] in SINK_STAGES):
                yield f"{s} {op['name']}: no PNG sink for {split}"


@check
def dtype_before_variants(r, p):  # noqa: ANN001, ANN201
    fanned = {x for a in r["Augmentations"] if a["materialization"] == "aggressive" for x in a["splits"]}
    for s, op in _ops(r, "Transformations"):
        spec = p.op(s, op["op"])
        if spec and spec.dtype_altering and (both := sorted(set(op["splits"]) & fanned)):
            yield f"{op['name']}: {both} are augmented aggressively"


@check
def extensions(r, p):  # noqa: ANN001, ANN201
    for space, keys in r["extensions"].items():
        if space not in p.extension_keys:
            yield f"namespace {space}"
        elif unknown := sorted(set(keys) - p.extension_keys[space]):
            yield f"{space}: {unknown}"


@check
def no_stratify_on_copies(r, p):  # noqa: ANN001, ANN201
    fan = any(s and s.fan_out for s in (p.op(x, o["op"]) for x, o in _ops(r, "Generation")))
    if fan and r["Splits"]["stratify_by"] in ("source_record_id", "window_index"):
        yield f"stratify_by {r['Splits']['stratify_by']}"


@check
def npy_before_normalize(r, p):  # noqa: ANN001, ANN201
    altered = {op["params"].get("field", "image") for s, op in _ops(r, "Transformations") if (spec := p.op(s, op["op"])) and spec.dtype_altering and spec.fit_on_train}
    for s in r["Sinks"]:
        if s["format"] == "npy_per_record" and s["field"] in altered and s["stage"] in SINK_STAGES and SINK_STAGES.index(s["stage"]) >= SINK_STAGES.index("post_Transformations"):
            yield f"{s['name']}: {s['field']} is normalised by then"


@check
def tree_labels(r, p):  # noqa: ANN001, ANN201
    for s in r.sources:
        if s["type"].endswith("_tree"):
            if not s["layout"]:
                yield f"{s['name']}: no layout"
            elif ("{label}" in s["layout"]) + bool(s["label_from"]) + s["unlabeled"] != 1:
                yield f"{s['name']}: one label source is needed"
