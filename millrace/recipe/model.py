"""Recipes: YAML to a checked mapping.  The version is looked at before the shape, older versions are brought forward."""

from __future__ import annotations

import copy
import json
import logging
from dataclasses import dataclass
from pathlib import Path

import yaml

from ..errors import RecipeError

LATEST = 3
log = logging.getLogger("millrace")

# section: {key: (kinds, needed)}; lists hold one mapping per operation
_SEED = (int, dict, type(None))
_ASSERTIONS = {"field": ((str, type(None)), False), "assertion": (dict, True), "severity": (str, False)}
SHAPES: dict[str, tuple[type, dict]] = {
    "Input": (dict, {"sources": (list, True)}),
    "Output": (dict, {"record_schema": (dict, True)}),
    "Labels": (dict, {"field": (str, True), "source": (dict, False)}),
    "SampleData": (dict, {"selector": (dict, True)}),
    "InputContracts": (list, _ASSERTIONS),
    "Filters": (list, {"name": (str, True), "op": (str, True), "params": (dict, False), "stages": (list, False), "splits": (list, False), "seed": (_SEED, False)}),
    "Splits": (dict, {"ratios": ((dict, type(None)), False), "key_assignment": ((dict, type(None)), False), "stratify_by": ((str, type(None)), False), "seed": (_SEED, False), "class_balance": ((str, dict, type(None)), False), "applies_to": ((str, type(None)), False)}),
    "Generation": (list, {"name": (str, True), "op": (str, True), "inputs": (list, True), "output_schema": ((dict, str), True), "seed": (_SEED, True), "splits": (list, False), "params": (dict, False), "replace_input_records": (bool, False)}),
    "Transformations": (list, {"name": (str, True), "op": (str, True), "params": (dict, False), "fit_source": ((str, type(None)), False), "splits": (list, False)}),
    "Augmentations": (list, {"name": (str, True), "op": (str, True), "params": (dict, False), "splits": (list, False), "seed": (_SEED, False), "materialization": (str, False), "expansion": (int, False)}),
    "Featurizations": (list, {"name": (str, True), "inputs": (list, True), "output_field": (str, True), "op": (str, True), "params": (dict, False), "splits": (list, False), "fit_source": ((str, type(None)), False)}),
    "OutputExpectations": (list, _ASSERTIONS),
    "Visualizations": (list, {"name": (str, True), "op": (str, True), "params": (dict, False), "stage": (str, True), "mode": (str, True)}),
    "Sinks": (list, {"name": (str, True), "stage": (str, True), "splits": ((list, type(None)), False), "field": (str, True), "format": (str, True), "path_template": (str, True)}),
    "overlays": (dict, {}),
    "extensions": (dict, {}),
}
NEEDED = ("Input", "Output", "Labels", "Splits")
SOURCE = {"name": (str, True), "type": (str, True), "path": (str, True), "label_from": ((dict, type(None)), False), "partition": ((str, type(None)), False), "unlabeled": (bool, False), "layout": ((str, type(None)), False), "target_sample_rate": (int, False), "options": (dict, False)}
STAGES = ("InputContracts", "Filters", "Splits", "Generation", "Transformations", "Augmentations", "Featurizations", "OutputExpectations", "Visualizations")


@dataclass(frozen=True)
class Recipe:
    """The sections of a recipe, defaults filled in."""

    body: dict
    path: Path | None = None

    def __getitem__(self, section: str) -> dict | list:
        return self.body[section]

    @property
    def plugin(self) -> str:
        return self.body["plugin"]

    @property
    def seed(self) -> int:
        return self.body["seed"]

    @property
    def sources(self) -> list[dict]:
        return self.body["Input"]["sources"]

    @property
    def label(self) -> str:
        return self.body["Labels"]["field"]

    def splits(self) -> set[str]:
        """Names of all splits that the recipe can make."""
        s = self.body["Splits"]
        found = set(s["ratios"] or {}) | {str(v) for v in ((s["key_assignment"] or {}).get("mapping") or {}).values()}
        return found | {x["partition"] for x in self.sources if x["partition"]}

    def without(self, *sections: str) -> Recipe:
        return Recipe({k: type(v)() if k in sections else v for k, v in self.body.items()}, self.path)


def migrate(raw: dict) -> dict:
    """Versions 1 and 2 in the form of version 3."""
    out = copy.deepcopy(raw)
    version = out.get("schema_version", 1)
    if version not in (1, 2, LATEST):
        raise RecipeError(f"schema_version {version!r} is unknown")
    if version == 1:
        for f in out.get("Filters") or []:
            if "predicate" in f and "op" not in f:
                params = dict(f.pop("predicate"))
                if "op" not in params:
                    raise RecipeError(f"Filters {f.get('name')!r}: the predicate names no op")
                f["op"] = params.pop("op")
                if "seed" in params:
                    f.setdefault("seed", params.pop("seed"))
                f["params"] = params
        for g in out.get("Generation") or []:
            if "op" not in g:
                params = dict(g.get("params") or {})
                g["op"] = params.pop("op", g.get("name"))
                g["params"] = params
            if "applies_at" in g:
                if "splits" in g:
                    raise RecipeError(f"Generation {g.get('name')!r}: applies_at and splits")
                g["splits"] = g.pop("applies_at")
            if g.pop("output_schema_matches_input", False) is True:
                g["output_schema"] = "matches_input"
        renamed = {"dtype": "dtype_equals", "range": "value_range", "record_count": "record_count_in_range"}
        for section in ("InputContracts", "OutputExpectations"):
            for a in out.get(section) or []:
                kind = (a.get("assertion") or {}).get("kind")
                if kind in renamed:
                    a["assertion"]["kind"] = renamed[kind]
    if version < LATEST and "variants" in out:
        out.setdefault("overlays", out.pop("variants"))
        out.pop("variants", None)
    out["schema_version"] = LATEST
    return out


def _shaped(where: str, value: dict, shape: dict) -> dict:
    if not isinstance(value, dict):
        raise RecipeError(f"{where}: not a mapping")
    if unknown := sorted(set(value) - set(shape)):
        log.warning("%s: unknown keys %s", where, unknown)
        raise RecipeError(f"{where}: unknown keys {unknown}")
    out = {}
    for key, (kinds, needed) in shape.items():
        if value.get(key) is None:
            if needed:
                raise RecipeError(f"{where}: {key} is missing")
            first = kinds if isinstance(kinds, type) else None
            out[key] = first() if first in (dict, list, bool) else None
            continue
        if not isinstance(value[key], kinds) or (isinstance(value[key], bool) and kinds is int):
            raise RecipeError(f"{where}: {key} has the wrong kind")
        out[key] = value[key]
    return out


def parse(raw: dict, path: Path | None = None) -> Recipe:
    """A mapping as a recipe of the latest version."""
    if not isinstance(raw, dict):
        raise RecipeError("a recipe is a mapping")
    raw = migrate(raw)
    known = {"schema_version", "plugin", "seed", *SHAPES}
    if unknown := sorted(set(raw) - known):
        log.warning("unknown sections %s", unknown)
        raise RecipeError(f"unknown sections {unknown}")
    if missing := [s for s in ("plugin", *NEEDED) if s not in raw]:
        raise RecipeError(f"missing: {missing}")
    body = {"schema_version": raw["schema_version"], "plugin": str(raw["plugin"]), "seed": int(raw.get("seed", 0))}
    for section, (kind, shape) in SHAPES.items():
        value = raw.get(section)
        if value is None:
            body[section] = None if section == "SampleData" else kind()
            continue
        if not isinstance(value, kind):
            raise RecipeError(f"{section}: not a {kind.__name__}")
        if kind is list:
            body[section] = [_shaped(f"{section}[{i}]", v, shape) for i, v in enumerate(value)]
        else:
            body[section] = _shaped(section, value, shape) if shape else value
    body["Input"]["sources"] = [_shaped(f"Input.sources[{i}]", s, SOURCE) for i, s in enumerate(body["Input"]["sources"])]
    for f in body["Filters"]:
        f["stages"] = f["stages"] or ["pre_split"]
    for section in ("Generation", "Augmentations"):
        for op in body[section]:
            op["splits"] = op["splits"] or ["train"]
    for a in body["Augmentations"]:
        a["materialization"], a["expansion"] = a["materialization"] or "lazy", 1 if a["expansion"] is None else a["expansion"]
    for section in ("InputContracts", "OutputExpectations"):
        for a in body[section]:
            a["severity"] = a["severity"] or "error"
    body["Labels"]["source"] = {"kind": "direct", **body["Labels"]["source"]}
    return Recipe(body, path)


def overlaid(recipe: Recipe, names: list[str]) -> Recipe:
    """Each overlay replaces whole sections, the last one wins; overlays themselves go."""
    body = copy.deepcopy(recipe.body)
    found, body["overlays"] = body["overlays"], {}
    for name in names:
        if name not in found:
            raise RecipeError(f"no overlay {name!r}")
        body |= copy.deepcopy(found[name])
    return parse(json.loads(json.dumps({k: v for k, v in body.items() if v is not None})), recipe.path)


def load(path: str | Path, overlays: list[str] | None = None) -> Recipe:
    path = Path(path)
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise RecipeError(f"{path}: {e}") from e
    recipe = parse(raw, path)
    return overlaid(recipe, overlays) if overlays else recipe
