"""Plugins: what operations exist, their parameters, and what runs them."""

from __future__ import annotations

import importlib
import importlib.metadata
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import PluginError

GROUP = "millrace.plugins"


@dataclass(frozen=True)
class Param:
    kinds: type | tuple[type, ...] = object
    needed: bool = True


@dataclass(frozen=True)
class OpSpec:
    """An operation of one section.

    run: Filters (df, params, ctx) -> df; Generation (rows of one split, params, ctx) -> new
    rows; Transformations and Featurizations (df, params, ctx, fitted) -> df with the column
    changed or added; Augmentations (df, params, ctx) -> df; Visualizations (df, params, ctx) ->
    PNG bytes, or a dict of them.  fit: (training rows, params, ctx) -> name: number or list.
    ctx has spark, recipe, seed, label, op (the recipe's entry).
    """

    name: str
    section: str
    run: Callable
    params: dict[str, Param] = field(default_factory=dict)
    fit: Callable | None = None
    pixel_altering: bool = False
    dtype_altering: bool = False
    fan_out: bool = False

    @property
    def fit_on_train(self) -> bool:
        return self.fit is not None


@dataclass(frozen=True)
class Plugin:
    """ops by (section, name); sources: type -> (spark, source, root) -> DataFrame; extension_keys: namespace -> keys."""

    name: str
    ops: dict[tuple[str, str], OpSpec]
    sources: dict[str, Callable]
    sections: frozenset[str]
    stamped: frozenset[str] = frozenset({"record_id", "path", "partition"})
    extension_keys: dict[str, frozenset[str]] = field(default_factory=dict)

    def op(self, section: str, name: str) -> OpSpec | None:
        return self.ops.get((section, name))


def by_name(specs: list[OpSpec]) -> dict[tuple[str, str], OpSpec]:
    out: dict[tuple[str, str], OpSpec] = {}
    for s in specs:
        if (s.section, s.name) in out:
            raise PluginError(f"{s.section} has two operations {s.name}")
        out[s.section, s.name] = s
    return out


def discover(paths: list[str] | None = None) -> dict[str, Plugin]:
    """The built-in plugins, those of installed entry points, and those of module files with a PLUGIN; names must differ."""
    from . import builtin

    found: dict[str, Plugin] = {}

    def add(plugin: object, where: str) -> None:
        if not isinstance(plugin, Plugin):
            raise PluginError(f"{where}: PLUGIN is no plugin")
        if plugin.name in found:
            raise PluginError(f"{where}: there already is a plugin {plugin.name!r}")
        found[plugin.name] = plugin

    for p in builtin.PLUGINS:
        add(p, "built in")
    for e in importlib.metadata.entry_points(group=GROUP):
        add(e.load(), e.name)
    for path in paths or []:
        spec = importlib.util.spec_from_file_location(Path(path).stem, path)
        if spec is None or not Path(path).exists():
            raise PluginError(f"{path}: no module")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        add(getattr(module, "PLUGIN", None), path)
    return found
