"""Identity of a recipe, cache keys, the layout of the cache, and cleaning it."""

from __future__ import annotations

import hashlib
import json
import shutil
import time
from dataclasses import dataclass
from pathlib import Path

from ..errors import CacheError, SiblingAmbiguous, SiblingMissing, SiblingWithoutStats
from .model import Recipe

DOMAIN = "millrace-recipe-1"


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; whole floats as they are written."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def segments(recipe: Recipe) -> dict[str, str]:
    """SHA-256 of the core, the operations' parameters, the extensions and the overlays (applied before, so empty); an empty part has no hash."""
    ops = ("Filters", "Generation", "Transformations", "Augmentations", "Featurizations", "Visualizations")
    parts = {
        "core": {k: v for k, v in recipe.body.items() if k not in (*ops, "overlays", "extensions", "seed")},
        "plugin": {k: recipe.body[k] for k in ops if recipe.body[k]},
        "overlays": {},
        "extensions": recipe.body["extensions"],
    }
    return {name: hashlib.sha256(f"{DOMAIN}:{name}:{canonical(p)}".encode()).hexdigest() if p else "" for name, p in parts.items()}


def recipe_hash(recipe: Recipe) -> str:
    return hashlib.sha256(":".join([DOMAIN, *(f"{k}={v}" for k, v in segments(recipe).items())]).encode()).hexdigest()


@dataclass(frozen=True)
class CacheKey:
    recipe: str
    inputs: str
    seed: int

    def folder(self, root: str | Path) -> Path:
        return Path(root) / "instances" / self.recipe[:16] / self.inputs[:16] / str(self.seed)


def cache_key(recipe: Recipe, hashes: dict[str, str], seed: int | None = None) -> CacheKey:
    """hashes: source name -> content hash."""
    inputs = hashlib.sha256(canonical(hashes).encode()).hexdigest()
    return CacheKey(recipe_hash(recipe), inputs, recipe.seed if seed is None else seed)


def status(key: CacheKey, root: str | Path) -> str:
    """hit, miss or corrupt."""
    folder = key.folder(root)
    try:
        found = json.loads((folder / "manifest.json").read_text())
    except FileNotFoundError:
        return "corrupt" if folder.exists() else "miss"
    except ValueError:
        return "corrupt"
    return "hit" if found.get("recipe_hash") == key.recipe and found.get("inputs_hash") == key.inputs else "corrupt"


def instances(root: str | Path) -> list[Path]:
    return sorted(p for p in (Path(root) / "instances").glob("*/*/*") if p.is_dir())


def clean(root: str | Path, by_recipe: str | None = None, by_inputs: str | None = None, by_seed: int | None = None, older_than: float | None = None, orphans: bool = False, everything: bool = False, force: bool = False) -> dict[str, list[str]]:
    """Removes instances by hash prefix, seed or age (seconds), leftovers of failed runs, or all (with force)."""
    if everything and not force:
        raise CacheError("all instances go only with force")
    if not any((by_recipe, by_inputs, by_seed is not None, older_than is not None, orphans, everything)):
        raise CacheError("nothing selected")
    removed, skipped = [], []
    chosen = any((by_recipe, by_inputs, by_seed is not None, older_than is not None))
    for p in instances(root):
        fits = chosen and (not by_recipe or p.parent.parent.name.startswith(by_recipe[:16])) and (not by_inputs or p.parent.name.startswith(by_inputs[:16]))
        fits = fits and (by_seed is None or p.name == str(by_seed)) and (older_than is None or time.time() - p.stat().st_mtime > older_than)
        orphan = orphans and not (p / "manifest.json").exists()
        (removed if everything or fits or orphan else skipped).append(p)
    if orphans or everything:
        removed += [p for p in (Path(root) / "tmp").glob("*") if p.is_dir()]
    for p in removed:
        shutil.rmtree(p)
    return {"removed": [str(p) for p in removed], "skipped": [str(p) for p in skipped]}


def sibling_stats(root: str | Path, sibling: Recipe, op_id: str) -> dict:
    """Fitted values of an operation of another recipe's one instance."""
    folder = Path(root) / "instances" / recipe_hash(sibling)[:16]
    found = [p for p in sorted(folder.glob("*/*")) if (p / "manifest.json").exists()]
    if not found:
        raise SiblingMissing(f"no instance of {sibling.path}")
    if len(found) > 1:
        raise SiblingAmbiguous(f"{len(found)} instances of {sibling.path}")
    path = found[0] / "fitted_statistics" / f"{op_id}.json"
    if not path.exists():
        raise SiblingWithoutStats(f"{found[0]}: no statistics of {op_id!r}")
    return json.loads(path.read_text())
