"""Command line: python -m millrace.cli [options] verb ...

Exit codes: 0 done, 1 failed, 2 wrong use or recipe, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from .engine import Config, Engine
from .errors import MillraceError, RecipeError
from .session import session


class JsonFormatter(logging.Formatter):
    """One JSON object a line."""

    _OWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        more = {k: v for k, v in record.__dict__.items() if k not in self._OWN}
        return json.dumps({"level": record.levelname.lower(), "logger": record.name, "message": record.getMessage(), **more}, default=str)


def set_up_logging(level: str, target: str | None) -> None:
    handler = logging.FileHandler(target) if target else logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    log = logging.getLogger("millrace")
    log.handlers, log.propagate = [handler], False
    log.setLevel(level.upper())


def starter(root: str | Path, size: int = 32) -> dict:
    """A recipe for a folder of images with one folder per class."""
    root = Path(root)
    classes = sorted(p.name for p in root.iterdir() if p.is_dir() and any(f.suffix.lower() in (".png", ".jpg", ".jpeg") for f in p.iterdir()))
    if not classes:
        raise RecipeError(f"{root}: no folders of images")
    return {
        "schema_version": 3,
        "plugin": "image_classification",
        "seed": 0,
        "Input": {"sources": [{"name": root.name, "type": "image_folder", "path": str(root)}]},
        "Output": {"record_schema": {"image": {"dtype": "uint8"}, "label": {"dtype": "str"}}},
        "Labels": {"field": "label", "source": {"kind": "direct"}},
        "InputContracts": [{"field": "label", "assertion": {"kind": "value_in_set", "values": classes}}],
        "Splits": {"ratios": {"train": 0.8, "val": 0.1, "test": 0.1}, "stratify_by": "label"},
        "Transformations": [{"name": "scale", "op": "normalize", "fit_source": "train", "splits": ["train", "val", "test"]}],
        "Visualizations": [{"name": "classes", "op": "class_distribution_histogram", "stage": "post_pipeline", "mode": "reporting"}],
    }


def starter_table(spark: SparkSession, path: str, kind: str, label: str) -> dict:
    """A recipe for a table, its fields taken from the schema."""
    from .sources import readers

    kinds = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "str", "boolean": "bool"}
    df = readers.read(spark, kind, path, **({"header": "true", "inferSchema": "true"} if kind == "csv" else {}))
    schema = {c: {"dtype": kinds.get(t, t)} for c, t in df.dtypes}
    if label not in schema:
        raise RecipeError(f"{path}: no column {label}")
    return {
        "schema_version": 3, "plugin": "tabular", "seed": 0,
        "Input": {"sources": [{"name": "table", "type": kind, "path": path}]},
        "Output": {"record_schema": schema}, "Labels": {"field": label},
        "Splits": {"ratios": {"train": 0.8, "val": 0.1, "test": 0.1}, "stratify_by": label},
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--cache-root")
    p.add_argument("--log-level", default="warning")
    p.add_argument("--log-target")
    p.add_argument("--plugin-path", action="append", default=[])
    p.add_argument("--seed", type=int)
    p.add_argument("--overlay", action="append", default=[])
    p.add_argument("--master")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("validate", "materialize", "status", "inspect", "export"):
        v = verbs.add_parser(name)
        v.add_argument("recipe")
        if name == "materialize":
            v.add_argument("--stage")
            v.add_argument("--force", action="store_true")
        if name == "inspect":
            v.add_argument("--view")
            v.add_argument("--out")
        if name == "export":
            v.add_argument("--sink", action="append")
            v.add_argument("--root")
    v = verbs.add_parser("report")
    v.add_argument("instance")
    v = verbs.add_parser("clean")
    v.add_argument("--by-recipe")
    v.add_argument("--by-inputs")
    v.add_argument("--by-seed", type=int)
    v.add_argument("--by-age", type=float, help="seconds")
    v.add_argument("--orphans", action="store_true")
    v.add_argument("--all", action="store_true")
    v.add_argument("--yes", action="store_true")
    v = verbs.add_parser("init")
    v.add_argument("folder")
    v.add_argument("recipe")
    v.add_argument("--kind", default="image_folder")
    v.add_argument("--label", default="label")
    verbs.add_parser("check")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> object:
    config = Config.resolve(dict(os.environ), cache_root=args.cache_root, plugin_paths=args.plugin_path, seed=args.seed)
    if args.verb == "check":
        return Engine.check(config)
    if args.verb == "report":
        return Engine.report(args.instance)
    if args.verb == "clean":
        from .recipe import identity

        return identity.clean(config.cache_root, args.by_recipe, args.by_inputs, args.by_seed, args.by_age, args.orphans, args.all, args.yes)
    if args.verb == "init" and args.kind == "image_folder":
        Path(args.recipe).write_text(yaml.safe_dump(starter(args.folder), sort_keys=False))
        return {"recipe": args.recipe}
    spark = spark or session(**({"spark.master": args.master} if args.master else {}))
    if args.verb == "init":
        Path(args.recipe).write_text(yaml.safe_dump(starter_table(spark, args.folder, args.kind, args.label), sort_keys=False))
        return {"recipe": args.recipe}
    engine = Engine.from_recipe(spark, args.recipe, config, args.overlay)
    if args.verb == "validate":
        found = engine.validate()
        if not found.passed:
            raise RecipeError(json.dumps(found.failures))
        return {"passed": True}
    if args.verb == "materialize":
        show = None if args.quiet else (lambda name: print(name, file=sys.stderr)) if args.verbose else None
        return {"path": str(engine.materialize(stop_after=args.stage, force=args.force, progress=show).path)}
    if args.verb == "status":
        found = engine.status()
        return {"status": found["status"], "path": found["path"]}
    if args.verb == "inspect":
        found = engine.inspect(view=args.view)
        if "png" in found:
            parts = found["png"] if isinstance(found["png"], dict) else {"": found["png"]}
            for name, body in parts.items():
                Path(f"{args.out or args.view}{'_' + name if name else ''}.png").write_bytes(body)
            found["png"] = sorted(parts)
        return found
    return engine.export(args.sink, args.root)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    set_up_logging("debug" if args.verbose else args.log_level, args.log_target)
    try:
        found = run(args, spark)
    except KeyboardInterrupt:
        return 130
    except MillraceError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.exit_code
    if not args.quiet:
        print(found if isinstance(found, str) else json.dumps(found, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
