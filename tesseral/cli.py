"""Command line: ``python -m tesseral init | generate | migrate … | db …``, configured by ``tesseral.json``."""

from __future__ import annotations

import argparse
import dataclasses
import importlib.util
import json
import os
import sys

from .errors import TesseralError
from .plans.introspect import schema_source
from .plans.migrate import Migrations, Migrator
from .schema import Schema
from .sources.store import VersionedStore

STARTER = '''"""The schema of this project."""

from tesseral.schema import define_schema, id_, table, text

schema = define_schema(users=table("users", id=id_(), email=text().not_null().unique(), name=text()))
'''


@dataclasses.dataclass
class Config:
    schema: str = "schema.py"
    store: str = "store"
    migrations: str = "migrations"

    @staticmethod
    def load(path: str) -> Config:
        if not os.path.exists(path):
            return Config()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        known = {f.name for f in dataclasses.fields(Config)}
        if not isinstance(data, dict) or set(data) - known or not all(isinstance(v, str) and v for v in data.values()):
            raise TesseralError(f"{path}: only {', '.join(sorted(known))} can be set, to text")
        return Config(**data)


def load_schema(path: str) -> Schema:
    if not os.path.exists(path):
        raise TesseralError(f"Schema file not found: {path}")
    spec = importlib.util.spec_from_file_location("tesseral_project_schema", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, "schema", None)
    if not isinstance(found, Schema):
        raise TesseralError(f"{path} must define schema = define_schema(...)")
    return found


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tesseral", description=__doc__)
    out.add_argument("--config", default="tesseral.json")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="write a schema and a configuration")
    generate = commands.add_parser("generate", help="write a migration for the schema's changes")
    generate.add_argument("--name", default="migration")
    generate.add_argument("--accept-data-loss", action="store_true")
    migrate = commands.add_parser("migrate").add_subparsers(dest="action", required=True)
    dev = migrate.add_parser("dev", help="generate, then deploy")
    dev.add_argument("--name", default="migration")
    dev.add_argument("--accept-data-loss", action="store_true")
    for name in ("deploy", "status"):
        migrate.add_parser(name)
    migrate.add_parser("reset").add_argument("--force", action="store_true")
    migrate.add_parser("down").add_argument("--steps", type=int, default=1)
    db = commands.add_parser("db").add_subparsers(dest="action", required=True)
    db.add_parser("push").add_argument("--accept-data-loss", action="store_true")
    db.add_parser("pull").add_argument("--out", default=None)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark)
    except TesseralError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace, spark=None) -> int:
    base = os.path.dirname(os.path.abspath(args.config))
    config = Config.load(args.config)
    local = lambda p: os.path.join(base, p)
    if args.command == "init":
        for path, text in ((args.config, json.dumps(dataclasses.asdict(config), indent=2) + "\n"), (local(config.schema), STARTER)):
            if os.path.exists(path):
                print(f"kept {path}")
            else:
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text)
                print(f"wrote {path}")
        return 0
    migrations = Migrations(local(config.migrations))
    if args.command == "generate" or args.command == "migrate" and args.action == "dev":
        made = migrations.generate(load_schema(local(config.schema)), args.name, args.accept_data_loss)
        print("\n".join([made.state, *made.reasons, *made.changes]))
        if args.command == "generate" or made.state == "blocked":
            return int(made.state == "blocked")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    store = VersionedStore(spark, config.store if "://" in config.store else local(config.store))
    migrator = Migrator(store, migrations)
    if args.command == "migrate":
        done = {"dev": migrator.deploy, "deploy": migrator.deploy, "reset": lambda: migrator.reset(args.force), "down": lambda: migrator.down(args.steps)}
        if args.action == "status":
            for state, names in migrator.status().items():
                print(f"{state}: {', '.join(names) or '-'}")
        else:
            print("\n".join(done[args.action]()) or "nothing to do")
        return 0
    if args.action == "push":
        done, blocked = migrator.push(load_schema(local(config.schema)), args.accept_data_loss)
        print("\n".join([*done, *[f"held back: {d}" for d in blocked]]) or "nothing to do")
        return int(bool(blocked))
    source = schema_source(migrator.live())
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(source)
    else:
        print(source)
    return 0
