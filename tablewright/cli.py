"""Command line: diff, sync, tables, version."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from .plans import config as configs
from .plans import decide, report, sync
from .plans.schema import PlanError
from .sources.jdbc import JdbcSide
from .sources.tables import Side

VERSION = "0.1.0"
COMMANDS = ("diff", "sync", "tables", "version")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tablewright", description="Compare and align tables with Spark.")
    out.add_argument("command", nargs="?", default="diff", choices=COMMANDS)
    out.add_argument("--config")
    for f in fields(configs.Config):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            out.add_argument(flag, action="store_true", default=None)
        else:
            out.add_argument(flag)
    return out


def session() -> SparkSession:
    return SparkSession.builder.appName("tablewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def opened(spark: SparkSession, place: str | configs.Address, config: configs.Config, side: str, command: str) -> Side | JdbcSide:
    """A side for reading. A snapshot keeps the versions of both sides of a diff and of a sync's source; a database
    read over several connections has none, so it is refused there."""
    if isinstance(place, str) and not place.startswith("jdbc:"):
        return Side(spark, place, config.snapshot and (side == "src" or command == "diff"))
    if config.snapshot:
        raise PlanError("a snapshot over several database connections can't be held", argument=True)
    if isinstance(place, configs.Address):
        return JdbcSide(spark, place.url, place.options(), config.parallel)
    user, variable = getattr(config, f"{side}_user"), getattr(config, f"{side}_password_env")
    given = {"user": user} | ({"password": os.environ[variable]} if os.environ.get(variable) else {}) if user else {}
    return JdbcSide(spark, place, given, config.parallel)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, ask=input, out=sys.stdout) -> int:
    given = vars(parser().parse_args(arguments))
    command, path = given.pop("command"), given.pop("config")
    if command == "version":
        print(VERSION, file=out)
        return 0
    try:
        base = configs.Config()
        if path:
            with open(path) as file:
                base = configs.from_yaml(file.read())
        config = configs.overlay(base, given)
        places = [config.place(side) for side in ("src", "dst")]
        spark = spark or session()
        src, dst = (opened(spark, place, config, side, command) for place, side in zip(places, ("src", "dst")))
        only, exclude = list(config.tables), list(config.exclude_tables)
        if command == "tables":
            print("\n".join(decide.common_tables(src.tables(), dst.tables(), only, exclude)), file=out)
            return 0
        if command == "diff":
            results = sync.compare_sides(src, dst, only, exclude, config.spec, config.parallel)
            print((report.diff_json if config.json else report.diff_text)(results), file=out)
            return decide.exit_code(r.status for r in results)
        return _sync(src, dst, only, exclude, config, ask, out)
    except PlanError as error:
        print(f"error: {error}", file=sys.stderr)
        return 3 if error.argument else 2
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 3


def _sync(src: Side, dst: Side, only: list[str], exclude: list[str], config: configs.Config, ask, out) -> int:
    options = sync.SyncOptions(config.spec, not config.no_sync_schema, config.allow_row_rewrite, config.allow_structure_truncate, config.batch_size, config.sample_limit, config.parallel)
    plans = sync.plan_sync(src, dst, only, exclude, options)
    show = report.sync_text if not config.json else lambda p: report.sync_json(p, config.apply)
    if config.apply and any(p.status == decide.PLANNED for p in plans):
        if not config.yes:
            print(report.sync_text(plans), report.confirm_text(plans, config.allow_structure_truncate), sep="\n", file=out)
        shown = [decide.Plan(p.mode) for p in plans]
        if decide.needs_confirmation(shown, config.yes, None if config.yes else ask("Apply? [y/N] ")):
            return 2
        plans = sync.apply_sync(src, dst, plans, options)
    print(show(plans), file=out)
    if any(p.argument for p in plans):
        return 3
    return decide.exit_code(p.status for p in plans)


if __name__ == "__main__":
    sys.exit(main())
