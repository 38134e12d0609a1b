"""What the jobs share: their log, configuration and command line."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def configured(kind: type, path: str | None):
    """The job's configuration from a JSON file; names that it does not know are an error."""
    if path is None:
        return kind()
    with open(path) as f:
        given = json.load(f)
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(given) - known:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}; known are {sorted(known)}")
    return kind(**given)


def command_line(name: str, paths: dict[str, str], kind: type, run: Callable, argv: list[str] | None = None) -> None:
    """Parses --config and a flag for each path, makes the session, runs the job on it and stops it."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__.split("\n")[0])
    p.add_argument("--config", help="JSON file of settings")
    for flag, says in paths.items():
        p.add_argument(f"--{flag}", required=True, help=says)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    cfg = configured(kind, a.config)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(getattr(a, flag) for flag in paths), cfg)
    finally:
        spark.stop()
