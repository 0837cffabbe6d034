"""Command line: report what a change affects.

The two sides are snapshot documents, or with -repo two revisions of a git
repository, whose snapshots a front end exports (``sources.exporter``)."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans.analyze import Engine, analyze
from .render import FORMATS, render
from .sources import exporter, snapshots


def run(args: Sequence[str], out=sys.stdout, err=sys.stderr) -> int:
    """Exit status: 0 for success and help, 1 for any error."""
    parser = argparse.ArgumentParser(prog="faultline", description=__doc__)
    parser.add_argument("-old", "--old", required=True, help="old snapshot document, or revision")
    parser.add_argument("-new", "--new", required=True, help="new snapshot document, or revision")
    parser.add_argument("-repo", "--repo", help="git repository, or a folder of one")
    parser.add_argument("-exporter", "--exporter", help="with -repo: command that prints a worktree's snapshot document")
    parser.add_argument("-modules", "--modules", help="with -repo: command that prints a worktree's modules")
    parser.add_argument("-cache", "--cache", action="store_true", help="with -repo: keep snapshots between runs")
    parser.add_argument("-output", "--output", default="simple", choices=FORMATS)
    parser.add_argument("-verbose", "--verbose", action="store_true", help="time and number of packages on stderr")
    try:
        given = parser.parse_args(list(args))
    except SystemExit as e:
        return 1 if e.code else 0
    began = time.monotonic()
    try:
        spark = SparkSession.builder.appName("faultline").getOrCreate()
        if given.repo:
            if not given.exporter:
                raise ValueError("-repo needs -exporter")
            cache = snapshots.Cache.default() if given.cache else None
            load_modules = exporter.module_loader(spark, given.modules) if given.modules else None
            engine = Engine(spark, exporter.snapshot_loader(spark, given.exporter), cache, load_modules, given.exporter)
            found = engine.analyze(given.repo, given.old, given.new)
        else:
            both = snapshots.read(spark, given.old, "old").unionByName(snapshots.read(spark, given.new, "new"))
            found = analyze(snapshots.packages(both), snapshots.symbols(both), snapshots.deps(both))
        out.write(render(found, given.output))
        if given.verbose:
            err.write(f"{found.packages.count()} packages in {time.monotonic() - began:.1f} s\n")
    except Exception as e:  # noqa: BLE001 - every failure is reported the same way
        err.write(f"faultline: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
