"""The whole query: diff, reverse, closure, packages, package graph."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, modules, package_graph
from ..operators.closure import closure
from ..render import Analysis
from ..runtime import materialize
from ..sources import git, snapshots

Loader = Callable[[git.Revision, str], DataFrame]
#: Gives the packages' modules, the checksums and the configuration of a revision
#: (``pkg``, ``sums`` and ``config`` of ``operators.modules.changed_packages``).
ModuleLoader = Callable[[git.Revision, str], tuple[DataFrame, DataFrame, DataFrame]]


def affected_symbols(symbols: DataFrame, deps: DataFrame, module_changes: DataFrame | None = None) -> DataFrame:
    """(node): changed symbols and all that depends on them, in old or new."""
    edges = diff.reverse_edges(symbols, deps)
    return closure(edges, diff.changed_symbols(symbols, module_changes).select(F.col("id").alias("node")))


def analyze(packages: DataFrame, symbols: DataFrame, deps: DataFrame, module_changes: DataFrame | None = None) -> Analysis:
    """The affected packages, the changed ones and the edges between them."""
    changed = materialize(diff.changed_symbols(symbols, module_changes))
    edges = materialize(diff.reverse_edges(symbols, deps))
    affected = closure(edges, changed.select(F.col("id").alias("node")))
    return Analysis(
        package_graph.in_order(package_graph.affected_packages(affected, symbols, packages)),
        package_graph.changed_packages(changed, symbols),
        package_graph.package_edges(affected, edges, symbols),
    )


class Engine:
    """Analyses by revision, through loaders and a cache.

    ``load(revision, rev)`` gives the snapshot documents of a revision (a front
    end's facts); equal trees are loaded once, and equal snapshots differ in
    nothing.  ``load_modules`` is asked only if the hashes of the module files
    differ.  ``tool`` names the front end in the cache.
    """

    def __init__(self, spark: SparkSession, load: Loader, cache: snapshots.Cache | None = None, load_modules: ModuleLoader | None = None, tool: str = "") -> None:
        self.spark, self.load, self.cache, self.load_modules, self.tool = spark, load, cache, load_modules, tool

    def snapshot(self, revision: git.Revision, rev: str) -> DataFrame:
        if self.cache is None:
            return self.load(revision, rev)
        key = self.cache.key("snapshot", revision.tree, revision.subdir, self.tool)
        return self.cache.through(self.spark, "snapshots", key, lambda: self.load(revision, rev)).withColumn("rev", F.lit(rev))

    def pair(self, old: git.Revision, new: git.Revision) -> DataFrame:
        """The snapshots of both revisions, loaded side by side."""
        if (old.tree, old.subdir) == (new.tree, new.subdir):
            first = self.snapshot(old, "old")
            return first.unionByName(first.withColumn("rev", F.lit("new")))
        with ThreadPoolExecutor(2) as pool:
            jobs = {rev: pool.submit(self.snapshot, revision, rev) for rev, revision in (("old", old), ("new", new))}
        loaded = []
        for rev, job in jobs.items():
            try:
                loaded.append(job.result())
            except Exception as e:
                raise RuntimeError(f"load {rev} snapshot: {e}") from e
        return loaded[0].unionByName(loaded[1])

    def module_changes(self, both: DataFrame, old: git.Revision, new: git.Revision) -> DataFrame | None:
        """(package_path) whose modules changed; None if the module files are equal."""
        if both.select("module_hash").distinct().count() < 2:
            return None
        if self.load_modules is None:
            raise ValueError("the module files differ, and nothing loads modules")
        first, second = self.load_modules(old, "old"), self.load_modules(new, "new")
        return modules.changed_packages(*[a.unionByName(b) for a, b in zip(first, second, strict=True)])

    def analyze(self, repository: str, old: str, new: str) -> Analysis:
        a, b = git.resolve(repository, old), git.resolve(repository, new)
        both = materialize(self.pair(a, b))
        return analyze(snapshots.packages(both), snapshots.symbols(both), snapshots.deps(both), self.module_changes(both, a, b))
