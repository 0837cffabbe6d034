"""Revisions and files of git repositories, read on the driver."""

from __future__ import annotations

import contextlib
import os
import shutil
import subprocess
import tempfile
import threading
from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import REVISION

_LOCKS: dict[str, threading.Lock] = {}
_GUARD = threading.Lock()


class GitError(RuntimeError):
    """git failed; the message has what it said."""


@dataclass(frozen=True)
class Revision:
    repository: str
    root: str
    subdir: str
    commit: str
    tree: str


def git(repository: str, *args: str) -> str:
    run = subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, check=False)
    if run.returncode:
        raise GitError(f"git {' '.join(args)}: {run.stderr.strip() or run.returncode}")
    return run.stdout.strip()


def resolve(repository: str, ref: str) -> Revision:
    """The commit and tree that ``ref`` names, seen from a folder of a repository."""
    here = os.path.realpath(repository)
    root = os.path.realpath(git(here, "rev-parse", "--show-toplevel"))
    subdir = os.path.relpath(here, root)
    if subdir == ".." or subdir.startswith(".." + os.sep):
        raise GitError(f"{repository} is outside of {root}")
    commit = git(root, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}")
    tree = git(root, "rev-parse", "--verify", f"{commit}^{{tree}}")
    return Revision(here, root, subdir, commit, tree)


def _lock(root: str) -> threading.Lock:
    with _GUARD:
        return _LOCKS.setdefault(root, threading.Lock())


@contextlib.contextmanager
def checkout(revision: Revision) -> Iterator[str]:
    """A detached worktree of the revision; yields the folder of its subdir.
    Worktrees of one repository are added and removed one at a time."""
    top = tempfile.mkdtemp(prefix="faultline-")
    tree = os.path.join(top, os.path.basename(top))
    try:
        with _lock(revision.root):
            git(revision.root, "worktree", "add", "--detach", tree, revision.commit)
        try:
            folder = os.path.normpath(os.path.join(tree, revision.subdir))
            if not os.path.isdir(folder):
                raise GitError(f"{revision.subdir} is no folder in {revision.commit}")
            yield folder
        finally:
            with _lock(revision.root):
                git(revision.root, "worktree", "remove", "--force", tree)
    finally:
        shutil.rmtree(top, ignore_errors=True)


def revisions(spark: SparkSession, repository: str, old: str, new: str) -> DataFrame:
    """(role, repository, root, subdir, commit, tree) of both revisions."""
    rows = [(role, *astuple(resolve(repository, ref))) for role, ref in (("old", old), ("new", new))]
    return spark.createDataFrame(rows, REVISION)


def files(spark: SparkSession, revision: Revision) -> DataFrame:
    """(path, content) of all files of a revision below its subdir."""
    with checkout(revision) as folder:
        rows = []
        for at, _, names in os.walk(folder):
            for name in names:
                path = os.path.join(at, name)
                if name != ".git" and os.path.isfile(path):
                    with open(path, "rb") as f:
                        rows.append((os.path.relpath(path, folder).replace(os.sep, "/"), bytearray(f.read())))
    return spark.createDataFrame(sorted(rows), "path string, content binary")
