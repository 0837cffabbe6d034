"""Module, workspace and checksum files."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files whose content decides whether modules are compared (fixed values).
MODULE_FILES = ("go.mod", "go.sum", "go.work", "go.work.sum")


def directives(text: str) -> dict[str, list[list[str]]]:
    """The directives of a module or workspace file, blocks unfolded."""
    out: dict[str, list[list[str]]] = {}
    block = None
    for line in text.splitlines():
        tokens = [t[1:-1] if t[:1] in "\"`" else t for t in re.findall(r'"[^"]*"|`[^`]*`|[^\s()]+|[()]', re.sub(r"//.*", "", line))]
        if not tokens:
            continue
        if tokens == [")"]:
            block = None
        elif len(tokens) == 2 and tokens[1] == "(":
            block = tokens[0]
        elif block:
            out.setdefault(block, []).append(tokens)
        else:
            out.setdefault(tokens[0], []).append(tokens[1:])
    return out


def parse_file(path: str) -> dict[str, list[list[str]]] | None:
    """A file's directives; None if there is no such file."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return directives(f.read())


def config_fields(rev: str, root: str) -> list[tuple[str, str, str, str]]:
    """(rev, file, field, value) of what configures a build."""
    rows = []
    for name in ("go.mod", "go.work"):
        found = parse_file(os.path.join(root, name)) or {}
        for field in ("module", "go", "toolchain"):
            if name == "go.work" and field == "module":
                continue
            rows.append((rev, name, field, " ".join(found.get(field, [[""]])[0])))
        rows.append((rev, name, "godebug", "\u0000".join(sorted(" ".join(t) for t in found.get("godebug", [])))))
    return rows


def files_hash(root: str) -> str:
    """Hash over the module files that exist; if equal, modules are too."""
    total = hashlib.sha256()
    for name in MODULE_FILES:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, "rb") as f:
                total.update(name.encode() + b"\0" + f.read() + b"\0")
    return total.hexdigest()


def sum_lines(texts: DataFrame) -> DataFrame:
    """(rev, file_ord, line_no, line) of ``texts(rev, path, text)``; the
    workspace's checksums come after the module's."""
    order = F.when(F.col("path").endswith("go.work.sum"), 1).otherwise(0)
    return texts.select("rev", order.alias("file_ord"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
