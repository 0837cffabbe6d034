"""Reports of an analysis: simple, summary, text, json and dot."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.identity import display_name
from .operators.package_graph import in_order

FORMATS = ("simple", "json", "text", "summary", "dot")
#: Appearance of changed packages in DOT (fixed values).
CHANGED_COLOR, CHANGED_WIDTH = "#cf222e", "2"


@dataclass
class Analysis:
    """packages(path, relative_path, name), changed(path), edges(src, dst)."""

    packages: DataFrame
    changed: DataFrame
    edges: DataFrame


def names(packages: DataFrame) -> DataFrame:
    return in_order(packages).select(display_name("relative_path", "name").alias("display"))


def json_rows(packages: DataFrame) -> DataFrame:
    return in_order(packages).select(F.to_json(F.struct(F.col("relative_path").alias("path"), "name")).alias("row"))


def dot_nodes(packages: DataFrame, changed: DataFrame) -> DataFrame:
    """(n, path, label, changed): nodes numbered by path.  A report is read by a
    person, so its packages are few enough to be numbered in one place."""
    mark = changed.select("path").distinct().withColumn("changed", F.lit(True))
    rows = packages.join(mark, "path", "left")
    return rows.select(F.row_number().over(Window.orderBy("path")).alias("n"), "path", display_name("relative_path", "name").alias("label"), F.coalesce("changed", F.lit(False)).alias("changed"))


def dot_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): numbers of the nodes of each edge."""
    a = nodes.select(F.col("path").alias("src"), F.col("n").alias("a"))
    b = nodes.select(F.col("path").alias("dst"), F.col("n").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("a", "b")


def _quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _dot(analysis: Analysis, graph: str) -> str:
    nodes = dot_nodes(analysis.packages, analysis.changed)
    ends = analysis.edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    lost = ends.join(nodes, "path", "left_anti").orderBy("path").first()
    if lost is not None:
        raise ValueError(f"an edge ends at an unknown package: {lost[0]}")
    lines = [f"digraph {graph} {{", '\trankdir="LR";']
    for r in nodes.orderBy("n").collect():
        style = [f"label={_quote(r.label)}", 'shape="box"']
        if r.changed:
            style = [f'color="{CHANGED_COLOR}"', style[0], f'penwidth="{CHANGED_WIDTH}"', style[1]]
        lines.append(f"\tn{r.n}[{','.join(style)}];")
    lines += [f"\tn{r.a}->n{r.b};" for r in dot_edges(nodes, analysis.edges).orderBy("a", "b").collect()]
    return "\n".join([*lines, "", "}"]) + "\n"


def render(analysis: Analysis, fmt: str = "simple", graph: str = "impact") -> str:
    """The report as text."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "dot":
        return _dot(analysis, graph)
    if fmt == "json":
        rows = [json.loads(r[0]) for r in json_rows(analysis.packages).collect()]
        text = json.dumps(rows, indent=2, ensure_ascii=False)
        return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") + "\n"
    shown = [r[0] for r in names(analysis.packages).collect()]
    if fmt == "simple":
        return "".join(f"{x}\n" for x in shown)
    return f"Affected packages: {len(shown)}\n" + "".join(f"- {x}\n" for x in shown)
