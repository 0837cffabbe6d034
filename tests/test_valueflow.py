"""Call results and struct fields, against hand-made facts and brute force."""

import random
import re

import pytest

from faultline.operators import closure, valueflow
from faultline.runtime import materialize

EXPR = "node long, parent long, parent_kind string"


def values(df):
    return {tuple(r) for r in df.collect()}


def brute_targets(expr, base, calls, returns):
    """Least fixpoint of all rules at once, one fact at a time."""
    found, size = set(base), -1
    while size != len(found):
        size = len(found)
        found |= {(p, f) for n, f in found for m, p, kind in expr if m == n and kind == "paren"}
        found |= {(call, g) for call, callee, i in calls for n, f in list(found) if n == callee for h, j, r in returns if (h, j) == (f, i) for m, g in list(found) if m == r}
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_function_targets_through_returns(spark, seed):
    rng = random.Random(seed)
    node = lambda: rng.randrange(24)
    expr = [(n, node(), rng.choice(["paren", "other"])) for n in range(24)]
    base = [(node(), f"f{rng.randrange(5)}") for _ in range(10)]
    calls = [(node(), node(), rng.randrange(2)) for _ in range(14)]
    returns = [(f"f{f}", rng.randrange(2), node()) for f in range(5) for _ in range(3)]
    frames = [
        spark.createDataFrame([(n, n) for n in range(24)], "node long, object long"),
        spark.createDataFrame(expr, EXPR),
        spark.createDataFrame(base, "node long, label string"),
        spark.createDataFrame([], "obj long, function string"),
        spark.createDataFrame([], "obj long, target string"),
        spark.createDataFrame(calls, "call long, callee long, result int"),
        spark.createDataFrame(returns, "function string, result int, node long"),
    ]
    assert values(valueflow.function_targets(*frames)) == brute_targets(expr, base, calls, returns)
    assert values(valueflow.function_targets(*frames[:5])) == brute_targets(expr, base, [], [])


def test_field_bindings_are_two_passes_and_accepted(spark):
    # a field takes x's type; b copies a, c copies b (a third pass would be needed); 9 doesn't fit
    stores = spark.createDataFrame([("a", 7, 1), ("b", 7, 2), ("c", 7, 3), ("a", 7, 4)], "field string, type_id long, node long")
    reads = spark.createDataFrame([(2, "a"), (3, "b")], "node long, field string")
    nodes = spark.createDataFrame([(1, "x", 7), (2, None, 7), (3, None, 7), (4, "y", 7)], "node long, object string, static_type long")
    bindings = spark.createDataFrame([("x", 5), ("y", 9)], "obj string, type long")
    types = spark.createDataFrame([(5, False, "named", None), (9, False, "named", None), (7, True, "named", None)], "type_id long, is_interface boolean, kind string, elem_type_id long")
    none = spark.createDataFrame([], "node long, inner long, type long")
    fits = spark.createDataFrame([(5, 7)], "from_type long, to_type long")
    got = valueflow.field_bindings(stores, reads, nodes, spark.createDataFrame([], EXPR), bindings, types, none, fits)
    assert values(got) == {("a", 5), ("b", 5)}


def test_call_results_carry_types(spark):
    # node 1 is returned as result 0 of f, which 2 calls; result 1 of f stays open
    calls = spark.createDataFrame([(2, 20, 0), (3, 20, 1)], "call long, callee long, result int")
    targets = spark.createDataFrame([(20, "f")], "node long, label string")
    returns = spark.createDataFrame([("f", 0, 1)], "function string, result int, node long")
    assert values(valueflow.result_edges(calls, targets, returns)) == {(1, 2)}


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("broadcast", [0, 1000])
def test_labels_go_as_words(spark, monkeypatch, few, broadcast):
    # 150 labels make three words; a cycle, a chain into it, one out of it, and a node that leads nowhere
    monkeypatch.setattr(closure, "FEW_EDGES", few)
    monkeypatch.setattr(closure, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(closure, "BROADCAST_LABELS", broadcast)
    edges = [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (2, 7), (4, 7), (4, 7), (None, 7)]
    base = [(0, f"a{i}") for i in range(90)] + [(2, f"b{i}") for i in range(59)] + [(5, "c"), (5, "a0"), (8, "b1"), (7, None), (None, "c"), (0, "a0")]
    want, size = {b for b in base}, -1
    while size != len(want):
        size = len(want)
        want |= {(dst, label) for src, dst in edges for node, label in want if node is not None and node == src}
    made = []
    monkeypatch.setattr(closure, "materialize", lambda df: made.append(materialize(df)) or made[-1])
    got = closure.labelled_closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(base, "node long, label string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # what goes from round to round are words, not labels
    assert max(df.count() for df in made if "node" in df.columns) < 40


@pytest.mark.parametrize("block", [2, 5000])
def test_indexed_targets_are_joined_last(spark, monkeypatch, block):
    monkeypatch.setattr(valueflow, "BLOCK_NODES", block, raising=False)
    rng = random.Random(block)
    key = lambda: rng.choice([None, 0, 1, 2])
    asked = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 2]), key()) for _ in range(60)] + [(n, 0, 1) for n in range(40, 60)]
    stored = [(rng.choice([None, 0, 1]), key(), rng.choice([None, *"abcdef"])) for _ in range(25)]
    want = {(n, t) for n, o, q in asked for p, s, t in stored if o is not None and o == p and (q is None or s is None or q == s)}
    got = valueflow.indexed_targets(spark.createDataFrame(asked, "node long, obj int, key long"), spark.createDataFrame(stored, "obj int, key long, target string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # the large result isn't shuffled to be made distinct
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[node#\w+, target#\w+\]", plan)


def test_large_results_lie_close_together(spark, tmp_path):
    # 100 nodes ask for 30000 targets each: node by node, no target would be met again within a page of a file
    asked = spark.range(100).selectExpr("id as node", "0 as obj", "id % 2 as key")
    stored = spark.range(60000).selectExpr("0 as obj", "cast(null as long) as key", "'target' || id % 30000 as target")
    got = valueflow.indexed_targets(asked, stored)
    got.write.parquet(out := str(tmp_path / "out"))
    rows = spark.read.parquet(out)
    assert rows.count() == rows.distinct().count() == 100 * 30000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1_400_000
    # a compiled loop over the nodes would hold all rows that come of one run of targets; the executed plan marks what is compiled
    got.foreachPartition(lambda rows: None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"^[^*\n]*Generate explode\(transform\(nodes", plan, re.M)
