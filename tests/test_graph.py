"""Diff, closure, package graph and reports on small relations."""

import pytest

from faultline.operators import diff, package_graph
from faultline.operators.closure import closure
from faultline.plans.analyze import analyze
from faultline.render import render

SYMBOLS = "rev string, id string, package_path string, hash string"
DEPS = "rev string, sym string, dep string"
PACKAGES = "rev string, path string, name string, relative_path string, hash string, imports array<string>"


def values(df):
    return {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_closure_diamond_and_cycle(spark):
    e = edges(spark, [("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "y")])
    assert values(closure(e, nodes(spark, "a", "b"))) == {"a", "b", "c", "d"}


def test_closure_is_idempotent_and_monotone(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("q", "r")])
    once = closure(e, nodes(spark, "a"))
    assert values(closure(e, once)) == values(once)
    assert values(once) <= values(closure(e, nodes(spark, "a", "q")))


def test_closure_of_nothing(spark):
    assert values(closure(edges(spark, [("a", "b")]), nodes(spark, "a").limit(0))) == set()


def test_changes_by_kind_without_dispatch(spark):
    s = spark.createDataFrame(
        [("old", "a", "p", "1"), ("new", "a", "p", "2"), ("old", "b", "p", "1"), ("new", "c", "p", "1"), ("old", "d", "p", "1"), ("new", "d", "p", "1"), ("new", "f::interface-trace::0::h", "p", "1")], SYMBOLS
    )
    assert values(diff.symbol_changes(s)) == {("a", "modified"), ("b", "removed"), ("c", "added")}


def test_module_changes_are_roots(spark):
    s = spark.createDataFrame([("old", "a", "p", "1"), ("new", "a", "p", "1")], SYMBOLS)
    changed = diff.changed_symbols(s, spark.createDataFrame([("p",)], "package_path string"))
    assert values(changed) == {"p::package-init::$init"}


def test_edges_need_their_target_in_the_same_revision(spark):
    s = spark.createDataFrame([("old", "a", "p", "1"), ("old", "b", "q", "1"), ("new", "b", "q", "1")], SYMBOLS)
    d = spark.createDataFrame([("old", "b", "a"), ("new", "b", "a")], DEPS)
    assert values(diff.reverse_edges(s, d)) == {("a", "b")}
    assert values(diff.reverse_edges(s.where("rev = 'new'"), d)) == set()


@pytest.fixture
def chain(spark):
    """A changed method, a dispatch symbol of its package, a user, the user's user."""
    rows = [("pay::method::P.Pay", "m/payment"), ("svc::func::Do::interface-trace::0::h", "m/payment"), ("svc::func::Do", "m/service"), ("srv::func::main", "m/cmd/server")]
    s = spark.createDataFrame([(rev, i, p, rev if i.startswith("pay") else "1") for rev in ("old", "new") for i, p in rows], SYMBOLS)
    uses = [(rows[1][0], rows[0][0]), (rows[2][0], rows[1][0]), (rows[3][0], rows[2][0])]
    d = spark.createDataFrame([(rev, a, b) for rev in ("old", "new") for a, b in uses], DEPS)
    p = spark.createDataFrame([(rev, x, x.split("/")[-1] if "cmd" not in x else "main", x[2:], "", []) for rev in ("old", "new") for x in ("m/payment", "m/service", "m/cmd/server")], PACKAGES)
    return p, s, d


def test_dispatch_collapses_to_packages(chain):
    found = analyze(*chain)
    assert [r.relative_path for r in found.packages.collect()] == ["cmd/server", "payment", "service"]
    assert values(found.changed) == {"m/payment"}
    assert values(found.edges) == {("m/payment", "m/service"), ("m/service", "m/cmd/server")}


def test_equal_snapshots_change_nothing(chain):
    p, s, d = chain
    old = s.where("rev = 'old'")
    same = old.unionByName(old.replace("old", "new", "rev"))
    assert analyze(p, same, d).packages.collect() == []


def test_order_of_rows_does_not_matter(chain):
    p, s, d = chain
    a, b = analyze(p, s, d), analyze(p.orderBy("hash"), s.orderBy("id"), d.orderBy("dep", ascending=False))
    assert a.packages.collect() == b.packages.collect()


def test_reports(chain):
    found = analyze(*chain)
    assert render(found) == "cmd/server.main\npayment.payment\nservice.service\n"
    assert render(found, "summary") == render(found, "text") == "Affected packages: 3\n- cmd/server.main\n- payment.payment\n- service.service\n"
    assert render(found, "json").startswith('[\n  {\n    "path": "cmd/server",\n    "name": "main"\n  },')
    dot = 'digraph impact {\n\trankdir="LR";\n\tn1[label="cmd/server.main",shape="box"];\n\tn2[color="#cf222e",label="payment.payment",penwidth="2",shape="box"];\n\tn3[label="service.service",shape="box"];\n\tn2->n3;\n\tn3->n1;\n\n}\n'
    assert render(found, "dot") == dot
    with pytest.raises(ValueError, match="unknown format"):
        render(found, "xml")


def test_new_overrides_old(spark):
    s = spark.createDataFrame([("old", "a", "p", "1"), ("new", "a", "q", "1"), ("old", "b", "r", "1")], SYMBOLS)
    assert values(package_graph.symbol_packages(s)) == {("a", "q"), ("b", "r")}
