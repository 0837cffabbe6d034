"""Module changes, checksum files and module files."""

from faultline.operators import modules
from faultline.sources import modfiles
from faultline.functions import comments
from pyspark.sql import functions as F

PKG = "rev string, package_path string, modules array<string>, sum_keys array<string>"
SUMS = "rev string, key string, value string"
CONFIG = "rev string, global_hash string"


def run(spark, old, new, old_sums, new_sums, config=("x", "x")):
    pkg = spark.createDataFrame([("old", "p", *old), ("new", "p", *new)], PKG)
    sums = spark.createDataFrame([("old", k, v) for k, v in old_sums.items()] + [("new", k, v) for k, v in new_sums.items()], SUMS)
    conf = spark.createDataFrame([("old", config[0]), ("new", config[1])], CONFIG)
    return modules.changed_packages(pkg, sums, conf).count() == 1


def test_module_changes(spark):
    a = (["m@v1"], ["m@v1"])
    assert not run(spark, a, a, {"m@v1": "1"}, {"m@v1": "1"})
    assert run(spark, a, (["m@v2"], ["m@v2"]), {"m@v1": "1"}, {"m@v2": "1"})
    assert run(spark, a, a, {"m@v1": "1"}, {"m@v1": "2"})
    assert not run(spark, a, a, {"z": "1"}, {"z": "1", "m@v1": "1"})
    assert run(spark, a, a, {"m@v1": "1"}, {"m@v1": "1"}, ("x", "y"))


def test_later_sum_lines_win(spark):
    texts = spark.createDataFrame([("new", "go.sum", "m v1 h1:a\nbad line here too\nm v1 h1:b\n\nn v1 h1:c\n"), ("new", "go.work.sum", "n v1 h1:d")], "rev string, path string, text string")
    got = {(r.key, r.value) for r in modules.sums_last_wins(modfiles.sum_lines(texts)).collect()}
    assert got == {("m@v1", "h1:b"), ("n@v1", "h1:d")}


def test_module_file(tmp_path):
    (tmp_path / "go.mod").write_text('module example.com/m // main\n\ngo 1.22\n\nrequire (\n\ta.b/c v1.0.0\n\t"d.e/f" v2.0.0 // indirect\n)\ngodebug x=1\n')
    found = modfiles.parse_file(str(tmp_path / "go.mod"))
    assert found["module"] == [["example.com/m"]] and found["require"] == [["a.b/c", "v1.0.0"], ["d.e/f", "v2.0.0"]]
    assert modfiles.parse_file(str(tmp_path / "go.work")) is None
    assert ("new", "go.mod", "godebug", "x=1") in modfiles.config_fields("new", str(tmp_path))
    before = modfiles.files_hash(str(tmp_path))
    (tmp_path / "go.sum").write_text("")
    assert modfiles.files_hash(str(tmp_path)) != before


def test_embed_patterns(spark):
    df = spark.createDataFrame([('go:embed a/*.txt "b c" `d e`',), ("go:generate x",)], "t string")
    got = [r[0] for r in df.select(comments.embed_patterns("t").alias("p")).collect()]
    assert got == [["a/*.txt", "b c", "d e"], []]


def test_globs_do_not_cross_folders(spark):
    df = spark.createDataFrame([("a/*", "a/b", True), ("a/*", "a/b/c", False), ("all:x?", "xy", True), ("*.t", "a.t", True), ("*.t", "aXt", False)], "p string, f string, want boolean")
    rows = df.withColumn("r", comments.glob_regex("p")).select("want", F.expr("f rlike r").alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_globs(spark):
    from faultline.functions.comments import glob_regex

    cases = [
        ("a*b", "axxb", True), ("a*b", "a/b", False), ("?x", "ax", True), ("?x", "/x", False), ("[^a]x", "ax", False), ("[^a]x", "bx", True),
        ("[a-c]x", "bx", True), ("[a-c]x", "dx", False), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("[a\\]]x", "]x", True), ("[ab", "a", False),
        ("a\\", "a", False), ("x.y", "xzy", False), ("x.y", "x.y", True), ("a+(b)", "a+(b)", True), ("[[&]x", "[x", True), ("[[&]x", "&x", True), ("all:d*", "dir", True), ("", "", True),
    ]
    rows = spark.createDataFrame(cases, "p string, t string, want boolean").withColumn("re", glob_regex("p")).selectExpr("p", "t", "want", "t rlike re as got")
    assert [(r.p, r.t) for r in rows.collect() if r.got != r.want] == []
