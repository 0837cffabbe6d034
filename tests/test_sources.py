"""git, snapshots, the cache and the command line."""

import io
import json
import subprocess

import pytest

from faultline import cli
from faultline.sources import git, snapshots


@pytest.fixture
def repository(tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True)

    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "a")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("one")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "sub" / "a.txt").write_text("two")
    run("commit", "-qam", "two")
    return tmp_path


def test_revisions_and_files(spark, repository):
    old, new = git.resolve(str(repository / "sub"), "HEAD~1"), git.resolve(str(repository / "sub"), "HEAD")
    assert old.subdir == "sub" and old.tree != new.tree
    assert [(r.path, bytes(r.content)) for r in git.files(spark, old).collect()] == [("a.txt", b"one")]
    assert "prunable" not in git.git(str(repository), "worktree", "list") and git.git(str(repository), "worktree", "list").count("\n") == 0
    assert git.revisions(spark, str(repository), "HEAD~1", "HEAD").count() == 2
    with pytest.raises(git.GitError):
        git.resolve(str(repository), "nothing")


def document(value):
    symbol = lambda i, h, deps: {"id": i, "package_path": i.split("::")[0], "hash": h, **({"dependencies": deps} if deps else {})}
    package = lambda p: {"path": p, "name": p.split("/")[-1], "relative_path": p[2:], "hash": "h"}
    symbols = [symbol("m/lib::func::V", value, []), symbol("m/cmd::func::main", "1", ["m/lib::func::V"])]
    return {"tree": value, "module_path": "m", "module_hash": "", "packages": {p: package(p) for p in ("m/lib", "m/cmd")}, "symbols": {s["id"]: s for s in symbols}}


def test_command_line(spark, tmp_path):
    for name in ("old", "new"):
        (tmp_path / f"{name}.json").write_text(json.dumps(document(name)))
    out, err = io.StringIO(), io.StringIO()
    assert cli.run(["-old", str(tmp_path / "old.json"), "-new", str(tmp_path / "new.json"), "-verbose"], out, err) == 0
    assert out.getvalue() == "cmd.cmd\nlib.lib\n" and err.getvalue().startswith("2 packages")
    assert cli.run(["-old", "x"], out, err) == 1


def test_cache(spark, tmp_path, monkeypatch):
    cache = snapshots.Cache(str(tmp_path))
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    key = cache.key("snapshot", "tree", ".")
    assert cache.through(spark, "n", key, build).count() == cache.through(spark, "n", key, build).count() == 3
    assert made == [1] and cache.key("snapshot", "other", ".") != key
    monkeypatch.setenv("FAULTLINE_CACHE", "relative")
    with pytest.raises(ValueError, match="absolute"):
        snapshots.Cache.default()


@pytest.fixture
def exported(repository):
    """Three commits: the second changes lib, the third only a module's checksum."""

    def commit(value, checksum):
        snapshot = document(value) | {"module_hash": checksum}
        init = "m/cmd::package-init::$init"
        snapshot["symbols"][init] = {"id": init, "package_path": "m/cmd", "hash": "i"}
        packages = [{"package_path": p, "modules": ["x@v1"], "sum_keys": ["x@v1"] if p == "m/cmd" else []} for p in ("m/lib", "m/cmd")]
        (repository / "snapshot.json").write_text(json.dumps(snapshot))
        (repository / "modules.json").write_text(json.dumps({"packages": packages, "sums": {"x@v1": checksum}, "config": "c"}))
        subprocess.run(["git", "-C", str(repository), "add", "."], check=True)
        subprocess.run(["git", "-C", str(repository), "commit", "-qm", value], check=True)

    commit("a", "1")
    commit("b", "1")
    commit("b", "2")
    return repository


def test_command_line_on_a_repository(spark, exported, monkeypatch, tmp_path_factory):
    monkeypatch.setenv("FAULTLINE_CACHE", str(tmp_path_factory.mktemp("cache")))

    def run(old, new, *more):
        out, err = io.StringIO(), io.StringIO()
        status = cli.run(["-repo", str(exported), "-exporter", "cat snapshot.json", "-cache", "-old", old, "-new", new, *more], out, err)
        return status, out.getvalue(), err.getvalue()

    assert run("HEAD~2", "HEAD~1") == (0, "cmd.cmd\nlib.lib\n", "")
    assert run("HEAD", "HEAD") == (0, "", "")
    status, _, err = run("HEAD~1", "HEAD")
    assert status == 1 and "module files differ" in err
    assert run("HEAD~1", "HEAD", "-modules", "cat modules.json") == (0, "cmd.cmd\n", "")
    status, _, err = run("HEAD~4", "HEAD")
    assert status == 1 and "load old snapshot" in err
