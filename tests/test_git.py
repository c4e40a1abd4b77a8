import json
import subprocess

import pytest

from sparkgrove import __main__ as cli
from sparkgrove.config import Repo
from sparkgrove.engine import SearchEngine
from sparkgrove.sources.git import GitError, GitSource
from sparkgrove.sources.store import Store


def git(path, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(path), *args], check=True, capture_output=True)


@pytest.fixture
def origin(tmp_path):
    path = tmp_path / "origin"
    path.mkdir()
    git(path, "init", "-q", "-b", "trunk")
    (path / "src").mkdir()
    (path / "src" / "a.rs").write_text("fn main() {}\n")
    (path / "big.txt").write_text("x" * 5000)
    (path / "link").symlink_to("big.txt")
    git(path, "add", ".")
    git(path, "commit", "-q", "-m", "one")
    return path


def test_source(spark, origin, tmp_path):
    source = GitSource(Repo("org/x", str(origin)), str(tmp_path / "clones"))
    assert source.clone_or_open() and not source.clone_or_open()
    assert source.ref() == "trunk" and source.fetch() is None
    assert {(e.path, oct(e.mode)) for e in source.tree()} == {("src/a.rs", "0o100644"), ("big.txt", "0o100644"), ("link", "0o120000")}
    rows = {r.path: bytes(r.content) for r in source.files(spark, 1000).collect()}
    assert rows == {"src/a.rs": b"fn main() {}\n", "link": b"big.txt"}
    before = {r.path: r.oid for r in source.manifest(spark).collect()}
    (origin / "src" / "a.rs").write_text("fn test() {}\n")
    git(origin, "commit", "-q", "-a", "-m", "two")
    assert source.fetch() == source.commit()
    after = {r.path: r.oid for r in source.manifest(spark).collect()}
    assert [p for p in before if before[p] != after[p]] == ["src/a.rs"]
    keys = spark.createDataFrame([("org/x", "src/a.rs")], "repo string, path string")
    assert [bytes(r.content) for r in source.files(spark, keys=keys).collect()] == [b"fn test() {}\n"]


def test_only_changed_files_are_read(spark, origin, tmp_path, monkeypatch):
    for k in range(30):
        (origin / f"f{k}.txt").write_text(f"text number {k}\n")
    (origin / "bin").write_bytes(b"a\0b")
    git(origin, "add", ".")
    git(origin, "commit", "-q", "-m", "many")
    source, asked = GitSource(Repo("org/x", str(origin)), str(tmp_path / "clones")), []
    files = source.files
    monkeypatch.setattr(source, "files", lambda spark, size, keys: asked.append(sorted(r.path for r in keys.collect())) or files(spark, size, keys))
    engine = SearchEngine(spark, Store(spark, str(tmp_path / "s")))
    assert engine.cycle({"org/x": source}, max_file_size=1000) and len(asked[0]) == 32
    assert not engine.cycle({"org/x": source}, max_file_size=1000) and len(asked) == 1
    (origin / "f3.txt").write_text("other words\n")
    (origin / "f4.txt").unlink()
    (origin / "g.txt").write_text("other words too\n")
    git(origin, "add", "-A")
    git(origin, "commit", "-q", "-m", "two files")
    assert engine.watch({"org/x": source}, 0, 2, max_file_size=1000) == 1
    assert asked[1:] == [["f3.txt", "g.txt"]]
    assert engine.search("other words")["total_files"] == 2 and engine.search("text number")["total_files"] == 28
    assert engine.store.tokens() == {"org/x": source.commit()}


def test_key_as_text(tmp_path):
    source = GitSource(Repo("x", "git@h:a.git", ssh_key="-----KEY-----\nabc\n", ssh_key_passphrase="word"), str(tmp_path))
    env = source._environment(str(tmp_path))
    assert (tmp_path / "key").read_text() == "-----KEY-----\nabc\n" and (tmp_path / "key").stat().st_mode & 0o77 == 0
    assert f"'{tmp_path}/key'" in env["GIT_SSH_COMMAND"] and "word" not in (tmp_path / "ask").read_text()
    assert subprocess.run([env["SSH_ASKPASS"]], env=env, capture_output=True, text=True).stdout == "word\n"


def test_failure_is_an_error(tmp_path):
    with pytest.raises(GitError):
        GitSource(Repo("x", str(tmp_path / "nowhere")), str(tmp_path / "clones")).clone_or_open()


def test_command(spark, origin, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("sparkgrove.config.SCHEMES", ("/",))
    config = tmp_path / "c.toml"
    config.write_text(f'[indexer]\ndata_dir = "{tmp_path}/data"\nmax_file_size = 1000\n[[repos]]\nname = "org/x"\nurl = "{origin}"\n')
    cli.main(["--config", str(config)])
    cli.main(["--config", str(config), "--query", "fn main", "--files", "*.rs"])
    first, second = map(json.loads, capsys.readouterr().out.strip().splitlines())
    assert first == {"changed": True} and second["total_files"] == 1 and second["results"][0]["url"] == str(origin)
    assert [f["path"] for f in second["results"][0]["files"]] == ["src/a.rs"]
