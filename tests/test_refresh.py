import threading

import pytest
from pyspark.sql import functions as F

from sparkgrove.config import ConfigError, parse
from sparkgrove.engine import SearchEngine
from sparkgrove.operators import incremental, index
from sparkgrove.sources import corpora
from sparkgrove.sources.store import NotAnIndex, Store
from sparkgrove.streaming.refresh import FILE_VERSIONS, Heartbeat, apply_batch, latest, start

V1 = [("r", "a", b"one text"), ("r", "b", b"two text"), ("r", "c", b"three text")]
V2 = [("r", "a", b"one text"), ("r", "b", b"nine text"), ("r", "d", b"four text")]


def state(store):
    return sorted((r.repo, r.path, bytes(r.content)) for r in store.table("files").collect()), sorted(map(tuple, store.table("postings").collect()))


def rebuilt(spark, files):
    df = corpora.in_memory(spark, files)
    return sorted(files), sorted(map(tuple, index.postings(df).collect()))


def test_diff(spark):
    old, new = (corpora.manifest(corpora.in_memory(spark, v)) for v in (V1, V2))
    assert {r.path: r.change for r in incremental.manifest_diff(old, new).collect()} == {"a": "reused", "b": "changed", "c": "deleted", "d": "new"}


def test_refresh_equals_rebuild(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first, new = incremental.refresh(store, corpora.in_memory(spark, V1))
    assert new and incremental.refresh(store, corpora.in_memory(spark, V1[::-1])) == (first, False)
    assert state(store) == rebuilt(spark, V1)
    assert incremental.refresh(store, corpora.in_memory(spark, V2))[1]
    assert state(store) == rebuilt(spark, V2)


def test_a_refresh_writes_what_changed_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    incremental.refresh(store, corpora.in_memory(spark, V1))
    incremental.refresh(store, corpora.in_memory(spark, V2))
    row = store.pointer()
    assert len(row.layers) == 2 and [row.counts[f"{row.layers[1]}/{k}"] for k in ("files", "manifest", "gone")] == [2, 2, 2]


def test_layers_become_one_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sparkgrove.sources.store.MOST_LAYERS", 3)
    store, files = Store(spark, str(tmp_path / "s")), []
    for k in range(6):
        files = [x for x in files if x[1] != f"f{k - 2}"] + [("r", f"f{k}", f"text {k}".encode())]
        incremental.refresh(store, corpora.in_memory(spark, files))
    assert state(store) == rebuilt(spark, files) and len(store.pointer().layers) <= 3
    folders = {p.name for p in (tmp_path / "s").iterdir()} - {"versions"}
    assert folders == {x for r in store._pointers() for x in r.layers}


@pytest.mark.parametrize("bits, most", [(13, 4_000_000), (1, 20)])
def test_postings_are_stored_as_lists(spark, tmp_path, monkeypatch, bits, most):
    for where, name, value in (("operators.index", "BLOCK_BITS", bits), ("sources.store", "BLOCK_BITS", bits), ("operators.index", "LIST_GRAMS", most)):
        monkeypatch.setattr(f"sparkgrove.{where}.{name}", value)
    files = [("r" if k % 3 else "s", f"f{k}", f"Some text of {'Öl' if k % 4 else 'OIL'} {k % 5}".encode()) for k in range(40)] + [("r", "none", b"ab"), ("r", "bad", b"\xff\xfe\xfd TEXT")]
    store = Store(spark, str(tmp_path / "s"))
    store.write(corpora.in_memory(spark, files).coalesce(1))
    row = store.pointer()
    assert state(store) == rebuilt(spark, files)
    if bits == 13:  # a row for each trigram, not for each file of it
        assert row.counts[f"{row.layers[0]}/postings"] == len({t for _, _, t, _, _ in state(store)[1]})
    files = [(r, p, c + b" And More" if p in ("f3", "f8") else c) for r, p, c in files if p not in ("f0", "f20", "none")] + [("t", "new", b"a new one")]
    incremental.refresh(store, corpora.in_memory(spark, files))
    assert len(store.pointer().layers) == 2 and state(store) == rebuilt(spark, files)


def test_a_pointer_that_cant_be_read_is_an_error(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    incremental.refresh(store, corpora.in_memory(spark, V1))
    before = state(store)
    pointer = next(p for p in (tmp_path / "s" / "versions").iterdir() if p.name.startswith("part-") and p.suffix == ".json")
    kept = pointer.read_bytes()
    pointer.unlink()
    pointer.mkdir()
    (pointer / "_x").mkdir()
    with monkeypatch.context() as m:
        m.setattr(spark.__class__, "read", property(lambda self: (_ for _ in ()).throw(OSError("no connection"))))
        for act in (store.current, lambda: apply_batch(store, spark.createDataFrame([("r", "z", bytearray(b"z"), 1)], FILE_VERSIONS)), lambda: incremental.refresh(store, corpora.in_memory(spark, V2))):
            with pytest.raises(OSError):
                act()
    (pointer / "_x").rmdir()
    pointer.rmdir()
    pointer.write_bytes(kept)
    assert state(store) == before


def test_a_store_with_lost_files_is_not_opened(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    incremental.refresh(store, corpora.in_memory(spark, V1))
    SearchEngine(spark, store)
    for p in (tmp_path / "s" / store.pointer().layers[0] / "postings").glob("*.parquet"):
        p.unlink()
    with pytest.raises(NotAnIndex):
        SearchEngine(spark, store)


def test_versions_that_come_late(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    batch = lambda *rows: apply_batch(store, spark.createDataFrame([(a, b, None if c is None else bytearray(c), d) for a, b, c, d in rows], FILE_VERSIONS))
    assert batch(("r", "a", b"one", 1), ("r", "b", b"bee", 5)) and not batch(("r", "b", b"old", 4), ("r", "b", b"bee", 5))
    assert batch(("r", "a", None, 3)) and not batch(("r", "a", b"late", 2)) and batch(("r", "a", b"back", 4))
    assert state(store)[0] == [("r", "a", b"back"), ("r", "b", b"bee")]


def test_orphans(spark, tmp_path):
    stored = spark.createDataFrame([("org/x",), ("old",)], "repo string")
    assert [r.repo for r in incremental.orphans(stored, spark.createDataFrame([("org/x",)], "repo string")).collect()] == ["old"]
    store = Store(spark, str(tmp_path / "s"))
    store.write(corpora.in_memory(spark, [("org/x", "a", b"abc"), ("old", "b", b"abc")]))
    assert incremental.drop_orphans(store, ["org/x"]) and not incremental.drop_orphans(store, ["org/x"])
    assert [r.repo for r in store.table("files").collect()] == ["org/x"]


def test_damaged_store_counts_as_none(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "versions").mkdir(parents=True)
    (tmp_path / "s" / "versions" / "x.json").write_text('{"format": 99, "version": "v", "at": "2020-01-01T00:00:00.000Z"}\n')
    assert store.current() is None


def test_cycle(spark, tmp_path):
    engine = SearchEngine(spark, Store(spark, str(tmp_path / "s")))
    assert engine.health()["status"] == "no_repos"
    good = {"a": lambda: corpora.in_memory(spark, [("a", "f", b"hello there")]), "b": lambda: corpora.in_memory(spark, [("b", "g", b"hello two")])}
    assert engine.cycle(good) and engine.search("hello")["total_files"] == 2 and not engine.cycle(good)

    def broken():
        raise RuntimeError("no auth")

    def slow():
        gate.wait(120)

    assert not engine.cycle({"a": good["a"], "b": broken})
    assert engine.search("hello")["total_files"] == 2
    assert {r.repo: (r.status, r.error) for r in engine.status().collect()} == {"a": ("ready", None), "b": ("failed", "authentication failed")}
    gate = threading.Event()
    assert engine.cycle({"a": lambda: corpora.in_memory(spark, [("a", "f", b"hello again")]), "b": good["b"], "c": slow}, seconds=20) and engine.search("again")["total_files"] == 1
    assert engine.states["c"] == ("failed", "timed out") and not gate.is_set()
    gate.set()
    assert engine.cycle({"a": good["a"]}) and engine.search("hello")["total_files"] == 1 and engine.health()["watcher_status"] == "ok"


def test_stream(spark, tmp_path):
    folder, store, changes = str(tmp_path / "in"), Store(spark, str(tmp_path / "s")), []
    rows = [[("r", "a", b"one", 1), ("r", "b", b"two", 1), ("r", "b", b"two newer", 2)], [("r", "a", None, 3), ("r", "c", b"three", 3)], [("r", "c", b"three", 4)]]
    for batch in rows:
        spark.createDataFrame([(a, b, None if c is None else bytearray(c), d) for a, b, c, d in batch], FILE_VERSIONS).write.mode("append").parquet(folder)
        start(spark.readStream.schema(FILE_VERSIONS).parquet(folder), store, str(tmp_path / "c"), after=lambda: changes.append(1)).awaitTermination()
    assert state(store)[0] == [("r", "b", b"two newer"), ("r", "c", b"three")] and len(changes) == 2
    assert latest(spark.createDataFrame([("r", "a", bytearray(b"x"), 1), ("r", "a", None, 2)], FILE_VERSIONS)).first().content is None


def test_heartbeat():
    beat = Heartbeat(1)
    assert beat.status() == "starting"
    beat.beat()
    assert beat.status() == "ok"
    beat.last -= 33
    assert beat.status() == "stale"


def test_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.py").write_text("print(1)")
    row = corpora.folder(spark, str(tmp_path), "me").first()
    assert (row.repo, row.path, bytes(row.content)) == ("me", "src/x.py", b"print(1)")


GOOD = '[server]\nbind = "0.0.0.0:1"\n[[repos]]\nname = "org/x"\nurl = "git@h.org:a/b.git"\nref = "main"\n'


def test_config(monkeypatch):
    c = parse(GOOD)
    assert (c.server.bind, c.server.max_search_results, c.repos[0].name, c.cache.max_entries) == ("0.0.0.0:1", 10_000, "org/x", 1000)
    monkeypatch.setenv("TOKEN", "secret")
    repos = parse('[[repos]]\nname="a"\nurl="https://h/a"\nauth_token="${TOKEN}"\nssh_key="$NOT_SET_ANYWHERE"\n').repos
    assert repos[0].auth_token == "secret" and repos[0].ssh_key is None and "secret" not in repr(repos[0])


@pytest.mark.parametrize(
    "text",
    [
        "[server]\nunknown = 1", "[other]\na = 1", "[server]\ntimeout_secs = 0", "[cache]\nmax_entries = 0", "[indexer]\nmax_file_size = 0", '[server]\ncors_origins = ["ftp://x"]', "not toml",
        '[[repos]]\nname=""\nurl="https://h/a"', '[[repos]]\nname="../a"\nurl="https://h/a"', '[[repos]]\nname="/a"\nurl="https://h/a"', '[[repos]]\nname="a"\nurl="ftp://h/a"', '[[repos]]\nname="a"\nurl=""',
        '[[repos]]\nname="a"\nurl="git@h:a"\nauth_token="x"', '[[repos]]\nname="a"\nurl="https://h/a"\nref="a..b"', '[[repos]]\nname="a"\nurl="https://h/a"\nref="a b"',
        '[[repos]]\nname="a"\nurl="https://h/a"\n[[repos]]\nname="a"\nurl="https://h/b"',
    ],
)
def test_bad_config(text):
    with pytest.raises(ConfigError):
        parse(text)


def test_versions_without_other_content_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    batch = lambda *rows: spark.createDataFrame([(r, p, None if c is None else bytearray(c), v) for r, p, c, v in rows], FILE_VERSIONS)
    assert apply_batch(store, batch(("r", "a", b"one", 1)))
    assert not apply_batch(store, batch(("r", "a", b"one", 4), ("r", "b", None, 1)))
    assert not apply_batch(store, batch(("r", "a", b"late", 3))) and state(store)[0] == [("r", "a", b"one")]
    assert apply_batch(store, batch(("r", "a", None, 5))) and state(store)[0] == []
