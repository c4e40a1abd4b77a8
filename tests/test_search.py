import random

import pytest
from pyspark.sql import functions as F

from sparkgrove import queries
from sparkgrove.engine import ResultCache, SearchEngine, checked_glob, search_frames
from sparkgrove.functions.globs import GlobError
from sparkgrove.operators import index, matching, shaping
from sparkgrove.plans.planner import plan
from sparkgrove.sources import corpora
from sparkgrove.sources.store import NotAnIndex, Store

PAPERS = [("lib", "tea.txt", b"boil water, then steep the leaves"), ("lib", "soup.txt", b"boil the bones for hours"), ("lib", "salad.txt", b"toss the leaves with oil")]
SHELVES = [("north", "kitchen/tea.txt", b"Tea\n  kettle: copper kettle\nend"), ("north", "kitchen/pan.txt", b"Pan\n  see the kettle"), ("south", "garden.txt", b"a rake and a hoe")]


@pytest.fixture
def engine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write(corpora.in_memory(spark, SHELVES))
    return SearchEngine(spark, store)


def found_paths(spark, files, query, **how):
    df = corpora.in_memory(spark, files)
    return sorted(r.path for r in index.candidates(index.postings(df), plan(query, **how)).collect())


def test_candidates(spark):
    assert found_paths(spark, PAPERS, "the") == ["salad.txt", "soup.txt", "tea.txt"]
    assert found_paths(spark, PAPERS, "hours") == ["soup.txt"]
    assert found_paths(spark, PAPERS, "the leaves") == ["salad.txt", "tea.txt"]
    assert found_paths(spark, PAPERS, "pepper") == []
    split = [("lib", "both", b"green pear"), ("lib", "one", b"green plum")] + [("lib", f"n{k}", f"pear {k}".encode()) for k in range(5)]
    assert found_paths(spark, split, "green pear") == ["both"]
    assert index.with_all_trigrams(index.postings(corpora.in_memory(spark, split)), []).count() == 0


def test_two_documents_share_a_trigram(spark):
    rows = index.document_frequency(index.postings(corpora.in_memory(spark, [("lib", "a", b"oak elm"), ("lib", "b", b"elm ash")]))).collect()
    df = {r.tri: r.df for r in rows}
    assert (df[int.from_bytes(b"elm", "big")], df[int.from_bytes(b"oak", "big")]) == (2, 1)


def test_empty_corpus(spark):
    empty = corpora.in_memory(spark, PAPERS).limit(0)
    info = index.repo_info(empty, index.postings(empty))
    assert info.count() == 0 and shaping.health(info).first().asDict() == {"status": "no_repos", "repos_indexed": 0, "total_docs": 0}


def test_long_path_and_round_trip(spark, tmp_path):
    path = "deep/" * 16_000 + "leaf.txt"
    store = Store(spark, str(tmp_path / "s"))
    assert store.current() is None and store.tokens() == {}
    with pytest.raises(NotAnIndex):
        store.table("files")
    store.write(corpora.in_memory(spark, [("r", path, b"some text")]))
    row = store.table("files").first()
    assert (row.path, bytes(row.content), row.repo) == (path, b"some text", "r")


def blocks(spark, content, query, **how):
    out = search_frames(corpora.in_memory(spark, [("r", "f", content.encode())]), None, plan(query, **how), 10).collect()
    return [[(x.line_number, [tuple(r) for r in x.match_ranges]) for x in b.lines] for b in out[0].files[0].blocks] if out else []


def test_blocks(spark):
    lines = lambda n, hits: "\n".join("match" if k in hits else f"line {k}" for k in range(1, n + 1))
    numbers = lambda n, hits: [[x for x, _ in b] for b in blocks(spark, lines(n, hits), "match")]
    assert numbers(10, {2, 9}) == [[1, 2, 3, 4], [7, 8, 9, 10]]
    assert numbers(10, {3, 5}) == [list(range(1, 8))]
    assert numbers(6, {3, 4, 5}) == [list(range(1, 7))]
    assert [x for x, r in blocks(spark, lines(10, {3, 5}), "match")[0] if r] == [3, 5]


def test_unicode_ranges(spark):
    assert blocks(spark, "αβγ tetsa δε", "tetsa") == [[(1, [(4, 9)])]]
    assert blocks(spark, "Χρήστης TETSA end", "tetsa", ignore_case=True) == [[(1, [(8, 13)])]]
    assert blocks(spark, "αβγ foo123 δε", r"foo\d+", is_regex=True) == [[(1, [(4, 10)])]]
    assert blocks(spark, "foofoo x", "(foo)+|zzz*", is_regex=True) == [[(1, [(0, 6)])]]
    assert blocks(spark, "a foo b", "foo|x*", is_regex=True)[0][0][1][0] == (0, 0)


@pytest.mark.parametrize(("text", "query", "ranges"), [("abc and def", "abc.*def", [(0, 11)]), ("barbaz foo", "foo|barbaz", [(0, 6), (7, 10)]), ("xABCD", "(?i)abcd", [(1, 5)]), ("αβabcd", r"\p{Greek}*abcd", [(0, 6)]), ("yabcd xabcd", r"[\p{L}&&[^x]]?abcd", [(0, 5), (7, 11)])])
def test_patterns_with_width_stay_in_the_jvm(spark, text, query, ranges):
    found = plan(query, is_regex=True)
    assert not matching.can_be_empty(found) and [r for b in blocks(spark, text, query, is_regex=True) for _, r in b] == [ranges]


def test_patterns_that_may_match_nothing(spark):
    for query in (r"(?:word)?\p{Lu}*", r"[\p{L}&&[^x]]*(word)?", r"(?:word)?\z", r"(word)?\x{e9}?"):
        found = plan(query, is_regex=True)
        assert matching.can_be_empty(found) and blocks(spark, "a word ABC é", query, is_regex=True)
    assert (2, 6) in [r for b in blocks(spark, "a word", "(?:word)?x*", is_regex=True) for _, rs in b for r in rs]


def test_matching_rules(spark):
    assert [x for b in blocks(spark, "red\nblue sky\ngreen\ndark blue", "blue") for x, r in b if r] == [2, 4]
    assert [x for b in blocks(spark, "row 12\nrow 7\nrows", r"row \d+", is_regex=True) for x, r in b if r] == [1, 2]
    assert blocks(spark, "a\nb", "a\nb") == []
    many = "\n".join(["hit hit"] * 1001)
    texts = spark.createDataFrame([("r", "f", many)], "repo string, path string, text string")
    assert shaping.file_matches(matching.matching_lines(texts, plan("hit"))).first().match_count == 2000


def test_strict_and_exact_modes(spark):
    upper = corpora.in_memory(spark, [("r", "u", b"WINTER"), ("r", "f", b"spring"), ("r", "b", b"autumn")])
    grams = index.postings(upper)
    count = lambda q, mode, **how: index.candidates(grams, plan(q, mode=mode, **how)).count()
    assert (count("winter", "strict", ignore_case=True), count("winter", "exact", ignore_case=True)) == (0, 1)
    assert (count("spring|autumn", "strict", is_regex=True), count("spring|autumn", "exact", is_regex=True)) == (0, 2)


def test_ingest(spark):
    files = [("r", "ok", b"x" * 10), ("r", "big", b"x" * 11), ("r", "bin", b"\0"), ("r", "v/x.min.js", b"y"), ("r", "link", b"z")]
    df = corpora.in_memory(spark, files).withColumn("mode", F.when(F.col("path") == "link", 0o120000).otherwise(0o100644))
    assert sorted(r.path for r in corpora.ingest(df, 10, ["*.min.js", "[bad"]).collect()) == ["ok"]
    invalid = corpora.in_memory(spark, [("r", "f", b"\xff\xfe hello")])
    assert search_frames(invalid, index.postings(invalid), plan("hello"), 5).count() == 0


def test_scan_and_index_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    files = docs.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    grams = index.postings(files).cache()
    rng = random.Random(2)
    texts = [r.text for r in docs.collect()]
    for k in range(6):
        text = rng.choice(texts)
        at = rng.randrange(max(1, len(text) - 8))
        literal = text[at : at + rng.randint(3, 8)]
        if "\n" in literal or len(literal.encode()) < 3:
            continue
        p = plan(literal, ignore_case=k % 2 == 1)
        of = lambda f, p=p: sorted(map(tuple, shaping.file_matches(matching.matching_lines(corpora.with_text(f), p)).collect()))
        assert of(files) == of(index.candidate_files(files, grams, p)) != []


def test_engine(engine):
    out = engine.search("kettle")
    assert out["total_files"] == 2 and [r["repo"] for r in out["results"]] == ["north"] and not out["truncated"]
    first = out["results"][0]["files"][1]
    assert first["path"] == "kitchen/tea.txt" and first["blocks"][0]["lines"][1]["match_ranges"] == [[2, 8], [17, 23]] and "url" not in out["results"][0]
    assert engine.search("saucepan")["total_files"] == 0
    assert engine.search("kettle", max_results=1)["truncated"] and engine.search("rake", repos=" south ,x")["total_files"] == 1
    assert engine.search("rake", repos="")["total_files"] == 0 and engine.search("kettle", files="kitchen/*")["total_files"] == 2
    events = list(engine.search_stream("and a|the kettle|copper", is_regex=True))
    assert [k for k, _ in events] == ["result", "result", "done"] and events[-1][1]["total_files"] == 3
    assert {r.repo: r.doc_count for r in engine.repos().collect()} == {"north": 2, "south": 1}
    assert engine.health()["status"] == "ready" and engine.health()["total_docs"] == 3
    assert engine.search("kettle") == engine.search("kettle")
    engine.store.append([engine.store.layer(corpora.in_memory(engine.spark, [("south", "shed.txt", b"a kettle")]))])
    assert engine.search("kettle")["total_files"] == 3  # the cache goes by the store's version


def test_globs_that_cant_be_used():
    assert checked_glob("../x", lenient=True) is None and checked_glob("", False) is None and checked_glob("*.rs") == "*.rs"
    for bad in ("../x", "[a"):
        with pytest.raises(GlobError):
            checked_glob(bad)


def test_cache():
    now = [0.0]
    cache = ResultCache(2, 10, lambda: now[0])
    for k in "abc":
        cache.put((k,), k)
    assert cache.get(("a",)) is None and cache.get(("b",)) == "b"
    cache.put(("d",), "d")
    assert cache.get(("c",)) is None and cache.get(("b",)) == "b"
    now[0] = 10
    assert cache.get(("b",)) is None
    expired = ResultCache(5, 0)
    expired.put(("x",), "x")
    assert expired.get(("x",)) is None


def test_status_and_details(spark, engine):
    status = shaping.sanitized(spark.createDataFrame([("a", "failed", "remote authentication required"), ("b", "failed", "ref not found"), ("c", "failed", "boom"), ("d", "ready", None)], "repo string, status string, error string"))
    assert [r.error for r in status.orderBy("repo").collect()] == ["authentication failed", "repository or ref not found", "indexing failed", None]
    assert {r.status: r.n for r in shaping.status_counts(status).collect()} == {"failed": 3, "ready": 1}
    engine.details = spark.createDataFrame([("north", "https://x/a", None, "main"), ("south", "https://x/b", "dev", "main")], "repo string, url string, ref string, resolved_ref string")
    got = {r["repo"]: (r["url"], r["git_ref"]) for r in engine.search("and a|the kettle", is_regex=True)["results"]}
    assert got == {"north": ("https://x/a", "main"), "south": ("https://x/b", "dev")}


def test_queries_count_all_lines_of_a_file(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(1)
    docs.withColumn("text", F.repeat(F.lit("the License\n"), 1500)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("literal_file_matches", "literal_ci"):
        assert [r.match_count for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] == [1500], name
    assert queries.QUERIES["match_ranges"](spark, str(tmp_path)).count() == 1500
    for name in ("repo_totals", "search_results"):
        assert [r.total_match_count for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] == [1500], name
