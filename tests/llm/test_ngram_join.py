import random

import pytest

from sparkgrove.llm import common, graph, ngram_join
from sparkgrove.llm.common import stored
from sparkgrove.llm.graph import components


def sets_of(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(sets_of(t))
    flat = [(i, s) for i, v in sets.items() for s in v if s and i is not None]
    links = [(i, j) for k, (i, s) in enumerate(flat) for j, t in flat[k + 1 :] if 100 * len(s & t) >= 80 * len(s | t)]
    parent = least([i for i in sets if i is not None], links)
    return sorted((i, len(sets_of(t)), parent[i]) for i, t in rows if i is not None)


def got(rows):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)


def near_copies(seed, groups, members, words, changes):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text[5:5] = common
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_tables(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = ngram_join.ngram_components(docs).collect()
    assert got(out) == brute(rows) and len(out) == len(rows)


@pytest.mark.parametrize(("groups", "members", "words", "changes", "part"), [(3, 60, 60, 6, 10**6), (2, 70, 60, 8, 20), (6, 25, 30, 2, 15)])
def test_many_near_copies(spark, monkeypatch, groups, members, words, changes, part):
    monkeypatch.setattr(ngram_join, "PART_ROWS", part)
    monkeypatch.setattr(ngram_join, "FEW", 6)
    rows = near_copies(groups, groups, members, words, changes)
    assert got(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_null_ids_follow_their_exact_copies(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (None, "x"), (4, "A b C d e  f")]
    out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in out) == [(0, 0), (0, 0), (0, 3), (3, 3), (4, 3)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    want = least({x for e in edges for x in e}, edges)
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_jobs(spark, monkeypatch):
    """A small graph goes through its rounds in one task: far fewer jobs and the same components."""
    rng, took = random.Random(3), []
    names = rng.sample(range(10_000), 150)
    df = stored(spark.createDataFrame([*zip(names[:99], names[1:100], strict=True), *((names[100], x) for x in names[101:])], "a long, b long"))
    least = {x: min(own) for own in (names[:100], names[100:]) for x in own}
    for most in (graph.FEW_EDGES, 0):
        monkeypatch.setattr(graph, "FEW_EDGES", most)
        before = spark._jsc.sc().dagScheduler().numTotalJobs()
        assert {r.node: r.component for r in components(df).collect()} == {x: y for x, y in least.items() if x != y}
        took.append(spark._jsc.sc().dagScheduler().numTotalJobs() - before)
    assert took[0] < took[1] / 2, took


def test_driver_gives_memory_back(spark, monkeypatch):
    """After each written table, as plans compiled for it leave the driver's JVM with free native memory."""
    given, give = [], common.give_back_driver
    monkeypatch.setattr(common, "give_back_driver", lambda s: given.append(give(s)))
    stored(spark.range(3).toDF("a"))
    assert given == [True]
