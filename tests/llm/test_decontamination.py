import hashlib
import random
import re

import pytest

from sparkgrove.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(n, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item) if item is not None else "null")
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if got := windows.get(tuple(words[k : k + size])):
                    found |= got
                    hit |= set(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key is not None, key or 0, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def got(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "de", "É1", "x2", "ü", "Zz"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for k in range(12)]
    items += [(50, "never-seen words a b c"), (51, None), (None, "b c Zz de"), (3, items[3][1]), (52, "a a a a a a a"), (10, "other text, same id x2")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            words[3:3] = (rng.choice(items)[1] or "").split()
        docs.append((k, rng.choice([" ", "\n", "-"]).join(words)))
    return docs + [(60, None), (None, "b c zz de"), (None, ""), (61, "a " * 30), (5, "x2 a b c other"), (5, docs[5][1])], items


@pytest.mark.parametrize("n", [3, 4, 10])
@pytest.mark.parametrize("broadcast", [0, decontamination.BROADCAST_WORDS])
def test_brute_force(spark, monkeypatch, made, n, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", broadcast)
    docs, items = made
    table = spark.createDataFrame([(i, t, 1, [1]) for i, t in docs], "doc_id long, text string, pos int, words array<int>")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, word string")
    assert got(decontamination.decontaminate(table, bench, n).collect()) == brute(docs, items, n)


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_tables(spark, request, name):
    docs = request.getfixturevalue(name)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    out = decontamination.decontaminate(docs, bench).collect()
    assert got(out) == brute(rows, items, 10)
    assert all(not r.contaminated for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_proximity(spark, made):
    docs, items = made
    docs = [d for d in docs if d[0] != 5]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    keys = {r.mark: r.doc_id for r in table.select("doc_id", decontamination.mark_of(table.text).alias("mark")).collect()}
    out = {(r.item_id, keys[r.mark], r.pos) for r in decontamination.proximity_matches(table, spark.createDataFrame([(50, "De ü"), (51, "a Zz x2"), (52, "nowhere a")], "item_id long, text string"), 3).collect()}
    counts = {}
    for _, t in docs:
        for w in words_of(t):
            counts[w] = counts.get(w, 0) + 1
    want = set()
    for item, terms in (("50", ["de", "ü"]), ("51", ["a", "zz", "x2"])):
        rare = min(terms, key=lambda w: (counts[w], w))
        for key, text in docs:
            words = words_of(text)
            for pos, w in enumerate(words):
                if w == rare and all(x in words[max(0, pos - 3) : pos + 4] for x in terms):
                    want.add((item, key, pos))
    assert {x for x in out if x[1] is not None} == {x for x in want if x[1] is not None}
