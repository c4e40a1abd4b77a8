import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgrove.llm import line_dedup, queries
from sparkgrove.llm.common import stored


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, times):
    chars = list(text)
    for _ in range(times):
        k, kind = rng.randrange(max(1, len(chars))), rng.randrange(3)
        chars[k : k + (kind > 0)] = [rng.choice("abcé😀")] if kind < 2 else []
    return "".join(chars) or "x"


@pytest.mark.parametrize("threshold", [1, 2, 3, 6])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 40)))
        b = edited(rng, a, rng.randint(0, threshold + 3))
        if abs(len(a) - len(b)) <= threshold:
            pairs += [(a, b), (b, a)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.characters(F.col("a")).alias("x"), line_dedup.characters(F.col("b")).alias("y"))
    for r in df.select("a", "b", line_dedup.edit_distance(F.col("x"), F.col("y"), threshold).alias("d")).collect():
        want = distance(r.a, r.b)
        assert r.d == want if want <= threshold else r.d > threshold, (r.a, r.b, want, r.d)


def brute(rows, threshold, least_chars=None):
    """The dropped line numbers of each row; rows: (doc_id, text) with distinct ids."""
    least_chars = threshold + 1 if least_chars is None else least_chars
    places = [(i if i is not None else -1, no, line) for i, t in rows if t is not None for no, line in enumerate(t.split("\n")) if line.strip(" \t\r\v\f")]
    distinct = sorted({line for _, _, line in places})
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, x in enumerate(distinct):
        for y in distinct[k + 1 :]:
            if min(len(x), len(y)) >= least_chars and abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold:
                parent[find(x)] = find(y)
    seen, gone = set(), {}
    for i, no, line in sorted(places):
        if find(line) in seen:
            gone.setdefault(i, set()).add(no)
        seen.add(find(line))
    return {(i if i is not None else -1): (",".join(map(str, sorted(gone.get(i if i is not None else -1, ())))), None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone.get(i if i is not None else -1, ()))) for i, t in rows}


def line_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(3, 40))) for _ in range(40)]
    rows = [(k, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5])) for _ in range(rng.randint(0, 7)))) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, base[0] + "\n" + base[1]), (103, "\n".join([base[2]] * 50))]


@pytest.mark.parametrize(("threshold", "least", "broadcast", "few", "part_rows"), [(1, 4, 0, 2, 8), (2, None, 0, 2, 8), (2, 6, line_dedup.BROADCAST_ROWS, line_dedup.FEW, line_dedup.PART_ROWS)])
def test_report(spark, monkeypatch, threshold, least, broadcast, few, part_rows):
    """With few and part_rows low, almost all keys go the way of those that many lines share, some in salted parts."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "PART_ROWS", part_rows)
    monkeypatch.setattr(line_dedup, "BUCKETS", 64 if few == 2 else line_dedup.BUCKETS)
    rows = line_rows(threshold)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, no int").repartition(3)
    out = line_dedup.line_report(docs, threshold, least).collect()
    assert {(-1 if r.doc_id is None else r.doc_id): (r.dropped, r.text) for r in out} == brute(rows, threshold, least)
    assert all(r.n_dropped == len([x for x in r.dropped.split(",") if x]) for r in out) and len(out) == len(rows)


def test_odd_documents(odd_documents, no_documents):
    out = line_dedup.line_report(odd_documents).collect()
    assert len(out) == odd_documents.count() and {r.n_dropped for r in out if r.doc_id == 5} == {0}
    assert [r.text for r in out if r.doc_id == 1] == [None]
    cleaned = line_dedup.dedup_lines(odd_documents)
    assert cleaned.columns == odd_documents.columns and cleaned.count() == odd_documents.count()
    assert line_dedup.line_report(no_documents).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """Not all pairs of a group are made, and the group is one class all the same."""
    rng = random.Random(5)
    base = "this is the line that very many documents share, but for a sign or two in each of them"
    lines = sorted({edited(rng, base, rng.choice([1, 1, 2])) for _ in range(300)} | {base})
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    distinct = stored(line_dedup.distinct_lines(docs, 2, 3))
    pairs, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda p, *how: pairs.append(p.count()) or verified(p, *how))
    line_dedup.line_links(docs, distinct, 2)
    assert sum(pairs) < len(lines) ** 2 / 8
    found = {r.doc_id for r in line_dedup.line_report(docs, 2).collect() if r.n_dropped}
    assert found == {i for i, x in brute(list(enumerate(lines)), 2).items() if x[0]} and len(found) > 250


def test_finer_keys_of_large_groups(spark, monkeypatch):
    """Lines that share a part but aren't near each other get a few further keys each, however many they are."""
    rng, made, finer = random.Random(7), [], line_dedup._finer
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]

    def counted(entries, *how):
        out = finer(entries, *how)
        made.append((entries.count(), out.count()))
        return out

    monkeypatch.setattr(line_dedup, "_finer", counted)
    for n in (150, 300):
        lines = {" ".join(rng.choice(words) if rng.random() < 0.15 else w for w in words[:20]) for _ in range(n)}
        rows = list(enumerate(sorted(lines | {edited(rng, x, 1) for x in sorted(lines)[:20]})))
        out = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.dropped for r in out} == {i: x[0] for i, x in brute(rows, 2).items()}
    (few, few_made), (many, many_made) = made
    assert 0 < few < many and few_made <= 5 * few and many_made <= 5 * many


def test_one_component_needs_no_further_rounds(spark, monkeypatch):
    """Where all lines of each shared key are in one component after the first pairs, nothing else is verified or joined."""
    calls, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda p, *how: calls.append(p.count()) or verified(p, *how))
    lines = ["a line that many documents share, number " + c for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.doc_id for r in line_dedup.line_report(docs, 2).collect() if not r.n_dropped] == [0]
    assert len(calls) == 1 and calls[0] >= 25


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough\nother", "en"), (2, "a line that is long enough!", "de"), (3, None, "fr")], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.text, r.lang) for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {1: ("a line that is long enough\nother", "en"), 2: (None, "de"), 3: (None, "fr")}


def test_query_and_stage_link_two_edits(spark, monkeypatch):
    rows = [(1, "a line that is long enough\nother"), (2, "a lime that is lung enough"), (3, "a line that is long enouxyz")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert {r.doc_id: (r.dropped, r.text) for r in queries.op7_line_dedup(spark, "").collect()} == brute(rows, 2)
    assert {r.doc_id for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {1, 3}


def test_documents_two_edits(documents):
    docs = documents.where("length(text) < 1500").limit(90)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.line_report(docs, threshold=2).collect()
    assert {r.doc_id: (r.dropped, r.text) for r in out} == brute(rows, 2)
