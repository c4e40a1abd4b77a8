import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from sparkgrove.llm import toxicity
from tests.llm import test_decontamination as dec
from tests.llm import test_line_dedup as lines
from tests.llm import test_ngram_join as ngrams

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            tokenizer = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            total = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
            assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == total
            continue
        assert after.columns == columns and dict(after.dtypes) == dict(docs.dtypes)
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            scores = toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert kept == {r.doc_id: before[r.doc_id] for r in scores if not r.predicted}
        elif name == "line_dedup":
            want = lines.brute(list(before.items()), 2)
            assert kept == {i: t for i, (gone, t) in want.items() if not gone or t.strip(" \n")} and len(kept) < len(before)
        elif name == "ngram_join":
            assert kept == {i: before[i] for i, _, c in ngrams.brute(list(before.items())) if i == c}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == {x[1]: before[x[1]] for x in dec.brute(list(before.items()), items, 10) if not x[6]}
        docs = after


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and out.agg(F.max("length")).first()[0] <= 2048


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (None, "only without an id"), (4, "a b c d e f g"), (5, "A line of text that is here twice\n"), (6, "A line of text that is here twice"), (7, "\n\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: (r.doc_id or 0, r.text or "")
    assert sorted(map(key, corpus_pipeline.drop_near_copies(spark, docs, SF).collect())) == sorted([(1, ""), (2, ""), (3, rows[2][1]), (0, rows[5][1]), (5, rows[7][1]), (7, "\n\n")])
    cleaned = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert sorted(r.doc_id or 0 for r in cleaned.collect()) == [0, 0, 1, 2, 5, 7]  # a copy of the first line goes at any length
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_other_texts_of_an_id_stay(spark):
    text, other, third = "a b c d e f g", "quite another text that is no copy of it", "one more text of the first id that is alone"
    rows = [(1, text), (3, text), (3, other), (3, other), (5, other), (1, third), (None, third), (None, "without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(t for _, t in found) == sorted([text, other, third, "without an id"])
    assert {i for i, t in found if t == third} == {1} and (None, "without an id") in found


def test_contaminated_without_an_id_or_with_a_shared_one(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [(None, "so " + item), (None, "clean"), (4, item + " so"), (4, "clean too"), (5, item), (5, item), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "clean"), (4, "clean too"), (6, "")]
