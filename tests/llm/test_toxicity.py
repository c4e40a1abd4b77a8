import itertools
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparkgrove.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.learn(docs, labels)


def test_trigram_counts():
    counts = toxicity.trigrams("Ab é").reshape(28, 28, 28)
    want = {(0, 0, 1): 1, (0, 1, 2): 1, (1, 2, 0): 1, (2, 0, 27): 1, (0, 27, 0): 1}
    assert {tuple(map(int, k)): int(counts[tuple(k)]) for k in np.argwhere(counts)} == want


def test_viterbi_is_the_best_path(learnt):
    model, _ = learnt

    def cost(word):
        total, a, b = 0.0, 0, 0
        for c in [*map(toxicity.symbol, word), 0]:
            total += model.cost[a, b, c]
            a, b = b, c
        return total

    for word in ("1d10t", "l00000ser", "s.t.u.p.1.d", "tr@$h", "c1*wn", "xx!!yy"):
        lattice = toxicity.lattice_of(word)
        paths = [("".join(t for t, _ in p), sum(x for _, x in p)) for p in itertools.product(*lattice)]
        best = min(extra + cost(text) for text, extra in paths)
        text, total = model.viterbi(lattice)
        assert total == pytest.approx(best, abs=1e-3)


def test_restores_words(learnt):
    restorer = toxicity.Restorer(learnt[0])
    assert restorer.restore("1d10t l0ser s c u m m.o.r.o.n tr@sh stuuuupid cl0wn") == "idiot loser scum moron trash stupid clown"
    assert restorer.restore("the plain words of it") == "the plain words of it"


def test_obfuscated_words_count(learnt):
    scorer = toxicity.Scorer(*learnt)
    clean = "Is and the of nterti thorreou ndernt by for and threea it is. "
    assert scorer.score(clean) < 0.5
    for word in ("idiot", "1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "tr@sh", "st*pid"):
        assert scorer.score(clean + word + " " + clean) > 0.5, word


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi").where("doc_id < 6000")
    rows = {r.doc_id: r for r in toxicity.toxicity(some, labels).collect()}
    truth = [(rows[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert np.mean([r.predicted == y for r, y in truth]) > 0.96
    bad, good = [r.score for r, y in truth if y], [r.score for r, y in truth if not y]
    assert np.mean([[x > y for y in good] for x in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())


@pytest.mark.parametrize("name", ["odd_documents", "no_documents"])
def test_odd_documents(spark, request, name):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (99, 1), (5, 0), (5, 0), (6, 1), (7, 0)], "doc_id long, toxic int")
    for labelled in (labels, labels.where("toxic = 0"), labels.limit(0)):
        out = toxicity.toxicity(docs, labelled).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) <= 1


def test_keep_clean(spark, learnt):
    docs = spark.createDataFrame([(1, "an idiot and a moron, trash", "en"), (2, "the and of it", "de"), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, toxicity.keep_clean(docs, *learnt).collect())) == [(2, "the and of it", "de"), (3, None, None)]


def test_scores_dont_depend_on_other_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    own = toxicity.toxicity(docs, labels).collect()
    other = toxicity.toxicity(docs.selectExpr("doc_id", "text", "'x' lang", "'y' source"), labels).collect()
    assert sorted(own) == sorted(other)


@pytest.mark.parametrize("word", ["!diot", "|oser", "(lown", "<lown", "+rash", "*diot", "idio+", "scu*"])
def test_signs_at_the_ends_are_decoded(word):
    assert toxicity.suspicious(word)
    assert any(x.strip(toxicity.TRIM) != x for x in toxicity.edges(word))


def test_disguised_ends_count(learnt):
    scorer = toxicity.Scorer(*learnt)
    clean = "Is and the of nterti thorreou ndernt by for and threea it is. "
    for word, plain in (("!diot", "idiot"), ("*diot", "idiot"), ("idio+", "idiot"), ("idio+,", "idiot"), ("(!diot", "idiot"), ("+rash", "trash"), ("(lown", "clown"), ("<lown", "clown"), ("$cum", "scum"), ("|oser", "loser")):
        assert scorer.hits(word) >= scorer.hits(plain) > set(), word
        assert scorer.score(clean + word + " " + clean) >= scorer.score(clean + plain + " " + clean), word
    assert scorer.score(clean + "!diot " + clean) > 0.5
    for word in ("the!", "(and", "threea.", "it?", "*of*"):
        assert scorer.score(clean + word + " " + clean) < 0.5, word


def test_words_left_out_have_no_features(learnt):
    scorer = toxicity.Scorer(*learnt)
    for token in ("!diot", "hello!", "(see", "1d10t", "s.t.u.p.1.d", "*diot", "st*pid!!", "a+b", "c++"):
        every = [w for w in scorer.restorer.forms(token) if w[:3] in scorer.starts]
        assert scorer.hits(token) == {f for w in every for f in toxicity.word_features(w) if f in scorer.classifier.weights}, token


def test_signs_beyond_ascii_and_doubled_letters(learnt):
    assert toxicity.suspicious("idi€t") and toxicity.suspicious("i•d•i•o•t") and not toxicity.suspicious("größe")
    scorer = toxicity.Scorer(*learnt)
    for word, plain in (("l€ser", "leser"), ("i•d•i•o•t", "idiot"), ("stuupid", "stupid"), ("looser", "loser"), ("iddioott", "idiot")):
        assert plain in scorer.restorer.forms(word), word
        assert scorer.hits(word) >= scorer.hits(plain), word


def test_letters_set_apart(learnt):
    scorer = toxicity.Scorer(*learnt)
    for text in ("and i d i o t the", "and i d | o t the", "and i  d  i  o  t the", "and i   d i   o t the"):
        assert any("idiot" in scorer.restorer.forms(t) for t in scorer.restorer.tokens(text)), text
    assert "a.|.b" not in scorer.restorer.tokens("aa | bb | cc")


#: How each kind of disguise writes a word.
KINDS = {
    "digits": lambda w: w.translate(str.maketrans("oieast", "013457")),
    "signs": lambda w: w.translate(str.maketrans("asi", "@$!")),
    "masked vowel": lambda w: w[:1] + w[1:].replace("i", "*").replace("o", "*").replace("u", "*"),
    "drawn out": lambda w: w[:2] + w[1] * 3 + w[2:],
    "dots": ".".join,
    "blanks": " ".join,
    "two blanks": "  ".join,
    "sign at the end": lambda w: w + "!",
}


def test_disguises_of_each_kind_are_found(learnt):
    scorer = toxicity.Scorer(*learnt)
    words = ["idiot", "moron", "loser", "stupid", "trash", "scum", "clown"]
    clean = "Is and the of nterti thorreou ndernt by for and threea it is. "
    words = [w for w in words if scorer.score(clean + w + " " + clean) > 0.5]
    assert len(words) >= 4
    found = {kind: [scorer.score(clean + write(w) + " " + clean) > 0.5 for w in words] for kind, write in KINDS.items()}
    assert min(map(np.mean, found.values())) >= 0.5 and np.mean([*map(np.mean, found.values())]) >= 0.75, (words, found)


def test_query_by_brute_force(spark, documents):
    """Scores without caches or pruned beginnings, from all forms of all tokens."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = documents.where("length(text) < 3000")
    model, classifier = toxicity.learn(docs, labels)
    for r, text in zip(toxicity.score_documents(docs, model, classifier).orderBy("doc_id").collect(), [x.text for x in docs.orderBy("doc_id").collect()], strict=True):
        restorer = toxicity.Restorer(model)
        features = {f for t in restorer.tokens(text or "") for w in restorer.forms(t) for f in toxicity.word_features(w)}
        z = classifier.bias + sum(w for f, w in classifier.weights.items() if f in features)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_stage_forgets_words_after_each_task(monkeypatch):
    """Workers live on beside stages that need the memory."""
    scorer, made = toxicity.Scorer(None, SimpleNamespace(weights={}, score=lambda features: 0.0)), []
    monkeypatch.setattr(toxicity, "Scorer", lambda *_: scorer)
    monkeypatch.setattr(toxicity, "ship", lambda _: None)
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), schema=None, mapInArrow=lambda run, _: made.append(run))
    toxicity.keep_clean(docs, None, None)
    kept = made[0](iter([pa.RecordBatch.from_pydict({"text": ["some plain words", None]})]))
    assert next(kept).num_rows == 2 and scorer.seen
    assert not list(kept) and not scorer.seen and not scorer.restorer.decoded
