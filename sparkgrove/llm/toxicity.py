"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character trigram model is counted over the words of all documents.
2. Suspicious words (digits or signs among letters, letters drawn out, letters set apart by blanks or signs) become
   lattices of what each character may stand for; the Viterbi path under the language model restores the word.
3. A logistic regression on the words of the restored text, whole and by their beginnings, gives the score. It is fitted
   on ``SAMPLE_ROWS`` labelled documents at most, the first by a hash of their ids; everything else covers all rows.

Defined results: a null text is empty; an empty text gets the score of a document without any word; repeated rows give
repeated results; null labels, and labels without a document, are left out; equal rows of labels count once, a document with both labels counts once for each; with
labels of one kind only, or none, every score is that kind's smoothed share; no rows give no rows; other columns of the
input are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.common import first_by_hash, id_text, map_batches, ship, stored, texts_of, tidy

#: At most so many labelled documents are fitted on.
SAMPLE_ROWS = 8192
MAX_FEATURES = 1000
LEAST_DOCUMENTS = 3
WORDS_KEPT = 150_000
SYMBOLS = 28  # 0: not a letter; 1 to 26: a to z; 27: another letter
# What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
VOWELS = "aeiou"
SUBSTITUTE, MASK, SHORTEN, DROP, DROP_LEET = 1.0, 2.5, 0.4, 0.3, 6.0  # costs, as negative logarithms
TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Of these, signs that stand for letters.
SIGNS = "".join(c for c in LEET if not c.isalnum()) + "*"
DRAWN_OUT = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1+")
#: A sign that stands for letters beside a letter at an end of a token; other signs there are punctuation.
SIGN_AT_END = re.compile(r"^[!-/:-@\[-`{-~]*[%s][^\W\d_]|[^\W\d_][%s][!-/:-@\[-`{-~]*$" % ((re.escape(SIGNS),) * 2))
#: Single signs with up to three blanks between them.
SPACED_AT_ALL = re.compile(r" \S {1,3}\S(?!\S)")
SPACED = re.compile(r"(?<!\S)\S(?: {1,3}\S){2,}(?!\S)")
BLANKS = re.compile(" +")


# ---- language model -----------------------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.int32)
for _c in range(256):
    _low = chr(_c).lower()
    _CLASS[_c] = ord(_low) - 96 if "a" <= _low <= "z" else 27 if chr(_c).isalpha() else 0


def trigrams(text: str) -> np.ndarray:
    """Counts of the trigrams of symbols in the text, as one row; letters beyond Latin-1 count as no letters."""
    codes = _CLASS[np.frombuffer((" " + text + " ").encode("latin-1", "replace"), np.uint8)]
    before = np.concatenate([np.zeros(1, np.int32), codes[:-2]])
    return np.bincount((before * SYMBOLS + codes[:-1]) * SYMBOLS + codes[1:], minlength=SYMBOLS**3)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


class CharModel:
    """-log p(symbol | two symbols before), smoothed with that of shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c[0, 0] = c[:, 0].sum(axis=0)  # a word's first letter knows nothing of the word before
        c[0, 0, 0] = 0
        one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + SYMBOLS)
        two = c.sum(axis=0)
        two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
        three = (c + 5 * two[None]) / (c.sum(axis=2, keepdims=True) + 5)
        self.cost = -np.log(three).astype(np.float32)
        self.rows = self.cost.tolist()

    def viterbi(self, lattice: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """The cheapest word: each place of the lattice offers strings with their channel costs."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in lattice:
            following: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, word) in best.items():
                for text, extra in options:
                    x, y, total = a, b, cost + extra
                    for c in text:
                        s = symbol(c)
                        total += self.rows[x][y][s]
                        x, y = y, s
                    if (old := following.get((x, y))) is None or (total, word + text) < old:
                        following[x, y] = (total, word + text)
            best = following
        cost, word = min((cost + self.rows[a][b][0], word) for (a, b), (cost, word) in best.items())
        return word, cost


def lattice_of(word: str) -> list[list[tuple[str, float]]]:
    """A place for each run of one character."""
    out = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        c, n = m[1], m.end() - m.start()
        letters = [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        if c == "*":
            letters = [(x, MASK) for x in VOWELS]
        options = [(x * k, extra * k + SHORTEN * (k < n)) for x, extra in letters for k in range(1, min(n, 2) + 1)]
        if not c.isalnum():
            options.append(("", DROP_LEET if c in LEET or c == "*" else DROP))
        out.append(options or [("", DROP)])
    return out


def suspicious(token: str) -> bool:
    """Signs or digits among its letters, drawn-out letters, or signs that stand for letters beside a letter at an end.

    Other signs around a word are punctuation.
    """
    word = token.strip(TRIM)
    odd = not word.isalpha() or DRAWN_OUT.search(word) or SIGN_AT_END.search(token)
    return bool(odd) and any(c.isalpha() for c in word)


def shortened(word: str) -> list[str]:
    """The word with one of its runs of a letter as a single letter, and with all of them."""
    if not DOUBLED.search(word):
        return []
    return [*(word[: m.start()] + m[1] + word[m.end() :] for m in DOUBLED.finditer(word)), DOUBLED.sub(r"\1", word)]


def edges(token: str) -> set[str]:
    """The token without signs at its ends, and with each number of runs of those next to the word that stand for letters."""
    word = token.strip(TRIM)
    begin = token.index(word)
    before, after = token[:begin], token[begin + len(word) :]
    before = before[len(before.rstrip(SIGNS)) :]
    after = after[: len(after) - len(after.lstrip(SIGNS))]
    befores = [before[m.start() :] for m in re.finditer(r"(.)\1*", before)] + [""]
    afters = [after[: m.end()] for m in re.finditer(r"(.)\1*", after)] + [""]
    return {x + word + y for x in befores for y in afters}


def lattices_of(spelling: str) -> list[list[list[tuple[str, float]]]]:
    """The lattices of one of edges(): one for each letter that its outer signs may be, with and without dropped signs.

    The model knows too little of a word's ends to tell these letters apart. That such a sign is dropped is another one's
    reading.
    """
    found = [lattice_of(spelling)]
    letters_only = [[x for x in options if x[1] != DROP_LEET] or options for options in found[0]]
    if letters_only != found[0]:
        found.append(letters_only)
    for end in (0, -1):
        if spelling[end] in TRIM:
            letters = dict.fromkeys(x[0] for x, _ in found[0][end] if x)
            found = [[*x[:end], own, *x[end:][1:]] for x in found for c in letters if (own := [y for y in x[end] if y[0].startswith(c)])]
    return found


def beginnings(lattice: list[list[tuple[str, float]]]) -> set[str]:
    """The first three letters of all words that the lattice offers."""
    found, whole = {""}, set()
    for options in lattice:
        found = {x + text for x in found for text, _ in options}
        whole |= {x[:3] for x in found if len(x) >= 3}
        found = {x for x in found if len(x) < 3}
        if not found:
            break
    return whole | found


def count_model(docs: DataFrame) -> CharModel:
    """The model of all words of docs. The counts come together as sums for each of the 28^3 trigrams."""

    def run(batch):
        total = np.zeros(SYMBOLS**3, np.int64)
        for text in texts_of(batch):
            total += trigrams(text) if len(text) > 4000 else 0
        total += trigrams(" ".join(x for x in texts_of(batch) if len(x) <= 4000))
        seen = np.flatnonzero(total)
        yield {"gram": seen, "n": total[seen]}

    rows = map_batches(id_text(docs), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    counts[[r.gram for r in rows]] = [r.n for r in rows]
    return CharModel(counts)


# ---- restored words and features ----------------------------------------------------------------------------------


class Restorer:
    """The words of a text, in lower case and without signs around them, with restored ones beside suspicious ones."""

    def __init__(self, model: CharModel):
        self.model = model
        self.decoded: dict[str, str] = {}

    def forms(self, token: str, starts: set[str] | None = None) -> tuple[str, ...]:
        """Of restored words, those may be left out whose first three letters aren't among starts."""
        word = token.strip(TRIM)
        got = (word,) if word else ()
        if suspicious(token):
            restored = {word for x in edges(token) for word in self.restored(x, starts)}
            got = tuple(dict.fromkeys([*got, *sorted(restored - {""})]))
        return tuple(dict.fromkeys([*got, *(x for w in got for x in shortened(w))]))

    def restored(self, spelling: str, starts: set[str] | None) -> list[str]:
        if (words := self.decoded.get(spelling)) is None:
            lattices = lattices_of(spelling)
            if starts is not None and starts.isdisjoint({x for lattice in lattices for x in beginnings(lattice)}):
                return []
            if len(self.decoded) > WORDS_KEPT:
                self.decoded.clear()
            words = self.decoded[spelling] = [self.model.viterbi(x)[0] for x in lattices]
        return words

    def tokens(self, text: str) -> set[str]:
        text = text.lower()
        found = set(text.split())
        if SPACED_AT_ALL.search(text):
            found.update(BLANKS.sub(".", m[0]) for m in SPACED.finditer(text))
        return found

    def restore(self, text: str) -> str:
        """The text with each suspicious word restored, for reading."""
        joined = SPACED.sub(lambda m: BLANKS.sub(".", m[0]), text.lower())
        return " ".join((self.model.viterbi(lattice_of(t))[0] or t) if suspicious(t) else t for t in joined.split())


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in range(3, min(len(word), 8) + 1))]


# ---- classifier ---------------------------------------------------------------------------------------------------


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float]

    def score(self, features: set[str]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in features), -30, 30))))


def choose(on_bad: np.ndarray, on_good: np.ndarray, bad: int, good: int, most: int = MAX_FEATURES) -> np.ndarray:
    """Numbers of the features that speak most for label 1, by their likelihood ratio. Given: how many documents have each."""
    if not bad or not good:
        return np.zeros(0, np.int64)
    share, both = (bad + 0.5) / (bad + good + 1), on_bad + on_good
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = on_bad * np.log(on_bad / (both * share)) + np.where(on_good > 0, on_good * np.log(on_good / (both * (1 - share))), 0)
    gain = np.where((on_bad >= LEAST_DOCUMENTS) & (on_bad / bad > on_good / good), gain, 0)
    return np.lexsort((np.arange(len(gain)), -gain))[: min(most, int((gain > 3).sum()))]


def fit(names: list[str], rows: list[tuple[np.ndarray, int]], steps: int = 300, ridge: float = 1e-5) -> Classifier:
    """Weights of the named features. rows: the numbers of those in each document, and its label."""
    y = np.array([y for _, y in rows], np.float32)
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not names:
        return Classifier(bias, {})
    x = np.zeros((len(rows), len(names)), np.float32)
    for row, (found, _) in zip(x, rows, strict=True):
        row[found] = 1
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    w[0] = bias
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:].astype(np.float32), -30, 30)))
        g = np.concatenate([[(p - y).mean()], x.T @ (p - y) / len(y) + ridge * w[1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(float(w[0]), dict(zip(names, w[1:].tolist(), strict=True)))


def may_learn(doc_id: Column) -> Column:
    """Not held out: the crc32 of the id as text isn't a multiple of 5."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0


def labelled_words(docs: DataFrame, labels: DataFrame, model: CharModel, rows: int = SAMPLE_ROWS, learn: Callable[[Column], Column] = may_learn) -> DataFrame:
    """doc_id, words, label of the labelled documents whose ids come first by hash, ``rows`` at most, as a table."""
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label")).where("label_id IS NOT NULL AND label IN (0, 1)")
    ids = id_text(docs).select("doc_id").join(own, F.col("doc_id") == F.col("label_id")).where(learn(F.col("doc_id")))
    picked = first_by_hash(ids.select("doc_id", F.lit(0).alias("group"), "label"), rows).select(F.col("doc_id").alias("label_id"), "label")
    joined = id_text(docs).join(F.broadcast(picked.dropDuplicates()), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")

    restorer = Restorer(model)

    def run(batch):
        words = [sorted({w for t in restorer.tokens(x) for w in restorer.forms(t)}) for x in texts_of(batch)]
        yield {"doc_id": batch.column("doc_id"), "words": words, "label": batch.column("label")}

    return stored(map_batches(joined, run, "doc_id long, words array<string>, label int"))


def _counted(sample: DataFrame, known: dict[str, int] | None) -> dict[str, int]:
    """In how many documents of the sample features stand (only known ones, if given), if in LEAST_DOCUMENTS or known."""

    def run(batch):
        found = ({f for w in words for f in word_features(w) if known is None or f in known} for words in batch.column("words").to_pylist())
        on = Counter(f for x in found for f in x)
        yield {"feature": list(on), "n": list(on.values())}

    rows = map_batches(sample, run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return {r.feature: r.n for r in (rows if known else rows.where(F.col("n") >= LEAST_DOCUMENTS)).toLocalIterator()}


def learn_classifier(sample: DataFrame) -> Classifier:
    """Features are made and counted on the executors; of each document only the numbers of the chosen ones come here."""
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    on_bad = _counted(sample.where("label = 1"), None)
    on_good = _counted(sample.where("label = 0"), on_bad) if on_bad else {}
    names = sorted(on_bad)
    chosen = choose(np.array([on_bad[f] for f in names], float), np.array([on_good.get(f, 0) for f in names], float), sizes.get(1, 0), sizes.get(0, 0))
    names = [names[k] for k in chosen]
    place = {f: k for k, f in enumerate(names)}

    def numbers(batch):
        found = [sorted({place[f] for w in words for f in word_features(w) if f in place}) for words in batch.column("words").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "features": found}

    rows = map_batches(sample, numbers, "doc_id long, label int, features array<int>").collect()
    return fit(names, [(np.array(r.features, np.int64), r.label) for r in sorted(rows)])


NO_FEATURES: frozenset[str] = frozenset()


class Scorer:
    """Scores texts, with the features of words it has seen at hand."""

    def __init__(self, model: CharModel, classifier: Classifier):
        self.classifier, self.restorer = classifier, Restorer(model)
        self.seen: dict[str, frozenset[str]] = {}
        #: What the words of features begin with; no other word needs a closer look.
        self.starts = {f.removeprefix("^")[:3] for f in classifier.weights}

    def hits(self, token: str) -> frozenset[str]:
        words = [w for w in self.restorer.forms(token, self.starts) if w[:3] in self.starts]
        return frozenset(f for w in words for f in word_features(w) if f in self.classifier.weights) if words else NO_FEATURES

    def forget(self) -> None:
        self.seen.clear()
        self.restorer.decoded.clear()

    def score(self, text: str) -> float:
        seen = self.seen
        features: set[str] = set()
        for token in self.restorer.tokens(text):
            hits = seen.get(token)
            if hits is None:
                if len(seen) > WORDS_KEPT:
                    seen.clear()
                hits = seen[token] = self.hits(token)
            if hits:
                features |= hits
        return self.classifier.score(features)


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(docs: DataFrame, model: CharModel, classifier: Classifier) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model, classifier))

    def run(batch):
        scores = [shared.value.score(x) for x in texts_of(batch)]
        ids = batch.column("doc_id").to_pylist()
        yield {"doc_id": ids, "held_out": [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_batches(id_text(docs), run, SCORES)


def keep_clean(docs: DataFrame, model: CharModel, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under 0.5.

    Workers forget the words they have seen after each task, since they wait beside stages that need the memory for joins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model, classifier))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield batch.filter(pa.array([shared.value.score(x or "") < 0.5 for x in batch.column(text_col).to_pylist()], pa.bool_()))
        finally:
            shared.value.forget()

    return docs.mapInArrow(tidy(run), docs.schema)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[CharModel, Classifier]:
    """Counts the language model over docs and fits on the labelled rows that aren't held out."""
    model = count_model(docs)
    return model, learn_classifier(labelled_words(docs, labels, model, sample_rows))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document."""
    return score_documents(docs, *learn(docs, labels, sample_rows))
