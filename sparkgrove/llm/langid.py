"""Language identification with a linear-chain conditional random field over words.

Each word has features of its beginning and end, its character n-grams and itself (the lexicon), hashed into
``DIMENSIONS`` weights a label; transitions between neighbours' labels are learnt too. ``LanguageModel.label_words``
labels the words of code-switched text by forward-backward; a document's language is that of its largest mean posterior.

Training takes texts of ``SAMPLE_ROWS`` documents for each language at most, the first by a hash of their ids. Executors cut
them into stretches and turn their words into numbers; ``STRETCHES`` of a language at most come to the driver, which strings
them together with changes of language among them, so that changes can be learnt.

Forward-backward runs on many documents at once: each is cut into blocks; the blocks' matrices are multiplied up side by
side, carried from block to block, and then the posteriors within all blocks found side by side. It is exact.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows give repeated results;
without documents to learn from every text is ``und``; more than ``MOST_LANGUAGES`` values of lang are an error; with one language all texts that have letters are of it; no rows
give no rows; other columns of the input are not carried.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.llm.common import first_by_hash, id_text, map_batches, stored, texts_of

SAMPLE_ROWS = 400
STRETCHES = 4000
MOST_LANGUAGES = 256
DIMENSIONS = 1 << 16
WORDS_KEPT = 300_000
BLOCK = 64
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; none if it has no letter (a fraction or a superscript is none)."""
    words = WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one word after another, and where each word's begin.

    A word is ``^word$``: its 2-, 3- and 4-grams (those at the ends are its affixes) and the whole (the lexicon).
    """
    joined = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    left = np.repeat(starts + lengths, lengths) - np.arange(len(joined))  # characters up to the word's end
    mixed, grams, owners = np.zeros(len(joined), np.uint64), [], []
    owner = np.repeat(np.arange(len(words)), lengths)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, 5):
        mixed = (mixed[: len(joined) - n + 1] * np.uint64(1_000_003) + joined[n - 1 :]) * factor
        mixed ^= mixed >> np.uint64(29)
        if n > 1:
            inside = np.flatnonzero(left[: len(mixed)] >= n)
            grams.append(mixed[inside])
            owners.append(owner[inside])
    grams.append(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) * factor)
    owners.append(np.arange(len(words)))
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return (grams[order] >> np.uint64(40)).astype(np.int64) % DIMENSIONS, np.concatenate([[0], np.cumsum(counts)[:-1]])


def posteriors(emit: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior of each label for each word. emit: words x labels, log scores, of documents of these lengths in turn."""
    labels = emit.shape[1]
    e = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    t = np.exp(transition - transition.max())
    blocks = -(-lengths // BLOCK)
    n = int(blocks.sum())
    if not n:
        return e
    # place of each word in blocks x BLOCK, and of each block in its document
    first_block, first_word = np.concatenate([[0], np.cumsum(blocks)[:-1]]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(e)) - np.repeat(first_word, lengths)
    row, col = np.repeat(first_block, lengths) + within // BLOCK, within % BLOCK
    grid, real = np.ones((BLOCK, n, labels)), np.zeros((BLOCK, n, 1), bool)
    grid[col, row], real[col, row] = e, True
    head = np.zeros((n, 1), bool)
    head[first_block[blocks > 0]] = True
    step = np.where(head[:, :, None], np.eye(labels), t[None])  # the first word of a document has no transition

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    # (1) each block's matrix: from the label before it to its last label
    m = scaled(step * grid[0][:, None, :])
    for k in range(1, BLOCK):
        m = np.where(real[k][:, :, None], scaled((m @ t) * grid[k][:, None, :]), m)
    # (2) carried from block to block: forward before each block, backward after each block
    before, after = np.full((n, labels), 1 / labels), np.full((n, labels), 1 / labels)
    order = np.argsort(-blocks, kind="stable")
    firsts, sizes = first_block[order], blocks[order]
    for k in range(1, int(blocks.max())):
        live = firsts[: np.searchsorted(-sizes, -k, side="left")]
        before[live + k] = scaled(np.einsum("bi,bij->bj", before[live + k - 1], m[live + k - 1]))
    for k in range(int(blocks.max()) - 2, -1, -1):
        live = firsts[: np.searchsorted(-sizes, -(k + 1), side="left")]
        after[live + k] = scaled(np.einsum("bij,bj->bi", m[live + k + 1], after[live + k + 1]))
    # (3) within all blocks
    forward = np.empty_like(grid)
    a = scaled(np.einsum("bi,bij->bj", before, step) * grid[0])
    forward[0] = a
    for k in range(1, BLOCK):
        a = np.where(real[k], scaled((a @ t) * grid[k]), a)
        forward[k] = a
    out, b = np.empty_like(grid), after
    for k in range(BLOCK - 1, -1, -1):
        out[k] = scaled(forward[k] * b)
        b = np.where(real[k], scaled((grid[k] * b) @ t.T), b)
    return out[col, row]


class LanguageModel:
    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.weights, self.transition = labels, weights, transition
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(labels)), np.float32)

    def __getstate__(self):
        return self.labels, self.weights, self.transition

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > WORDS_KEPT:
            self.rows, self.scores = {}, self.scores[:0]
        new = list(dict.fromkeys(w for w in words if w not in self.rows))
        if new:
            features, starts = word_grams(new)
            self.scores = np.concatenate([self.scores, np.add.reduceat(self.weights[features], starts, axis=0)])
            at = len(self.rows)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
        return self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].astype(float)

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        words = [words_of(x) for x in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        if not self.labels or not lengths.sum():
            return [("und", 0.0)] * len(texts)
        post = posteriors(self.emissions([w for x in words for w in x]), lengths, self.transition)
        sums = np.zeros((len(texts), len(self.labels)))
        some = np.flatnonzero(lengths)
        sums[some] = np.add.reduceat(post, np.concatenate([[0], np.cumsum(lengths)[:-1]])[some], axis=0)
        best = sums.argmax(axis=1)
        return [(self.labels[b], min(1.0, float(sums[i, b] / n))) if n else ("und", 0.0) for i, (b, n) in enumerate(zip(best, lengths, strict=True))]

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Word, language and posterior of each word of a text that may mix languages."""
        words = words_of(text)
        if not words or not self.labels:
            return [(w, "und", 0.0) for w in words]
        post = posteriors(self.emissions(words), np.array([len(words)]), self.transition)
        return [(w, self.labels[p.argmax()], float(p.max())) for w, p in zip(words, post, strict=True)]


def stretches(text: str, seed: int) -> list[list[str]]:
    """The words of a text in stretches of 4 to 60."""
    rng, words, out, at = np.random.default_rng(seed), words_of(text), [], 0
    while at < len(words):
        n = int(rng.integers(4, 61))
        out.append(words[at : at + n])
        at += n
    return out


@dataclass
class Sample:
    """Numbered words of stretches, and the features of each number."""

    labels: list[str]
    words: list[np.ndarray]
    label_of: list[int]
    features: np.ndarray
    starts: np.ndarray


def gathered(rows: list[tuple[str, np.ndarray]], features_of: dict[int, np.ndarray]) -> Sample:
    """rows: (language, words as hashes) of stretches, already in mixed order."""
    labels = sorted({y for y, _ in rows})
    known = np.array(sorted(features_of), np.int64)
    counts = [len(features_of[w]) for w in known.tolist()]
    features = np.concatenate([features_of[w] for w in known.tolist()]) if len(known) else np.zeros(0, np.int64)
    return Sample(labels, [np.searchsorted(known, x) for _, x in rows], [labels.index(y) for y, _ in rows], features, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64))


def train(sample: Sample, steps: int = 40, ridge: float = 1e-6) -> LanguageModel:
    """Maximum likelihood by gradient steps over all stretches, in sequences of BLOCK words."""
    labels, features, starts = sample.labels, sample.features, sample.starts
    k = len(labels)
    weights, transition = np.zeros((DIMENSIONS, k), np.float32), np.zeros((k, k))
    n = sum(map(len, sample.words)) // BLOCK
    if k < 2 or not n:
        return LanguageModel(labels, weights, transition)
    # a rest shorter than a sequence isn't trained on
    ids = np.concatenate(sample.words)[: n * BLOCK].reshape(n, BLOCK).T
    gold = np.repeat(sample.label_of, [len(x) for x in sample.words])[: n * BLOCK].reshape(n, BLOCK).T
    n_words = len(starts)
    counts = np.diff(np.concatenate([starts, [len(features)]]))
    eye, sums = np.eye(k), [np.zeros_like(weights, float), np.zeros((k, k))]
    for _ in range(steps):
        emit = np.add.reduceat(weights[features], starts, axis=0)[ids].astype(float)
        e, t = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(transition - transition.max())
        forward, back = np.empty_like(e), np.ones_like(e)
        forward[0] = e[0] / e[0].sum(axis=1, keepdims=True)
        for i in range(1, BLOCK):
            a = (forward[i - 1] @ t) * e[i]
            forward[i] = a / a.sum(axis=1, keepdims=True)
        for i in range(BLOCK - 2, -1, -1):
            b = (e[i + 1] * back[i + 1]) @ t.T
            back[i] = b / b.sum(axis=1, keepdims=True)
        post = forward * back
        post /= post.sum(axis=2, keepdims=True)
        pair = np.einsum("tni,tnj->tnij", forward[:-1], e[1:] * back[1:]) * t
        pair = (pair / pair.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
        seen = np.bincount((gold[:-1] * k + gold[1:]).reshape(-1), minlength=k * k).reshape(k, k)
        error = (eye[gold] - post).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.reshape(-1), error[:, y], n_words) for y in range(k)], axis=1)
        grown = [np.stack([np.bincount(features, np.repeat(by_word[:, y], counts), DIMENSIONS) for y in range(k)], axis=1) - ridge * ids.size * weights, seen - pair - 1e-3 * transition]
        for x, g, s, rate in zip((weights, transition), grown, sums, (0.2, 0.3), strict=True):
            s += g * g
            x += (rate * g / (np.sqrt(s) + 1e-8)).astype(x.dtype)
    return LanguageModel(labels, weights, transition)


def may_learn(doc_id: Column) -> Column:
    """Not held out: the crc32 of the id as text doesn't leave 2 when divided by 4."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2


def word_hash(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63) for w in words], np.int64)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = STRETCHES) -> LanguageModel:
    """Fits the model. Only hashes of words and numbers of features come to the driver."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("group")).where("group IS NOT NULL AND doc_id IS NOT NULL").where(may_learn(F.col("doc_id")))
    if own.select("group").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    picked = first_by_hash(own, rows).select(F.col("doc_id").alias("picked_id"), F.col("group").alias("lang")).dropDuplicates()
    texts = id_text(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("doc_id", "text", "lang")

    def cut(batch):
        out: dict[str, list] = {"lang": [], "place": [], "words": []}
        for key, text, lang in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("lang").to_pylist(), strict=True):
            for k, words in enumerate(stretches(text, key & 0xFFFFFFFF)):
                out["lang"].append(lang)
                out["place"].append(xxhash.xxh3_64_intdigest(f"{key}:{k}:{words[0]}") - (1 << 63))
                out["words"].append(words)
        yield out

    cuts = map_batches(texts, cut, "lang string, place long, words array<string>")
    first = W.Window.partitionBy("lang").orderBy("place", "words")
    chosen = stored(cuts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).select("lang", "place", "words"))

    def hashed(batch):
        yield {"lang": batch.column("lang"), "place": batch.column("place"), "words": [word_hash(x) for x in batch.column("words").to_pylist()]}

    def featured(batch):
        words = sorted({w for x in batch.column("words").to_pylist() for w in x})
        features, starts = word_grams(words)
        yield {"word": word_hash(words), "features": np.split(features, starts[1:])}

    found = map_batches(chosen, hashed, "lang string, place long, words array<long>").toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    numbers = map_batches(chosen, featured, "word long, features array<int>").groupBy("word").agg(F.first("features").alias("features")).toArrow()
    features_of = dict(zip(numbers["word"].to_pylist(), (np.array(x, np.int64) for x in numbers["features"].to_pylist()), strict=True))
    return train(gathered(list(zip(found["lang"].to_pylist(), (np.array(x, np.int64) for x in found["words"].to_pylist()), strict=True)), features_of))


PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
        found = [x for k in range(0, len(texts), 400) for x in shared.value.documents(texts[k : k + 400])]
        yield {"doc_id": ids, "held_out": [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_batches(id_text(docs), run, PREDICTIONS)


def language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return predict(docs, learn(docs, sample_rows))
