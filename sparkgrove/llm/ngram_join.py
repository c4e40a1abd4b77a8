"""N-gram Jaccard join: prefix filtering, rarest n-grams first, each pair verified once.

1. A table of 2^18 buckets counts in how many documents n-grams of each bucket stand; it covers all documents and has a
   fixed size. It orders n-grams from rare to frequent; any order gives the same links, this one gives few candidates.
2. Documents with equal sets are one class; its smallest doc_id stands for it. Of each class the prefix of n-grams
   that any linked class must share is listed as (n-gram, class, size, position).
3. Classes that share a prefix n-gram are candidates if the length and positional filters let them. Of an n-gram that few
   classes share all pairs are taken. Of one that many share, one class is paired with all others first; then what isn't
   yet connected with the n-gram's largest component is tried against some of its members, and at last against every
   class of another component. So no link between components is lost, but a large group doesn't make all its pairs.
   N-grams frequent by the table are dealt out in salted parts.
4. Candidates pass a suffix filter: parities of the sets' n-grams by hash, in 2,048 bits, show a number of n-grams that only
   one of both has, and so bound the overlap beyond the prefix. Then their whole sets are compared. The result is the
   connected components of the links.

Defined results: null and empty texts have no n-grams and are linked with nothing; a text of fewer words than the n-gram's
has its whole sequence as its one n-gram; a row without doc_id belongs to its exact copies' component, or to none (null);
repeated rows give repeated results; documents with equal ids but other texts are linked with what any of them is linked
with; no rows give no rows; other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.common import id_text, limited as within, map_batches, stored, stored_small, texts_of, tidy, to_arrow
from sparkgrove.llm.graph import components

WORDS = 5
PERCENT = 80
BUCKET_BITS = 18
#: Up to so many classes with one n-gram are paired with each other at once.
FEW = 16
#: An n-gram in more documents than this, and than four times the mean of all buckets, is dealt out in parts of so many rows.
PART_ROWS = 4096
#: Members of a component against which others are tried before all are.
TRIED = 6
#: Rows of a few numbers, and rows with parities, that are sent to all executors; with more of them a join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_MARKS = 100_000
TRIES = 1

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct n-grams. Bytes are split at 0x20 and 0x09 to 0x0D and only A-Z lowered."""
    split = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(split)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, n)
    size = min(n, words)
    x = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        x = _mixed(x * _MUL + h[k : n - size + 1 + k])
    return np.unique(x)


def needed(n, percent: int = PERCENT):
    """The least size of a set that can be linked with one of n."""
    return (n * percent + 99) // 100


def bucket_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """In how many documents n-grams of each bucket stand."""

    def run(batch):
        total, waiting, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        for text in texts_of(batch):
            waiting.append(shingles(text, words) >> np.uint64(64 - BUCKET_BITS))
            size += len(waiting[-1])
            if size > 1 << 20:
                total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(total))
                waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(total))
        seen = np.flatnonzero(total)
        yield {"bucket": seen, "n": total[seen]}

    rows = map_batches(docs, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


PARITIES = 2048
SETS = "doc_id long, n int, key1 long, key2 long, bits array<long>, tokens array<long>, salts array<int>"


def prefixes(docs: DataFrame, counts: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each document its set's size, two hashes of the set, its parities by hash and its prefix, rarest first.

    salts: the part for each token of the prefix, -1 where the token isn't dealt out in parts; null if all are -1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    part_rows = max(PART_ROWS, int(4 * counts.mean()))

    def run(batch):
        counts = shared.value
        out: dict[str, list] = {k.split()[0]: [] for k in SETS.split(", ")}
        ids = batch.column("doc_id").to_pylist()
        for key, text in zip(ids, texts_of(batch), strict=True):
            x = shingles(text, words)
            n = len(x)
            often = counts[(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            first = np.lexsort((x, often))[: n - needed(n, percent) + 1 if n else 0]
            parts = -(-often[first] // part_rows)
            data = x.tobytes()
            mine = xxhash.xxh3_64_intdigest(str(key)) & 0x7FFFFFFF
            row = (
                key, n, xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh3_64_intdigest(data, 1) - (1 << 63),
                np.packbits(np.bincount((x % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).view(np.int64),
                x[first].view(np.int64), np.where(parts > 1, mine % np.maximum(parts, 1), -1) if (parts > 1).any() else None,
            )
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        yield out

    return map_batches(docs, run, SETS)


PAIRS = "a long, b long, token long, rep long, n int, pos int"


def _allowed(n1, p1, n2, p2, percent):
    """Length and positional filters: p1 and p2 are the places of a shared n-gram in the order from rare to frequent."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    overlap = -(-percent * (n1 + n2) // (100 + percent))
    return (low >= needed(high, percent)) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= overlap)


def shared_prefixes(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """First candidates (a, b) from entries (token, salt, rep, n, pos), and the entries of tokens that many share."""
    arrow = to_arrow(entries.sparkSession, PAIRS)
    names = ("token", "salt", "rep", "n", "pos")

    def of_runs(token, salt, rep, n, pos) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        left, right = [], []
        for size in range(2, FEW + 1):
            own = starts[(sizes == size) & (salt[starts] < 0)]
            if len(own):
                i, j = np.triu_indices(size, 1)
                left.append((own[:, None] + i).reshape(-1))
                right.append((own[:, None] + j).reshape(-1))
        many = np.flatnonzero((sizes > FEW) | (salt[starts] >= 0))
        for k in many:
            at = np.arange(starts[k], starts[k] + sizes[k])
            left.append(np.full(len(at) - 1, at[0]))
            right.append(at[1:])
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            good = _allowed(n[i].astype(np.int64), pos[i], n[j].astype(np.int64), pos[j], percent) & (rep[i] != rep[j])
            pairs = np.unique(np.stack([np.minimum(rep[i], rep[j])[good], np.maximum(rep[i], rep[j])[good]]), axis=1)
            none = pa.nulls(pairs.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(none.cast(f.type) for f in list(arrow)[2:])], schema=arrow)
        if len(many):
            at = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in many])
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(token[at]), pa.array(rep[at]), pa.array(n[at]), pa.array(pos[at])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            token, salt = now[:2]
            ends = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last run may go on in the next batch
            if cut:
                yield from of_runs(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield from of_runs(*held)

    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", F.xxhash64("rep"))
    return dealt.select(*names).mapInArrow(tidy(run), PAIRS)


def limited(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Marked for broadcast if it has ``most`` rows (BROADCAST_ROWS) at most."""
    return within(rows, BROADCAST_ROWS if most is None else most)


def full_sets(docs: DataFrame, reps: DataFrame, words: int = WORDS) -> DataFrame:
    """rep, tokens: the whole sets of the documents named in reps."""

    def run(batch):
        yield {"rep": batch.column("doc_id"), "tokens": [shingles(x, words).view(np.int64) for x in texts_of(batch)]}

    return map_batches(docs.join(limited(reps), F.col("doc_id") == F.col("rep"), "left_semi"), run, "rep long, tokens array<long>")


def overlap_possible(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column, percent: int) -> Column:
    """The suffix filter: n-grams of unlike parity are in one set only."""
    unlike = F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(unlike, F.lit(0), lambda n, k: n + k)
    return apart <= n_a + n_b - 2 * F.ceil((n_a + n_b) * percent / (100 + percent))


def verified(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked, by their whole sets."""
    sets = stored_small(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), words))
    ends = pairs.select(F.col("b").alias("end")).distinct()
    pairs = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a")).join(limited(pairs), "a")
    second = sets.join(limited(ends), F.col("rep") == F.col("end"), "left_semi")
    pairs = pairs.join(second.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = pairs.select("a", "b", (F.size("tokens_a") + F.size("tokens_b")).alias("n"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))
    return stored(both.where(F.col("both") * 100 >= (F.col("n") - F.col("both")) * percent).select("a", "b").distinct())


def _apart(hot: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of tokens with classes of more than one component: all of them, and those outside the token's largest."""
    known = hot.join(limited(found), F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", "bits", F.coalesce("component", "rep").alias("component"))
    sizes = known.groupBy("token", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("k", F.col("component"))).alias("most"), F.count("*").alias("n_components")).where("n_components > 1").select("token", F.col("most.component").alias("largest"))
    known = stored_small(known.join(limited(stored_small(largest)), "token"))
    return known, known.where("component <> largest")


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), one row per document."""
    docs = id_text(docs)
    table = stored(prefixes(docs, bucket_counts(docs, words), words, percent))
    keys = ["n", "key1", "key2"]
    classes = stored_small(table.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    own = table.where("n > 0").join(limited(classes.where("rep IS NOT NULL").select("rep").distinct()), F.col("doc_id") == F.col("rep"), "left_semi")
    own = own.select(F.col("doc_id").alias("rep"), "n", F.posexplode(F.arrays_zip("tokens", F.coalesce("salts", F.transform("tokens", lambda t: F.lit(-1))).alias("salts"))).alias("pos", "e"))
    first = stored(shared_prefixes(own.select(F.col("e.tokens").alias("token"), F.col("e.salts").alias("salt"), "rep", "n", "pos"), percent))
    active = first.select(F.explode(F.array("a", "b", "rep")).alias("rep")).where("rep IS NOT NULL").distinct()
    marks = stored_small(table.join(limited(active), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "n", "bits"))
    pairs = first.where("a IS NOT NULL").select("a", "b").distinct()
    near_marks = limited(marks, BROADCAST_MARKS)
    for x in "ab":
        pairs = pairs.join(near_marks.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    possible = overlap_possible(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), percent)
    tried = stored_small(pairs.where(possible).select("a", "b").distinct())
    found = stored_small(components(verified(docs, tried, words, percent)))

    def allowed(x: str, y: str) -> Column:
        """Length, positional and suffix filters between two entries of one token."""
        n1, p1, b1, n2, p2, b2 = (F.col(f"{t}.{c}") for t in (x, y) for c in ("n", "pos", "bits"))
        overlap = F.ceil((n1 + n2) * percent / (100 + percent))
        return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= overlap) & overlap_possible(n1, b1, n2, b2, percent)

    def more(pairs: DataFrame) -> None:
        nonlocal tried, found
        fresh = stored_small(pairs.select(F.least("o.rep", "x.rep").alias("a"), F.greatest("o.rep", "x.rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return
        tried = tried.unionByName(fresh)
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = stored_small(components(stars.unionByName(verified(docs, fresh, words, percent))))

    if first.where("token IS NOT NULL").limit(1).count():
        hot = stored_small(first.where("token IS NOT NULL").select("token", "rep", "n", "pos").join(near_marks.select("rep", "n", "bits"), ["rep", "n"]))
        same = F.col("o.token") == F.col("x.token")
        for k in range(TRIES):
            known, others = _apart(hot, found)
            more(others.alias("o").join(limited(stored_small(_members(known, k)), BROADCAST_MARKS).alias("x"), same & allowed("o", "x")))
        known, others = _apart(hot, found)
        different = (F.col("o.component") != F.col("x.component")) & ((F.col("x.component") == F.col("x.largest")) | (F.col("o.rep") < F.col("x.rep")))
        more(known.alias("x").join(limited(others, BROADCAST_MARKS).alias("o"), same & different & allowed("o", "x")))
    # documents without n-grams are linked with nothing: they need no join, where all of them would be one key;
    # nor do those that are alone in their class and component
    linked = stored_small(classes.join(limited(found), F.col("rep") == F.col("node"), "left").where("members > 1 OR component IS NOT NULL").select(*keys, F.coalesce("component", "rep").alias("linked")))
    named = table.where("n > 0").select("doc_id", *keys).join(limited(linked), keys, "left").select("doc_id", "n", "linked")
    named = named.unionByName(table.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("linked")))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("linked", "doc_id").alias("component_id"))


def _members(known: DataFrame, seed: int) -> DataFrame:
    """TRIED members of each token's largest component, by a hash; sums of minima, so no group is gathered."""
    largest = known.where("component = largest")
    minima = [F.min_by(F.struct("rep", "n", "pos", "bits"), F.xxhash64("rep", F.lit(seed * TRIED + k))).alias(f"m{k}") for k in range(TRIED)]
    return largest.groupBy("token").agg(*minima).select("token", F.explode(F.array_distinct(F.array(*(f"m{k}" for k in range(TRIED))))).alias("m")).select("token", "m.*")


#: The same result in DuckDB's SQL: all pairs of documents with a common n-gram, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + 4], ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 5, 0) + 2)) AS i FROM word_lists WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
