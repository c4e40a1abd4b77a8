"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

1. How often each benchmark word occurs is counted over all documents.
2. Of each window of ``n`` item words the rarest ``LISTS`` places are its anchors; a window with a word that no document
   has can't occur and goes. The postings (word, mark, position) of all anchor words are stored as a table; the mark is a
   hash of the whole text, so that exact copies are one document here.
3. A posting minus its word's place in the item is the place where the item would begin. Lists so adjusted are intersected:
   a beginning stays where all anchors of some window have it. It stands for all windows of the item at once, so a passage
   that many documents share makes one row for each occurrence, not one for each window.
4. At each beginning that is left all postings of the item's words are met, a row for each place; runs of ``n`` places in a
   row are hits. Only texts with beginnings are split for that, and no text is shuffled for it.

``phrase_hits`` gives the hits; ``proximity_matches`` finds the places where all words of an item stand within some
distance, from the rarest word's list.

Defined results: null texts have no words; an item of fewer than n words, but not none, is one window; repeated items and
item_ids count once; documents with equal ids are each compared with their own text; a null doc_id or item_id is kept (a
null item_id is the text "null"); no rows give no rows; other columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.llm.common import ascii_lower, id_text, limited, stored, stored_small

N = 10
LISTS = 2
#: Rows and bytes that are sent to all executors; with more of them joins shuffle.
BROADCAST_WORDS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: What stands between words, in text whose letters still have their case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words of a text in their own case; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def mark_of(text: Column) -> Column:
    return F.xxhash64(text)


def occurrences(docs: DataFrame) -> DataFrame:
    """mark, pos, word: a row for each word, which isn't stored or shuffled as it is."""
    rows = docs.select(mark_of(F.col("text")).alias("mark"), F.posexplode(raw_words(F.col("text"))).alias("pos", "raw"))
    return rows.select("mark", "pos", ascii_lower(F.col("raw")).alias("word"))


def small(rows: DataFrame, weight: Column) -> DataFrame:
    """Marked for broadcast if it is BROADCAST_WORDS rows and, by their weights, BROADCAST_BYTES at most."""
    return limited(rows, BROADCAST_WORDS, weight, BROADCAST_BYTES)


def by_word(words: DataFrame) -> DataFrame:
    return small(words, F.octet_length("word") + 48)


def item_words(items: DataFrame) -> DataFrame:
    """item_id (as text) and words, once each; items without words go."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.transform(raw_words(F.col("text")), ascii_lower).alias("words"))
    return words.where(F.size("words") > 0).dropDuplicates()


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, n: how often each of the words occurs in docs; words that don't occur are missing."""
    return occurrences(docs).join(by_word(words), "word").groupBy("word").agg(F.count("*").alias("n"))


def store_postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The stored table (word, mark, pos) of the words' occurrences in docs."""
    return stored(occurrences(docs).join(by_word(words), "word").select("word", "mark", "pos"))


def anchored(items: DataFrame, counts: DataFrame, n: int = N, lists: int = LISTS) -> DataFrame:
    """item_id, words, n, windows (for each that can occur, the places of its rarest words)."""
    places = items.select("item_id", "words", F.posexplode("words").alias("place", "word")).join(counts.withColumnRenamed("n", "count"), "word", "left")
    known = places.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("place", "count"))).alias("counts"))
    sized = known.withColumn("n", F.least(F.lit(n), F.size("words")))
    windows = sized.select("item_id", "words", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("counts") - F.col("n")), lambda i: F.slice(F.col("counts"), i + 1, F.col("n")))).alias("window"))
    windows = windows.where(~F.exists("window", lambda p: p["count"].isNull()))
    rarest = F.slice(F.array_sort(F.transform("window", lambda p: F.struct(p["count"].alias("count"), p["place"].alias("place")))), 1, lists)
    return windows.groupBy("item_id", "words", "n").agg(F.collect_set(F.array_sort(F.transform(rarest, lambda p: p["place"]))).alias("windows"))


def beginnings(postings: DataFrame, items: DataFrame) -> DataFrame:
    """mark, item_id, words_key, n, first: where the lists of a window's anchors, each less its place, meet."""
    anchors = items.select("item_id", "words", F.explode(F.array_distinct(F.flatten("windows"))).alias("place"))
    anchors = anchors.select("item_id", "place", F.xxhash64("words").alias("words_key"), F.element_at("words", F.col("place") + 1).alias("word"))
    adjusted = postings.join(small(anchors, F.octet_length("word") + F.octet_length("item_id") + 48), "word").select("mark", "item_id", "words_key", (F.col("pos") - F.col("place")).alias("first"), "place")
    met = adjusted.groupBy("mark", "item_id", "words_key", "first").agg(F.collect_set("place").alias("places"))
    keyed = items.select("item_id", F.xxhash64("words").alias("words_key"), "n", "windows")
    whole = met.join(small(keyed, 48 * (F.size("windows") + 2)), ["item_id", "words_key"])
    return whole.where(F.exists("windows", lambda w: F.size(F.array_except(w, F.col("places"))) == 0)).select("mark", "item_id", "words_key", "n", "first")


def phrase_hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """mark (of the text), item_id, from_pos and to_pos: the stretches of words, both ends included, that windows of items cover."""
    words = stored_small(item_words(items))
    vocabulary = words.select(F.explode("words").alias("word")).distinct()
    plan = stored_small(anchored(words, stored_small(word_counts(docs, vocabulary)), n))
    anchor_words = stored_small(plan.select(F.explode(F.transform(F.array_distinct(F.flatten("windows")), lambda p: F.element_at("words", p + 1))).alias("word")).distinct())
    begins = stored(beginnings(store_postings(docs, anchor_words), plan))
    places = plan.select("item_id", F.xxhash64("words").alias("words_key"), F.posexplode("words").alias("place", "word"))
    expected = begins.join(places, ["item_id", "words_key"]).withColumn("pos", F.col("first") + F.col("place")).where("pos >= 0")
    marks = begins.select(F.col("mark").alias("_mark")).distinct()
    concerned = docs.join(limited(marks, BROADCAST_WORDS), mark_of(F.col("text")) == F.col("_mark"), "left_semi")
    met = expected.join(occurrences(concerned), ["mark", "pos", "word"], "left_semi")
    begin = ["mark", "item_id", "words_key", "n", "first"]
    runs = met.withColumn("run", F.col("place") - F.row_number().over(W.Window.partitionBy(*begin).orderBy("place")))
    runs = runs.groupBy(*begin, "run").agg(F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos")).where(F.col("to_pos") - F.col("from_pos") + 1 >= F.col("n"))
    return runs.select("mark", "item_id", "from_pos", "to_pos").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """One row per document: its words, those that are hit, the items hit, and whether any is."""
    docs = id_text(docs)
    hits = stored_small(phrase_hits(docs, items, n))
    found = hits.groupBy("mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = hits.select("mark", F.explode(F.sequence("from_pos", "to_pos")).alias("pos")).distinct().groupBy("mark").agg(F.count("*").alias("n_hit"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    by_text = stored_small(hit.join(found, "mark").select(F.col("mark").alias("_mark"), "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256")))
    rows = docs.select("doc_id", mark_of(F.col("text")).alias("mark"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(limited(by_text, BROADCAST_WORDS), F.col("mark") == F.col("_mark"), "left")
    none = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contaminated_marks(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """mark: hashes of the texts in which windows of items occur."""
    return phrase_hits(id_text(docs), items, n).select("mark").distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, distance: int) -> DataFrame:
    """item_id, mark (of the text), pos: occurrences of an item's rarest word with all its other words at most ``distance`` words away.

    Postings are joined by text and stretch of ``distance`` words, so a long document isn't joined with itself.
    """
    docs = id_text(docs)
    words = stored_small(item_words(items))
    terms = words.select("item_id", F.xxhash64("words").alias("words_key"), F.size(F.array_distinct("words")).alias("n_terms"), F.explode(F.array_distinct("words")).alias("word"))
    vocabulary = terms.select("word").distinct()
    counts = stored_small(word_counts(docs, vocabulary))
    by_item = W.Window.partitionBy("item_id", "words_key")
    ranked = terms.join(counts, "word", "left").withColumn("k", F.row_number().over(by_item.orderBy(F.col("n").asc_nulls_first(), "word")))
    possible = ranked.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(by_item)).where("least > 0")
    step = max(1, distance)
    hits = store_postings(docs, vocabulary).distinct().join(possible, "word").withColumn("stretch", F.floor(F.col("pos") / step))
    rarest = hits.where("k = 1").select("item_id", "words_key", "mark", F.col("pos").alias("at"), "n_terms", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    near = rarest.join(hits.select("item_id", "words_key", "mark", "stretch", "pos", "word"), ["item_id", "words_key", "mark", "stretch"]).where(F.abs(F.col("pos") - F.col("at")) <= distance)
    return near.groupBy("item_id", "words_key", "mark", "at", "n_terms").agg(F.count_distinct("word").alias("n")).where("n = n_terms").select("item_id", "mark", F.col("at").alias("pos")).distinct()


#: The same result in DuckDB's SQL: all windows of all documents against those of the items.
ORACLE = r"""
WITH doc_word_lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item_lists AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM item_lists WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS i FROM doc_word_lists, sizes)
), hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows w ON p.n = w.n AND p.phrase = w.phrase),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_word_lists d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
