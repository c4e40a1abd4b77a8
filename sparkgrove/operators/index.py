"""The trigram index: postings of files, and the files that have what a plan needs.

Postings have a row for each trigram of each file, so counting a file's rows counts its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.plans.planner import SearchPlan
from sparkgrove.plans.regex import Formula


BATCH, BATCH_FILES = "spark.sql.execution.arrow.maxRecordsPerBatch", 500
POSTINGS = "repo string, path string, tri int, raw boolean, folded boolean"
LISTS = "block long, tri int, files array<smallint>"
#: Files of a block, as a power of two; with two bits for raw and folded an entry has 15 bits.
BLOCK_BITS = 13
#: A worker makes lists when so many trigrams of files have come together.
LIST_GRAMS = 4_000_000


def postings(files: DataFrame) -> DataFrame:
    """repo, path, tri, raw, folded: each distinct trigram of each file; raw: of its bytes, folded: of its lower-cased text.

    A row needs no other row, so there is no shuffle. The lower case is Spark's own, as in matching; the windows over the
    bytes are taken by array operations on Arrow batches.
    """
    return _with_low(files, "repo", "path").mapInArrow(_postings_of(), POSTINGS)


def _with_low(files: DataFrame, *keys: str) -> DataFrame:
    """keys, content and its lower case (low), of which each text has one made."""
    conf = files.sparkSession.conf
    if not 0 < int(conf.get(BATCH, "0")) <= BATCH_FILES:
        conf.set(BATCH, BATCH_FILES)  # so that large files don't add up in a worker
    return files.select(*keys, "content", F.lower(F.col("content").cast("string")).cast("binary").alias("low"))


def _postings_of():
    """The task's function; it is sent as it is, so that executors needn't have this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def windows(data):
            """The distinct 3-byte windows, ascending."""
            a = np.frombuffer(data, np.uint8).astype(np.int32)
            return np.unique(a[:-2] << 16 | a[1:-1] << 8 | a[2:]) if len(a) > 2 else a[:0]

        def of(batch):
            grams, raws, folds, sizes = [], [], [], []
            for content, low in zip(batch.column("content").to_pylist(), batch.column("low").to_pylist(), strict=True):
                own = both = windows(content or b"")
                raw = folded = np.ones(len(own), bool)
                if low != content:
                    other = windows(low)
                    both = np.union1d(own, other)
                    raw, folded = np.isin(both, own, assume_unique=True), np.isin(both, other, assume_unique=True)
                for column, value in zip((grams, raws, folds, sizes), (both, raw, folded, len(both)), strict=True):
                    column.append(value)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            columns = [batch.column("repo").take(owner), batch.column("path").take(owner), pa.array(np.concatenate(grams), pa.int32()), pa.array(np.concatenate(raws)), pa.array(np.concatenate(folds))]
            return pa.RecordBatch.from_arrays(columns, names=["repo", "path", "tri", "raw", "folded"])

        for batch in batches:
            if batch.num_rows:
                yield of(batch)

    return run


def posting_lists(files: DataFrame) -> DataFrame:
    """block, tri, files: the same postings, with the files of a block that have a trigram in one row (or a few).

    files: id, content. An id's low BLOCK_BITS bits number the file in its block, the others name the block. In a list each
    file is its number, then a bit for raw and one for folded. ``unlisted`` gives the postings back.
    """
    return _with_low(files, "id").mapInArrow(_lists_of(BLOCK_BITS, LIST_GRAMS), LISTS)


def _lists_of(bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def windows(data):
            a = np.frombuffer(data, np.uint8).astype(np.int32)
            return np.unique(a[:-2] << 16 | a[1:-1] << 8 | a[2:]).astype(np.int64) if len(a) > 2 else np.empty(0, np.int64)

        def of(block, kept):
            """Sorted by trigram and file; what stands twice, as raw and as folded, becomes one entry with both bits."""
            x = np.sort(np.concatenate(kept))
            key = x >> 2
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            entries = (key[first] & (1 << bits) - 1) << 2 | np.bitwise_or.reduceat(x & 3, first)
            tri = key[first] >> bits
            start = np.flatnonzero(np.r_[True, tri[1:] != tri[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(tri)], pa.int32()), pa.array(entries, pa.int16()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), block), pa.int64()), pa.array(tri[start], pa.int32()), lists], names=["block", "tri", "files"])

        block, kept, n = None, [], 0
        for batch in batches:
            for number, content, low in zip(*(batch.column(c) for c in ("id", "content", "low")), strict=True):
                number, content, low = number.as_py(), content.as_py(), low.as_py()
                if n and (number >> bits != block or n >= most):
                    yield of(block, kept)
                    kept, n = [], 0
                block, at = number >> bits, (number & (1 << bits) - 1) << 2
                for data, flags in ((content or b"", 3),) if low == content else ((content or b"", 2), (low, 1)):
                    grams = windows(data)
                    kept.append(grams << bits + 2 | at | flags)
                    n += len(grams)
        if n:
            yield of(block, kept)

    return run


def unlisted(lists: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """postings from posting_lists and the names of each block: an array of (repo, path) by the file's number, null for those to leave out.

    Lists meet names a block at a time and are taken apart only then, so that no posting is shuffled.
    """
    each = lists.join(names, on).select("names", "tri", F.explode("files").alias("entry"))
    found = each.select(F.get("names", F.shiftright("entry", 2)).alias("file"), "tri", (F.col("entry").bitwiseAND(2) != 0).alias("raw"), (F.col("entry").bitwiseAND(1) != 0).alias("folded"))
    return found.where("file IS NOT NULL").select("file.repo", "file.path", "tri", "raw", "folded")


def repo_info(files: DataFrame, index: DataFrame) -> DataFrame:
    """repo, doc_count, trigram_count."""
    docs = files.groupBy("repo").agg(F.count("*").alias("doc_count"))
    grams = index.where("raw").groupBy("repo").agg(F.count_distinct("tri").alias("trigram_count"))
    return docs.join(grams, "repo", "left").select("repo", "doc_count", F.coalesce("trigram_count", F.lit(0)).alias("trigram_count"))


def document_frequency(index: DataFrame) -> DataFrame:
    """repo, tri, df of the trigrams of raw bytes."""
    return index.where("raw").groupBy("repo", "tri").agg(F.count("*").alias("df"))


def _all_trigrams(needs: Formula) -> set[int]:
    return set(needs.need).union(*(_all_trigrams(f) for branch in needs.either for f in branch), set())


def _holds(needs: Formula, found: Column) -> Column:
    """Whether a set of trigrams satisfies the formula."""
    tests = [F.size(F.array_except(F.array(*map(F.lit, sorted(needs.need))), found)) == 0] if needs.need else []
    tests += [reduce(lambda x, y: x | y, (_holds(f, found) for f in branch)) for branch in needs.either]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def candidates(index: DataFrame, plan: SearchPlan) -> DataFrame:
    """repo, path of files that may match: division of the postings by the plan's trigrams.

    The filter on tri reaches the scan of a stored index, which is sorted by it; only the wanted lists are grouped.
    """
    wanted = sorted(_all_trigrams(plan.needs))
    lists = index.where(F.col("folded" if plan.lowered else "raw") & F.col("tri").isin(wanted))
    if not plan.needs.either:
        return lists.groupBy("repo", "path").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("repo", "path")
    return lists.groupBy("repo", "path").agg(F.collect_set("tri").alias("found")).where(_holds(plan.needs, F.col("found"))).select("repo", "path")


def with_all_trigrams(index: DataFrame, trigrams: list[int]) -> DataFrame:
    """repo, path of files that have all of the trigrams; none if the list is empty."""
    lists = index.where(F.col("raw") & F.col("tri").isin(sorted(set(trigrams)))) if trigrams else index.where("false")
    return lists.groupBy("repo", "path").agg(F.count("*").alias("n")).where(F.col("n") == len(set(trigrams))).select("repo", "path")


def candidate_files(files: DataFrame, index: DataFrame, plan: SearchPlan) -> DataFrame:
    """The files themselves. The side of candidates is broadcast by Spark if it turns out to be small."""
    return files.join(candidates(index, plan), ["repo", "path"], "left_semi") if plan.can_use_index else files
