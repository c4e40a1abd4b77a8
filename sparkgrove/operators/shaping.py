"""Results: totals, limits, blocks of lines with context, and nested answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.functions.text import decoded, lines_of

CONTEXT = 2
FILE = ["repo", "path"]


def file_matches(matched: DataFrame) -> DataFrame:
    """repo, path, match_count: occurrences in each file."""
    return matched.groupBy(*FILE).agg(F.sum(F.size("match_ranges")).alias("match_count"))


def repo_totals(files: DataFrame) -> DataFrame:
    """repo, total_file_count, total_match_count from file_matches, before any limit."""
    return files.groupBy("repo").agg(F.count("*").alias("total_file_count"), F.sum("match_count").alias("total_match_count"))


def grand_totals(totals: DataFrame, limit: int) -> DataFrame:
    """total_files, total_matches and whether any repo has more files than the limit."""
    return totals.agg(
        F.coalesce(F.sum("total_file_count"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("total_match_count"), F.lit(0)).alias("total_matches"),
        F.coalesce(F.bool_or(F.col("total_file_count") > limit), F.lit(False)).alias("truncated"),
    )


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first files of each repo by path, ``limit`` at most."""
    order = W.Window.partitionBy("repo").orderBy("path")
    return files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def with_blocks(matched: DataFrame, context: int = CONTEXT) -> DataFrame:
    """matched with block: the number, from 1, of the stretch of the file it is shown in.

    With context lines around them, two matches are shown in one block if at most 2 * context + 1 lines lie from one to
    the other.
    """
    order = W.Window.partitionBy(*FILE).orderBy("line_number")
    far = F.col("line_number") - F.lag("line_number").over(order) > 2 * context + 1
    return matched.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("block", F.sum("far").over(order).cast("int")).drop("far")


def context_blocks(matched: DataFrame, line_counts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """repo, path, block, first_line, last_line, n_matching. line_counts: repo, path, n_lines."""
    ends = with_blocks(matched, context).groupBy(*FILE, "block").agg(F.min("line_number").alias("low"), F.max("line_number").alias("high"), F.count("*").alias("n_matching"))
    return ends.join(line_counts, FILE).select(*FILE, "block", F.greatest(F.lit(1), F.col("low") - context).alias("first_line"), F.least("n_lines", F.col("high") + context).alias("last_line"), "n_matching")


def line_counts(texts: DataFrame) -> DataFrame:
    return texts.select(*FILE, F.size(lines_of(F.col("text"))).alias("n_lines"))


def context_lines(texts: DataFrame, matched: DataFrame, context: int = CONTEXT) -> DataFrame:
    """repo, path, block, line_number, line, match_ranges: every line of every block; context lines have no ranges.

    Blocks are made of matches, so that only files with matches meet their texts again.
    """
    blocks = with_blocks(matched, context).groupBy(*FILE, "block").agg(F.min("line_number").alias("low"), F.max("line_number").alias("high"), F.map_from_entries(F.collect_list(F.struct("line_number", "match_ranges"))).alias("found"))
    split = texts.select(*FILE, lines_of(F.col("text")).alias("lines"))
    joined = blocks.join(split, FILE)
    numbers = F.sequence(F.greatest(F.lit(1), F.col("low") - context), F.least(F.size("lines"), F.col("high") + context))
    rows = joined.select(*FILE, "block", "found", "lines", F.explode(numbers).alias("line_number"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(*FILE, "block", "line_number", F.element_at("lines", F.col("line_number")).alias("line"), F.coalesce(F.try_element_at("found", F.col("line_number")), none).alias("match_ranges"))


def nested(context: DataFrame, files: DataFrame, totals: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """One row per repo: url, git_ref, files (path, match_count, blocks of lines), totals.

    files are those shown with blocks; totals count all. repos: repo, url, ref and resolved_ref, all but the first optional.
    """
    by_block = context.groupBy(*FILE, "block").agg(F.array_sort(F.collect_list(F.struct("line_number", "line", "match_ranges"))).alias("lines"))
    by_file = by_block.groupBy(*FILE).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "lines"))), lambda b: F.struct(b["lines"].alias("lines"))).alias("blocks"))
    shown = files.join(by_file, FILE).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "match_count", "blocks"))).alias("files"))
    out = totals.join(shown, "repo", "left")
    if repos is None:
        out = out.withColumn("url", F.lit(None).cast("string")).withColumn("git_ref", F.lit(None).cast("string"))
    else:
        own = {c: F.col(c) if c in repos.columns else F.lit(None).cast("string") for c in ("url", "ref", "resolved_ref")}
        out = out.join(repos.select("repo", own["url"].alias("url"), F.coalesce(own["ref"], own["resolved_ref"]).alias("git_ref")), "repo", "left")
    empty = F.array().cast(shown.schema["files"].dataType)
    return out.select("repo", "url", "git_ref", F.coalesce("files", empty).alias("files"), "total_file_count", "total_match_count")


def health(info: DataFrame) -> DataFrame:
    """status (ready with at least one repo), repos_indexed, total_docs from index.repo_info."""
    return info.agg(F.when(F.count("*") > 0, "ready").otherwise("no_repos").alias("status"), F.count("*").alias("repos_indexed"), F.coalesce(F.sum("doc_count"), F.lit(0)).alias("total_docs"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))


#: What is said of a failure, so that no details of addresses or credentials get out.
FAILURES = ("authentication failed", "repository or ref not found", "indexing failed")


def sanitized(status: DataFrame) -> DataFrame:
    """status (repo, status, error) with errors as one of three fixed messages."""
    said = F.when(F.contains(F.col("error"), F.lit("auth")), FAILURES[0]).when(F.contains(F.col("error"), F.lit("not found")), FAILURES[1]).otherwise(FAILURES[2])
    return status.withColumn("error", F.when(F.col("status") == "failed", said))


def utf8_texts(files: DataFrame) -> DataFrame:
    return files.select(*FILE, decoded(F.col("content")).alias("text")).where(F.col("text").isNotNull())
