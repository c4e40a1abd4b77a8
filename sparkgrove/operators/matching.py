"""Matches of a plan in the lines of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.functions.globs import matches_glob
from sparkgrove.functions.text import lines_of, literal_ranges, regex_ranges
from sparkgrove.plans.planner import SearchPlan
from sparkgrove.plans.regex import for_python

#: At most so many matching lines of a file count.
LINE_CAP = 1000


def lines(texts: DataFrame) -> DataFrame:
    """repo, path, line_number (from 1), line."""
    rows = texts.select("repo", "path", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return rows.select("repo", "path", (F.col("pos") + 1).alias("line_number"), "line")


def by_path(files: DataFrame, glob: str | None) -> DataFrame:
    return files if glob is None else files.where(matches_glob(F.col("path"), glob))


def by_repo(files: DataFrame, repos: str | list[str] | None) -> DataFrame:
    """repos: names, or names with commas between; no names at all match nothing."""
    if repos is None:
        return files
    names = [x.strip() for x in repos.split(",")] if isinstance(repos, str) else repos
    return files.where(F.col("repo").isin([x for x in names if x]))


def line_matches(plan: SearchPlan, line: Column) -> Column:
    if plan.is_regex:
        return line.rlike(plan.java)
    return F.contains(F.lower(line) if plan.ignore_case else line, F.lit(plan.pattern))


def match_ranges(plan: SearchPlan, line: Column) -> Column:
    """Without regard to case the ranges are those in the lower-cased line."""
    if plan.is_regex:
        return regex_ranges(line, plan.java)
    return literal_ranges(F.lower(line) if plan.ignore_case else line, plan.pattern)


def can_be_empty(plan: SearchPlan) -> bool:
    """Whether the pattern may match between characters, where ranges can't be told from stretches between matches."""
    return plan.is_regex and not plan.least_width


RANGES = "repo string, path string, line_number int, line string, match_ranges array<struct<start:int,end:int>>"


def matching_lines(texts: DataFrame, plan: SearchPlan, cap: int = LINE_CAP) -> DataFrame:
    """repo, path, line_number, line, match_ranges of the first ``cap`` matching lines of each file.

    The filter stands before the ranges are found, and the texts' lines aren't shuffled unless they match.
    """
    found = lines(texts).where(line_matches(plan, F.col("line")))
    if can_be_empty(plan):
        ranged = found.mapInArrow(_python_ranges(plan), RANGES).where(F.size("match_ranges") > 0)
    else:
        ranged = found.withColumn("match_ranges", match_ranges(plan, F.col("line")))
    first = W.Window.partitionBy("repo", "path").orderBy("line_number")
    return ranged.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= cap).drop("rank")


def _python_ranges(plan: SearchPlan):
    """Ranges of patterns that may match nothing, by Arrow batches. An empty match beside the match before isn't one."""
    pattern = for_python(plan.java, plan.ignore_case)

    def of(line: str) -> list[dict]:
        out, last = [], -1
        for m in pattern.finditer(line):
            if m.end() > m.start() or m.start() != last:
                out.append({"start": m.start(), "end": m.end()})
            last = m.end()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([of(x) for x in batch.column("line").to_pylist()], kind)], names=[*batch.schema.names, "match_ranges"])

    return run
