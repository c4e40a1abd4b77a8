"""Column functions over file contents: lines, sizes, encodings, occurrences and web links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file is binary if a zero byte stands in so many bytes at its beginning.
BINARY_PROBE = 8192


def lines_of(content: Column) -> Column:
    """Lines without their ends: LF or CR LF ends a line, an end at the end of the text begins no further line."""
    parts = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_binary(content: Column, probe: int = BINARY_PROBE) -> Column:
    return F.contains(F.substring(content, 1, probe), F.lit(b"\0"))


def decoded(content: Column) -> Column:
    """The text of UTF-8 bytes; null where they aren't valid."""
    return F.try_validate_utf8(content.cast("string"))


def content_key(content: Column) -> Column:
    """A key that changes with the content."""
    return F.sha1(content)


def literal_ranges(line: Column, literal: str) -> Column:
    """Half-open ranges, in code points, of a literal's non-overlapping occurrences from the left."""
    return _ranges(F.split(line, java_quote(literal), -1), F.lit(len(literal)), None)


def regex_ranges(line: Column, java_pattern: str) -> Column:
    """The same for the matches of a pattern of the Java dialect that is never empty."""
    return _ranges(F.split(line, java_pattern, -1), None, F.regexp_extract_all(line, F.lit(java_pattern), F.lit(0)))


def _ranges(gaps: Column, size: Column | None, matches: Column | None) -> Column:
    """From the stretches between matches and the matches' sizes."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    pieces = F.slice(gaps, 1, F.size(gaps) - 1) if matches is None else F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), matches.alias("match"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.char_length(piece if matches is None else piece["gap"])
        end = begin + (size if matches is None else F.char_length(piece["match"]))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pieces, start, step)["out"]


def java_quote(literal: str) -> str:
    """A pattern of the Java dialect that matches just the literal."""
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}#&-~ " else c for c in literal)


def occurrences(line: Column, literal: str) -> Column:
    """How often a literal stands in a line, without overlaps."""
    return ((F.char_length(line) - F.char_length(F.replace(line, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def web_url(url: Column) -> Column:
    """A repository's web page from the address it is cloned from: scp-like and ssh addresses become https, .git goes."""
    plain = F.regexp_replace(url, r"\.git$", "")
    scp = F.regexp_replace(plain, r"^[\w.-]+@([^:/]+):(.+)$", "https://$1/$2")
    return F.regexp_replace(scp, r"^ssh://(?:[^@/]+@)?([^:/]+)(?::\d+)?/", "https://$1/")


def html_escaped(text: Column) -> Column:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def highlighted(line: Column, ranges: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The line as HTML with its ranges, which count code points, marked."""
    starts = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["end"]))
    ends = F.concat(F.transform(ranges, lambda r: r["start"]), F.array(F.char_length(line)))
    plain = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: html_escaped(F.substring(line, p["a"] + 1, p["b"] - p["a"])))
    marked = F.transform(ranges, lambda r: F.concat(F.lit(before), html_escaped(F.substring(line, r["start"] + 1, r["end"] - r["start"])), F.lit(after)))
    both = F.arrays_zip(plain.alias("p"), F.concat(marked, F.array(F.lit(""))).alias("m"))
    return F.array_join(F.transform(both, lambda x: F.concat(x["p"], x["m"])), "")
