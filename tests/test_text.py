import pytest
from pyspark.sql import functions as F

from sparkgrove.functions import globs, text, trigrams
from sparkgrove.operators import index


@pytest.mark.parametrize(("content", "want"), [("a\n", ["a"]), ("a\n\n", ["a", ""]), ("", []), ("a\r\nb\r", ["a", "b\r"]), ("a\r\r\nb", ["a\r", "b"]), ("\n", [""]), ("x", ["x"])])
def test_lines(spark, content, want):
    assert spark.createDataFrame([(content,)], "c string").select(text.lines_of(F.col("c"))).first()[0] == want


def test_trigrams(spark):
    assert [trigrams.shown(t) for t in trigrams.extract(b"foobar")] == ["foo", "oob", "oba", "bar"]
    assert trigrams.extract(b"") == trigrams.extract(b"ab") == [] and len(trigrams.extract_unique(b"aaaa")) == 1
    assert trigrams.unpack(trigrams.pack(1, 2, 255)) == (1, 2, 255) and trigrams.shown(trigrams.pack(32, 7, 97)) == " \\x07a"
    rows = ["foobar", "", "ab", "日本", "aaaa"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, c string")
    grams = index.postings(df.select(F.lit("r").alias("repo"), F.col("k").cast("string").alias("path"), F.encode("c", "UTF-8").alias("content"))).collect()
    for k, x in enumerate(rows):
        assert sorted(r.tri for r in grams if r.path == str(k)) == sorted(set(trigrams.extract(x.encode())))
    assert all(r.raw and r.folded for r in grams)


def test_binary_and_utf8(spark):
    rows = [(1, b"a" * 8191 + b"\0"), (2, b"a" * 8192 + b"\0"), (3, b"\xff\xfe text"), (4, "é".encode()), (5, b"")]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "k int, c binary")
    assert [r.b for r in df.orderBy("k").select(text.is_binary(F.col("c")).alias("b")).collect()] == [True, False, False, False, False]
    assert [r.t for r in df.orderBy("k").select(text.decoded(F.col("c")).alias("t")).collect()][2:] == [None, "é", ""]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("*.rs", "src/main.rs", True), ("*.rs", "a.rsx", False), ("a?c", "a/c", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True),
        ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[]]x", "]x", True), ("A*", "a", False), ("a.b+(c)", "a.b+(c)", True), ("a.b", "axb", False), ("x", "x\n", False), ("[a-]", "-", True),
    ],
)
def test_globs(spark, glob, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(globs.matches_glob(F.col("p"), glob)).first()[0] is want


@pytest.mark.parametrize("glob", ["a**b", "***", "[abc", "a/**b"])
def test_bad_globs(glob):
    with pytest.raises(globs.GlobError):
        globs.glob_to_regex(glob)


def test_ranges(spark):
    df = spark.createDataFrame([("αβγ tetsa δε tetsa",), ("😀a.b😀a.b",), ("none",)], "l string")
    of = lambda c: [[tuple(x) for x in r[0]] for r in df.select(c).collect()]
    assert of(text.literal_ranges(F.col("l"), "tetsa")) == [[(4, 9), (13, 18)], [], []]
    assert of(text.literal_ranges(F.col("l"), "a.b")) == [[], [(1, 4), (5, 8)], []]
    assert of(text.regex_ranges(F.col("l"), "(?dU)\\w\\.b")) == [[], [(1, 4), (5, 8)], []]


def test_web_urls_and_html(spark):
    urls = ["git@github.com:a/b.git", "ssh://git@h.org:22/a/b.git", "https://h.org/a.git", "https://h.org/a"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.web_url(F.col("u"))).collect()] == ["https://github.com/a/b", "https://h.org/a/b", "https://h.org/a", "https://h.org/a"]
    row = spark.sql("SELECT '😀<b>&x' AS l, array(named_struct('start', 1, 'end', 4)) AS r")
    assert row.select(text.highlighted(F.col("l"), F.col("r"))).first()[0] == "😀<mark>&lt;b&gt;</mark>&amp;x"
