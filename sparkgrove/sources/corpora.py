"""Corpora as tables of files: repo, path and content (bytes), and optionally mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions.globs import matches_any
from sparkgrove.functions.text import content_key, decoded, is_binary

MAX_FILE_SIZE = 1 << 20
SYMLINK = 0o120000


def in_memory(spark: SparkSession, files: list[tuple[str, str, bytes]]) -> DataFrame:
    """Files given as (repo, path, content)."""
    return spark.createDataFrame([(r, p, bytearray(c)) for r, p, c in files], "repo string, path string, content binary")


def folder(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """All files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.regexp_replace(F.col("path"), "^.*?" + path.strip("/").replace(".", "\\.") + "/", "")
    return files.select(F.lit(repo).alias("repo"), relative.alias("path"), "content")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table: a repo for each source, a folder for each language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("source").alias("repo"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table: a repo for each host."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("repo"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table: a repo for each role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    return c.select(F.col("role").alias("repo"), path.alias("path"), F.col("text").cast("binary").alias("content"))


def ingest(files: DataFrame, max_file_size: int = MAX_FILE_SIZE, excludes: list[str] | None = None) -> DataFrame:
    """Files that are indexed: no symlinks, none that an exclude matches, none over the size, none with zero bytes early on."""
    if "mode" in files.columns:
        files = files.where(F.col("mode").isNull() | (F.col("mode") != SYMLINK))
    if excludes:
        files = files.where(~matches_any(F.col("path"), excludes))
    return files.where((F.octet_length("content") <= max_file_size) & ~is_binary(F.col("content"))).select("repo", "path", "content")


def with_text(files: DataFrame) -> DataFrame:
    """repo, path, text of files whose content is UTF-8."""
    return files.select("repo", "path", decoded(F.col("content")).alias("text")).where(F.col("text").isNotNull())


def manifest(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """repo, path and a key of the content."""
    if excludes:
        files = files.where(~matches_any(F.col("path"), excludes))
    return files.select("repo", "path", content_key(F.col("content")).alias("oid"))
