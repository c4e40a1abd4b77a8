"""python -m sparkgrove --config FILE [--watch | --query TEXT ...]: refresh the index of the configured repositories, once or
at intervals, or search it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sparkgrove.config import Config, load
from sparkgrove.engine import ResultCache, SearchEngine
from sparkgrove.sources.git import GitSource
from sparkgrove.sources.store import Store


def make_engine(spark: SparkSession, config: Config) -> SearchEngine:
    details = spark.createDataFrame([(r.name, r.url, r.ref) for r in config.repos], "repo string, url string, ref string") if config.repos else None
    return SearchEngine(spark, Store(spark, f"{config.indexer.data_dir}/indexes"), details, config.server.max_search_results, ResultCache(config.cache.max_entries, config.cache.ttl_secs), config.indexer.poll_interval_secs)


def refresh(spark: SparkSession, engine: SearchEngine, config: Config, cycles: int | None = 1) -> int:
    """Run cycles at the configured interval (None: without end); how many changed the index."""
    i = config.indexer
    sources = {r.name: GitSource(r, f"{i.data_dir}/repos", i.index_timeout_secs) for r in config.repos}
    return engine.watch(sources, i.poll_interval_secs, cycles, workers=i.max_concurrent_indexers, seconds=i.index_timeout_secs, max_file_size=i.max_file_size, excludes=i.exclude_patterns)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sparkgrove", description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--query")
    p.add_argument("--watch", action="store_true")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--ignore-case", action="store_true")
    p.add_argument("--repos")
    p.add_argument("--files")
    p.add_argument("--max", type=int, default=0)
    a = p.parse_args(args)
    config = load(a.config)
    spark = SparkSession.builder.appName("sparkgrove").getOrCreate()
    engine = make_engine(spark, config)
    out = {"changed": bool(refresh(spark, engine, config, None if a.watch else 1))} if a.query is None else engine.search(a.query, a.regex, a.ignore_case, a.repos, a.files, a.max)
    print(json.dumps(out, ensure_ascii=False))


if __name__ == "__main__":
    main()
