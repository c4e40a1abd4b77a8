"""Refreshing an index from snapshots: what changed, what is kept, what goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrove.sources.corpora import ingest, manifest
from sparkgrove.sources.store import KEY, SCHEMAS, Store

#: A written layer, its repo and change token.
Prepared = tuple[str, dict[str, int]]


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, path, change: reused, changed, new or deleted."""
    both = old.select(*KEY, F.col("oid").alias("old_oid")).join(new.select(*KEY, F.col("oid").alias("new_oid")), KEY, "full_outer")
    change = F.when(F.col("old_oid").isNull(), "new").when(F.col("new_oid").isNull(), "deleted").when(F.col("old_oid") == F.col("new_oid"), "reused").otherwise("changed")
    return both.select(*KEY, change.alias("change"))


def orphans(stored_repos: DataFrame, configured: DataFrame) -> DataFrame:
    """Stored repos that aren't configured any more, by their full names."""
    return stored_repos.select("repo").distinct().join(configured.select("repo"), "repo", "left_anti")


def prepare(store: Store, fresh: DataFrame, read: Callable[[DataFrame], DataFrame], repo: str | None = None) -> Prepared | None:
    """Write a layer that brings the store (or one repo in it) to the manifest ``fresh``; None if nothing changed.

    read gives the files (repo, path, content, already filtered) of the keys it is given; only new and changed ones are
    asked for, and postings made for them alone.
    """
    if store.current() is None:
        known = store.spark.createDataFrame([], SCHEMAS["manifest"])
    else:
        known = store.table("manifest")
        known = known if repo is None else known.where(F.col("repo") == repo)
    diff = manifest_diff(known, fresh).where("change <> 'reused'").persist()
    try:
        if not diff.limit(1).count():
            return None
        wanted = diff.where("change IN ('changed', 'new')").select(*KEY)
        gone = diff.where("change IN ('changed', 'deleted')").select(*KEY)
        return store.layer(read(wanted), gone, fresh.join(wanted, KEY, "left_semi"))
    finally:
        diff.unpersist()


def refresh(store: Store, files: DataFrame) -> tuple[str | None, bool]:
    """Bring the store to the files given (already filtered). Returns the version in force and whether it is a new one.

    If nothing changed nothing is written.
    """
    old = store.current()
    if old is None:
        return store.write(files), True
    prepared = prepare(store, manifest(files), lambda keys: files.join(keys, KEY, "left_semi"))
    return (old, False) if prepared is None else (store.append([prepared]), True)


def prepare_repo(store: Store, repo: str, source, max_file_size: int, excludes: list[str] | None) -> tuple[Prepared | None, str | None]:
    """A layer for what changed in a repo, or None, and the repo's new change token.

    source is a function that gives all its files (repo, path, content), or an object with token(), manifest(spark) and
    files(spark, keys), of which nothing but the token is read while that stays, and then only files whose oid changed.
    """
    mine = F.col("repo") == repo
    filtered = lambda files: ingest(files, max_file_size, excludes).where(mine)
    if not hasattr(source, "token"):
        files = filtered(source())
        return prepare(store, manifest(files), lambda keys: files.join(keys, KEY, "left_semi"), repo), None
    token = source.token()
    if token is not None and store.tokens().get(repo) == token:
        return None, token
    return prepare(store, source.manifest(store.spark, max_file_size).where(mine), lambda keys: filtered(source.files(store.spark, max_file_size, keys)), repo), token


def drop_orphans(store: Store, configured: list[str]) -> bool:
    """Take repos that aren't configured out of the store, if there are any."""
    if store.current() is None:
        return False
    gone = store.table("manifest").where(~F.col("repo").isin(configured)).select(*KEY)
    if not gone.limit(1).count():
        return False
    none = store.spark.createDataFrame([], SCHEMAS["files"])
    store.append([store.layer(none, gone)])
    return True
