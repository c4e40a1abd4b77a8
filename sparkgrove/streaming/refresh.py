"""Keeping an index up to date from a stream of file versions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StreamingQuery

from sparkgrove.functions.text import content_key
from sparkgrove.sources.corpora import ingest, manifest
from sparkgrove.sources.store import KEY, Store

FILE_VERSIONS = "repo string, path string, content binary, version long"


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each file; null content deletes it."""
    order = W.Window.partitionBy("repo", "path").orderBy(F.desc("version"), F.desc("content"))
    return versions.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def differs(store: Store, newest: DataFrame) -> bool:
    """Whether any of these versions has other content than what is stored for its file."""
    stored = store.table("manifest").select(*KEY, F.col("oid").alias("_stored")).join(newest.select(*KEY), KEY, "left_semi")
    own = newest.select(*KEY, F.when(F.col("content").isNotNull(), content_key(F.col("content"))).alias("_own"))
    return bool(own.join(stored, KEY, "left").where(~F.col("_own").eqNullSafe(F.col("_stored"))).limit(1).count())


def apply_batch(store: Store, batch: DataFrame) -> bool:
    """Put a batch of file versions over what is stored, as a layer of its own.

    Versions are stored, those of deleted files too; one that isn't newer than what is stored for its file changes nothing,
    in whatever batch it comes. Returns whether any file did change; a newer version may have the content of the one before.
    """
    newest = latest(batch)
    if store.current() is not None:
        known = store.table("manifest").select(*KEY, "version").unionByName(store.table("gone").select(*KEY, "version")).where("version IS NOT NULL")
        known = known.join(newest.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.max("version").alias("_known"))
        newest = newest.join(known, KEY, "left").where(F.col("_known").isNull() | (F.col("version") > F.col("_known"))).drop("_known")
    newest = newest.persist()
    try:
        if not newest.limit(1).count():
            return False
        files = ingest(newest.where(F.col("content").isNotNull()))
        rows = manifest(newest.where(F.col("content").isNotNull())).join(newest.select(*KEY, "version"), KEY)
        changes = store.current() is None or differs(store, newest)
        store.append([store.layer(files, newest.select(*KEY, "version"), rows)])
        return changes
    finally:
        newest.unpersist()


def start(versions: DataFrame, store: Store, checkpoint: str, interval: str | None = None, after: Callable[[], None] | None = None) -> StreamingQuery:
    """Apply a stream of file versions in micro-batches: every interval, or (None) all that is there, then end.

    after is called after each batch that changed something, for caches. A batch that is run again after a failure gives
    the same files and so changes nothing.
    """

    def each(batch: DataFrame, _: int) -> None:
        if apply_batch(store, batch) and after:
            after()

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return versions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Heartbeat:
    """Tells whether refreshing goes on: stale after two intervals and half a minute without a beat."""

    def __init__(self, interval: float):
        self.interval, self.last = interval, None

    def beat(self) -> None:
        self.last = time.monotonic()

    def status(self) -> str:
        if self.last is None:
            return "starting"
        return "stale" if time.monotonic() - self.last > 2 * self.interval + 30 else "ok"
