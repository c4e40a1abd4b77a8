"""Stored snapshots in layers, with a pointer to the version in force.

A layer is a folder with files, their postings and manifest, and the keys that it takes out of the layers before it. A
version names its layers in order, so a change of a few files writes a small layer and nothing else. A layer is written
beside the others and the pointer is moved only when it is whole, so readers see one version or the other. After
``MOST_LAYERS`` layers all are written anew as one; layers that the last ``KEEP`` versions don't name are deleted.

Postings are stored as lists of the numbers that a layer's files have in blocks, and given as rows. The lists are dealt out
by ranges of trigrams and lie sorted by them, so that a lookup reads few files and row groups.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkgrove.operators.index import BLOCK_BITS, LISTS, posting_lists, unlisted
from sparkgrove.sources.corpora import manifest

FORMAT_VERSION = 3
MOST_LAYERS = 12
KEEP = 2
#: Keys that later layers take out are sent to all executors up to this number.
BROADCAST_KEYS = 1_000_000
KEY = ["repo", "path"]
SCHEMAS = {
    "files": "repo string, path string, content binary",
    "postings": "repo string, path string, tri int, raw boolean, folded boolean",
    "manifest": "repo string, path string, oid string, version long",
    "gone": "repo string, path string, version long",
}
#: As written: files have numbers within their layer, postings are lists of these.
WRITTEN = SCHEMAS | {"files": SCHEMAS["files"] + ", id long", "postings": LISTS}
#: Row groups of files, in bytes, so that postings are made by many tasks however few wrote the files.
FILE_GROUP = 8 << 20
POINTER = "format int, version string, layers array<string>, counts map<string, long>, tokens map<string, string>, at timestamp"


class NotAnIndex(ValueError):
    """There is no index here, or one of another format, or one with rows missing."""


def filled(name: str, layers: list[str], counts: dict[str, int]) -> list[int]:
    """The numbers of the layers with rows in a table; the first if there are none."""
    return [k for k in range(len(layers)) if counts.get(f"{layers[k]}/{name}")] or [0]


class Store:
    """A folder with versions of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- versions

    def _pointers(self) -> list[Row]:
        """The latest versions, newest first. Only a folder that isn't there means that there are none."""
        try:
            rows = self.spark.read.schema(POINTER).json(f"{self.path}/versions")
            return rows.where(F.col("format") == FORMAT_VERSION).orderBy(F.desc("at"), F.desc("version")).limit(KEEP).collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def pointer(self, version: str | None = None) -> Row | None:
        found = [r for r in self._pointers() if version in (None, r.version)]
        return found[0] if found else None

    def current(self) -> str | None:
        """The version in force; None if there is none of this format. A pointer that can't be read is an error."""
        row = self.pointer()
        return row.version if row else None

    def tokens(self) -> dict[str, str]:
        """The change token of each repo in the version in force, where its source has one."""
        row = self.pointer()
        return dict(row.tokens or {}) if row else {}

    def publish(self, layers: list[str], counts: dict[str, int], tokens: dict[str, str]) -> str:
        """Put these layers in force as a new version; older ones' layers go."""
        version = uuid.uuid4().hex
        one = self.spark.createDataFrame([(FORMAT_VERSION, version, layers, {k: n for k, n in counts.items() if k.split("/")[0] in layers}, tokens)], POINTER.rsplit(",", 1)[0])
        one.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").json(f"{self.path}/versions")
        self._clean()
        return version

    def _clean(self) -> None:
        """Delete what older versions wrote, but not layers that may be in work: those no version has named yet stay."""
        every = self.spark.read.schema(POINTER).json(f"{self.path}/versions").orderBy(F.desc("at"), F.desc("version")).select("layers").collect()
        kept = {x for r in every[:KEEP] for x in r.layers or []}
        self._delete({x for r in every[KEEP:] for x in r.layers or []} - kept)

    def _delete(self, layers: set[str]) -> None:
        for layer in layers:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{layer}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    # ---- reading

    def table(self, name: str, version: str | None = None) -> DataFrame:
        row = self.pointer(version)
        if row is None or not row.layers:
            raise NotAnIndex(self.path)
        return self._layers(name, row.layers, row.counts)

    def _layers(self, name: str, layers: list[str], counts: dict[str, int]) -> DataFrame:
        if name == "postings":
            return self._postings(layers, counts)
        return self._marked(name, layers, counts).where("_live").select(*(x.split()[0] for x in SCHEMAS[name].split(", ")))

    def _read(self, name: str, layers: list[str], numbers: list[int]) -> DataFrame:
        """A table of these layers as written, with each layer's number."""
        return reduce(DataFrame.unionByName, [self.spark.read.schema(WRITTEN[name]).parquet(f"{self.path}/{layers[k]}/{name}").withColumn("_layer", F.lit(k)) for k in numbers])

    def _marked(self, name: str, layers: list[str], counts: dict[str, int]) -> DataFrame:
        """A table of all layers as written, with the layer's number and _live: whether no later layer takes the row out."""
        wanted, gone = filled(name, layers, counts), filled("gone", layers, counts)
        rows, later = self._read(name, layers, wanted), [k for k in gone if k > wanted[0]]
        if name == "gone" or not later:
            return rows.withColumn("_live", F.lit(True))
        dead = self._read("gone", layers, later).groupBy(*KEY).agg(F.max("_layer").alias("_dead"))
        dead = F.broadcast(dead) if sum(counts[f"{layers[k]}/gone"] for k in later) <= BROADCAST_KEYS else dead
        return rows.join(dead, KEY, "left").withColumn("_live", F.col("_dead").isNull() | (F.col("_dead") <= F.col("_layer"))).drop("_dead")

    def _postings(self, layers: list[str], counts: dict[str, int]) -> DataFrame:
        """Rows of the lists. Files that are taken out are so by name, before their postings are made rows."""
        files = self._marked("files", layers, counts).select("_layer", F.shiftright("id", BLOCK_BITS).alias("block"), "id", F.when(F.col("_live"), F.struct(*KEY)).alias("file"))
        by_number = F.transform(F.array_sort(F.collect_list(F.struct("id", "file"))), lambda x: x["file"])  # a block's ids have no gaps
        return unlisted(self._read("postings", layers, filled("postings", layers, counts)), files.groupBy("_layer", "block").agg(by_number.alias("names")), ["_layer", "block"])

    def validate(self, version: str | None = None) -> None:
        """Raise NotAnIndex if a table of a layer has other rows than were written. Counts are read from the files' footers."""
        row = self.pointer(version)
        if row is None:
            raise NotAnIndex(self.path)
        for key, n in (row.counts or {}).items():
            try:
                found = self.spark.read.schema(WRITTEN[key.split("/")[1]]).parquet(f"{self.path}/{key}").count()
            except AnalysisException as e:
                raise NotAnIndex(f"{self.path}/{key}: {e.getCondition()}") from e
            if found != n:
                raise NotAnIndex(f"{self.path}/{key}: {found} rows instead of {n}")

    # ---- writing

    def layer(self, files: DataFrame, gone: DataFrame | None = None, rows: DataFrame | None = None) -> tuple[str, dict[str, int]]:
        """Write a layer that no version names yet: its name and the rows of its tables.

        files: repo, path, content. gone: keys (and version) that are taken out of the layers before. rows: the manifest; if it
        isn't given, that of the files.
        """
        name = uuid.uuid4().hex
        at, counts = f"{self.path}/{name}", {}

        def put(kind: str, df: DataFrame, sort: list[str], **options: int) -> DataFrame:
            if "version" in SCHEMAS[kind] and "version" not in df.columns:
                df = df.withColumn("version", F.lit(None).cast("long"))
            df = df.sortWithinPartitions(*sort)
            df = df.withColumn("id", F.monotonically_increasing_id()) if kind == "files" else df
            df.select(*(x.split()[0] for x in WRITTEN[kind].split(", "))).write.options(**options).parquet(f"{at}/{kind}")
            kept = self.spark.read.schema(WRITTEN[kind]).parquet(f"{at}/{kind}")
            counts[f"{name}/{kind}"] = kept.count()
            return kept

        kept = put("files", files.select("repo", "path", "content"), KEY, **{"parquet.block.size": FILE_GROUP})
        lists = posting_lists(kept).persist(StorageLevel.DISK_ONLY)  # ranges are found by a pass of their own
        try:
            put("postings", lists.repartitionByRange("tri"), ["tri", "block"])
        finally:
            lists.unpersist()
        put("manifest", manifest(kept) if rows is None else rows, KEY)
        put("gone", self.spark.createDataFrame([], SCHEMAS["gone"]) if gone is None else gone, KEY)
        return name, counts

    def write(self, files: DataFrame, rows: DataFrame | None = None, tokens: dict[str, str] | None = None) -> str:
        """Store files (repo, path, content) as a new version of one layer, and put it in force."""
        name, counts = self.layer(files, None, rows)
        return self.publish([name], counts, tokens or {})

    def append(self, written: list[tuple[str, dict[str, int]]], tokens: dict[str, str] | None = None) -> str:
        """Put layers over those in force. Too many of them become one."""
        row = self.pointer()
        layers, counts = list(row.layers) if row else [], dict(row.counts) if row else {}
        for name, own in written:
            layers, counts = [*layers, name], counts | own
        tokens = (dict(row.tokens or {}) if row else {}) | (tokens or {})
        if len(layers) > MOST_LAYERS:
            of = lambda kind: self._layers(kind, layers, counts)
            name, counts = self.layer(of("files"), of("gone").where("version IS NOT NULL"), of("manifest"))
            version = self.publish([name], counts, tokens)
            self._delete({name for name, _ in written})  # no version names these
            return version
        return self.publish(layers, counts, tokens)


def change_token(rows: DataFrame) -> str:
    """Equal for manifests with the same rows, whatever their order."""
    row = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("repo", "path", "oid").cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s or 0}"
