"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that all executors share.

    Only in local mode (tests), where the session names none, is a local folder made; it is removed at exit.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sparkgrove-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    give_back_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def stored_small(df: DataFrame) -> DataFrame:
    """stored() for a table that is small beside the corpus: in as many files as the cluster has cores at most."""
    return stored(df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)))


def limited(df: DataFrame, rows: int, weight: Column | None = None, most: int = 0) -> DataFrame:
    """Marked for broadcast if it has ``rows`` rows at most, and a sum of weights of ``most`` at most; else joins shuffle."""
    first = df.limit(rows + 1)
    n, total = (first.count(), 0) if weight is None else first.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def planned_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of df, which for tables on disk is that of their files; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, so that no other column of the input can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Rows and bytes of the batches that go to Python, so that long texts don't add up in a worker.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application, so that their Python finds it wherever it is installed."""
    context = spark.sparkContext
    for key, least in SMALL_BATCHES.items():
        if not 0 < int(spark.conf.get(key, "0")) <= least:
            spark.conf.set(key, least)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="sparkgrove-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/sparkgrove.zip", "w") as out:
            for path in sorted((root / "sparkgrove").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(f"{folder}/sparkgrove.zip")
        _shipped.add(context.applicationId)


_keepers: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """Tell how a worker forgets what it keeps under this name from task to task."""
    _keepers[name] = forget


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, but a worker that runs it forgets what others keep, and before and after gives free memory back to the system.

    Workers live on between tasks, beside stages that need the memory for joins.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, forget in _keepers.items():
            if other != name:
                forget()
        give_back()  # what the task before held beyond its end, as its broadcasts
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def give_back_driver(spark: SparkSession) -> bool:
    """Have the driver's Python and JVM give free native memory back, of which compiling many plans leaves much. Whether the JVM can."""
    give_back()
    try:
        jvm = spark._jvm
        of = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class isn't open to calls
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        next(m for m in of.getMethods() if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Run fn on each Arrow batch; it yields dicts of columns, which are cast to the schema."""
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def as_arrow(values, kind: pa.DataType):
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema for a Python stage, which gets ready to run."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(spark)
    return to_arrow_schema(StructType.fromDDL(schema))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts, a null as empty."""
    return [x or "" for x in batch.column("text").to_pylist()]


def first_by_hash(ids: DataFrame, rows: int) -> DataFrame:
    """The rows of ids (doc_id and group) whose doc_ids come first by a hash, ``rows`` of each group at most.

    Counts come first, and with them all but about four times the rows go where they are, so that no task gets a share
    from each of very many partitions.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = ids.groupBy("group").agg(F.count("*").alias("_n"))
    counts = F.broadcast(counts) if counts.limit(100_001).count() <= 100_000 else counts
    near = ids.join(counts, "group").where(place * F.col("_n") < 4 * rows).drop("_n")
    first = W.Window.partitionBy("group").orderBy(place, "doc_id", *(c for c in ids.columns if c not in ("doc_id", "group")))
    return near.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= rows).drop("_k")


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z only. Plain lower() does that for ASCII words; translate() is kept for the others."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
