"""Connected components with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkgrove.llm.common import stored_small

#: Up to so many edges go through the rounds in one task. Each exchange that isn't needed spares the driver a job and a thread.
FEW_EDGES = 1 << 16


def _hang_few(edges: DataFrame, both: bool) -> DataFrame:
    """As _hang, for edges of one partition, which it sorts instead of joining them: nothing is shuffled."""
    if both:
        edges = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    hung = edges.withColumn("m", F.least("a", F.min("b").over(W.Window.partitionBy("a"))))
    hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if both else hung.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return hung.where("a <> b").distinct()


def _hang(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours are hung on the least of them (and itself): the larger ones if both, else the smaller."""
    if both:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = edges.join(least, "a")
    hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if both else joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of all nodes of edges (a, b), except the least nodes themselves.

    Large-star and small-star steps in turn, until each node hangs on one that hangs on none. Sums are made before the
    shuffle and the joins can be split, so a node with very many edges is no task of its own; each round is a written table.
    Few edges (``FEW_EDGES``) take all of a round in one task. Empty edges give no rows. edges should be cheap to read twice.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    few = False
    while True:
        edges = edges.coalesce(1) if few else edges
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        nodes = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        n, astray = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("all") > 1))).first()
        if not astray:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        few = n <= FEW_EDGES
        hang = _hang_few if few else _hang
        edges = stored_small(hang(hang(edges.coalesce(1) if few else edges, True), False))
