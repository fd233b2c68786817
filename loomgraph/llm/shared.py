"""Cutting lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that are reduced to a spanning forest at once.
EDGES = 1_000_000


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where none is set a local session, as in tests, gets one of
    its own; on a cluster that is an error, as a folder of one machine would not do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that they outlive executors."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which is smaller than a checkpoint."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges (a, b) and all their hashes in one, by which two sets of edges are told apart. No sum: of hashes
    it overflows, however they are cut, on tables that are large enough."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def spanning(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), of bigint nodes, with the same components: of each so many, each node's to the smallest that it is
    tied with. Where many nodes are all linked with each other, little is left."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def reduced() -> pa.RecordBatch:
            nodes, ends = np.unique(np.concatenate([x for side in zip(*waiting) for x in side]), return_inverse=True)
            a, b = ends.reshape(2, -1)
            least = np.arange(len(nodes))
            while True:
                low = np.minimum(least[a], least[b])
                new = least.copy()
                for side in (a, b, least[a], least[b]):  # a node and the one that stands for it
                    np.minimum.at(new, side, low)
                new = new[new]
                if (new == least).all():
                    break
                least = new
            own = np.flatnonzero(least != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[least[own]])], names=["a", "b"])

        for batch in batches:
            waiting.append([batch.column(i).to_numpy() for i in (0, 1)])
            rows += batch.num_rows
            if rows >= EDGES:
                yield reduced()
                waiting.clear()
                rows = 0
        if waiting:
            yield reduced()

    return edges.select("a", "b").mapInArrow(trees, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); the component is its smallest node.

    Large and small stars in turn until nothing changes: every round at least halves how far a node is from
    the smallest node of its component. Self-loops and repeated edges don't matter; nulls must not occur."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = checkpointed(small.where("a > b").distinct())
        after = state(new)
        if after == before:
            break
        edges, before = new, after
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(new.select("b", "b").distinct())
