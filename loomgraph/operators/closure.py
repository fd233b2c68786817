"""Transitive closure with the least number of hops, for many starts at once."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cut from their history, and of a size that is known when a join is planned."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What was visited is put together each time it has so many parts more, or plans of deep closures grow too large.
PARTS = 20


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None, keep_seed: bool = False) -> DataFrame:
    """(seed, node, hops): what each seed reaches over (src, dst) edges within `depth` hops (None: all it
    reaches), with the fewest hops.

    `seeds` has (seed, node). One frontier a hop, without what was visited before, so cycles end; edges and each frontier
    are stored, so no hop plans or reads again what went before, and a small frontier is broadcast by its stored size. The loop
    stops when the frontier is empty. The seed itself, at 0 hops, is left out unless `keep_seed`."""
    steps = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if depth is None or depth > 1:
        steps = stored(steps)
    frontier = stored(seeds.select("seed", "node").distinct().withColumn("hops", F.lit(0)))
    visited = frontier
    for hop in count(1) if depth is None else range(1, depth + 1):
        new = frontier.join(steps, frontier.node == steps.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = stored(new.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if hop % PARTS == 0:
            visited = stored(visited)
    return visited if keep_seed else visited.where("hops > 0")


def _levels(steps: DataFrame) -> DataFrame:
    """(node, depth): the number of edges on the longest path from each node from which no cycle is reached. `steps` is stored,
    with distinct (src, dst).

    From the ends upwards: a node has its depth in the hop in which the last of its edges is met. Each edge is met once; nodes of
    which not all edges are met wait with their number."""
    spark = steps.sparkSession
    ways = stored(steps.join(steps.groupBy("src").agg(F.count("*").alias("out")), "src"))
    level = stored(steps.select(F.col("dst").alias("node")).distinct().join(steps.select(F.col("src").alias("node")), "node", "left_anti"))
    found, waiting = level.select("node", F.lit(0).alias("depth")), spark.createDataFrame([], "src string, out bigint, met bigint")
    for hop in count(1):
        met = ways.join(level, ways.dst == level.node).select("src", "out", F.lit(1).cast("bigint").alias("met"))
        state = stored(met.union(waiting).groupBy("src", "out").agg(F.sum("met").alias("met")))
        level, waiting = stored(state.where("met = out").select(F.col("src").alias("node"))), state.where("met < out")
        if level.isEmpty():
            return found
        found = found.union(level.select("node", F.lit(hop).alias("depth")))
        if hop % PARTS == 0:
            found = stored(found)


def _core(steps: DataFrame) -> DataFrame:
    """The edges between nodes that reach a cycle and are reached from one: all edges of cycles and of ways between them."""
    for _ in range(2):
        known = _levels(steps).select("node")
        for end in ("src", "dst"):
            steps = steps.join(known.withColumnRenamed("node", end), end, "left_anti")
        steps = stored(backwards(steps))
        if steps.isEmpty():
            break
    return steps


def longest(edges: DataFrame) -> DataFrame:
    """(node, depth): the number of edges on the longest path from each node that has an edge out. Edges that lie on a cycle
    are left out, so every path ends.

    Nodes get their depth level by level, so the work is that of the edges and not that of all pairs that reach each other;
    pairs are looked for among the edges of the core alone, for its cycles."""
    steps = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    nodes = steps.select(F.col("src").alias("node")).distinct()
    depths = _levels(steps)
    if not nodes.join(depths, "node", "left_anti").isEmpty():
        core = _core(steps)
        reached = closure(core, core.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct(), None).select(F.col("seed").alias("dst"), F.col("node").alias("src"))
        depths = _levels(stored(steps.join(core.join(reached, ["src", "dst"], "left_semi"), ["src", "dst"], "left_anti").select("src", "dst")))
    return nodes.join(depths, "node", "left").select("node", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def start(spark, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed string, node string")


def backwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def chains(edges: DataFrame, seed: str, depth: int = 20, arrow: str = " -> ") -> DataFrame:
    """(node, hops, chain): for every node that the seed reaches, the shortest path as text; of paths of one length the
    first by text. Paths never come back to a node they have; short names are what follows ":table:"."""
    spark = edges.sparkSession
    steps = stored(edges.select("src", "dst").distinct())
    frontier = stored(spark.createDataFrame([(seed, 0, [seed])], "node string, hops int, path array<string>"))
    best = frontier
    for hop in range(1, depth + 1):
        new = frontier.join(steps, frontier.node == steps.src).where(~F.array_contains("path", F.col("dst")))
        new = new.select(F.col("dst").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        # a longer path to a node is never the best, so only the first path to a new node goes on
        new = new.groupBy("node").agg(F.min("hops").alias("hops"), F.min("path").alias("path"))
        frontier = stored(new.join(best.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        best = best.union(frontier)
    short = F.array_join(F.transform("path", lambda x: F.substring_index(x, ":table:", -1)), arrow)
    return best.where("hops > 0").select("node", F.col("hops").cast("bigint").alias("hops"), short.alias("chain"))
