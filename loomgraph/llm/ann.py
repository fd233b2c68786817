"""Operator 2, approximate nearest neighbours by counting collisions.

Each single random projection keeps the vectors of a block in a sorted array. A query looks at a window around its
own value in each of them; windows grow by a factor (virtual rehashing), and a growing window reads only the
stretch of the array that is new at either end, where it adds one to the collisions of each vector. A vector whose
collisions reach the threshold is verified by its true distance. A query ends when its windows are so wide that
a vector as near as the k-th found so far would, with the wanted probability, have collided often enough."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, type_name
from .shared import checkpointed

NEIGHBOURS, PROJECTIONS, THRESHOLD, GROWTH = 10, 64, 0.6, 1.5
#: Quantile of the number of collisions that must reach the threshold: a vector at the k-th distance is
#: missed with a probability of about 23 %, a nearer one with less; over all k it is some 5 %.
SIGMAS = 0.75
#: Vectors that are indexed together.
DATA_BLOCK = 16384
#: Queries that go through the rounds together.
QUERY_BATCH = 64


def width_factor(projections: int = PROJECTIONS, threshold: float = THRESHOLD, sigmas: float = SIGMAS) -> float:
    """How wide half a window must be, in distances: the probability p of a collision must leave the threshold
    `sigmas` standard deviations below the expected number of collisions."""
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        p = erf(middle / sqrt(2))
        if projections * p - sigmas * sqrt(projections * p * (1 - p)) < threshold * projections:
            low = middle
        else:
            high = middle
    return high


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int = 7):
        self.vectors = vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections)).astype(np.float32)
        values = (vectors @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, 1)
        spread = float(np.median(self.values[:, -1] - self.values[:, 0])) if len(vectors) else 0.0
        self.first = spread / 16 or 1.0

    def search(self, queries: np.ndarray, k: int, own: list[int], threshold: int, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of the k nearest that are verified, with ties, and their distances. `own`
        are the queries' own places or -1.

        Queries widen their windows together, so that the ends of all of them in one array are found at once; each
        stops by its own distances."""
        n, total, at = len(self.vectors), len(queries), (queries @ self.directions).T
        counts, verified = np.zeros((total, n), np.int16), np.zeros((total, n), bool)
        for q, place in enumerate(own):
            if place >= 0:
                verified[q, place] = True
        left = np.stack([v.searchsorted(x) for v, x in zip(self.values, at)])
        right, half = left.copy(), np.full(total, self.first)
        best, far = [np.zeros(0, np.int64)] * total, [np.zeros(0)] * total
        active = np.arange(total)
        while len(active):
            reach = half[active]
            new_left = np.stack([v.searchsorted(x - reach) for v, x in zip(self.values, at[:, active])])
            new_right = np.stack([v.searchsorted(x + reach, "right") for v, x in zip(self.values, at[:, active])])
            need = np.full(len(active), np.inf)
            for i, q in enumerate(active.tolist()):
                fresh = [o[a:b] for o, a, b in zip(self.order, new_left[:, i].tolist(), left[:, q].tolist())]
                fresh += [o[a:b] for o, a, b in zip(self.order, right[:, q].tolist(), new_right[:, i].tolist())]
                counts[q] += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
                new = np.flatnonzero((counts[q] >= threshold) & ~verified[q])
                if len(new):
                    verified[q, new] = True
                    distance = np.sqrt(np.square(self.vectors[new] - queries[q]).sum(1, dtype=np.float64))
                    best[q], far[q] = np.concatenate([best[q], new]), np.concatenate([far[q], distance])
                    if len(best[q]) > k:
                        keep = np.flatnonzero(far[q] <= np.partition(far[q], k - 1)[k - 1])
                        best[q], far[q] = best[q][keep], far[q][keep]
                if len(far[q]) >= k:
                    need[i] = factor * far[q].max()
            left[:, active], right[:, active] = new_left, new_right
            done = (reach >= need) | ((new_right - new_left).min(0) == n)
            half[active] = np.minimum(reach * GROWTH, need)
            active = active[~done]
        return list(zip(best, far))


def nearest_neighbours(
    df: DataFrame, k: int = NEIGHBOURS, projections: int = PROJECTIONS, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
    queries: Column | None = None, data_block: int = DATA_BLOCK,
) -> DataFrame:
    """One row a query: (id, neighbours, distances): the ids of its k nearest other vectors among all rows, nearest
    first, by Euclidean distance. `queries` is the condition that makes a row a query; unless given, the id is
    divisible by 100. Approximate: a neighbour is missed with a probability of some 5 % (see SIGMAS); distances
    are exact. Equal distances are ordered by id.

    A row is not its own neighbour, but rows of the same id or vector are neighbours of each other. With k other vectors
    or fewer, all of them are listed. Vectors that are null, empty, of another length than most, or with
    elements that are null or not finite, are nobody's neighbours, and as queries have null ones.

    Vectors are indexed in blocks of about `data_block`; the queries go to each block behind its vectors and are
    answered one after the other, so a task holds one block and its index whatever the size of the table. Only ids and
    distances of the k best leave a block."""
    id_type, vector = type_name(df, id_col), F.col("v")
    asks = F.coalesce(F.col(id_col) % 100 == 0 if queries is None else queries, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"), asks.alias("asks"))
    sizes = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.where("asks").select(F.col("id").alias(id_col), F.lit(None).cast(f"array<{id_type}>").alias("neighbours"), F.lit(None).cast("array<float>").alias("distances"))
    dimension, blocks = sizes.d, ceil(sizes["count"] / data_block)
    usable = F.coalesce((F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("usable", usable))
    good = rows.where("usable")
    least, factor = max(1, round(threshold * projections)), width_factor(projections, threshold)

    vectors = good.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "row", "id", "v")
    asked = good.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "row", "id", "v")
    placed = vectors.union(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, index, places, ids = None, [], None, None, None
        for batch in batches:
            number, kind = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((np.diff(number, prepend=-1, append=-1) != 0) | (np.diff(kind, prepend=-1, append=-1) != 0))
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if number[a] != block:
                    block, parts, index = number[a], [], None
                if kind[a] == 0:
                    parts.append(part)
                    continue
                if index is None and parts:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    places, ids = table.column("row").to_numpy(), table.column("id").combine_chunks()
                    index, parts = Index(_matrix(table.column("v").combine_chunks(), dimension), projections), []
                if index is None:  # a block that got no vectors
                    continue
                asking, who = _matrix(part.column(4), dimension), part.column(2).to_numpy()
                own = np.minimum(np.searchsorted(places, who), len(places) - 1)
                own = np.where(places[own] == who, own, -1)
                answers = []
                for at in range(0, len(who), QUERY_BATCH):
                    answers += index.search(asking[at : at + QUERY_BATCH], k, own[at : at + QUERY_BATCH].tolist(), least, factor)
                near, distances = zip(*answers)
                sizes = [len(x) for x in near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(who, sizes)), pa.array(np.full(sum(sizes), block, np.int32)), pa.array(np.concatenate(distances).astype(np.float32)), ids.take(pa.array(np.concatenate(near)))],
                    names=["row", "block", "distance", "other"],
                )
        give_back()

    near = placed.mapInArrow(search, f"row bigint, block int, distance float, other {id_type}")
    # in two steps, so that no list is longer than some k times the root of the number of blocks, but for ties
    nearest = F.slice(F.array_sort(F.collect_list("one")), 1, k)
    some = near.groupBy("row", F.pmod("block", F.lit(ceil(sqrt(blocks)))).alias("part")).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k).alias("some"))
    best = some.select("row", F.explode("some").alias("one")).groupBy("row").agg(nearest.alias("n"))
    none = F.array().cast(f"array<struct<distance:float,other:{id_type}>>")
    out = rows.where("asks").select("id", "row", "usable").join(best, "row", "left").withColumn("n", F.when(F.col("usable"), F.coalesce("n", none)))
    return out.select(F.col("id").alias(id_col), F.col("n.other").alias("neighbours"), F.col("n.distance").alias("distances"))


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)
