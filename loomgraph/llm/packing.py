"""Operator 9, packing: bounded-space online packing of documents into windows of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, small_batches, type_name
from .shared import written
from .vocabulary import DEFAULT_VOCABULARY, library_chunks

CAPACITY, OPEN = 2048, 16
#: Partitions, or groups of them, whose leftovers are merged together, level by level, until there is one group.
MERGED = 256

#: (document, first token, number of tokens)
Piece = tuple[object, int, int]


class Windows:
    """At most `most` open windows. A piece goes to the open window that it fits with the least room left over."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[list] = []  # [free, pieces]

    def put(self, piece: Piece) -> list[list[Piece]]:
        """Place a piece; windows that this closes."""
        size, best = piece[2], None
        for window in self.open:
            if window[0] >= size and (best is None or window[0] < best[0]):
                best = window
        closed = []
        if best is None:
            if len(self.open) == self.most:
                fullest = min(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                closed.append(fullest[1])
            best = [self.capacity, []]
            self.open.append(best)
        best[0] -= size
        best[1].append(piece)
        if not best[0]:
            self.open.remove(best)
            closed.append(best[1])
        return closed


def merge(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Best fit, largest first, over all pieces at hand."""
    windows: list[list[Piece]] = []
    free: list[tuple[int, int]] = []  # (room, window), sorted
    for piece in sorted(pieces, key=lambda p: (-p[2], str(p[0]), p[1])):
        at = bisect_left(free, (piece[2], -1))
        room, window = free.pop(at) if at < len(free) else (capacity, len(windows))
        if window == len(windows):
            windows.append([])
        windows[window].append(piece)
        if room > piece[2]:
            insort(free, (room - piece[2], window))
    return windows


def pack_documents(df: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", merged: int = MERGED) -> DataFrame:
    """One row a window: (window_id, doc_ids, starts, lengths, used); entry i says that the tokens
    starts[i] .. starts[i] + lengths[i] - 1 of document doc_ids[i] lie in the window, in this order.

    A document of more tokens than a window holds fills whole windows first and goes on with its remainder as
    a piece; other documents are one piece. Each partition places its pieces as they come, best fit,
    into a fixed number of open windows; when none has room the fullest is closed. What is still open at the end
    of a partition is packed anew together with that of other partitions, `merged` at a time, largest piece first. Of each
    such group the emptiest windows, as many as a partition has open, are packed anew with those of other groups, and so
    on until there is one group. Closed windows stay where they are; only ids and lengths of leftovers are shuffled.

    Every token of every document lies in exactly one window. Null and empty texts have no tokens and are in
    no window. Rows that repeat an id are packed as documents of their own. Which documents share a
    window depends on how the input is cut into partitions; the rules above hold for any cut."""
    id_type = type_name(df, id_col)
    schema = f"grp bigint, leftover boolean, window_id bigint, doc_ids array<{id_type}>, starts array<int>, lengths array<int>, used int"

    def frame(rows: list[tuple[int, bool, int, list[Piece]]], kind: pa.DataType) -> pa.RecordBatch:
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.bool_()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([[p[0] for p in r[3]] for r in rows], pa.list_(kind)),
            pa.array([[p[1] for p in r[3]] for r in rows], pa.list_(pa.int32())),
            pa.array([[p[2] for p in r[3]] for r in rows], pa.list_(pa.int32())),
            pa.array([sum(p[2] for p in r[3]) for r in rows], pa.int32()),
        ]
        names = ["grp", "leftover", "window_id", "doc_ids", "starts", "lengths", "used"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, kind = TaskContext.get().partitionId(), 0, None
        windows = Windows(capacity, open_windows)
        for batch in slices(batches, 4000):
            kind = batch.column(0).type
            closed = []
            for doc, data in zip(batch.column(0).to_pylist(), library_chunks(vocabulary).join(batch.column(1).to_pylist())):
                size = len(data) // 4
                whole = size - size % capacity
                closed.extend([(doc, at, capacity)] for at in range(0, whole, capacity))
                if size > whole:
                    closed.extend(windows.put((doc, whole, size - whole)))
            yield frame([(part, False, part << 32 | number + i, w) for i, w in enumerate(closed)], kind)
            number += len(closed)
        if windows.open:
            yield frame([(part, True, 0, w[1]) for w in windows.open], kind)

    def merging(level: int, last: bool):
        """Merge the leftovers of each group; what stays open goes on to the next level."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left: dict[int, list[Piece]] = {}
            kind = None
            for batch in batches:
                kind = batch.column(3).type.value_type
                for group, *lists in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                    left.setdefault(group // merged, []).extend(zip(*lists))
            for group, pieces in left.items():
                windows = sorted(merge(pieces, capacity), key=lambda w: -sum(p[2] for p in w))
                done = len(windows) if last else max(0, len(windows) - open_windows)
                first = 1 << 62 | level << 54 | group << 20
                yield frame([(group, i >= done, first + i, w) for i, w in enumerate(windows)], kind)

        return run

    placed = written(small_batches(df).select(id_col, text_col).mapInArrow(place, schema))
    closed, left, level = placed.where("NOT leftover"), placed.where("leftover"), 1
    groups = (left.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // merged)
        some = left.repartition(F.floor(F.col("grp") / merged)).mapInArrow(merging(level, groups == 1), schema)
        if groups == 1:
            break
        some = written(some)
        closed, left, level = closed.union(some.where("NOT leftover")), some.where("leftover"), level + 1
    return closed.union(some).drop("grp", "leftover")
