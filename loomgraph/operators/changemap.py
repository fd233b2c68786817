"""Maps of change: flows from entry points, what a call reaches, and steps in the order of a flow.

Calls between the objects of one database are few next to all else in a graph, and these results depend on the order of
visits. A database's calls are therefore brought together and walked in one place, databases side by side."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Graph

PATHS_PER_ENTRY, BLOCK = 200, 10_000


#: What can be called. Triggers answer to events, and views, synonyms and scripts don't call.
CALLABLE = ("PROCEDURE", "FUNCTION", "SCALAR_FUNCTION", "TABLE_FUNCTION", "MULTI_TABLE_FUNCTION", "TABLE_VALUED_FUNCTION")


def _calls(graph: Graph, callable_only: bool = True) -> DataFrame:
    """(db, src, dst, conditional) of calls; one is conditional if no step that makes it stands outside conditions. Objects
    that are known to be something else than callable are left out, unless told otherwise."""
    c = graph.type("CALLS").select(F.col("owner").alias("src"), "dst").distinct()
    if callable_only:
        other = graph.label("SqlObject", "Trigger").where((F.col("label") == "Trigger") | ~F.col("object_type").isin(*CALLABLE)).select(F.col("id").alias("other"))
        c = c.join(other, F.col("src") == F.col("other"), "left_anti").join(other, F.col("dst") == F.col("other"), "left_anti")
    steps = graph.label("Step").where("action = 'EXEC'").select(F.substring_index("id", "#", 1).alias("src"), (F.coalesce("nesting", F.lit(0)) > 0).alias("c"))
    by = steps.groupBy("src").agg(F.bool_and("c").alias("conditional"))
    return c.join(by, "src", "left").select(F.substring_index("src", "::", 1).alias("db"), "src", "dst", F.coalesce("conditional", F.lit(False)).alias("conditional"))


def _adjacent(rows: pd.DataFrame) -> dict[str, list[tuple[str, bool]]]:
    out: dict[str, list[tuple[str, bool]]] = {}
    for r in rows.sort_values(["src", "dst"]).itertuples():
        out.setdefault(r.src, []).append((r.dst, bool(r.conditional)))
    return out


def _others(calls: dict[str, list[tuple[str, bool]]], node: str) -> Iterator[tuple[str, bool]]:
    """What a node calls but itself."""
    return ((d, c) for d, c in calls.get(node, []) if d != node)


def _blocks(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows by the block, so that a worker holds one block and not all that a database gives."""
    while block := list(islice(rows, BLOCK)):
        yield pd.DataFrame(block, columns=names)


def workflows(graph: Graph, per_entry: int = PATHS_PER_ENTRY, hops: int | None = None) -> DataFrame:
    """(entry, number, path, conditional, cycle_back_to, truncated): simple paths from every object that calls and isn't called,
    callees in order, up to `per_entry` for one entry, which is `truncated` if it has more; a path ends where nothing is called,
    where it would come back, or after so many `hops`, if given. Triggers, views and the like take no part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = _adjacent(pd.concat(batches))
        called = {d for s, ds in calls.items() for d, _ in ds if d != s}

        def paths(entry: str) -> Iterator[tuple[str, bool, str | None]]:
            path, conditional, open_ = [entry], [False], {entry}
            stack = [_others(calls, entry)]
            while stack:
                d, c = next(stack[-1], (None, False))
                if d is None:
                    stack.pop()
                    open_.remove(path.pop())
                    conditional.pop()
                elif d in open_:
                    yield " > ".join(path), conditional[-1], d
                elif next(_others(calls, d), None) is None or len(path) == hops:
                    yield " > ".join([*path, d]), conditional[-1] or c, None
                else:
                    path.append(d)
                    conditional.append(conditional[-1] or c)
                    open_.add(d)
                    stack.append(_others(calls, d))

        def rows() -> Iterator[tuple]:
            for entry in sorted(set(calls) - called):
                if next(_others(calls, entry), None) is None:
                    yield entry, 0, entry, False, None, False
                    continue
                found = list(islice(paths(entry), per_entry + 1))
                truncated = len(found) > per_entry
                yield from ((entry, i, p, c, b, truncated) for i, (p, c, b) in enumerate(found[:per_entry]))

        yield from _blocks(rows(), ["entry", "number", "path", "conditional", "cycle_back_to", "truncated"])

    return _calls(graph).groupBy("db").applyInPandas(run, "entry string, number bigint, path string, conditional boolean, cycle_back_to string, truncated boolean")


def model_workflows(graph: Graph) -> DataFrame:
    """Workflows as the node store's model lists them: up to 30 paths of up to 10 hops for an entry."""
    return workflows(graph, 30, 10).drop("conditional", "truncated")


def via_calls(graph: Graph, depth: int | None = None) -> DataFrame:
    """(id, reached, depth, cycle): in depth-first order from each object, the depth at which a callee is met first; the
    object itself comes once, as a cycle, if it can be reached. `depth` bounds the walk; without it all is met."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = _adjacent(pd.concat(batches))

        def rows() -> Iterator[tuple]:
            for root in sorted(calls):
                seen, stack = {root: 0}, [(d, 1) for d, _ in reversed(calls[root])]
                cycle = False
                while stack:
                    node, level = stack.pop()
                    if node == root:
                        if not cycle:
                            yield root, root, level, True
                        cycle = True
                    elif node not in seen:
                        seen[node] = level
                        yield root, node, level, False
                        if depth is None or level < depth:
                            stack.extend((d, level + 1) for d, _ in reversed(calls.get(node, [])))

        yield from _blocks(rows(), ["id", "reached", "depth", "cycle"])

    return _calls(graph).groupBy("db").applyInPandas(run, "id string, reached string, depth bigint, cycle boolean")


def inlined_flow(graph: Graph, depth: int = 5) -> DataFrame:
    """(root, position, level, object): the calls of every object in order, each followed by its own, to a depth; an object
    that is open already isn't entered again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = _adjacent(pd.concat(batches))

        def rows() -> Iterator[tuple]:
            for root in sorted(calls):
                path, stack, position = [root], [iter(calls[root])], 0
                while stack:
                    d, _ = next(stack[-1], (None, False))
                    if d is None:
                        stack.pop()
                        path.pop()
                        continue
                    yield root, position, len(stack), d
                    position += 1
                    if d not in path and len(stack) < depth:
                        path.append(d)
                        stack.append(iter(calls.get(d, [])))

        yield from _blocks(rows(), ["root", "position", "level", "object"])

    return _calls(graph, False).groupBy("db").applyInPandas(run, "root string, position bigint, level bigint, object string")


def layered(graph: Graph, table: str, per_level: int = 8, levels: int = 8) -> DataFrame:
    """(level, object): who is hit when a table changes, level by level, the first `per_level` by name of each."""
    from pyspark.sql import Window

    from .impact import table_impact

    reached = table_impact(graph, table, levels)
    place = F.row_number().over(Window.partitionBy("hops").orderBy("object"))
    return reached.withColumn("p", place).where(F.col("p") <= per_level).select(F.col("hops").alias("level"), "object")


def path_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("entry").agg(F.count("*").alias("paths"))
