"""Differences between two graphs, and measures against an independent catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import COLUMN_EDGES, TABLE_EDGES, Graph
from .closure import backwards, closure, stored


def content_hash(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, hash) of rows by all their columns in the order of their names."""
    rest = sorted(c for c in df.columns if c != key)
    return df.select(F.col(key).alias("id"), F.sha1(F.to_json(F.struct(*rest))).alias("hash"))


def object_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of rows (id, hash) that are added, removed or changed."""
    a, b = before.select("id", F.col("hash").alias("old")), after.select("id", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "id", "full").select("id", change.alias("change")).where("change IS NOT NULL")


def call_reach(graph: Graph, depth: int = 20) -> DataFrame:
    """(id, reached, hops): who is hit, through calls, when an object changes."""
    calls = backwards(graph.type("CALLS").select(F.col("owner").alias("src"), "dst").where("src <> dst"))
    seeds = graph.type("CALLS").select(F.col("dst").alias("seed"), F.col("dst").alias("node")).distinct()
    return closure(calls, seeds, depth).select(F.col("seed").alias("id"), F.col("node").alias("reached"), F.col("hops").cast("bigint").alias("hops"))


def data_reach(graph: Graph) -> DataFrame:
    from .impact import shared_data

    return shared_data(graph).select(F.col("writer").alias("id"), F.col("reader").alias("reached")).distinct()


def _access(before: Graph, after: Graph) -> DataFrame:
    """(owner, table, how, old, new): reads and writes, and which of the graphs has them."""
    rows = [g.type(*TABLE_EDGES).select("owner", F.col("dst").alias("table"), F.col("type").alias("how"), F.lit(k == 0).alias("old"), F.lit(k == 1).alias("new")) for k, g in enumerate((before, after))]
    return stored(rows[0].union(rows[1]).groupBy("owner", "table", "how").agg(F.bool_or("old").alias("old"), F.bool_or("new").alias("new")))


def _pairs(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(id, reached) of data_reach, from rows of _access."""
    side = lambda rows, how, name: rows.where(F.col("how") == how).select(F.col("owner").alias(name), "table")
    return side(writes, "WRITES_TO", "id").join(side(reads, "READS_FROM", "reached"), "table").where("id <> reached").select("id", "reached").distinct()


def _lost(access: DataFrame, here: str, there: str) -> DataFrame:
    """Pairs of data_reach that one graph has and the other hasn't. Such a pair rests on a row that is missing there; of the pairs
    that do, those stay out that other rows give there, which are looked for among their own writers and readers only."""
    mine, other, gone = access.where(here), access.where(there), stored(access.where(f"{here} AND NOT {there}"))
    pairs = stored(_pairs(gone, mine).union(_pairs(mine, gone)).distinct())
    ends = [pairs.select(F.col(c).alias("owner")).distinct() for c in ("id", "reached")]
    return pairs.join(_pairs(*(other.join(e, "owner", "left_semi") for e in ends)), ["id", "reached"], "left_anti")


def _change(rows: DataFrame, via: str, change: str) -> DataFrame:
    return rows.select("id", "reached", F.lit(via).alias("via"), F.lit(change).alias("change"))


def impact_delta(before: Graph, after: Graph) -> DataFrame:
    """(id, reached, via, change): pairs that one of the graphs has alone, by calls or by data. Pairs by data are told from the
    reads and writes that changed, so their number counts and not that of all pairs."""
    calls = [stored(call_reach(g).select("id", "reached")) for g in (before, after)]
    data, out = _access(before, after), None
    for old, new, change in ((0, 1, "added"), (1, 0, "removed")):
        part = _change(calls[new].join(calls[old], ["id", "reached"], "left_anti"), "calls", change).union(_change(_lost(data, *(("new", "old") if new else ("old", "new"))), "data", change))
        out = part if out is None else out.union(part)
    return out


def newly_affected(delta: DataFrame) -> DataFrame:
    return delta.where("change = 'added'").select(F.col("reached").alias("id")).distinct()


def gate(delta: DataFrame, fail_on_new: bool) -> int:
    """2 if there is new impact and that is to fail, otherwise 0."""
    return 2 if fail_on_new and not newly_affected(delta).isEmpty() else 0


def workflows_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entry, change, paths_before, paths_after) of rows (entry, paths)."""
    a, b = before.select("entry", F.col("paths").alias("paths_before")), after.select("entry", F.col("paths").alias("paths_after"))
    change = F.when(F.col("paths_before").isNull(), "added").when(F.col("paths_after").isNull(), "removed").when(F.col("paths_before") != F.col("paths_after"), "reshaped")
    return a.join(b, "entry", "full").select("entry", change.alias("change"), "paths_before", "paths_after").where("change IS NOT NULL")


def against_catalog(found: DataFrame, catalog: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, side): pairs that only the graph has ("extra") or only the catalog ("missing"), of names that the graph knows."""
    names = known.select("name").distinct()
    scope = catalog.select("src", "dst").join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    mine = found.select("src", "dst").distinct()
    return mine.exceptAll(scope).withColumn("side", F.lit("extra")).union(scope.exceptAll(mine).withColumn("side", F.lit("missing")))


def column_references(graph: Graph) -> DataFrame:
    """Distinct (module, entity, column, resolution) of an evaluation, in lower case; entities without a schema are in dbo."""
    names = graph.label("SqlObject").select(F.col("id").alias("owner"), F.lower("name").alias("module"))
    entity = F.lower(F.substring_index(F.substring_index("dst", ":column:", 1), ":table:", -1))
    rows = graph.type(*COLUMN_EDGES).join(names, "owner")
    return rows.select("module", F.when(entity.contains("."), entity).otherwise(F.concat(F.lit("dbo."), entity)).alias("entity"), F.lower(F.substring_index("dst", ":column:", -1)).alias("column"), "resolution").distinct()


def recall(found: DataFrame, oracle: DataFrame) -> DataFrame:
    """(total, strict, loose): oracle rows (module, entity, column), those found, and those found for any entity."""
    keys = ["module", "entity", "column"]
    wanted = oracle.select(*keys).distinct()
    strict = found.select(*keys).distinct().withColumn("s", F.lit(1))
    loose = found.select("module", "column").distinct().withColumn("l", F.lit(1))
    both = wanted.join(strict, keys, "left").join(loose, ["module", "column"], "left").agg(F.count("*").alias("total"), F.count("s").alias("strict"), F.count("l").alias("loose"))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total"), 4))
    return both.withColumn("strict_recall", share("strict")).withColumn("loose_recall", share("loose"))


def precision(found: DataFrame, oracle: DataFrame) -> DataFrame:
    """(resolution, n, right, precision) on the modules that the oracle has."""
    keys = ["module", "entity", "column"]
    seen = found.join(oracle.select("module").distinct(), "module", "left_semi").select(*keys, "resolution").distinct()
    by = seen.join(oracle.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "left").groupBy("resolution").agg(F.count("*").alias("n"), F.count("r").alias("right"))
    return by.withColumn("precision", F.round(F.col("right") / F.col("n"), 4))


def blind_references(found: DataFrame, oracle: DataFrame) -> DataFrame:
    keys = ["module", "entity", "column"]
    return oracle.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")


def perturbed(oracle: DataFrame) -> DataFrame:
    """A control: columns that don't exist, of which next to nothing may be found."""
    return oracle.withColumn("column", F.concat("column", F.lit("_not_there")))


def multiset_diff(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that one side has more often, with `side`."""
    expected = expected.select(*found.columns)
    return found.exceptAll(expected).withColumn("side", F.lit("extra")).union(expected.exceptAll(found).withColumn("side", F.lit("missing")))
