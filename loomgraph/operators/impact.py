"""Impact, provenance and confidence: what a change of a table or a column reaches, and how sure that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import ADDRESSABLE, COLUMN_EDGES, IMPACT_EDGES, TABLE_EDGES, Graph
from .closure import backwards, chains, closure, longest, start

CERTAIN, PROBABLE, UNKNOWN = "certain", "probable", "unknown"


def resolve_object(graph: Graph, name: str, limit: int = 10) -> DataFrame:
    """Nodes that a name can mean: 3 equal, 2 the end of the name after "." or ":", 1 inside it; `exact` if one alone is equal."""
    wanted, low_name, low_id = name.lower(), F.lower("name"), F.lower("id")
    ends = low_name.endswith("." + wanted) | low_name.endswith(":" + wanted) | low_id.endswith("." + wanted) | low_id.endswith(":" + wanted)
    score = F.when((low_name == wanted) | (low_id == wanted), 3).when(ends, 2).when(low_name.contains(wanted) | low_id.contains(wanted), 1)
    found = graph.label(*ADDRESSABLE).withColumn("score", score).where("score IS NOT NULL")
    best = found.agg((F.count_if(F.col("score") == 3) == 1).alias("exact"))
    top = found.orderBy(F.desc("score"), F.length("name"), "name", "id").limit(min(limit, 200))
    return top.crossJoin(F.broadcast(best)).select("id", "label", "name", F.col("score").cast("bigint").alias("score"), (F.col("exact") & (F.col("score") == 3)).alias("exact"))


def _owners(graph: Graph) -> DataFrame:
    return graph.type(*IMPACT_EDGES).select(F.col("owner").alias("src"), "dst")


def impact(graph: Graph, node: str, direction: str = "downstream", depth: int = 1, limit: int = 50) -> DataFrame:
    """(id, label, name, hops) of what depends on a node ("downstream"), or of what it depends on ("upstream")."""
    edges = _owners(graph)
    if direction == "downstream":
        edges = backwards(edges)
    reached = closure(edges, start(graph.nodes.sparkSession, [node]), max(1, min(depth, 5)))
    found = reached.join(graph.nodes.select("id", "label", "name"), reached.node == F.col("id"))
    return found.where(F.col("id") != node).select("id", "label", "name", F.col("hops").cast("bigint").alias("hops")).orderBy("hops", "id").limit(min(limit, 500))


def column_provenance(graph: Graph, column: str, depth: int = 5) -> DataFrame:
    """(id, hops) of the columns that a column's value derives from."""
    reached = closure(graph.type("DERIVES_FROM"), start(graph.nodes.sparkSession, [column]), min(depth, 20))
    return reached.select(F.col("node").alias("id"), F.col("hops").cast("bigint").alias("hops"))


def column_consumers(graph: Graph, column: str, depth: int = 5) -> DataFrame:
    reached = closure(backwards(graph.type("DERIVES_FROM")), start(graph.nodes.sparkSession, [column]), min(depth, 20))
    return reached.select(F.col("node").alias("id"), F.col("hops").cast("bigint").alias("hops"))


def column_evidence(graph: Graph) -> DataFrame:
    """(column, object, bucket, reason) for every column and object that refers to it, by the object's best evidence."""
    seen = graph.type(*COLUMN_EDGES).groupBy(F.col("dst").alias("column"), F.col("owner").alias("object"))
    by = seen.agg(*(F.bool_or(F.coalesce(F.col("resolution") == r, F.lit(False))).alias(r) for r in ("direct", "via_view", "star_expanded")))
    bucket = F.when(F.col("direct"), CERTAIN).when(F.col("via_view") | F.col("star_expanded"), PROBABLE)
    reason = F.when(F.col("direct"), None).when(F.col("via_view"), "through a view").when(F.col("star_expanded"), "from *")
    objects = graph.label("SqlObject").select(F.col("id").alias("object"))
    return by.join(objects, "object", "left_semi").select("column", "object", bucket.alias("bucket"), reason.alias("reason"))


def blind_objects(graph: Graph, db: str) -> DataFrame:
    """Objects of a database that run dynamic SQL of unknown text."""
    blind = graph.label("Step").where("is_dynamic AND dynamic_sql IS NULL").select(F.substring_index("id", "#", 1).alias("id")).distinct()
    return graph.label("SqlObject").where(F.col("db") == db).join(blind, "id", "left_semi").select("id", "name")


def _summary(buckets: DataFrame) -> DataFrame:
    by = buckets.groupBy("bucket", "reason").agg(F.count("*").alias("n"))
    text = F.when(F.col("reason").isNotNull(), F.concat_ws(" ", F.col("n").cast("string"), "reason"))
    detail = F.array_join(F.array_sort(F.collect_list(text)), ", ")
    return by.groupBy("bucket").agg(F.sum("n").alias("objects"), detail.alias("detail"))


def column_impact_summary(graph: Graph, column: str) -> DataFrame:
    """(bucket, objects, detail): how many objects refer to a column, by confidence."""
    blind = blind_objects(graph, column.split(":")[0]).select(F.lit(UNKNOWN).alias("bucket"), F.lit("unresolved dynamic SQL").alias("reason"))
    return _summary(column_evidence(graph).where(F.col("column") == column).select("bucket", "reason").union(blind))


def table_impact(graph: Graph, table: str, depth: int = 10) -> DataFrame:
    """(object, hops, bucket, reason): readers and writers of a table, and all that call them, by best evidence."""
    direct = graph.type(*TABLE_EDGES).where(F.col("dst") == table).select("owner", F.col("via_view").isNull().alias("sure"))
    first = direct.groupBy("owner").agg(F.bool_or("sure").alias("sure"))
    seeds = first.select(F.lit("all").alias("seed"), F.col("owner").alias("node"))
    reached = closure(backwards(graph.type("CALLS").select(F.col("owner").alias("src"), "dst")), seeds, depth - 1, keep_seed=True)
    best = reached.join(first, reached.node == first.owner, "left").select("node", (F.col("hops") + 1).cast("bigint").alias("hops"), F.coalesce("sure", F.lit(False)).alias("sure"))
    objects = graph.label("SqlObject").select(F.col("id").alias("node"))
    reason = F.when(F.col("sure"), None).when(F.col("hops") == 1, "through a view").otherwise("called indirectly")
    return best.join(objects, "node", "left_semi").select(F.col("node").alias("object"), "hops", F.when(F.col("sure"), CERTAIN).otherwise(PROBABLE).alias("bucket"), reason.alias("reason"))


def table_impact_summary(graph: Graph, table: str, depth: int = 10) -> DataFrame:
    blind = blind_objects(graph, table.split(":")[0]).select(F.lit(UNKNOWN).alias("bucket"), F.lit("unresolved dynamic SQL").alias("reason"))
    return _summary(table_impact(graph, table, depth).select("bucket", "reason").union(blind))


def derives_chain(graph: Graph, column: str) -> DataFrame:
    """Columns whose value is computed from this one: (node, hops, chain)."""
    return chains(backwards(graph.type("DERIVES_FROM")), column)


def provenance_chain(graph: Graph, column: str) -> DataFrame:
    """Columns that this one's value comes from: (node, hops, chain)."""
    return chains(graph.type("DERIVES_FROM"), column, arrow=" <- ")


def column_procedures(graph: Graph, column: str, depth: int = 10) -> DataFrame:
    """(object, column, hops): objects that read or write a column or one computed from it."""
    reached = closure(backwards(graph.type("DERIVES_FROM")), start(graph.nodes.sparkSession, [column]), depth, keep_seed=True)
    used = graph.type("READS_COLUMN", "WRITES_COLUMN").select("owner", "dst")
    return reached.join(used, reached.node == used.dst).groupBy(F.col("owner").alias("object"), F.col("node").alias("column")).agg(F.min("hops").cast("bigint").alias("hops"))


def lineage_roots(graph: Graph, depth: int | None = None) -> DataFrame:
    """(column, root, hops): for every column that derives from others, the origins that derive from nothing.
    `depth` bounds the derivations that are followed; without it all are."""
    edges = graph.type("DERIVES_FROM").select("src", "dst").where("src <> dst")
    seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    reached = closure(edges, seeds, depth)
    return reached.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("seed").alias("column"), F.col("node").alias("root"), F.col("hops").cast("bigint").alias("hops"))


def lineage_depths(graph: Graph) -> DataFrame:
    """(column, depth): for every column that derives from others, the derivations on the longest way to an origin. Derivations
    that lie on a cycle don't count."""
    return longest(graph.type("DERIVES_FROM")).select(F.col("node").alias("column"), "depth")


def affects(graph: Graph, depth: int | None = None, table: str | None = None) -> DataFrame:
    """(object, table, hops, via): tables that an object changes through the objects it calls, with the fewest calls; of one
    table alone if it is named. `depth` bounds the calls that are followed; without it all are.

    What an object writes goes to its callers as one list. Lists are shuffled by caller and taken apart there, so a row for
    each caller and table is never shuffled."""
    calls = graph.type("CALLS").select(F.col("owner").alias("src"), "dst").where("src <> dst")
    seeds = calls.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    reached = closure(calls, seeds, depth)
    writes = graph.type("WRITES_TO").where("owner IS NOT NULL")
    writes = (writes if table is None else writes.where(F.col("dst") == table)).groupBy("owner").agg(F.collect_set("dst").alias("tables"))
    lists = reached.join(writes, reached.node == writes.owner).select(F.col("seed").alias("object"), "hops", "node", "tables").repartition("object")
    found = lists.select("object", "hops", "node", F.explode("tables").alias("table"))
    return found.groupBy("object", "table").agg(F.min(F.struct("hops", "node")).alias("m")).select("object", "table", F.col("m.hops").cast("bigint").alias("hops"), F.col("m.node").alias("via"))


def workflow_writes(graph: Graph) -> DataFrame:
    """(workflow, table): what the objects of a workflow write."""
    members = graph.type("BELONGS_TO").select(F.col("src").alias("owner"), F.col("dst").alias("workflow"))
    return graph.type("WRITES_TO").select("owner", F.col("dst").alias("table")).distinct().join(members, "owner").select("workflow", "table").distinct()


def shared_data(graph: Graph) -> DataFrame:
    """(writer, table, reader): objects that hang together only by a table that one writes and another reads."""
    writes = graph.type("WRITES_TO").select(F.col("owner").alias("writer"), F.col("dst").alias("table")).distinct()
    reads = graph.type("READS_FROM").select(F.col("owner").alias("reader"), F.col("dst").alias("table")).distinct()
    return writes.join(reads, "table").where("writer <> reader").select("writer", "table", "reader")


def via_data(graph: Graph) -> DataFrame:
    """(object, tables, readers): the other procedures and functions that read what an object writes, as sorted text.

    Readers are told apart before they meet writers, and meet them as one list a table, so no pair is shuffled by itself."""
    kinds = graph.label("SqlObject").where(F.col("object_type").isin("PROCEDURE", "FUNCTION")).select(F.col("id").alias("owner"))
    side = lambda how: graph.type(how).select("owner", F.col("dst").alias("table")).where("owner IS NOT NULL AND table IS NOT NULL")
    writes, reads = side("WRITES_TO"), side("READS_FROM").join(kinds, "owner", "left_semi")
    rows = writes.select("table", F.col("owner").alias("writer"), F.lit(None).cast("string").alias("reader")).union(reads.select("table", F.lit(None), "owner"))
    by_table = rows.groupBy("table").agg(F.collect_set("writer").alias("writers"), F.collect_set("reader").alias("readers")).where("size(readers) > 0")
    met = by_table.select(F.explode("writers").alias("object"), "readers").select("object", F.array_remove("readers", F.col("object")).alias("readers")).where("size(readers) > 0")
    found = met.repartition("object").select("object", F.posexplode("readers").alias("at", "reader"))
    return found.groupBy("object").agg(F.count_if(F.col("at") == 0).alias("tables"), F.array_join(F.sort_array(F.collect_set("reader")), ", ").alias("readers"))


def view_readers(graph: Graph, views: DataFrame) -> DataFrame:
    """READS_FROM edges that readers of a view get to its base tables: (src, dst, via_view). `views` has (view, base)."""
    reads = graph.type("READS_FROM").select("src", F.col("dst").alias("view"))
    return reads.join(views, "view").select("src", F.col("base").alias("dst"), F.col("view").alias("via_view")).distinct()
