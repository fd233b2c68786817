"""Sinks of a graph, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.audit import counts_by_kind, step_rollup
from ..operators.compare import content_hash
from ..plans.model import Graph

COLOURS = {"SqlObject": "#4e79a7", "Table": "#59a14f", "Column": "#9c755f", "Step": "#bab0ac", "Trigger": "#e15759", "Workflow": "#f28e2b"}


def write_parquet(graph: Graph, path: str) -> None:
    """Nodes with the roll-up of their steps, and edges by type, whose ends all exist."""
    graph.nodes.join(step_rollup(graph), "id", "left").write.mode("overwrite").parquet(f"{path}/nodes")
    ids = graph.nodes.select("id")
    sound = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    sound.repartition("type").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    graph.nodes.sparkSession.createDataFrame([("format", "graph-v1"), ("project", path.rstrip("/").rsplit("/", 1)[-1])], "key string, value string").write.mode("overwrite").parquet(f"{path}/meta")


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_json(graph: Graph, path: str) -> None:
    """Nodes and edges as JSON lines, in order."""
    graph.nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.orderBy("type", "src", "dst").write.mode("overwrite").json(f"{path}/edges")


def write_flat(graph: Graph, path: str) -> None:
    """For a drawing: nodes with a colour and a size, edges with a dash, and the counts by kind."""
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    nodes = graph.nodes.select("id", F.col("label").alias("group"), "name", F.coalesce(colour[F.col("label")], F.lit("#888888")).alias("colour"), F.when(F.col("label") == "SqlObject", 4 + F.coalesce("complexity", F.lit(1))).otherwise(4).cast("bigint").alias("size"))
    edges = graph.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.col("type").isin("DERIVES_FROM", "AFFECTS").alias("dashed"))
    for name, rows in (("nodes", nodes), ("links", edges), ("counts", counts_by_kind(graph))):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def _xml(c):
    c = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    for found, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(found), F.lit(put))
    return c


def _lines(sections: list[DataFrame], path: str) -> None:
    """Write sections of (key, line), each in the order of its keys, as text; the part files one after the other are the whole."""
    rows = None
    for i, section in enumerate(sections):
        one = section.select(F.lit(i).alias("section"), "key", "line")
        rows = one if rows is None else rows.union(one)
    rows.orderBy("section", "key", "line").select("line").write.mode("overwrite").text(path)


def _text(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"{i:04}", line) for i, line in enumerate(lines)], "key string, line string")


def write_graphml(graph: Graph, path: str) -> None:
    """A folder of text files that are a GraphML document one after the other, in the order of their names: executors write
    it, and none holds more than its part."""
    spark, keys = graph.nodes.sparkSession, [c for c in graph.nodes.columns if c != "id"]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in keys]
    head += ['<key id="type" for="edge" attr.name="type" attr.type="string"/>', '<graph edgedefault="directed">']
    data = F.concat_ws("", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f'<data key="{k}">'), F.regexp_replace(_xml(k), r"[\r\n]", " "), F.lit("</data>"))) for k in keys))
    nodes = graph.nodes.select(F.col("id").alias("key"), F.concat(F.lit('<node id="'), _xml("id"), F.lit('">'), data, F.lit("</node>")).alias("line"))
    ends = F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="type">'), "type", F.lit("</data></edge>"))
    edges = graph.edges.select(F.concat_ws("\0", "type", "src", "dst").alias("key"), ends.alias("line"))
    _lines([_text(spark, head), nodes, edges, _text(spark, ["</graph>", "</graphml>"])], path)


def write_document(graph: Graph, path: str) -> None:
    """A folder of text files that are one JSON document one after the other: {"nodes": [...], "relationships": [...]}, each entry
    with its labels, its own properties and, of a relationship, its number."""
    from ..plans.build import numbered

    spark = graph.nodes.sparkSession
    own = [c for c in graph.nodes.columns if c not in ("id", "label")]
    node = F.to_json(F.struct("id", F.array("label").alias("labels"), F.struct(*own).alias("properties")))
    more = [c for c in graph.edges.columns if c not in ("src", "dst", "type", "owner")]
    edge = F.to_json(F.struct("id", "type", F.col("src").alias("startNodeId"), F.col("dst").alias("endNodeId"), F.struct(*more).alias("properties")))

    def listed(rows: DataFrame) -> DataFrame:
        # every entry but the first, which is the one of the least key, has a comma before it
        least = rows.agg(F.min("key").alias("least"))
        return rows.join(F.broadcast(least)).select("key", F.concat(F.when(F.col("key") == F.col("least"), "").otherwise(","), "line").alias("line"))

    nodes = listed(graph.nodes.select(F.col("id").alias("key"), node.alias("line")))
    edges = listed(numbered(graph.edges).select(F.lpad(F.substring("id", 2, 20), 20, "0").alias("key"), edge.alias("line")))
    _lines([_text(spark, ['{"nodes": [']), nodes, _text(spark, ['], "relationships": [']), edges, _text(spark, ["]}"])], path)


def write_results(facts: DataFrame, path: str) -> None:
    """The facts of each object as a line of JSON: what was read from its text, before any graph is built."""
    facts.select("id", F.to_json(F.struct(*facts.columns)).alias("value")).orderBy("id").select("value").write.mode("overwrite").text(path)


def object_documents(graph: Graph) -> DataFrame:
    """(id, file, hash, document): an object with its edges as JSON, the unit of the object store."""
    edges = graph.edges.where("owner IS NOT NULL").groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_set(F.struct("type", "src", "dst"))).alias("edges"))
    rows = graph.label("SqlObject").join(edges, "id", "left")
    document = F.to_json(F.struct(*rows.columns))
    return rows.select("id", F.concat(slug("id"), F.lit("-"), F.substring(F.sha1("id"), 1, 8)).alias("file"), F.sha1(document).alias("hash"), document.alias("document"))


def write_store(graph: Graph, path: str) -> None:
    object_documents(graph).write.mode("overwrite").parquet(path)


def update_store(graph: Graph, old_path: str, new_path: str) -> DataFrame:
    """Write the store's next state: unchanged documents are taken over, changed and new ones written, removed ones
    dropped. (id, change) of what is not unchanged."""
    old, new = graph.nodes.sparkSession.read.parquet(old_path), object_documents(graph)
    changes = old.select("id", F.col("hash").alias("h0")).join(new.select("id", F.col("hash").alias("h1")), "id", "full")
    changes = changes.select("id", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed").alias("change")).where("change IS NOT NULL")
    fresh = changes.where("change <> 'removed'").select("id")
    old.join(changes.select("id"), "id", "left_anti").unionByName(new.join(fresh, "id", "left_semi")).write.mode("overwrite").parquet(new_path)
    return changes


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def text_report(graph: Graph, object_id: str | None = None) -> str:
    """The database, or one object, in lines."""
    from ..operators.audit import describe_objects, hot_tables, ranking

    if object_id:
        row = describe_objects(graph).where(F.col("id") == object_id).first()
        return "\n".join(f"{k}: {v}" for k, v in row.asDict().items()) if row else f"{object_id}: not found"
    lines = [f"{r.kind} {r.name}: {r.n}" for r in counts_by_kind(graph).orderBy("kind", F.desc("n"), "name").collect()]
    lines += ["", "most complex:"] + [f"  {r.name} ({r.complexity})" for r in ranking(graph, 10).collect()]
    return "\n".join(lines + ["", "most used tables:"] + [f"  {r.name} ({r.degree})" for r in hot_tables(graph).collect()])


def mermaid(edges: DataFrame, title: str = "flowchart LR") -> DataFrame:
    """(text): a drawing of (src, dst) edges, a line each, in order."""
    line = F.concat(F.lit("  "), slug("src"), F.lit("[\""), "src", F.lit("\"] --> "), slug("dst"), F.lit("[\""), "dst", F.lit("\"]"))
    return edges.select(line.alias("l")).distinct().agg(F.concat(F.lit(title + "\n"), F.array_join(F.sort_array(F.collect_list("l")), "\n")).alias("text"))


@dataclass(frozen=True)
class Sink:
    """A way to write a graph: its name on a command line, the ending of what it writes, and the function."""

    flag: str
    extension: str
    write: Callable[[Graph, str], None]


SINKS = {
    s.flag: s
    for s in (
        Sink("parquet", ".graph", write_parquet), Sink("json", ".jsonl", write_json), Sink("document", ".json", write_document), Sink("flat", ".flat", write_flat),
        Sink("graphml", ".graphml", write_graphml), Sink("store", ".store", write_store),
    )
}


def write(graph: Graph, path: str, sink: str = "parquet") -> None:
    SINKS[sink].write(graph, path)


def snapshot(graph: Graph) -> DataFrame:
    """(id, hash) of all objects."""
    return content_hash(graph.label("SqlObject"))
