"""Roll-ups, rankings and audits of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import EDGE_TYPES, LABELS, TABLE_EDGES, Graph
from .impact import lineage_roots


def step_rollup(graph: Graph) -> DataFrame:
    """(id, total_steps, dynamic_steps, unresolved_steps, max_nesting) of every object that has steps."""
    steps = graph.label("Step").select(F.substring_index("id", "#", 1).alias("id"), "nesting", F.coalesce("is_dynamic", F.lit(False)).alias("d"), "dynamic_sql")
    return steps.groupBy("id").agg(F.count("*").alias("total_steps"), F.count_if("d").alias("dynamic_steps"), F.count_if(F.col("d") & F.col("dynamic_sql").isNull()).alias("unresolved_steps"), F.max("nesting").alias("max_nesting"))


def _objects(graph: Graph) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_steps", "dynamic_steps", "unresolved_steps", "max_nesting")]
    return graph.label("SqlObject").join(step_rollup(graph), "id", "left").select("id", "name", "db", "schema_name", "object_type", "complexity", "has_transaction", "has_error_handling", "has_cursor", "dynamic_sql_calls", "parse_error", *zero)


def coupling(graph: Graph) -> DataFrame:
    """(name, fan_out, fan_in) of objects that call or are called."""
    calls = graph.type("CALLS")
    out, into = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out")), calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    both = out.join(into, "id", "full").na.fill(0)
    return both.join(graph.label("SqlObject").select("id", "name"), "id").select("name", "fan_out", "fan_in")


def ranking(graph: Graph, top: int = 5) -> DataFrame:
    calls = graph.type("CALLS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("calls_out"))
    rows = _objects(graph).join(calls, "id", "left").na.fill(0, ["calls_out"])
    return rows.orderBy(F.desc("complexity"), F.desc("max_nesting"), "name").limit(top).select("name", "complexity", "total_steps", "dynamic_steps", "max_nesting", "calls_out")


def criticality(graph: Graph, top: int = 10) -> DataFrame:
    written = graph.type("WRITES_TO").groupBy(F.col("owner").alias("id")).agg(F.count_distinct("dst").alias("tables_written"))
    return written.join(graph.label("SqlObject").select("id", "name", "complexity"), "id").orderBy(F.desc("tables_written"), "name").limit(top).select("name", "tables_written", "complexity")


def workflow_footprint(graph: Graph, writes: DataFrame) -> DataFrame:
    names = graph.label("Workflow").select(F.col("id").alias("workflow"), "name")
    return writes.groupBy("workflow").agg(F.count_distinct("table").alias("tables_written")).join(names, "workflow").select(F.col("name").alias("workflow"), "tables_written")


def hot_tables(graph: Graph, top: int = 10) -> DataFrame:
    degree = graph.type(*TABLE_EDGES).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return degree.join(graph.label("Table").select("id", "name"), "id").orderBy(F.desc("degree"), "name").limit(top).select("name", "degree")


def without_error_handling(graph: Graph) -> DataFrame:
    return graph.label("SqlObject").where("NOT has_error_handling").select("name")


def with_cursors(graph: Graph) -> DataFrame:
    return graph.label("SqlObject").where("has_cursor").select("name")


def dynamic_sql(graph: Graph) -> DataFrame:
    return _objects(graph).where("dynamic_steps > 0").select("name", "dynamic_steps", "total_steps")


def destructive_steps(graph: Graph) -> DataFrame:
    return graph.label("Step").where(F.col("action").isin("DELETE", "TRUNCATE", "DROP")).groupBy("action").agg(F.count("*").alias("n"))


def inventory(graph: Graph) -> DataFrame:
    return graph.label("SqlObject").groupBy("object_type", "schema_name").agg(F.count("*").alias("n"))


def schema_governance(graph: Graph) -> DataFrame:
    columns = graph.label("Column").where("data_type IS NOT NULL")
    return columns.groupBy("data_type").agg(F.count("*").alias("columns"), F.count_if("is_nullable").alias("nullable"), F.count_if("is_primary_key").alias("primary_keys"))


def counts_by_kind(graph: Graph) -> DataFrame:
    """(kind, name, n): nodes by label and edges by type."""
    nodes = graph.nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return nodes.union(graph.edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge"), "name", "n"))


def store_info(graph: Graph, generated_at: str, today: str) -> DataFrame:
    """counts_by_kind with the store's age in days and whether it is older than 30."""
    age = F.datediff(F.to_date(F.lit(today)), F.to_date(F.lit(generated_at)))
    return counts_by_kind(graph).withColumn("age_days", age.cast("bigint")).withColumn("stale", age > 30)


def unknown_kinds(graph: Graph) -> DataFrame:
    """Labels and edge types outside the vocabulary, which are kept but reported."""
    return counts_by_kind(graph).where(~((F.col("kind") == "node") & F.col("name").isin(*LABELS) | (F.col("kind") == "edge") & F.col("name").isin(*EDGE_TYPES)))


def describe_objects(graph: Graph, limit: int = 10) -> DataFrame:
    """A card of each object: its numbers, and the first tables read and written, calls and callers, as sorted text."""
    def listed(edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
        found = edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(value)).alias("s"))
        return found.select("id", F.size("s").cast("bigint").alias(f"n_{name}"), F.array_join(F.slice("s", 1, limit), ", ").alias(name))

    out = _objects(graph)
    for part in (listed(graph.type("READS_FROM"), "owner", "dst", "reads"), listed(graph.type("WRITES_TO"), "owner", "dst", "writes"), listed(graph.type("CALLS"), "src", "dst", "calls"), listed(graph.type("CALLS"), "dst", "src", "callers")):
        out = out.join(part, "id", "left")
    names = [f"n_{n}" for n in ("reads", "writes", "calls", "callers")]
    return out.na.fill(0, names).select("id", "object_type", "complexity", "total_steps", "dynamic_steps", "unresolved_steps", "max_nesting", "has_transaction", "has_error_handling", "has_cursor", *names, "reads", "writes", "calls", "callers")


def blind_spots(graph: Graph) -> DataFrame:
    """Objects with steps of unresolved dynamic SQL, and the share of all unresolved steps each has in percent."""
    rows = _objects(graph).where("unresolved_steps > 0")
    total = rows.agg(F.sum("unresolved_steps").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("id", "unresolved_steps", "dynamic_steps", F.round(100.0 * F.col("unresolved_steps") / F.col("t"), 4).alias("percent"))


def macro_edges(graph: Graph, foreign_keys: bool = False) -> DataFrame:
    """Distinct (src, dst, type) between objects and tables."""
    types = ["CALLS", *TABLE_EDGES] + (["FK_TO"] if foreign_keys else [])
    return graph.type(*types).select(F.col("owner").alias("src"), "dst", "type").distinct()


def degrees(graph: Graph, foreign_keys: bool = False) -> DataFrame:
    # both ends of an edge at once, so distinct edges are made once
    return macro_edges(graph, foreign_keys).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hotspots(graph: Graph, top: int = 10) -> DataFrame:
    """Objects by complexity times degree; zero scores are left out, ties go to more unresolved steps."""
    rows = _objects(graph).join(degrees(graph), "id").withColumn("score", F.col("complexity") * F.col("degree")).where("score > 0")
    return rows.orderBy(F.desc("score"), F.desc("unresolved_steps"), "id").limit(top).select("id", "score", "complexity", "degree", "unresolved_steps")


def dependent_views(graph: Graph) -> DataFrame:
    """(table, views): how many tables' columns derive, in the end, from the columns of a table."""
    table = lambda c: F.lower(F.substring_index(c, ":column:", 1))
    roots = lineage_roots(graph).select(table("root").alias("table"), table("column").alias("view")).where("table <> view").distinct()
    return roots.groupBy("table").agg(F.count("*").alias("views"))


def blind_spot_severity(graph: Graph) -> DataFrame:
    """(id, severity): dependent views of the tables that an object writes, times its unresolved steps."""
    writes = graph.type("WRITES_TO").select(F.col("owner").alias("id"), F.lower("dst").alias("table")).distinct()
    views = writes.join(dependent_views(graph), "table").groupBy("id").agg(F.sum("views").alias("views"))
    return _objects(graph).where("unresolved_steps > 0").join(views, "id").select("id", "views", (F.col("views") * F.col("unresolved_steps")).alias("severity"))


def orphan_tables(graph: Graph) -> DataFrame:
    used = graph.type("READS_FROM", "WRITES_TO", "FK_TO", "REFERENCES")
    ends = used.select(F.col("dst").alias("id")).union(used.select("src"))
    return graph.label("Table").join(ends, "id", "left_anti").select("id", "name")


def lineage_coverage(graph: Graph) -> DataFrame:
    """(written, with_lineage, percent) of written columns; percent is null if none is written."""
    written = graph.type("WRITES_COLUMN").select(F.col("dst").alias("id")).distinct()
    known = graph.type("DERIVES_FROM").select(F.col("src").alias("id")).distinct().withColumn("known", F.lit(True))
    total = written.join(known, "id", "left").agg(F.count("*").alias("written"), F.count("known").alias("with_lineage"))
    return total.withColumn("percent", F.when(F.col("written") > 0, F.round(100.0 * F.col("with_lineage") / F.col("written"), 1)))


def opaque_writes(graph: Graph) -> DataFrame:
    """Objects that write tables and run unresolved dynamic SQL: (id, tables, unresolved_steps, severity)."""
    tables = graph.type("WRITES_TO").groupBy(F.col("owner").alias("id")).agg(F.count_distinct("dst").alias("tables"))
    severity = F.when(F.col("unresolved_steps") >= 10, "critical").when(F.col("unresolved_steps") >= 3, "high").otherwise("medium")
    return _objects(graph).where("unresolved_steps > 0").join(tables, "id").select("id", "tables", "unresolved_steps", severity.alias("severity"))


def catalog_driven(graph: Graph, catalog: str = "sys.") -> DataFrame:
    """Objects with dynamic steps that read tables whose name begins with `catalog`: (id, catalog_tables)."""
    reads = graph.type("READS_FROM").withColumn("t", F.substring_index("dst", ":table:", -1)).where(F.col("t").startswith(catalog))
    by = reads.groupBy(F.col("owner").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("t")), ", ").alias("catalog_tables"))
    return _objects(graph).where("dynamic_steps > 0").join(by, "id").select("id", "catalog_tables")


def temporal_history(graph: Graph, suffix: str = "_Archive") -> DataFrame:
    """(table, history): tables that stand beside one of the same name and the suffix."""
    tables = graph.label("Table").select("id", F.lower("name").alias("n"))
    history = tables.select(F.col("id").alias("history"), F.col("n").alias("h"))
    return tables.join(history, F.concat("n", F.lit(suffix.lower())) == F.col("h")).select(F.col("id").alias("table"), "history")


def foreign_key_counts(graph: Graph) -> DataFrame:
    return graph.type("FK_TO").groupBy(F.col("src").alias("table")).agg(F.count("*").alias("n"))


def writes_by_rule(graph: Graph) -> DataFrame:
    """(object, table, governed): whether all writes of an object to a table stand under conditions."""
    writes = graph.type("WRITES_TO").select("src", "owner", F.col("dst").alias("table"))
    nested = graph.label("Step").select(F.col("id").alias("src"), (F.coalesce("nesting", F.lit(0)) > 0).alias("g"))
    return writes.join(nested, "src").groupBy(F.col("owner").alias("object"), "table").agg(F.bool_and("g").alias("governed"))


def columns_without_lineage(graph: Graph) -> DataFrame:
    written = graph.type("WRITES_COLUMN").select(F.col("dst").alias("column")).distinct()
    return written.join(graph.type("DERIVES_FROM").select(F.col("src").alias("column")), "column", "left_anti")


def taint(graph: Graph) -> DataFrame:
    """(column, variable, step): columns that flow through a variable into dynamic SQL."""
    assigned = graph.type("ASSIGNED_FROM").select(F.col("src").alias("variable"), F.col("dst").alias("column"))
    built = graph.type("BUILDS_SQL_FROM").select(F.col("src").alias("step"), F.col("dst").alias("variable"))
    return assigned.join(built, "variable").select("column", "variable", "step").distinct()


def write_hotspots(graph: Graph, top: int = 10) -> DataFrame:
    by = graph.type("WRITES_TO").groupBy(F.col("dst").alias("table")).agg(F.count_distinct("owner").alias("writers"), F.array_join(F.sort_array(F.collect_set("action_type")), ", ").alias("actions"))
    return by.orderBy(F.desc("writers"), "table").limit(top)


def dynamic_surface(graph: Graph) -> DataFrame:
    """(name, dynamic_steps, unknown): objects that run dynamic SQL, and how many of these steps have no known text."""
    steps = graph.label("Step").where("is_dynamic").select(F.substring_index("id", "#", 1).alias("id"), "dynamic_sql")
    by = steps.groupBy("id").agg(F.count("*").alias("dynamic_steps"), F.count_if(F.col("dynamic_sql").isNull()).alias("unknown"))
    return graph.label("SqlObject").select("id", "name").join(by, "id").select("name", "dynamic_steps", "unknown")


def rule_frequency(graph: Graph) -> DataFrame:
    """(id, name, steps): conditions by the number of steps that stand right below them."""
    by = graph.type("GOVERNS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("steps"))
    return graph.label("Rule").select("id", "name").join(by, "id")


def invariants(graph: Graph) -> DataFrame:
    """(check_name, violations): what must be 0 in a sound graph.

    Nodes and edges are read once each. All that a row says of an id, its own or one that it names, goes into counters by id: one
    shuffle answers what would be a join a check, and ids that many edges name are added up before it."""
    counters = ("node", "object", "table", "end", "step", "column", "write", "negative")

    def said(id: Column, **counts: Column | int) -> Column:
        return F.struct(id.alias("id"), *((counts[c] if isinstance(counts.get(c), Column) else F.lit(counts.get(c, 0))).cast("bigint").alias(c) for c in counters))

    id, label = F.col("id"), F.col("label")
    is_ = lambda name: F.coalesce(label == name, F.lit(False))
    negative = is_("SqlObject") & F.coalesce(F.col("complexity") < 0, F.lit(False))
    of_nodes = F.array(
        said(id, node=1, object=is_("SqlObject").cast("int"), table=is_("Table").cast("int"), negative=negative.cast("int")),
        F.when(is_("Step"), said(F.substring_index("id", "#", 1), step=1)),
        F.when(is_("Column"), said(F.substring_index("id", ":column:", 1), column=1)),
    )
    writes = F.coalesce(F.col("type") == "WRITES_TO", F.lit(False)).cast("int")
    of_edges = F.array(said(F.col("src"), end=1), said(F.col("dst"), end=1, write=writes))
    rows = graph.nodes.select(F.explode(of_nodes).alias("r")).union(graph.edges.select(F.explode(of_edges).alias("r"))).where("r IS NOT NULL").select("r.*")
    by = rows.groupBy("id").agg(*(F.sum(c).alias(c) for c in counters))
    # a null id is no end, owner or table of anything
    lacks = lambda what, of: F.coalesce(F.sum(F.when(id.isNull() | (F.col(of) == 0), F.col(what))), F.lit(0))
    checks = {
        "duplicate ids": F.count_if(F.col("node") > 1),
        "edges without an end": lacks("end", "node"),
        "null ids": F.coalesce(F.sum(F.when(id.isNull(), F.col("node"))), F.lit(0)),
        "steps without an owner": lacks("step", "object"),
        "columns without a table": lacks("column", "table"),
        "writes to what is no table": lacks("write", "table"),
        "negative complexity": F.coalesce(F.sum("negative"), F.lit(0)),
    }
    return by.agg(*(n.alias(name) for name, n in checks.items())).unpivot([], list(checks), "check_name", "violations")
