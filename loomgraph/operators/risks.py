"""The rule engine: bad practices in objects and tables, as (severity, category, rule, component, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import TABLE_EDGES, Graph
from .audit import _objects
from .closure import stored

SEVERITIES = ("critical", "high", "medium", "low", "info")


def _accesses(graph: Graph) -> DataFrame:
    """(id, dst, type, action_type, n): reads and writes of objects, counted. The rules of objects and of tables both count on
    from here, so edges are grouped once."""
    return stored(graph.type(*TABLE_EDGES).groupBy(F.col("owner").alias("id"), "dst", "type", "action_type").agg(F.count("*").alias("n")))


def object_features(graph: Graph, accesses: DataFrame | None = None) -> DataFrame:
    """One row an object with all that the rules look at."""
    accesses = _accesses(graph) if accesses is None else accesses
    steps = graph.label("Step").select(F.substring_index("id", "#", 1).alias("id"), F.col("id").alias("step"), "action", F.coalesce("select_star", F.lit(False)).alias("star"))
    by_step = steps.groupBy("id").agg(F.bool_or("star").alias("star"), F.bool_or(F.col("action") == "TRUNCATE").alias("truncates"))
    # only steps that change rows are held against the filters
    filtered = graph.type("FILTERS_ON").select(F.col("src").alias("step"))
    unfiltered = steps.where(F.col("action").isin("UPDATE", "DELETE")).join(filtered, "step", "left_anti").select("id").distinct().withColumn("unfiltered", F.lit(True))
    per_table = accesses.where("type = 'WRITES_TO'").groupBy("id", "dst").agg(F.sum("n").alias("n"))
    writes = per_table.groupBy("id").agg(F.count("*").alias("tables_written"), F.max("n").alias("most_writes"))
    called = graph.type("CALLS").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    built = graph.type("BUILDS_SQL_FROM").select(F.col("dst").alias("variable"), F.col("owner").alias("id")).distinct()
    injected = built.join(graph.type("ASSIGNED_FROM").select(F.col("src").alias("variable")), "variable", "left_semi").select("id").distinct().withColumn("injection", F.lit(True))
    used = graph.type("USES_VARIABLE", "BUILDS_SQL_FROM").select(F.col("dst").alias("variable")).union(graph.type("ASSIGNED_FROM").select("src")).distinct()
    idle = graph.type("DECLARES").select(F.col("src").alias("id"), F.col("dst").alias("variable")).join(used, "variable", "left_anti").groupBy("id").agg(F.count("*").alias("idle"))
    out = _objects(graph)
    for part in (by_step, unfiltered, writes, called, injected, idle):
        out = out.join(part, "id", "left")
    flags = ["star", "unfiltered", "truncates", "called", "injection", "has_transaction", "has_error_handling", "has_cursor"]
    numbers = ["tables_written", "most_writes", "idle", "dynamic_sql_calls", "complexity"]
    return out.select("id", "name", "parse_error", "total_steps", "max_nesting", *(F.coalesce(f, F.lit(False)).alias(f) for f in flags), *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers))


def _found(rows: DataFrame, rules: list[tuple[Column, str, str, str, Column]]) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("category"), F.lit(r).alias("rule"), d.cast("string").alias("detail"))) for when, s, c, r, d in rules)))
    return rows.select(F.col("id").alias("component"), F.explode(hits).alias("f")).select("f.severity", "f.category", "f.rule", "component", "f.detail")


def object_risks(graph: Graph, accesses: DataFrame | None = None) -> DataFrame:
    c, none = F.col, F.lit("")
    leaf = F.substring_index("name", ".", -1)
    unsafe = c("has_transaction") & ~c("has_error_handling")
    complexity = F.greatest(c("complexity"), F.lit(1))
    rules = [
        (c("injection"), "critical", "security", "sql_injection", none),
        (~c("injection") & (c("dynamic_sql_calls") > 0), "high", "security", "dynamic_sql", c("dynamic_sql_calls")),
        (c("has_cursor") & unsafe, "high", "robustness", "cursor_in_transaction_without_handler", none),
        (~c("has_cursor") & unsafe, "high", "robustness", "transaction_without_handler", none),
        ((c("tables_written") > 0) & ~c("has_transaction") & ~c("has_error_handling"), "medium", "robustness", "unprotected_write", c("tables_written")),
        (c("has_cursor"), "medium", "performance", "cursor", none),
        (F.lower(leaf).startswith("sp_"), "medium", "performance", "sp_prefix", none),
        (c("most_writes") >= 3, "medium", "performance", "repeated_writes", c("most_writes")),
        (c("star"), "low", "performance", "select_star", none),
        (c("unfiltered"), "high", "integrity", "change_without_where", none),
        (c("truncates"), "medium", "integrity", "truncate", none),
        (complexity >= 10, "medium", "maintainability", "complexity", complexity),
        (complexity.between(6, 9), "low", "maintainability", "complexity", complexity),
        (c("max_nesting") >= 4, "medium", "maintainability", "nesting", c("max_nesting")),
        (c("max_nesting") == 3, "low", "maintainability", "nesting", c("max_nesting")),
        (c("idle") > 0, "low", "maintainability", "unused_variable", c("idle")),
        (~c("called") & (c("tables_written") == 0) & (c("total_steps") > 0) & F.lower("name").rlike(r"\bufn|\bfn|function"), "low", "maintainability", "dead_code", none),
        (c("tables_written") >= 5, "medium", "design", "does_too_much", c("tables_written")),
        (c("parse_error") != "", "info", "quality", "parse_error", c("parse_error")),
    ]
    return _found(object_features(graph, accesses), rules)


def table_features(graph: Graph, accesses: DataFrame | None = None) -> DataFrame:
    accesses = _accesses(graph) if accesses is None else accesses
    columns = graph.label("Column").select(F.substring_index("id", ":column:", 1).alias("id"), F.coalesce("is_nullable", F.lit(True)).alias("nullable"), F.coalesce("is_primary_key", F.lit(False)).alias("pk"))
    by = columns.groupBy("id").agg(F.count("*").alias("columns"), F.bool_or("pk").alias("has_pk"), F.bool_and("nullable").alias("all_nullable"))
    # a row of accesses is one action of one object on a table; those without an action don't count as writers
    writes, reads = F.col("type") == "WRITES_TO", F.col("type") == "READS_FROM"
    used = accesses.groupBy(F.col("dst").alias("id")).agg(F.count_if(writes & F.col("action_type").isNotNull() & F.col("id").isNotNull()).alias("writers"), F.sum(F.when(reads, F.col("n"))).alias("readers"))
    out = graph.label("Table").select("id").join(by, "id", "left").join(used, "id", "left")
    return out.select("id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("columns", "writers", "readers")), *(F.coalesce(f, F.lit(False)).alias(f) for f in ("has_pk", "all_nullable")))


def table_risks(graph: Graph, accesses: DataFrame | None = None) -> DataFrame:
    c, none = F.col, F.lit("")
    rules = [
        ((c("columns") > 0) & ~c("has_pk"), "medium", "integrity", "no_primary_key", none),
        (c("writers") >= 4, "medium", "design", "table_coupling", c("writers")),
        ((c("writers") > 0) & (c("readers") == 0) & (c("columns") > 0), "low", "design", "written_never_read", none),
        ((c("columns") > 0) & c("all_nullable"), "low", "integrity", "fully_nullable", none),
        (c("columns") >= 12, "low", "design", "wide_table", c("columns")),
    ]
    return _found(table_features(graph, accesses), rules)


def risks(graph: Graph, severity: str | None = None, executed: DataFrame | None = None) -> DataFrame:
    """All findings, of one severity if given; with `executed` (id), whether there is evidence that the component runs."""
    accesses = _accesses(graph)
    found = object_risks(graph, accesses).union(table_risks(graph, accesses))
    if severity:
        found = found.where(F.col("severity") == severity)
    if executed is not None:
        seen = executed.select(F.col("id").alias("component")).distinct().withColumn("seen", F.lit(True))
        found = found.join(seen, "component", "left").select("severity", "category", "rule", "component", "detail", F.coalesce("seen", F.lit(False)).alias("executed"))
    return found


def risk_counts(graph: Graph) -> DataFrame:
    return risks(graph).groupBy("severity", "category", "rule").agg(F.count("*").alias("n"))
