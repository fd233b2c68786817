"""The property graph as tables, and its closed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = {
    "SqlObject", "Table", "Column", "Step", "Parameter", "Variable", "Action", "Rule", "BusinessRule", "Workflow", "Trigger", "Database", "Schema",
    "Project", "Package", "File", "Namespace", "Class", "Method", "EntryPoint", "ExternalSystem", "Assembly",
}
EDGE_TYPES = {
    "HAS_PARAMETER", "DECLARES", "ASSIGNED_FROM", "HAS_STEP", "ACTION", "BUILDS_SQL_FROM", "USES_VARIABLE", "TARGETS", "WRITES_TO", "READS_FROM",
    "READS_COLUMN", "WRITES_COLUMN", "FILTERS_ON", "DERIVES_FROM", "CONDITIONED_BY", "NESTED_IN", "GOVERNS", "CALLS", "AFFECTS", "HAS_COLUMN", "FK_TO",
    "REFERENCES", "BELONGS_TO", "WORKFLOW_WRITES_TO", "CONTAINS", "HAS_RULE", "CONSTRAINS", "CREATES", "ON", "DEPENDS_ON", "EXECUTES_SQL", "MAPS_TO", "ALIAS_OF",
    "IMPLEMENTS", "EXPOSES", "CALLS_EXTERNAL",
}
IMPACT_EDGES = ("READS_FROM", "WRITES_TO", "CALLS", "FK_TO", "TARGETS", "EXECUTES_SQL", "DEPENDS_ON", "REFERENCES")
COLUMN_EDGES = ("READS_COLUMN", "WRITES_COLUMN", "FILTERS_ON")
ADDRESSABLE = ("SqlObject", "Table", "Column", "Workflow", "Trigger", "Class", "Method", "EntryPoint")
TABLE_EDGES = ("READS_FROM", "WRITES_TO")

#: name -> type of all node columns; a graph may lack some, which are then null.
NODE_COLUMNS = {
    "id": "string", "label": "string", "name": "string", "db": "string", "schema_name": "string", "object_type": "string", "complexity": "bigint",
    "has_transaction": "boolean", "has_error_handling": "boolean", "has_cursor": "boolean", "dynamic_sql_calls": "bigint", "parse_error": "string",
    "action": "string", "nesting": "bigint", "is_dynamic": "boolean", "dynamic_sql": "string", "select_star": "boolean", "line": "bigint",
    "data_type": "string", "is_nullable": "boolean", "is_primary_key": "boolean", "ordinal": "bigint",
}
EDGE_COLUMNS = {"src": "string", "dst": "string", "type": "string", "action_type": "string", "resolution": "string", "via_view": "string", "via": "string", "hops": "bigint", "inferred": "boolean", "confidence": "double", "bound_to": "string"}


@dataclass(frozen=True)
class Graph:
    """`nodes` and `edges`; edges carry `owner`, the object a step belongs to, so no query splits ids again."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> Graph:
        def fit(df: DataFrame, columns: dict[str, str]) -> DataFrame:
            return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))

        edges = fit(edges, EDGE_COLUMNS)
        return Graph(fit(nodes, NODE_COLUMNS), edges.withColumn("owner", owner("src")))

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))


def owner(column: str):
    """The part of a step's id before "#"."""
    return F.substring_index(column, "#", 1)
