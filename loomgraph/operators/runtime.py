"""Runtime evidence: query plans, captured events, and what they say about the graph."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import TABLE_EDGES, Graph

SYSTEM_SCHEMAS = ("sys", "information_schema", "mssqlsystemresource")
_WRITERS = ("insert", "update", "delete", "merge")


def _accesses(xml: str | None) -> list[dict]:
    """Objects that a plan touches, each with the procedure and the operator around it. A text that is no XML has none."""
    try:
        root = ElementTree.fromstring(xml or "<none/>")
    except ElementTree.ParseError:
        return []
    out, stack = [], [(root, None, {})]
    while stack:
        node, proc, operator = stack.pop()
        kind = node.tag.rsplit("}", 1)[-1]
        if kind == "StoredProc":
            proc = node.get("ProcName")
        elif kind == "RelOp":
            operator = node.attrib
        elif kind == "Object" and node.get("Table"):
            out.append({"proc": proc, "db": node.get("Database"), "schema": node.get("Schema"), "table": node.get("Table"), "operation": operator.get("PhysicalOp"), "estimate": operator.get("EstimateRows"), "actual": operator.get("ActualRows")})
        stack.extend((child, proc, operator) for child in node)
    return out


def plan_access(plans: DataFrame) -> DataFrame:
    """(proc, db, schema, table, is_write, operation, estimate_rows, actual_rows) of plan documents (xml).

    System schemas, work tables and temporary tables are left out; of several accesses of one kind to a table that
    with the most actual rows stays."""
    @F.pandas_udf("array<struct<proc:string,db:string,schema:string,table:string,operation:string,estimate:string,actual:string>>")
    def read(xml: pd.Series) -> pd.Series:
        return xml.map(_accesses)

    rows = plans.select(F.explode(read("xml")).alias("a")).select("a.*")
    bare = lambda c: F.regexp_replace(c, r"[\[\]]", "")
    rows = rows.select(bare("proc").alias("proc"), bare("db").alias("db"), bare("schema").alias("schema"), bare("table").alias("table"), "operation", F.expr("try_cast(estimate as double)").cast("bigint").alias("estimate_rows"), F.expr("try_cast(actual as bigint)").alias("actual_rows"))
    write = F.coalesce(F.lower("operation").rlike("|".join(_WRITERS)), F.lit(False))
    rows = rows.where(~F.lower("schema").isin(*SYSTEM_SCHEMAS) & ~F.lower("table").startswith("worktable") & ~F.col("table").startswith("#")).withColumn("is_write", write)
    best = F.max_by(F.struct("operation", "estimate_rows", "actual_rows"), F.struct(F.coalesce("actual_rows", F.lit(-1)), "operation"))
    by = rows.groupBy("proc", "db", "schema", "table", "is_write").agg(best.alias("b"))
    return by.select("proc", "db", "schema", "table", "is_write", "b.operation", "b.estimate_rows", "b.actual_rows")


def match_tables(access: DataFrame, graph: Graph) -> DataFrame:
    """Accesses with the id of the table they mean: by database, schema and name, else schema and name, else by a name
    that is the only one."""
    tables = graph.label("Table").select("id", F.lower("db").alias("d"), F.lower("name").alias("n"), F.lower(F.substring_index("name", ".", -1)).alias("leaf"))
    a = access.withColumn("row", F.monotonically_increasing_id())
    three = a.join(tables.select("d", "n", F.col("id").alias("id3")), (F.lower("db") == F.col("d")) & (F.lower(F.concat_ws(".", "schema", "table")) == F.col("n")), "left").drop("d", "n")
    unique = lambda key, name: tables.groupBy(F.col(key).alias("k" + name)).agg(F.min("id").alias(name), F.count("*").alias("c" + name)).where(f"c{name} = 1")
    two = three.join(unique("n", "id2"), F.lower(F.concat_ws(".", "schema", "table")) == F.col("kid2"), "left")
    one = two.join(unique("leaf", "id1"), F.lower("table") == F.col("kid1"), "left")
    return one.select(*access.columns, F.coalesce("id3", "id2", "id1").alias("table_id"))


def enrich(graph: Graph, access: DataFrame) -> DataFrame:
    """(object, table, type, evidence): edges that plans confirm, and those they discover."""
    objects = graph.label("SqlObject").select(F.col("id").alias("object"), F.lower(F.substring_index("name", ".", -1)).alias("leaf"))
    seen = match_tables(access, graph).where("table_id IS NOT NULL").join(objects, F.lower("proc") == F.col("leaf"))
    seen = seen.select("object", F.col("table_id").alias("table"), F.when(F.col("is_write"), "WRITES_TO").otherwise("READS_FROM").alias("type")).distinct()
    known = graph.type(*TABLE_EDGES).select(F.col("owner").alias("object"), F.col("dst").alias("table"), "type").distinct().withColumn("known", F.lit(True))
    return seen.join(known, ["object", "table", "type"], "left").select("object", "table", "type", F.when(F.col("known"), "confirmed").otherwise("discovered").alias("evidence"))


def correlate(events: DataFrame) -> DataFrame:
    """(session_id, seq, procedure): the procedure that each event other than a procedure's belongs to.

    Per session in the order of (ts, seq): a procedure takes its nest level and ends those at its level or deeper; another
    event belongs to the deepest open procedure above or at its level, null if there is none."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, stack = [], []
        for r in rows.sort_values(["ts", "seq"]).itertuples():
            if r.object_type == "PROC":
                while stack and stack[-1][0] >= r.nest_level:
                    stack.pop()
                stack.append((r.nest_level, r.object_name))
            else:
                while stack and stack[-1][0] > r.nest_level:
                    stack.pop()
                out.append((r.session_id, r.seq, stack[-1][1] if stack else None))
        return pd.DataFrame(out, columns=["session_id", "seq", "procedure"])

    return events.select("session_id", "ts", "seq", "nest_level", "object_type", "object_name").groupBy("session_id").applyInPandas(run, "session_id bigint, seq bigint, procedure string")


def correlate_sql(events: DataFrame) -> DataFrame:
    """The same without Python: an event belongs to the last procedure before it, at its level or above, after which no
    procedure or event closed it; that is the last procedure among those with no smaller level in between."""
    order = Window.partitionBy("session_id").orderBy("ts", "seq")
    rows = events.withColumn("rn", F.row_number().over(order))
    procs = rows.where("object_type = 'PROC'").select("session_id", F.col("rn").alias("prn"), F.col("nest_level").alias("level"), "object_name")
    marks = rows.select("session_id", F.col("rn").alias("mrn"), F.when(F.col("object_type") == "PROC", F.col("nest_level")).otherwise(F.col("nest_level") + 1).alias("closes"))
    ends = procs.join(marks, "session_id").where("mrn > prn AND closes <= level").groupBy("session_id", "prn").agg(F.min("mrn").alias("ends"))
    spans = procs.join(ends, ["session_id", "prn"], "left")
    asked = rows.where("object_type <> 'PROC'").select("session_id", "seq", "rn")
    hit = asked.join(spans, "session_id").where("prn < rn AND (ends IS NULL OR rn < ends)").groupBy("session_id", "seq").agg(F.max_by("object_name", "prn").alias("procedure"))
    return asked.join(hit, ["session_id", "seq"], "left").select("session_id", "seq", "procedure")


def plan_documents(plans: DataFrame) -> DataFrame:
    """One document a procedure of rows (proc, xml), in the order of their text."""
    body = F.array_join(F.sort_array(F.collect_list("xml")), "")
    return plans.groupBy("proc").agg(F.concat(F.lit("<Plans>"), body, F.lit("</Plans>")).alias("document"))


def event_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events by session and minute, for a stream or a batch: (session_id, window_start, events, procedures)."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    by = timed.groupBy("session_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("object_type") == "PROC").alias("procedures"))
    return by.select("session_id", F.col("w.start").alias("window_start"), "events", "procedures")
