"""Sources of modules: rows (name, sql) with names `Database::schema.object`."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..tsql.lexer import SqlError, bare, tokens

_CREATE = r"(?is)\b(?:CREATE|ALTER)\s+(?:OR\s+ALTER\s+)?(?:PROC(?:EDURE)?|FUNCTION|VIEW|TRIGGER|TABLE|SYNONYM)\s+([\w.\[\]\"$#]+)"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects with a name and its SQL; keys in any case."""
    rows = spark.read.option("multiLine", True).json(path)
    by = {c.lower(): c for c in rows.columns}
    return rows.select(F.col(f"`{by['name']}`").alias("name"), F.col(f"`{by['sql']}`").alias("sql"))


def object_name(sql: str) -> str | None:
    """The name that the first definition of a batch gives, by its tokens, or by a pattern if they can't be read."""
    try:
        found = tokens(sql)
        for i, t in enumerate(found):
            if t.up in ("CREATE", "ALTER"):
                j = i + 1
                while j < len(found) and found[j].up in ("OR", "ALTER"):
                    j += 1
                if j < len(found) and found[j].up in ("PROC", "PROCEDURE", "FUNCTION", "VIEW", "TRIGGER", "TABLE", "SYNONYM"):
                    parts, j = [], j + 1
                    while j < len(found) and (found[j].kind in ("word", "name") or found[j].text == "."):
                        if found[j].text != "." and parts and found[j - 1].text != ".":
                            break
                        if found[j].text != ".":
                            parts.append(bare(found[j].text))
                        j += 1
                    if parts:
                        return ".".join(parts if len(parts) > 1 else ["dbo", *parts])
    except SqlError:
        match = re.search(_CREATE, sql)
        if match:
            name = re.sub(r"[\[\]\"]", "", match.group(1))
            return name if "." in name else f"dbo.{name}"
    return None


def split_batches(files: DataFrame) -> DataFrame:
    """(path, batch, sql) of rows (path, sql): what lies between lines of GO, which may have a number."""
    parts = F.split("sql", r"(?im)^[ \t]*GO(?:[ \t]+\d+)?[ \t]*;?[ \t]*\r?$")
    return files.select("path", F.posexplode(parts).alias("batch", "sql")).where(F.trim("sql") != "")


def with_names(batches: DataFrame, db: str) -> DataFrame:
    """(name, sql) of batches that define an object."""
    @F.pandas_udf("string")
    def named(sql: pd.Series) -> pd.Series:
        return sql.map(object_name)

    found = batches.withColumn("n", named("sql")).where("n IS NOT NULL")
    return found.select(F.concat(F.lit(f"{db}::"), "n").alias("name"), "sql")


def longest(modules: DataFrame) -> DataFrame:
    """One module a name: the longest, of equally long ones the first by text."""
    return modules.groupBy("name").agg(F.max_by("sql", F.struct(F.length("sql"), "sql")).alias("sql"))


def read_sql_files(spark: SparkSession, path: str, db: str, pattern: str = "*.sql") -> DataFrame:
    """Modules of all .sql files below a folder, in a file or by a pattern."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return longest(with_names(split_batches(files.select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("sql"))), db))


def read_jdbc(spark: SparkSession, url: str, db: str, **options: str) -> DataFrame:
    """Modules of a live server, by its catalog of module texts."""
    query = "SELECT s.name AS s, o.name AS o, m.definition AS sql FROM sys.sql_modules m JOIN sys.objects o ON o.object_id = m.object_id JOIN sys.schemas s ON s.schema_id = o.schema_id WHERE o.type IN ('P', 'FN', 'IF', 'TF', 'TR', 'V') UNION ALL SELECT 'database', t.name, m.definition FROM sys.triggers t JOIN sys.sql_modules m ON m.object_id = t.object_id WHERE t.parent_class = 0"
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return rows.select(F.concat(F.lit(f"{db}::"), "s", F.lit("."), "o").alias("name"), "sql")


def matching(modules: DataFrame, like: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Modules whose object's name is LIKE a pattern, or one of some."""
    name = F.substring_index("name", "::", -1)
    if like:
        modules = modules.where(name.like(like))
    return modules.where(name.isin(names)) if names else modules


def table_definitions(columns: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """(name, sql) modules with CREATE TABLE, of catalog rows (db, schema, table, column, type, nullable, ordinal) and, where there
    are such columns, identity, computed (its text) and key_ordinal (its place in the primary key); `foreign_keys` are rows
    (db, schema, table, key, ordinal, column, to_schema, to_table, to_column)."""
    has = lambda c: F.col(c) if c in columns.columns else F.lit(None)
    quoted = lambda c: F.concat(F.lit("["), F.replace(F.col(c), F.lit("]"), F.lit("]]")), F.lit("]"))
    plain = F.concat_ws(" ", quoted("column"), "type", F.when(F.coalesce(has("identity").cast("boolean"), F.lit(False)), "IDENTITY(1,1)"), F.when(F.col("nullable"), "NULL").otherwise("NOT NULL"))
    line = F.when(has("computed").isNotNull(), F.concat_ws(" ", quoted("column"), F.lit("AS"), F.concat(F.lit("("), has("computed").cast("string"), F.lit(")")))).otherwise(plain)
    by, listed = ["db", "schema", "table"], lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["l"]), ", ")
    key = listed(F.collect_list(F.when(has("key_ordinal").isNotNull(), F.struct(has("key_ordinal").cast("int").alias("o"), quoted("column").alias("l")))))
    tables = columns.groupBy(*by).agg(listed(F.collect_list(F.struct(F.col("ordinal").alias("o"), line.alias("l")))).alias("b"), key.alias("pk"))
    if foreign_keys is not None:
        side = lambda c: listed(F.collect_list(F.struct(F.col("ordinal").alias("o"), quoted(c).alias("l"))))
        one = foreign_keys.groupBy(*by, "key").agg(side("column").alias("a"), side("to_column").alias("z"), F.first(F.concat(quoted("to_schema"), F.lit("."), quoted("to_table"))).alias("to"))
        text = F.concat(F.lit("FOREIGN KEY ("), "a", F.lit(") REFERENCES "), "to", F.lit(" ("), "z", F.lit(")"))
        tables = tables.join(one.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(text)), ", ").alias("fk")), by, "left")
    else:
        tables = tables.withColumn("fk", F.lit(None).cast("string"))
    name = F.concat_ws(".", "schema", "table")
    body = F.concat_ws(", ", "b", F.when(F.col("pk") != "", F.concat(F.lit("PRIMARY KEY ("), "pk", F.lit(")"))), "fk")
    return tables.select(F.concat("db", F.lit("::"), name).alias("name"), F.concat(F.lit("CREATE TABLE "), name, F.lit(" ("), body, F.lit(")")).alias("sql"))


#: Queries of a server's catalog for table_definitions.
CATALOG_COLUMNS = """SELECT s.name AS [schema], t.name AS [table], c.name AS [column], ty.name AS [type], c.is_nullable AS nullable, c.column_id AS ordinal, c.is_identity AS [identity], cc.definition AS computed, k.key_ordinal
FROM sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.columns c ON c.object_id = t.object_id JOIN sys.types ty ON ty.user_type_id = c.user_type_id
LEFT JOIN sys.computed_columns cc ON cc.object_id = c.object_id AND cc.column_id = c.column_id
LEFT JOIN (SELECT ic.object_id, ic.column_id, ic.key_ordinal FROM sys.index_columns ic JOIN sys.indexes i ON i.object_id = ic.object_id AND i.index_id = ic.index_id WHERE i.is_primary_key = 1) k ON k.object_id = c.object_id AND k.column_id = c.column_id"""
CATALOG_KEYS = """SELECT s.name AS [schema], t.name AS [table], f.name AS [key], fc.constraint_column_id AS ordinal, c.name AS [column], rs.name AS to_schema, rt.name AS to_table, rc.name AS to_column
FROM sys.foreign_keys f JOIN sys.foreign_key_columns fc ON fc.constraint_object_id = f.object_id JOIN sys.tables t ON t.object_id = f.parent_object_id JOIN sys.schemas s ON s.schema_id = t.schema_id
JOIN sys.columns c ON c.object_id = fc.parent_object_id AND c.column_id = fc.parent_column_id JOIN sys.tables rt ON rt.object_id = f.referenced_object_id JOIN sys.schemas rs ON rs.schema_id = rt.schema_id
JOIN sys.columns rc ON rc.object_id = fc.referenced_object_id AND rc.column_id = fc.referenced_column_id"""


def read_jdbc_tables(spark: SparkSession, url: str, db: str, **options: str) -> DataFrame:
    """CREATE TABLE modules of a live server, with keys, identity and computed columns."""
    load = lambda query: spark.read.format("jdbc").options(url=url, query=query, **options).load().withColumn("db", F.lit(db))
    return table_definitions(load(CATALOG_COLUMNS), load(CATALOG_KEYS))


def captured_events(events: DataFrame, column: str = "event_data") -> DataFrame:
    """(session_id, ts, seq, nest_level, object_type, object_name, plan_xml) of captured events, a row of `column` an event as the
    server gives it in XML; events without a session or a time go. `seq` is the row's file_offset where there is one."""
    x = F.col(column)
    value = lambda kind, name: F.nullif(F.xpath_string(x, F.lit(f"/event/{kind}[@name='{name}']/value")), F.lit(""))
    plan = F.regexp_extract(x, r"(?s)(<ShowPlanXML.*</ShowPlanXML>)", 1)
    seq = F.col("file_offset").cast("bigint") if "file_offset" in events.columns else F.monotonically_increasing_id()
    text = F.nullif(F.xpath_string(x, F.lit("/event/data[@name='object_type']/text")), F.lit(""))
    rows = events.select(
        F.coalesce(value("action", "session_id"), value("data", "session_id")).cast("bigint").alias("session_id"), F.to_timestamp(F.xpath_string(x, F.lit("/event/@timestamp"))).alias("ts"), seq.alias("seq"),
        value("data", "nest_level").cast("int").alias("nest_level"), F.upper(F.coalesce(text, value("data", "object_type"))).alias("object_type"), value("data", "object_name").alias("object_name"), F.nullif(plan, F.lit("")).alias("plan_xml"),
    )
    return rows.where("session_id IS NOT NULL AND ts IS NOT NULL")


def strip_comments(sql: DataFrame, column: str = "sql") -> DataFrame:
    """Without the comments before the first statement."""
    return sql.withColumn(column, F.regexp_replace(column, r"^(?s)(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)+", ""))


def read_oracle(spark: SparkSession, path: str) -> DataFrame:
    """(module, entity, column) of lines with "|" between."""
    return spark.read.option("sep", "|").schema("module string, entity string, column string").csv(path)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(xml) of plan documents, one a file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and relationships of a graph document, whose keys may be in either case."""
    doc = spark.read.option("multiLine", True).json(path)
    by = {c.lower(): c for c in doc.columns}

    def rows(name: str) -> DataFrame:
        inner = doc.select(F.explode(by[name]).alias("x")).select("x.*")
        return inner.select(*(F.col(f"`{c}`").alias(c[0].lower() + c[1:]) for c in inner.columns))

    return rows("nodes"), rows("relationships" if "relationships" in by else "edges")


class _Partition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SqlFolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "**", "*.sql"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_Partition(p) for p in found] or [_Partition("")]

    def read(self, partition: InputPartition):
        if partition.path:
            with open(partition.path, encoding="utf-8-sig") as file:
                for batch in re.split(r"(?im)^[ \t]*GO(?:[ \t]+\d+)?[ \t]*;?[ \t]*\r?$", file.read()):
                    if batch.strip() and (name := object_name(batch)):
                        yield f"{self.options.get('db', 'Db')}::{name}", batch


class SqlFolder(DataSource):
    """`spark.read.format("sqlfolder").option("db", ...).load(path)`: the extractor interface as a data source."""

    @classmethod
    def name(cls) -> str:
        return "sqlfolder"

    def schema(self) -> str:
        return "name string, sql string"

    def reader(self, schema) -> DataSourceReader:
        return SqlFolderReader(dict(self.options))
