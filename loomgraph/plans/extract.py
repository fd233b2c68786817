"""From modules to facts: one row an object, with its steps and all that was read from its text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import stored
from ..tsql.walker import analyse

_REFS = "array<struct<table:string,columns:array<string>>>"
STEP = f"""struct<ordinal:int,line:int,action:string,step_type:string,target:string,detail:string,columns:array<string>,
lineage:array<struct<column:string,table:string,sources:array<string>,expr:string,ops:array<string>>>,reads:{_REFS},filters:{_REFS},filter_text:string,filter_kind:string,filter_ops:array<string>,
conditions:array<string>,condition_keys:array<int>,nesting:int,is_dynamic:boolean,dynamic_sql:string,select_star:boolean,variables:array<string>>"""
TABLE = """struct<name:string,columns:array<struct<name:string,type:string,nullable:boolean,identity:boolean,primary_key:boolean,ordinal:int,computed:string,computed_from:array<string>,computed_ops:array<string>>>,
foreign_keys:array<struct<columns:array<string>,to:string,to_columns:array<string>>>,constraints:array<struct<kind:string,text:string,columns:array<string>>>>"""
FACTS = f"""struct<id:string,db:string,schema_name:string,name:string,full_name:string,object_type:string,complexity:int,has_transaction:boolean,has_error_handling:boolean,has_cursor:boolean,dynamic_sql_calls:int,parse_error:string,
steps:array<{STEP}>,parameters:array<struct<name:string,type:string,is_output:boolean>>,variables:array<struct<name:string,type:string,value:string>>,assigned:array<struct<variable:string,table:string,column:string>>,
tables:array<{TABLE}>,triggers:array<struct<name:string,table:string,timing:string,events:array<string>,line:int>>,functions:array<string>,
outputs:array<struct<name:string,sources:array<struct<table:string,column:string>>,expr:string,ops:array<string>>>,synonym_for:string>"""
FACTS = FACTS.replace("\n", "")


#: Modules that a task reads at most. They are few bytes and much work, so partitions by bytes leave it to a few tasks.
ROWS_A_TASK = 1000


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """`n` rows over all cores, in turn: a repartition by a key goes where the join before it has the same."""
    return rows.repartition(max(1, min(n, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK)))))


def _analysed(modules: DataFrame, strict: bool) -> DataFrame:
    """Facts of rows (name, sql, catalog), the last as a JSON object."""
    @F.pandas_udf("string")
    def read(name: pd.Series, sql: pd.Series, catalog: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        out = []
        for n, s, c in zip(name, sql, catalog):
            if c not in known:
                known = {c: json.loads(c) if c else {}}
            out.append(json.dumps(analyse(n or "", s or "", known[c], strict), ensure_ascii=False))
        return pd.Series(out)

    # cut, so that the parsed text is read once and not once a field
    return stored(modules.select(F.from_json(read("name", "sql", "catalog"), FACTS).alias("f"))).select("f.*")


#: Words of a text, as names have them.
_WORD = r"[\w$#@]+"


def known_columns(facts: DataFrame) -> DataFrame:
    """(db, name, columns) of tables, views and table functions."""
    tables = facts.select("db", F.explode("tables").alias("t")).where("size(t.columns) > 0").select("db", F.lower("t.name").alias("name"), F.col("t.columns.name").alias("columns"))
    outputs = facts.where("size(outputs) > 0").select("db", F.lower("full_name").alias("name"), F.col("outputs.name").alias("columns"))
    return tables.union(outputs).groupBy("db", "name").agg(F.max("columns").alias("columns"))


def _with_catalog(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (row, db, sql) with the columns, as a JSON object, of those tables of their database whose name can be in the text:
    the first word of its last part is."""
    words = rows.select("row", "db", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(_WORD), F.lit(0)))).alias("word"))
    named = known.withColumn("word", F.regexp_extract(F.substring_index("name", ".", -1), _WORD, 0))
    needed = words.join(named, ["db", "word"]).groupBy("row").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "columns"))))).alias("catalog"))
    return rows.join(needed, "row", "left")


def extract(modules: DataFrame, strict: bool = False, passes: int = 2) -> DataFrame:
    """Facts of modules (name, sql).

    The first pass reads definitions; the following ones read all modules again with the columns of the tables and views
    that they name, as far as these are known then, which "*" and bare names need. Views of views ask for one more pass a
    level."""
    rows = stored(modules.select("name", "sql").withColumn("db", F.substring_index("name", "::", 1)).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    facts = _analysed(_spread(rows, n).withColumn("catalog", F.lit(None).cast("string")), strict)
    for _ in range(passes - 1):
        facts = _analysed(_spread(_with_catalog(rows, known_columns(facts)), n), strict)
    return facts


def steps(facts: DataFrame) -> DataFrame:
    """One row a step: (id, owner, db, and the fields of a step)."""
    return facts.select(F.col("id").alias("owner"), "db", F.explode("steps").alias("s")).select(F.concat("owner", F.lit("#step"), F.col("s.ordinal").cast("string")).alias("id"), "owner", "db", "s.*")
