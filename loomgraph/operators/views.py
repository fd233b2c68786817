"""What a report or a page about a graph shows: figures, lists and texts, without any drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Graph


def _listed(column: str):
    return F.array_join(F.sort_array(F.collect_set(column)), ", ")


def key_figures(graph: Graph) -> DataFrame:
    """(figure, n): objects and tables, and how many objects have a parse error or, of those without one, a transaction,
    handler, cursor or dynamic SQL."""
    o = graph.label("SqlObject")
    fine = F.coalesce("parse_error", F.lit("")) == ""
    flag = lambda c: F.count_if(fine & F.coalesce(c, F.lit(False)))
    rows = o.agg(
        F.count("*").alias("objects"), F.count_if(~fine).alias("parse errors"), flag("has_transaction").alias("with transaction"), flag("has_error_handling").alias("with handler"),
        flag("has_cursor").alias("with cursor"), F.count_if(fine & (F.coalesce("dynamic_sql_calls", F.lit(0)) > 0)).alias("with dynamic SQL"),
    )
    tables = graph.label("Table").agg(F.count("*").alias("tables"))
    return rows.unpivot([], rows.columns, "figure", "n").union(tables.unpivot([], ["tables"], "figure", "n"))


def most_complex(graph: Graph, top: int = 12) -> DataFrame:
    """(name, complexity, dynamic_sql_calls) of objects without a parse error."""
    return graph.label("SqlObject").where("coalesce(parse_error, '') = ''").orderBy(F.desc("complexity"), "name").limit(top).select("name", "complexity", "dynamic_sql_calls")


def most_written(graph: Graph, top: int = 12) -> DataFrame:
    """(table, writers): tables by the number of objects that write them."""
    return graph.type("WRITES_TO").groupBy(F.col("dst").alias("table")).agg(F.count_distinct("owner").alias("writers")).orderBy(F.desc("writers"), "table").limit(top)


def entity_relations(graph: Graph) -> DataFrame:
    """(child, parent): the foreign keys between tables, each pair once."""
    return graph.type("FK_TO").select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()


def table_view(graph: Graph) -> DataFrame:
    """(id, columns, readers, writers): a table with its number of columns and the objects that read and write it."""
    columns = graph.type("HAS_COLUMN").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("columns"))
    by = lambda kind, name: graph.type(kind).groupBy(F.col("dst").alias("id")).agg(_listed("owner").alias(name))
    out = graph.label("Table").select("id").join(columns, "id", "left").join(by("READS_FROM", "readers"), "id", "left").join(by("WRITES_TO", "writers"), "id", "left")
    return out.select("id", F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("readers", F.lit("")).alias("readers"), F.coalesce("writers", F.lit("")).alias("writers"))


def filters_by_table(graph: Graph) -> DataFrame:
    """(object, filters): the columns that an object filters on, as "table(column, column)", tables and columns in order."""
    table, column = F.substring_index("dst", ":column:", 1), F.substring_index("dst", ":column:", -1)
    by = graph.type("FILTERS_ON").select("owner", table.alias("t"), column.alias("c")).groupBy("owner", "t").agg(_listed("c").alias("cs"))
    return by.select(F.col("owner").alias("object"), F.concat("t", F.lit("("), "cs", F.lit(")")).alias("f")).groupBy("object").agg(F.array_join(F.sort_array(F.collect_list("f")), ", ").alias("filters"))


def control_flow(facts: DataFrame) -> DataFrame:
    """(object, kind, path, key, level, text, ordinal): the nodes of each object's flow: one "condition" for each block, also if
    blocks have equal texts, and one "step" for each step below it. `path` is the keys of the blocks around it."""
    s = facts.select(F.col("full_name").alias("object"), F.explode("steps").alias("s"))
    blocks = s.select("object", F.posexplode("s.conditions").alias("p", "text"), F.col("s.condition_keys").alias("keys"), F.col("s.ordinal").alias("o"))
    key = F.coalesce(F.try_element_at("keys", F.col("p") + 1), F.lit(-1))
    own = F.array_join(F.slice("keys", 1, F.col("p")).cast("array<string>"), "/")
    nodes = blocks.select("object", F.lit("condition").alias("kind"), own.alias("path"), key.alias("key"), F.col("p").alias("level"), "text", "o").groupBy("object", "kind", "path", "key", "level", "text").agg(F.min("o").alias("ordinal"))
    steps = s.select("object", F.lit("step").alias("kind"), F.array_join(F.col("s.condition_keys").cast("array<string>"), "/").alias("path"), F.lit(-1).alias("key"), F.size("s.conditions").alias("level"), F.concat_ws(" ", "s.action", "s.target").alias("text"), F.col("s.ordinal").alias("ordinal"))
    return nodes.union(steps)


def flow_metrics(facts: DataFrame) -> DataFrame:
    """(object, conditions, depth): the number of condition nodes in an object's flow, and how deep they go."""
    c = control_flow(facts).where("kind = 'condition'").groupBy("object").agg(F.count("*").alias("conditions"), (F.max("level") + 1).alias("depth"))
    return facts.select(F.col("full_name").alias("object")).join(c, "object", "left").select("object", F.coalesce("conditions", F.lit(0)).alias("conditions"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def computed_columns(facts: DataFrame) -> DataFrame:
    """(table, column, sources, operators): what is computed and not stored."""
    t = facts.select(F.explode("tables").alias("t")).select(F.col("t.name").alias("table"), F.explode("t.columns").alias("c")).where("size(c.computed_from) > 0")
    return t.select("table", F.col("c.name").alias("column"), F.array_join("c.computed_from", ", ").alias("sources"), F.array_join("c.computed_ops", ",").alias("operators"))


def shares(counts: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """(name, n, percent, bar): of each its share of all, to one decimal, and its length against the longest, of 20. Counts are
    first summed by name, so what the whole is set against is one row."""
    by = counts.groupBy(F.col(name).alias("name")).agg(F.sum(n).alias("n"))
    whole = by.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return by.join(F.broadcast(whole)).select("name", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"), F.repeat(F.lit("#"), F.ceil(20 * F.col("n") / F.col("most")).cast("int")).alias("bar"))


def object_summaries(graph: Graph) -> DataFrame:
    """(id, summary): a sentence about each object."""
    count = lambda kind, name: graph.type(kind).groupBy(F.col("owner").alias("id")).agg(F.count_distinct("dst").alias(name))
    o = graph.label("SqlObject")
    for kind, name in (("READS_FROM", "reads"), ("WRITES_TO", "writes"), ("CALLS", "calls")):
        o = o.join(count(kind, name), "id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = F.concat("name", F.lit(" is a "), F.lower("object_type"), F.lit(" of complexity "), F.col("complexity").cast("string"), F.lit("; it reads "), number("reads"), F.lit(" tables, writes "), number("writes"), F.lit(" and calls "), number("calls"), F.lit(" objects"), F.when(F.coalesce("dynamic_sql_calls", F.lit(0)) > 0, "; it runs dynamic SQL").otherwise(""), F.lit("."))
    return o.select("id", text.alias("summary"))


#: (kind, what is asked); the answers are lists of names in order.
CASES = ("writes_of_object", "transitive_callees", "top_steps", "table_consumers", "column_roots", "call_condition")


def benchmark_cases(graph: Graph, seed: int = 7) -> DataFrame:
    """(kind, subject, answer): one question of each kind for which the graph has an answer. The subject is the first by a hash
    with the seed, so the same graph and seed give the same cases; the answer is a sorted list."""
    from .changemap import _calls, via_calls
    from .impact import lineage_roots

    w, r = graph.type("WRITES_TO"), graph.type("READS_FROM")
    rows = [
        w.groupBy(F.col("owner").alias("subject")).agg(F.sort_array(F.collect_set("dst")).alias("answer")),
        via_calls(graph).where("NOT cycle").groupBy(F.col("id").alias("subject")).agg(F.sort_array(F.collect_set("reached")).alias("answer")),
        None,
        r.join(w.select("dst").distinct(), "dst", "left_semi").groupBy(F.col("dst").alias("subject")).agg(F.sort_array(F.collect_set("owner")).alias("answer")),
        lineage_roots(graph).groupBy(F.col("column").alias("subject")).agg(F.sort_array(F.collect_set("root")).alias("answer")),
        _calls(graph).where("conditional").groupBy(F.col("src").alias("subject")).agg(F.sort_array(F.collect_set("dst")).alias("answer")),
    ]
    steps = graph.label("Step").groupBy(F.substring_index("id", "#", 1).alias("o")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o").limit(3)
    rows[2] = steps.agg(F.lit("corpus").alias("subject"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "o"))), lambda x: x["o"]).alias("answer")).where("size(answer) = 3")
    out = None
    for kind, row in zip(CASES, rows):
        one = row.orderBy(F.xxhash64("subject", F.lit(seed)), "subject").limit(1).select(F.lit(kind).alias("kind"), "subject", "answer")
        out = one if out is None else out.union(one)
    return out


def grade(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(kind, precision, recall, exact) of answers (kind, answer) to the cases; without an answer all is 0."""
    both = cases.join(answers.select("kind", F.col("answer").alias("given")), "kind", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    right, distinct = F.size(F.array_intersect("answer", "given")), F.size(F.array_distinct("given"))
    share = lambda n: F.when(n > 0, F.round(right / n, 4)).otherwise(0.0)
    return both.select("kind", share(distinct).alias("precision"), share(F.size("answer")).alias("recall"), (F.sort_array(F.array_distinct("given")) == F.sort_array("answer")).alias("exact"))

