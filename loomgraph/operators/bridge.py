"""From application code to the database: which objects the SQL inside other source files names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Graph

_NAME = r"((?:\[[^\]]+\]|\w+)(?:\s*\.\s*(?:\[[^\]]+\]|\w+)){0,2})"


def name_variants(graph: Graph) -> DataFrame:
    """(name, id) by which an object or a table can be called: with database, with schema, and bare if only one has it."""
    rows = graph.label("SqlObject", "Table").select("id", F.lower("db").alias("d"), F.lower("name").alias("n"))
    full = rows.select("id", F.explode(F.array(F.concat_ws(".", "d", "n"), "n")).alias("name"))
    leaf = rows.select("id", F.substring_index("n", ".", -1).alias("name"))
    only = leaf.join(leaf.groupBy("name").count().where("count = 1").select("name"), "name", "left_semi").select("id", "name")
    return full.union(only).distinct().select("name", "id")


def references(files: DataFrame, graph: Graph) -> DataFrame:
    """(path, kind, name, id, resolution) of SQL in the texts of files (path, text): procedures after EXEC, tables after
    FROM, JOIN, INTO or UPDATE. A name with a hole, as string templates have, is matched as a pattern and marked ambiguous;
    what the graph doesn't know stays, unresolved, if it follows EXEC."""
    def found(pattern: str, kind: str) -> DataFrame:
        return files.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("raw"))

    holes = r"((?:\[?\w*\]?\.)?\[?\w*\{\w*\}\w*\]?)"
    rows = found(rf"(?i)\bEXEC(?:UTE)?\s+{_NAME}", "EXEC").union(found(rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+{_NAME}", "TABLE"))
    rows = rows.select("path", "kind", F.lower(F.regexp_replace("raw", r"[\[\]\s]", "")).alias("name")).distinct()
    known = name_variants(graph)
    exact = rows.join(known, "name", "left").where("id IS NOT NULL OR kind = 'EXEC'")
    exact = exact.select("path", "kind", "name", "id", F.when(F.col("id").isNotNull(), "literal").otherwise("unresolved").alias("resolution"))
    template = found(rf"(?i)\bEXEC(?:UTE)?\s+{holes}", "EXEC").union(found(rf"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+{holes}", "TABLE"))
    template = template.select("path", "kind", F.lower(F.regexp_replace("raw", r"[\[\]\s]", "")).alias("name")).where(F.col("name").contains("{")).distinct()
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("name", r"\.", r"\\."), r"\{\w*\}", r"\\w+"), F.lit("$"))
    ambiguous = template.withColumn("pattern", like).join(known.withColumnRenamed("name", "known"), F.expr("known RLIKE pattern"))
    return exact.union(ambiguous.select("path", "kind", "name", "id", F.lit("ambiguous"))).distinct()


def unused_references(projects: DataFrame, uses: DataFrame) -> DataFrame:
    """(project, refers_to) of project references (project, refers_to) that no use (project, used) bears out."""
    return projects.join(uses.select("project", F.col("used").alias("refers_to")).distinct(), ["project", "refers_to"], "left_anti")


def class_uses(uses: DataFrame) -> DataFrame:
    return uses.groupBy("source", "target").agg(F.count("*").alias("n"))


def dispatch(calls: DataFrame, registered: DataFrame, implementations: DataFrame) -> DataFrame:
    """(interface, method, target, by) of calls (interface, method): the class registered for an interface, else the only one
    that implements it, else none."""
    only = implementations.groupBy("interface").agg(F.min("class").alias("single"), F.count("*").alias("n")).where("n = 1").select("interface", "single")
    by = calls.join(registered.select("interface", F.col("class").alias("chosen")).dropDuplicates(["interface"]), "interface", "left").join(only, "interface", "left")
    return by.select("interface", "method", F.coalesce("chosen", "single").alias("target"), F.when(F.col("chosen").isNotNull(), "registered").when(F.col("single").isNotNull(), "only implementation").otherwise("unresolved").alias("by"))


def application(files: DataFrame, graph: Graph) -> Graph:
    """The graph of application code, of files (path, f) as sources.code.extracted gives them: files, classes, methods and entry
    points, the SQL that methods run against the objects and tables of `graph`, and the services that they call.

    A method's id has its namespace and class, as a class can be in several files. A procedure's name or a table that the
    graph doesn't know gives no edge; a name with a hole gives an ambiguous edge to each that it can mean."""
    space = F.coalesce(F.try_element_at("f.classes", F.lit(1))["namespace"], F.lit(""))
    rows = files.select("path", "f", F.when(space != "", F.concat(space, F.lit("."))).otherwise("").alias("space"))
    method = lambda name: F.concat(F.lit("app::method:"), "space", name)
    each = lambda part: rows.select("path", "space", F.explode(f"f.{part}").alias("x"))
    classes, methods, entries, external, sql = (each(p) for p in ("classes", "methods", "entries", "external", "sql"))
    file, of_class = F.concat(F.lit("app::file:"), "path"), lambda name: F.concat(F.lit("app::class:"), "space", name)
    entry = F.concat(F.lit("app::entry:"), F.col("x.kind"), F.lit(":"), F.col("x.key"))
    node = lambda df, id, label, name: df.select(id.alias("id"), F.lit(label).alias("label"), name.alias("name"))
    nodes = [
        node(rows, file, "File", F.col("path")), node(classes, of_class(F.col("x.name")), "Class", F.col("x.name")), node(methods, method(F.concat_ws(".", "x.class", "x.name")), "Method", F.col("x.name")),
        node(entries, entry, "EntryPoint", F.col("x.key")), node(external, F.concat(F.lit("app::external:"), "x.url"), "ExternalSystem", F.col("x.url")),
    ]
    edge = lambda df, src, dst, kind, resolution=None: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(None).cast("string") if resolution is None else resolution).alias("resolution"))
    implements = classes.select("space", "x", F.explode("x.bases").alias("base"))
    # a procedure is called by its name alone; anything else is SQL
    text = F.when(F.col("x.procedure"), F.concat(F.lit("EXEC "), F.col("x.text"))).otherwise(F.col("x.text"))
    asked = sql.select(method(F.col("x.method")).alias("path"), text.alias("text"))
    deleted = asked.select("path", F.regexp_replace("text", r"(?i)\bMERGE\s+(?!INTO)", "MERGE INTO ").alias("text"))
    named = references(deleted, graph).where("id IS NOT NULL")
    edges = [
        edge(classes, file, of_class(F.col("x.name")), "CONTAINS"), edge(methods, of_class(F.col("x.class")), method(F.concat_ws(".", "x.class", "x.name")), "CONTAINS"),
        edge(implements, of_class(F.col("x.name")), of_class(F.col("base")), "IMPLEMENTS"), edge(entries, of_class(F.substring_index("x.method", ".", 1)), entry, "EXPOSES"),
        edge(entries, entry, method(F.col("x.method")), "CALLS"), edge(external, method(F.col("x.method")), F.concat(F.lit("app::external:"), "x.url"), "CALLS_EXTERNAL"),
        edge(named, F.col("path"), F.col("id"), "EXECUTES_SQL", F.col("resolution")),
    ]
    together = lambda parts: reduce(DataFrame.union, parts).distinct()
    return Graph.of(together(nodes), together(edges))
