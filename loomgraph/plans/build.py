"""From facts to the graph: nodes and edges."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_transient, normalise, stable_hash, with_schema
from ..operators.closure import cut, stored
from ..operators.impact import affects
from .extract import steps as step_rows
from .model import EDGE_COLUMNS, NODE_COLUMNS, Graph, owner


def _nodes(df: DataFrame, id: Column, label: str, **more: Column | str) -> DataFrame:
    return df.select(id.alias("id"), F.lit(label).alias("label"), *(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in more.items()))


def _edges(df: DataFrame, src: Column | str, dst: Column | str, type: Column | str, **more: Column | str) -> DataFrame:
    pick = lambda x: F.col(x) if isinstance(x, str) else x
    kind = F.lit(type) if isinstance(type, str) else type
    return df.select(pick(src).alias("src"), pick(dst).alias("dst"), kind.alias("type"), *(pick(v).alias(k) for k, v in more.items())).where("src IS NOT NULL AND dst IS NOT NULL")


class Builder:
    """Holds the resolution of names, which every edge to a table depends on."""

    def __init__(self, facts: DataFrame):
        self.facts, self.steps = facts, stored(step_rows(facts.where("object_type NOT IN ('TABLE', 'SYNONYM')")))
        self.nodes: list[DataFrame] = []
        self.edges: list[DataFrame] = []
        objects = facts.where("object_type NOT IN ('TABLE', 'SYNONYM')")
        self.fit = lambda df, columns: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()))
        self.objects = objects.select("id", "db", normalise("full_name").alias("key"), "object_type")
        self.synonyms = facts.where("synonym_for <> ''").select("id", "db", normalise("full_name").alias("key"), normalise(with_schema("synonym_for")).alias("to")).dropDuplicates(["db", "key"])
        self._tables()
        p, v = objects.select("id", F.explode("parameters").alias("p")), objects.select("id", F.explode("variables").alias("v"))
        names = p.select("id", F.lower("p.name").alias("variable"), F.concat("id", F.lit("#param:"), F.col("p.name")).alias("vid"))
        self.variables = names.union(v.select("id", F.lower("v.name"), F.concat("id", F.lit("#var:"), F.col("v.name")))).dropDuplicates(["id", "variable"])
        s = self.steps
        self.writes = self.named(s.where("action IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE', 'TRUNCATE', 'OUTPUT', 'ALTER')").select("id", "db", "action", "columns", F.col("target").alias("table")))

    def _mentions(self) -> DataFrame:
        """(db, name) of every table that is named anywhere."""
        f, s = self.facts, self.steps
        parts = [
            s.where("target <> '' AND action NOT IN ('EXEC', 'DECLARE_CURSOR', 'OPEN_CURSOR', 'FETCH', 'CLOSE_CURSOR', 'DEALLOCATE')").select("db", F.col("target").alias("name")),
            s.select("db", F.explode("reads.table").alias("name")),
            s.select("db", F.explode("filters.table").alias("name")),
            s.select("db", F.explode("lineage.table").alias("name")),
            f.select("db", F.explode("tables.name").alias("name")),
            f.select("db", F.explode("tables").alias("t")).select("db", F.explode("t.foreign_keys.to").alias("name")),
            f.select("db", F.explode("outputs").alias("o")).select("db", F.explode("o.sources.table").alias("name")),
            f.select("db", F.explode("assigned.table").alias("name")),
            f.select("db", F.explode("triggers.table").alias("name")),
        ]
        return reduce(DataFrame.union, parts).where(~is_transient("name") & (F.col("name") != "")).distinct()

    def _tables(self) -> None:
        """A bare name means the only qualified table of that name, otherwise one in dbo; synonyms mean their target."""
        named = self._mentions().withColumn("key", normalise("name"))
        qualified = named.where(F.col("key").contains(".")).select("db", "key", F.substring_index("key", ".", -1).alias("leaf")).distinct()
        only = qualified.groupBy("db", "leaf").agg(F.min("key").alias("only"), F.count("*").alias("n")).where("n = 1").select("db", "leaf", "only")
        found = named.join(only.withColumnRenamed("leaf", "key"), ["db", "key"], "left")
        full = F.when(F.col("key").contains("."), F.col("key")).otherwise(F.coalesce("only", F.concat(F.lit("dbo."), "key")))
        found = found.select("db", "name", full.alias("key"))
        aliased = self.synonyms.select("db", F.col("key"), "to")
        found = found.join(aliased, ["db", "key"], "left").select("db", "name", F.coalesce("to", "key").alias("key"))
        known = self.objects.where("object_type NOT IN ('SCRIPT')").select("db", "key", F.col("id").alias("object_id"), "object_type")
        self.names = stored(found.join(known, ["db", "key"], "left").select("db", F.col("name").alias("table"), "key", F.concat("db", F.lit(":table:"), "key").alias("table_id"), "object_id", "object_type"))

    def named(self, df: DataFrame, column: str = "table") -> DataFrame:
        """With table_id, object_id and object_type of the table that a column names; rows of unknown or passing names go."""
        names = self.names.withColumnRenamed("table", column)
        return df.join(names, ["db", column])

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        if nodes is not None:
            self.nodes.append(nodes)
        if edges is not None:
            self.edges.append(edges)

    # ---- objects, parameters, variables

    def build_objects(self) -> None:
        f = self.facts.where("object_type NOT IN ('TABLE', 'SYNONYM')")
        synonyms = self.facts.where("object_type = 'SYNONYM'")
        self.add(_nodes(synonyms, F.col("id"), "SqlObject", name="full_name", db="db", schema_name="schema_name", object_type="object_type"))
        self.add(_nodes(f, F.col("id"), "SqlObject", name="full_name", db="db", schema_name="schema_name", object_type="object_type", complexity="complexity", has_transaction="has_transaction", has_error_handling="has_error_handling", has_cursor="has_cursor", dynamic_sql_calls="dynamic_sql_calls", parse_error="parse_error"))
        p = f.select("id", "db", F.explode("parameters").alias("p"))
        pid = F.concat("id", F.lit("#param:"), F.col("p.name"))
        self.add(_nodes(p, pid, "Parameter", name=F.col("p.name"), db="db", data_type=F.col("p.type")), _edges(p, "id", pid, "HAS_PARAMETER"))
        v = f.select("id", "db", F.explode("variables").alias("v"))
        vid = F.concat("id", F.lit("#var:"), F.col("v.name"))
        self.add(_nodes(v, vid, "Variable", name=F.col("v.name"), db="db", data_type=F.col("v.type")), _edges(v, "id", vid, "DECLARES"))
        a = f.select("id", "db", F.explode("assigned").alias("a")).select("id", "db", F.lower("a.variable").alias("variable"), F.col("a.table").alias("table"), F.col("a.column").alias("column"))
        a = self.named(a).join(self.variables, ["id", "variable"])
        self.add(None, _edges(a, "vid", F.concat("table_id", F.lit(":column:"), "column"), "ASSIGNED_FROM"))

    # ---- steps

    def build_steps(self) -> None:
        s = self.steps
        self.add(_nodes(s, F.col("id"), "Step", name="step_type", db="db", action="action", nesting="nesting", is_dynamic="is_dynamic", dynamic_sql="dynamic_sql", select_star="select_star", line="line"), _edges(s, "owner", "id", "HAS_STEP"))
        action = F.concat("db", F.lit(":action:"), "action")
        self.add(_nodes(s.select("db", "action").distinct(), action, "Action", name="action", db="db"), _edges(s, "id", action, "ACTION"))
        used = s.select("id", "owner", "is_dynamic", F.explode(F.transform("variables", F.lower)).alias("variable")).join(self.variables.withColumnRenamed("id", "owner"), ["owner", "variable"])
        self.add(None, _edges(used, "id", "vid", F.when(F.col("is_dynamic"), "BUILDS_SQL_FROM").otherwise("USES_VARIABLE")))

    def build_access(self) -> None:
        """Reads, writes and columns. A view or table function that is read is a target, and its base tables are read through it."""
        s = self.steps
        writes = self.writes
        as_object = F.col("object_id").isNotNull() & F.col("object_type").isin("VIEW", "TABLE_FUNCTION", "MULTI_TABLE_FUNCTION")
        self.add(None, _edges(writes, "id", F.when(as_object, F.col("object_id")).otherwise(F.col("table_id")), F.when(as_object, "TARGETS").otherwise("WRITES_TO"), action_type="action"))
        self.add(None, _edges(writes.withColumn("c", F.explode("columns")), "id", F.concat("table_id", F.lit(":column:"), "c"), "WRITES_COLUMN", action_type="action", resolution=F.lit("direct")))
        reads = self.named(s.select("id", "db", "action", "select_star", F.explode("reads").alias("r")).select("id", "db", "action", "select_star", F.col("r.table").alias("table"), F.col("r.columns").alias("columns")))
        self.add(None, _edges(reads, "id", F.when(as_object, F.col("object_id")).otherwise(F.col("table_id")), F.when(as_object, "TARGETS").otherwise("READS_FROM"), action_type="action", resolution=F.lit("direct")))
        plain = reads.where(~as_object).withColumn("c", F.explode("columns"))
        resolution = F.when(F.col("select_star"), "star_expanded").otherwise("direct")
        self.add(None, _edges(plain, "id", F.concat("table_id", F.lit(":column:"), "c"), "READS_COLUMN", action_type="action", resolution=resolution))
        # one level of views: what the reader of a view reads in the view's own tables
        out = self.facts.where("object_type IN ('VIEW', 'TABLE_FUNCTION')").select(F.col("id").alias("object_id"), "db", F.explode("outputs").alias("o"))
        base = self._view_bases(out)
        through = reads.where(as_object).select("id", "action", "object_id", "columns")
        tables = through.join(base.select("object_id", "base_id").distinct(), "object_id")
        self.add(None, _edges(tables, "id", "base_id", "READS_FROM", action_type="action", resolution=F.lit("via_view"), via_view="object_id"))
        columns = through.withColumn("c", F.explode("columns")).join(base, (through.object_id == base.object_id) & (F.lower("c") == F.lower("output"))).drop(base.object_id)
        self.add(None, _edges(columns, "id", F.concat("base_id", F.lit(":column:"), "column"), "READS_COLUMN", action_type="action", resolution=F.lit("via_view"), via_view="object_id"))

    def _view_bases(self, out: DataFrame) -> DataFrame:
        """(object_id, output, base_id, column) of views and table functions."""
        flat = out.select(F.col("object_id").alias("view_id"), "db", F.col("o.name").alias("output"), F.explode("o.sources").alias("x")).select("view_id", "db", "output", F.col("x.table").alias("table"), F.col("x.column").alias("column"))
        return self.named(flat).select(F.col("view_id").alias("object_id"), "output", F.col("table_id").alias("base_id"), "column")

    def build_filters(self) -> None:
        s = self.steps
        f = self.named(s.select("id", "db", "action", F.explode("filters").alias("r")).select("id", "db", "action", F.col("r.table").alias("table"), F.col("r.columns").alias("columns"))).withColumn("c", F.explode("columns"))
        column = F.concat("table_id", F.lit(":column:"), "c")
        self.add(None, _edges(f, "id", column, "FILTERS_ON", action_type="action", resolution=F.lit("direct")))
        written = self.writes.where("action = 'UPDATE'").select("id", F.col("table_id").alias("w"), F.explode("columns").alias("wc"))
        both = written.join(f.where("action = 'UPDATE'").select("id", column.alias("fc")), "id").select(F.concat("w", F.lit(":column:"), "wc").alias("wc"), "fc").where("wc <> fc").distinct()
        self.add(None, _edges(both, "wc", "fc", "CONDITIONED_BY"))
        rules = s.where("filter_text <> ''").select("id", "db", "filter_text", "filter_kind", F.explode("filters.table").alias("table"))
        rid = F.concat("db", F.lit(":bizrule:where:"), stable_hash("filter_text"))
        self.add(_nodes(rules.select("db", "filter_text").distinct(), rid, "BusinessRule", name="filter_text", db="db"), _edges(rules.select("id", "db", "filter_text").distinct(), "id", rid, "HAS_RULE"))
        self.add(None, _edges(self.named(rules), rid, "table_id", "CONSTRAINS").distinct())

    def build_lineage(self) -> None:
        s = self.steps
        l = s.where("target <> ''").select("db", "owner", "id", F.col("target").alias("to"), F.explode("lineage").alias("l")).select("db", "owner", "id", "to", F.col("l.column").alias("column"), F.col("l.table").alias("table"), F.explode("l.sources").alias("source"))
        self.add(None, self._bridged(l))
        views = self.facts.where("object_type IN ('VIEW', 'TABLE_FUNCTION')").select(F.col("id").alias("object_id"), "db", "full_name", F.explode("outputs").alias("o"))
        base = self._view_bases(views).distinct()
        ids = self.facts.select(F.col("id").alias("object_id"), F.concat("db", F.lit(":table:"), normalise("full_name")).alias("view_table"))
        v = base.join(ids, "object_id")
        self.add(_nodes(v.select("view_table", "output").distinct(), F.concat("view_table", F.lit(":column:"), "output"), "Column", name="output"), _edges(v, F.concat("view_table", F.lit(":column:"), "output"), F.concat("base_id", F.lit(":column:"), "column"), "DERIVES_FROM", via_view="object_id"))
        t = self.facts.select("db", F.explode("tables").alias("t")).select("db", F.col("t.name").alias("table"), F.explode("t.columns").alias("c"))
        computed = self.named(t.select("db", "table", F.col("c.name").alias("column"), F.explode("c.computed_from").alias("source")))
        self.add(None, _edges(computed, F.concat("table_id", F.lit(":column:"), "column"), F.concat("table_id", F.lit(":column:"), "source"), "DERIVES_FROM"))

    def _bridged(self, l: DataFrame, hops: int = 5) -> DataFrame:
        """Lineage with temporary tables left out: what goes through them is joined to its origin, within an object."""
        low = lambda c: F.lower(F.col(c))
        rows = l.select("db", "owner", "to", "column", "table", "source").distinct()
        into = rows.where(is_transient("to")).select(F.col("owner").alias("o"), low("to").alias("t"), low("column").alias("c"), F.col("table").alias("t2"), F.col("source").alias("s2"))
        done, open_ = rows.where(~is_transient("to") & ~is_transient("table")), rows.where(~is_transient("to") & is_transient("table"))
        parts = [done]
        for _ in range(hops):
            step = open_.join(into, (F.col("owner") == F.col("o")) & (low("table") == F.col("t")) & (low("source") == F.col("c"))).select("db", "owner", "to", "column", F.col("t2").alias("table"), F.col("s2").alias("source"))
            parts.append(step.where(~is_transient("table")))
            open_ = step.where(is_transient("table"))
        rows = reduce(DataFrame.union, parts)
        a = self.named(rows.withColumnRenamed("to", "to_name"), "to_name").select("db", "column", "table", "source", F.col("table_id").alias("to_id"))
        a = self.named(a)
        return _edges(a, F.concat("to_id", F.lit(":column:"), "column"), F.concat("table_id", F.lit(":column:"), "source"), "DERIVES_FROM").where("src <> dst").distinct()

    # ---- conditions, calls, triggers

    def build_rules(self) -> None:
        s = self.steps.where("size(conditions) > 0").select("id", "db", F.posexplode("conditions").alias("pos", "text"), F.size("conditions").alias("n"), "conditions")
        rid = lambda text: F.concat("db", F.lit(":rule:"), F.substring_index(text, ":", 1), F.lit(":"), stable_hash(text))
        self.add(_nodes(s.select("db", "text").distinct(), rid("text"), "Rule", name="text", db="db"))
        self.add(None, _edges(s.where("pos = n - 1"), rid("text"), "id", "GOVERNS"))
        nested = s.where("pos > 0").select("db", rid("text").alias("child"), F.expr("conditions[pos - 1]").alias("above"))
        self.add(None, _edges(nested, "child", rid("above"), "NESTED_IN").where("src <> dst").distinct())

    def build_calls(self) -> None:
        targets = self.objects.select("db", "key", F.col("id").alias("to"))
        key = lambda c: F.when(F.size(F.split(c, r"\.")) >= 3, F.substring_index(normalise(c), ".", -2)).otherwise(normalise(with_schema(c)))
        calls = self.steps.where("NOT is_dynamic AND action = 'EXEC' AND target <> ''").select("owner", F.col("id").alias("step"), F.col("target").alias("name"), "db", F.lit("EXEC").alias("kind"))
        calls = calls.union(self.steps.where("NOT is_dynamic AND action = 'INSERT' AND detail <> ''").select("owner", "id", "detail", "db", F.lit("EXEC")))
        calls = calls.union(self.facts.select(F.col("id"), F.explode("functions").alias("n"), "db").select("id", F.lit(None).cast("string"), "n", "db", F.lit("FUNCTION")))
        db = F.when(F.size(F.split("name", r"\.")) >= 3, F.element_at(F.split("name", r"\."), -3)).otherwise(F.col("db"))
        found = calls.select("owner", "step", db.alias("db"), key("name").alias("key"), "kind").join(targets, ["db", "key"])
        self.add(None, _edges(found.select("owner", "to", "kind").distinct(), "owner", "to", "CALLS", action_type="kind"))
        self.add(None, _edges(found.where("step IS NOT NULL"), "step", "to", "TARGETS", action_type="kind"))

    def build_triggers(self) -> None:
        t = self.facts.select("id", "db", "object_type", F.explode("triggers").alias("t")).select("id", "db", "object_type", F.col("t.name").alias("name"), F.col("t.table").alias("table"), F.col("t.timing").alias("timing"))
        tid = F.concat("db", F.lit("::"), with_schema("name"))
        made = t.where("object_type <> 'TRIGGER'")
        self.add(_nodes(made, tid, "Trigger", name="name", db="db"), _edges(made, "id", tid, "CREATES"))
        self.add(None, _edges(self.named(t), tid, "table_id", "ON", action_type="timing"))

    # ---- containers and tables

    def build_containers(self) -> None:
        f = self.facts.where("object_type NOT IN ('TABLE', 'SYNONYM')").select("id", "db", F.lower("schema_name").alias("s"))
        wf = F.concat(F.lit("wf:"), "db", F.lit(":"), "s")
        self.add(_nodes(f.select("db", "s").distinct(), wf, "Workflow", name="s", db="db"), _edges(f, "id", wf, "BELONGS_TO"))
        member = f.select(F.col("id").alias("owner"), wf.alias("wf"))
        wrote = self.writes.where("object_id IS NULL OR object_type NOT IN ('VIEW', 'TABLE_FUNCTION', 'MULTI_TABLE_FUNCTION')").select(owner("id").alias("owner"), "table_id").distinct()
        self.add(None, _edges(wrote.join(member, "owner").select("wf", "table_id").distinct(), "wf", "table_id", "WORKFLOW_WRITES_TO"))
        tables = self.names.where("object_id IS NULL OR object_type NOT IN ('VIEW', 'TABLE_FUNCTION', 'MULTI_TABLE_FUNCTION')").select("db", "key", "table_id").distinct()
        self.add(_nodes(tables, F.col("table_id"), "Table", name="key", db="db", schema_name=F.substring_index("key", ".", 1)))
        inside = f.select("db", "s", F.col("id")).union(tables.select("db", F.substring_index("key", ".", 1), "table_id"))
        sid, did = F.concat("db", F.lit(":schema:"), "s"), F.concat("db", F.lit(":database"))
        self.add(_nodes(inside.select("db", "s").distinct(), sid, "Schema", name="s", db="db"), _edges(inside, sid, "id", "CONTAINS"))
        self.add(_nodes(inside.select("db").distinct(), did, "Database", name="db", db="db"), _edges(inside.select("db", "s").distinct(), did, sid, "CONTAINS"))

    def build_definitions(self) -> None:
        t = self.named(self.facts.select("db", F.explode("tables").alias("t")).withColumn("table", F.col("t.name")))
        c = t.select("db", "table_id", F.explode("t.columns").alias("c"))
        cid = F.concat("table_id", F.lit(":column:"), F.col("c.name"))
        self.add(_nodes(c, cid, "Column", name=F.col("c.name"), db="db", data_type=F.col("c.type"), is_nullable=F.col("c.nullable"), is_primary_key=F.col("c.primary_key"), ordinal=F.col("c.ordinal")), _edges(c, "table_id", cid, "HAS_COLUMN"))
        k = t.select("db", "table_id", F.explode("t.foreign_keys").alias("k")).select("db", F.col("table_id").alias("own"), F.col("k.to").alias("table"), F.col("k.columns").alias("a"), F.col("k.to_columns").alias("b"))
        k = self.named(k)
        self.add(None, _edges(k, "own", "table_id", "FK_TO"))
        z = k.select("own", "table_id", F.explode(F.arrays_zip("a", "b")).alias("z"))
        self.add(None, _edges(z, F.concat("own", F.lit(":column:"), F.col("z.a")), F.concat("table_id", F.lit(":column:"), F.col("z.b")), "REFERENCES"))
        r = t.select("db", "table_id", F.explode("t.constraints").alias("r"))
        rid = F.concat(F.lit(""), "db", F.lit(":bizrule:"), F.substring_index("table_id", ":", -1), F.lit(":"), F.lower("r.kind"), F.lit(":"), stable_hash("r.text"))
        self.add(_nodes(r, rid, "BusinessRule", name=F.col("r.text"), db="db"), _edges(r, "table_id", rid, "HAS_RULE"))
        self.add(None, _edges(r.withColumn("c", F.explode("r.columns")), rid, F.concat("table_id", F.lit(":column:"), "c"), "CONSTRAINS"))

    def build_synonyms(self) -> None:
        s = self.synonyms.join(self.names.select("db", F.col("key").alias("to"), "table_id").distinct(), ["db", "to"])
        self.add(None, _edges(s, "id", "table_id", "ALIAS_OF"))

    def _part(self, name: str) -> tuple[DataFrame | None, DataFrame | None]:
        """Nodes and edges of one part, stored. Parts don't need each other, so they are planned and run side by side."""
        own = copy(self)
        own.nodes, own.edges = [], []
        getattr(own, f"build_{name}")()
        together = lambda made, columns: stored(reduce(DataFrame.union, [self.fit(x, columns) for x in made]).distinct()) if made else None
        return together(own.nodes, NODE_COLUMNS), together(own.edges, EDGE_COLUMNS)

    def graph(self) -> Graph:
        """All of it: the first node of an id stays, its labels don't change; edges are distinct; columns that are only
        mentioned get a node; edges whose ends have none are left out; what objects change through their calls is added."""
        parts = ("objects", "steps", "access", "filters", "lineage", "rules", "calls", "triggers", "containers", "definitions", "synonyms")
        with ThreadPoolExecutor(len(parts)) as pool:
            made = list(pool.map(self._part, parts))
        fit = self.fit
        edges = reduce(DataFrame.union, [e for _, e in made if e is not None])
        # a name that holds a parameter's place is a guess, and says so
        bound = F.nullif(F.regexp_extract("dst", r"«param:(@[\w$#@]+)»", 1), F.lit(""))
        edges = edges.withColumn("bound_to", bound).withColumn("inferred", F.when(bound.isNotNull(), True)).withColumn("confidence", F.when(bound.isNotNull(), 0.5))
        edges = stored(edges.distinct())
        # the spelling of a column that was met first, of several the first by text
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where(F.col("id").contains(":column:"))
        spelt = stored(ends.groupBy(F.lower("id").alias("low")).agg(F.min("id").alias("spelt")))
        for end in ("src", "dst"):
            edges = edges.join(spelt, F.lower(end) == F.col("low"), "left").withColumn(end, F.coalesce("spelt", end)).drop("low", "spelt")
        edges = stored(edges.distinct())
        mentioned = _nodes(spelt, F.col("spelt"), "Column", name=F.substring_index("spelt", ":column:", -1), db=F.substring_index("spelt", ":", 1))
        nodes = reduce(DataFrame.union, [n for n, _ in made if n is not None])
        nodes = nodes.join(spelt, F.lower("id") == F.col("low"), "left").withColumn("id", F.coalesce("spelt", "id")).drop("low", "spelt")
        nodes = nodes.union(fit(mentioned, NODE_COLUMNS))
        rest = [c for c in NODE_COLUMNS if c not in ("id", "label")]
        nodes = nodes.groupBy("id", "label").agg(*(F.max(c).alias(c) for c in rest))
        nodes = stored(nodes.groupBy("id").agg(F.min(F.struct("label", *rest)).alias("n")).select("id", "n.label", *(F.col(f"n.{c}").alias(c) for c in rest)))
        known = nodes.select("id")
        edges = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        graph = Graph.of(nodes, stored(edges))
        effects = affects(graph)
        effects = _edges(effects, "object", "table", "AFFECTS", via="via", hops="hops")
        return Graph.of(nodes, graph.edges.select(*EDGE_COLUMNS).union(fit(effects, EDGE_COLUMNS)))


def build(facts: DataFrame) -> Graph:
    return Builder(facts).graph()


def merge_graphs(graphs: list[Graph]) -> Graph:
    """Several graphs as one: of nodes with one id the first stays, edges are put together."""
    nodes = reduce(DataFrame.union, [g.nodes.withColumn("_g", F.lit(i)) for i, g in enumerate(graphs)])
    rest = [c for c in graphs[0].nodes.columns if c != "id"]
    one = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), "_g").alias("n")).select("id", *(F.col(f"n.{c}").alias(c) for c in rest))
    edges = reduce(DataFrame.union, [g.edges for g in graphs]).distinct()
    return Graph.of(one, edges)


def numbered(edges: DataFrame) -> DataFrame:
    """With ids r0, r1, ... for an export, in the order of type and ends. Rows are sorted by ranges and numbered within each;
    what a range starts with is the number of rows before it, of which there is one figure a range."""
    rows = cut(edges.orderBy("type", "src", "dst", *(c for c in edges.columns if c not in ("type", "src", "dst"))))  # its partitions stay as they are
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes, starts, at = {r._part: r["count"] for r in rows.groupBy("_part").count().collect()}, [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    start = edges.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return rows.join(F.broadcast(start), "_part").withColumn("id", F.concat(F.lit("r"), (F.col("_start") + F.col("_row")).cast("string"))).drop("_part", "_row", "_start")
