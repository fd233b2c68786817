"""Operators over the graph, against SQL and against small graphs."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.operators import audit, changemap, compare, impact, risks, runtime
from loomgraph.operators.closure import closure
from loomgraph.plans import build, corpus, extract, testgraph
from loomgraph.plans import queries as core
from loomgraph.plans.model import Graph
from loomgraph.sources import modules, sinks

SF = "/root/testdata/sf0.001"
CHECKED = ["h1_step_rollup", "h3_coupling", "h14_describe_objects", "h19_blind_spot_severity", "g2_impact", "g5_table_impact_summary", "g7_derives_chain", "g11_f19_affects", "i_risks", "j2_impact_delta", "j6_recall", "j13_correlate_sql", "c_steps", "d_derives_from", "f_access", "f_column_access", "f_links", "g10_lineage_depths", "g12_workflows", "g13_via_calls", "g16_model_workflows", "g19_inlined_flow"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem", "orders", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def _same(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, db, name):
    found = core.queries()[name](spark, SF)
    columns = sorted(found.columns)
    cursor = db.execute(core.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert _same(tuple(r[c] for c in columns) for r in found.collect()) == _same(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


def test_small_corpus(spark):
    """The modules of corpus, which call, read and write each other."""
    facts = extract.extract(corpus.modules(spark))
    found = facts.selectExpr("full_name", "explode(steps) AS s").selectExpr("full_name", "s.ordinal", "s.action", "s.target", "s.filter_kind")
    assert _same(map(tuple, found.collect())) == _same(corpus.STEPS)
    edges = build.build(facts).edges.collect()
    bare = lambda x: x.replace("Shop:table:", "").replace("Shop::", "")
    assert {(bare(r.src), bare(r.dst)) for r in edges if r.type == "DERIVES_FROM"} == set(corpus.DERIVES)
    assert {(bare(r.owner), r.type, bare(r.dst)) for r in edges if r.type in ("READS_FROM", "WRITES_TO")} == set(corpus.ACCESS)
    links = {(r.owner, r.type, r.dst) for r in edges if r.type in ("CALLS", "FK_TO", "REFERENCES", "TARGETS", "CREATES", "ON") and (r.type != "REFERENCES" or ":column:" in r.src)}
    assert links == set(corpus.LINKS) | {("Shop::dbo.Report", "TARGETS", "Shop::dbo.SumUp"), ("Shop::dbo.SumUp", "TARGETS", "Shop::dbo.AddNote")}


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def small(spark, edges, nodes=()):
    return Graph.of(spark.createDataFrame([*nodes, ("-", "None", "-")], "id string, label string, name string"), spark.createDataFrame([*edges, ("-", "-", "NONE")], "src string, dst string, type string"))


def test_closure_of_cycles_nulls_and_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("b", "c"), (None, "d"), ("c", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a"), ("z", "z")], "seed string, node string")
    assert sorted(map(tuple, closure(edges, seeds, 9).collect())) == [("a", "b", 1), ("a", "c", 2)]
    assert closure(edges.limit(0), seeds, 9).count() == 0


def test_lineage_and_effects_of_any_depth(spark):
    columns = [(f"D:table:t{i}:column:c", f"D:table:t{i - 1}:column:c", "DERIVES_FROM") for i in range(1, 46)]
    calls = [(f"D::o{i}", f"D::o{i - 1}", "CALLS") for i in range(1, 24)] + [("D::o0", "D::o23", "CALLS"), ("D::o0", "D:table:x", "WRITES_TO")]
    g = small(spark, [*columns, *calls])
    assert sorted(map(tuple, impact.lineage_roots(g).collect())) == sorted((c, columns[0][1], i) for i, (c, _, _) in enumerate(columns, 1))
    assert sorted(map(tuple, impact.affects(g).collect())) == sorted((f"D::o{i}", "D:table:x", i, "D::o0") for i in range(1, 24))
    assert [tuple(r) for r in audit.dependent_views(g).collect()] == [("d:table:t0", 45)]
    assert impact.lineage_roots(g, 20).count() == 20


def test_change_maps(spark):
    g = small(spark, [("D::a", "D::b", "CALLS"), ("D::b", "D::c", "CALLS"), ("D::c", "D::b", "CALLS"), ("D::a", "D::d", "CALLS")])
    flows = sorted((r.path, r.cycle_back_to) for r in changemap.workflows(g).collect())
    assert flows == [("D::a > D::b > D::c", "D::b"), ("D::a > D::d", None)]
    assert sorted(map(tuple, changemap.via_calls(g).where("id = 'D::b'").collect())) == [("D::b", "D::b", 2, True), ("D::b", "D::c", 1, False)]


def test_change_maps_without_caps(spark):
    chain = [(f"D::c{i:02}", f"D::c{i + 1:02}", "CALLS") for i in range(60)]
    g = small(spark, chain)
    assert [tuple(r) for r in changemap.workflows(g).select("path", "cycle_back_to", "truncated").collect()] == [(" > ".join(f"D::c{i:02}" for i in range(61)), None, False)]
    assert changemap.via_calls(g).where("id = 'D::c00'").count() == 60 and changemap.via_calls(g, 20).where("id = 'D::c00'").count() == 20
    levels = [(f"E::{level}{a}", f"E::{level + 1}{b}", "CALLS") for level in range(1, 5) for a in range(7) for b in range(7)]
    g = small(spark, [*(("E::0", f"E::1{b}", "CALLS") for b in range(7)), *levels])
    flow = [tuple(r) for r in changemap.inlined_flow(g).where("root = 'E::0'").orderBy("position").select("position", "level", "object").collect()]
    assert len(flow) == 7 + 7**2 + 7**3 + 7**4 + 7**5 and [p for p, _, _ in flow] == list(range(len(flow)))
    assert flow[-7:] == [(len(flow) - 7 + b, 5, f"E::5{b}") for b in range(7)]
    cut = changemap.workflows(g).collect()
    assert len(cut) == 200 and all(r.truncated for r in cut)
    exact = small(spark, [("F::a", f"F::b{i:03}", "CALLS") for i in range(200)])
    assert [r.truncated for r in changemap.workflows(exact).collect()] == [False] * 200


def test_diff(spark):
    a, b = (spark.createDataFrame(r, "id string, hash string") for r in ([("x", "1"), ("y", "1")], [("y", "2"), ("z", "1")]))
    assert sorted(map(tuple, compare.object_diff(a, b).collect())) == [("x", "removed"), ("y", "changed"), ("z", "added")]
    g0, g1 = small(spark, []), small(spark, [("D::a", "D::b", "CALLS")])
    assert compare.gate(compare.impact_delta(g0, g0), True) == 0
    assert compare.gate(compare.impact_delta(g0, g1), True) == 2 and compare.gate(compare.impact_delta(g0, g1), False) == 0


def test_coverage_of_nothing_is_null(spark):
    assert audit.lineage_coverage(small(spark, [])).first().percent is None


def test_unknown_kinds_are_reported(spark):
    assert {r.name for r in audit.unknown_kinds(small(spark, [("a", "b", "ODD")])).collect()} == {"None", "NONE", "ODD"}


def test_injection_and_unused_variables(spark):
    nodes = [("D::p", "SqlObject", "p"), ("D::p#step0", "Step", "s")]
    g = small(spark, [("D::p#step0", "D::p#var:@a", "BUILDS_SQL_FROM"), ("D::p#var:@a", "D:table:t:column:c", "ASSIGNED_FROM"), ("D::p", "D::p#var:@a", "DECLARES"), ("D::p", "D::p#var:@b", "DECLARES")], nodes)
    found = {(r.rule, r.detail) for r in risks.risks(g).collect()}
    assert ("sql_injection", "") in found and ("unused_variable", "1") in found
    assert audit.taint(g).count() == 1


def test_plans(spark):
    xml = """<ShowPlanXML xmlns="x"><StoredProc ProcName="[p]"><RelOp PhysicalOp="Clustered Index Seek" EstimateRows="3.5"><Object Database="[D]" Schema="[dbo]" Table="[T]"/></RelOp>
    <RelOp PhysicalOp="Table Insert" EstimateRows="1" ActualRows="7"><Object Database="[D]" Schema="[dbo]" Table="[T]"/><Object Database="[D]" Schema="[sys]" Table="[x]"/></RelOp></StoredProc></ShowPlanXML>"""
    access = runtime.plan_access(spark.createDataFrame([(xml,), (None,), ("<a/>",)], "xml string"))
    assert sorted((r.proc, r.table, r.is_write, r.actual_rows) for r in access.collect()) == [("p", "T", False, None), ("p", "T", True, 7)]
    g = Graph.of(spark.createDataFrame([("D::dbo.p", "SqlObject", "dbo.p", "D"), ("D:table:dbo.t", "Table", "dbo.t", "D")], "id string, label string, name string, db string"), spark.createDataFrame([("D::dbo.p#step0", "D:table:dbo.t", "READS_FROM")], "src string, dst string, type string"))
    assert sorted((r.type, r.evidence) for r in runtime.enrich(g, access).collect()) == [("READS_FROM", "confirmed"), ("WRITES_TO", "discovered")]


def test_event_correlation_both_ways(spark):
    rows = [(1, 1, 0, "PROC", "a"), (1, 2, 1, "ADHOC", "x"), (1, 3, 1, "PROC", "b"), (1, 4, 2, "ADHOC", "y"), (1, 5, 0, "PROC", "c"), (1, 6, 1, "ADHOC", "z"), (2, 1, 0, "ADHOC", "w")]
    e = spark.createDataFrame([(s, q, n, t, o, q) for s, q, n, t, o in rows], "session_id bigint, seq bigint, nest_level int, object_type string, object_name string, ts bigint")
    wanted = [(1, 2, "a"), (1, 4, "b"), (1, 6, "c"), (2, 1, None)]
    for run in (runtime.correlate, runtime.correlate_sql):
        assert _same(map(tuple, run(e).collect())) == _same(wanted)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.sql").write_text("CREATE VIEW dbo.v AS SELECT a FROM dbo.t\r\nGO\r\nPRINT 1\nGO 2\nCREATE PROC dbo.p AS SELECT 1", encoding="utf-8-sig")
    (tmp_path / "in" / "deep" / "b.sql").write_text("CREATE PROC dbo.p AS SELECT 1 AS longer_one")
    found = modules.read_sql_files(spark, str(tmp_path / "in"), "D")
    assert {r.name: "longer" in r.sql for r in found.collect()} == {"D::dbo.v": False, "D::dbo.p": True}
    spark.dataSource.register(modules.SqlFolder)
    assert spark.read.format("sqlfolder").option("db", "D").load(str(tmp_path / "in")).count() == 3
    g = build.build(extract.extract(corpus.modules(spark)))
    sinks.write(g, str(tmp_path / "out"))
    back = sinks.read_parquet(spark, str(tmp_path / "out"))
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.edges.count()
    sinks.write(g, str(tmp_path / "s0"), "store")
    less = Graph(g.nodes.where("name <> 'dbo.Report'"), g.edges.where("owner <> 'Shop::dbo.Report' OR owner IS NULL"))
    assert [tuple(r) for r in sinks.update_store(less, str(tmp_path / "s0"), str(tmp_path / "s1")).collect()] == [("Shop::dbo.Report", "removed")]
    assert spark.read.parquet(str(tmp_path / "s1")).count() == spark.read.parquet(str(tmp_path / "s0")).count() - 1
    assert "most used tables" in sinks.text_report(g)
    assert impact.resolve_object(g, "clients").first().name == "dbo.clients"


def test_graph_of_synonyms_effects_guesses_and_triggers(spark):
    rows = [
        ("D::dbo.T", "CREATE TABLE dbo.T (a INT)"),
        ("D::dbo.syn", "CREATE SYNONYM dbo.syn FOR dbo.T"),
        ("D::dbo.reader", "CREATE PROCEDURE dbo.reader AS BEGIN SELECT a FROM dbo.syn; END"),
        ("D::dbo.writer", "CREATE PROCEDURE dbo.writer AS BEGIN UPDATE dbo.T SET a = 1; END"),
        ("D::dbo.middle", "CREATE PROCEDURE dbo.middle AS BEGIN EXEC dbo.writer; END"),
        ("D::dbo.top", "CREATE PROCEDURE dbo.top AS BEGIN EXEC dbo.middle; END"),
        ("D::dbo.guess", "CREATE PROCEDURE dbo.guess @t SYSNAME AS BEGIN DECLARE @s NVARCHAR(MAX) = N'DELETE FROM dbo.' + QUOTENAME(@t); EXEC sp_executesql @s; END"),
        ("D::dbo.maker", "CREATE PROCEDURE dbo.maker AS BEGIN EXEC (N'CREATE TRIGGER dbo.tr ON dbo.T AFTER INSERT AS BEGIN DELETE FROM dbo.U; END'); END"),
        ("D::dbo.fires", "CREATE TRIGGER dbo.fires ON dbo.T AFTER INSERT AS BEGIN EXEC dbo.lonely; END"),
        ("D::dbo.lonely", "CREATE PROCEDURE dbo.lonely AS BEGIN SELECT 1 AS x; END"),
    ]
    g = build.build(extract.extract(spark.createDataFrame(rows, "name string, sql string")))
    edges = g.edges.collect()
    of = lambda kind: {(r.src, r.dst) for r in edges if r.type == kind}
    assert of("ALIAS_OF") == {("D::dbo.syn", "D:table:dbo.t")} and any(r.owner == "D::dbo.reader" and r.dst == "D:table:dbo.t" for r in edges if r.type == "READS_FROM")
    assert {(r.src, r.dst, r.via, r.hops) for r in edges if r.type == "AFFECTS"} == {("D::dbo.middle", "D:table:dbo.t", "D::dbo.writer", 1), ("D::dbo.top", "D:table:dbo.t", "D::dbo.writer", 2)}
    guessed = [r for r in edges if r.type == "WRITES_TO" and r.owner == "D::dbo.guess"]
    assert [(r.inferred, r.confidence, r.bound_to) for r in guessed] == [(True, 0.5, "@t")] and not any(r.inferred for r in edges if r.owner == "D::dbo.writer")
    assert ("D::dbo.maker", "D::dbo.tr") in of("CREATES") and not [r for r in edges if r.type == "WRITES_TO" and r.owner == "D::dbo.maker"]
    flows = changemap.workflows(g).collect()
    assert [r.path for r in flows] == ["D::dbo.top > D::dbo.middle > D::dbo.writer"] and changemap.via_calls(g).where("id LIKE '%fires'").count() == 0


def test_lineage_depth_is_the_greatest(spark):
    c = lambda x: f"D:table:t:column:{x}"
    edges = [("d", "c"), ("c", "b"), ("b", "a"), ("d", "a"), ("x", "y"), ("y", "x"), ("y", "a")]
    g = small(spark, [(c(a), c(b), "DERIVES_FROM") for a, b in edges])
    assert {tuple(r) for r in impact.lineage_depths(g).collect()} == {(c("d"), 3), (c("c"), 2), (c("b"), 1), (c("y"), 1), (c("x"), 0)}


def test_model_workflows(spark):
    g = small(spark, [(f"D::c{i:02}", f"D::c{i + 1:02}", "CALLS") for i in range(15)])
    (flow,) = changemap.model_workflows(g).collect()
    assert flow.path == " > ".join(f"D::c{i:02}" for i in range(11)) and flow.cycle_back_to is None


def test_documents_are_whole(spark, tmp_path):
    import json
    import xml.etree.ElementTree as tree
    from pathlib import Path

    g = build.build(extract.extract(corpus.modules(spark)))
    whole = lambda name: "".join(p.read_text() for p in sorted(Path(tmp_path, name).glob("part-*")))
    sinks.write(g, str(tmp_path / "d"), "document")
    doc = json.loads(whole("d"))
    nodes, edges = g.nodes.count(), g.edges.count()
    assert (len(doc["nodes"]), len(doc["relationships"])) == (nodes, edges) and [r["id"] for r in doc["relationships"]] == [f"r{i}" for i in range(edges)]
    sinks.write(g, str(tmp_path / "g"), "graphml")
    root = tree.fromstring(whole("g").encode())
    assert [len(root.findall(f".//{{http://graphml.graphdrawing.org/xmlns}}{t}")) for t in ("node", "edge")] == [nodes, edges]
    assert sinks.SINKS["document"].extension == ".json"


def test_tables_of_a_catalog(spark):
    columns = [("D", "dbo", "A", "Id", "INT", False, 1, True, None, 1), ("D", "dbo", "A", "B", "INT", True, 2, False, None, None), ("D", "dbo", "A", "C", "INT", True, 3, False, "[Id]+[B]", None), ("D", "dbo", "Z", "Id", "INT", False, 1, False, None, 1)]
    columns = spark.createDataFrame(columns, "db string, schema string, table string, column string, type string, nullable boolean, ordinal int, identity boolean, computed string, key_ordinal int")
    keys = spark.createDataFrame([("D", "dbo", "A", "fk1", 1, "B", "dbo", "Z", "Id")], "db string, schema string, table string, key string, ordinal int, column string, to_schema string, to_table string, to_column string")
    facts = {r["full_name"]: r for r in extract.extract(modules.table_definitions(columns, keys)).collect()}
    a = facts["dbo.A"]["tables"][0]
    assert {c["name"]: (c["primary_key"], c["identity"], c["nullable"]) for c in a["columns"]}["Id"] == (True, True, False)
    assert a["columns"][2]["computed_from"] == ["B", "Id"] and [(k["columns"], k["to"], k["to_columns"]) for k in a["foreign_keys"]] == [(["B"], "dbo.Z", ["Id"])]
    assert modules.table_definitions(columns.drop("identity", "computed", "key_ordinal")).count() == 2


def test_captured_events(spark):
    event = """<event name="sp_statement_completed" timestamp="2024-03-01T10:00:00.000Z"><data name="nest_level"><value>1</value></data><data name="object_type"><value>8272</value><text>PROC</text></data><data name="object_name"><value>AddNote</value></data><data name="showplan_xml"><value><ShowPlanXML a="1"><X/></ShowPlanXML></value></data><action name="session_id"><value>55</value></action></event>"""
    rows = modules.captured_events(spark.createDataFrame([(event, 7), ("<event/>", 8)], "event_data string, file_offset bigint")).collect()
    assert [(r.session_id, r.seq, r.nest_level, r.object_type, r.object_name, r.plan_xml) for r in rows] == [(55, 7, 1, "PROC", "AddNote", '<ShowPlanXML a="1"><X/></ShowPlanXML>')]


def test_benchmark_cases_and_grades(spark):
    from loomgraph.operators import views
    from loomgraph.plans import testgraph

    g = testgraph.graph(spark, SF)
    cases = views.benchmark_cases(g)
    rows = {r.kind: r for r in cases.collect()}
    assert set(rows) == set(views.CASES) - {"call_condition"} and all(r.answer == sorted(r.answer) or r.kind == "top_steps" for r in rows.values())
    assert rows == {r.kind: r for r in views.benchmark_cases(g).collect()}
    given = spark.createDataFrame([("writes_of_object", rows["writes_of_object"].answer), ("table_consumers", [rows["table_consumers"].answer[0], "wrong"])], "kind string, answer array<string>")
    graded = {r.kind: r for r in views.grade(cases, given).collect()}
    assert (graded["writes_of_object"].precision, graded["writes_of_object"].recall, graded["writes_of_object"].exact) == (1, 1, True)
    assert graded["table_consumers"].precision == 0.5 and not graded["table_consumers"].exact and graded["column_roots"].recall == 0


def test_control_flow_keeps_equal_blocks_apart(spark):
    from loomgraph.operators import views

    sql = "CREATE PROCEDURE dbo.p AS BEGIN\nIF @a = 1 DELETE FROM dbo.T;\nIF @a = 1 BEGIN DELETE FROM dbo.U; WHILE @b < 2 DELETE FROM dbo.V; END\nEND"
    facts = extract.extract(spark.createDataFrame([("D::dbo.p", sql)], "name string, sql string"))
    assert [tuple(r) for r in views.flow_metrics(facts).collect()] == [("dbo.p", 3, 2)]
    nodes = views.control_flow(facts).collect()
    assert len([n for n in nodes if n.kind == "condition" and n.text == "IF: @a = 1"]) == 2 and len([n for n in nodes if n.kind == "step"]) == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_invariants_of_odd_rows_in_one_shuffle(spark):
    nodes = [("D::a", "SqlObject", "a"), ("D::a", "SqlObject", "a"), (None, "Table", "x"), (None, "Step", "s"), ("D::b#step0", "Step", "s"), ("D:table:t:column:c", "Column", "c"), ("odd", None, "o")]
    g = small(spark, [("D::a", "D::gone", "CALLS"), ("D::a", None, "CALLS"), ("D::a", "D::a", "WRITES_TO"), ("D::a", None, None)], nodes)
    found = audit.invariants(g)
    assert "Join" not in _plan(found) and _plan(found).count("Exchange hashpartitioning") == 1
    assert dict(map(tuple, found.collect())) == {"duplicate ids": 2, "edges without an end": 3, "null ids": 2, "steps without an owner": 2, "columns without a table": 1, "writes to what is no table": 1, "negative complexity": 0}


def test_steps_of_the_test_graph_are_grouped_once(spark):
    g = testgraph.graph(spark, SF)
    plans = [_plan(x) for x in (g.label("Step"), g.type("READS_FROM"), g.type("FILTERS_ON"), g.nodes, g.edges)]
    assert all("lineitem.parquet" not in p and "Exchange hashpartitioning(l_suppkey" not in p for p in plans)


def test_impact_delta_by_data_looks_at_what_changed(spark, monkeypatch):
    nodes = [(f"D::{x}", "SqlObject", x) for x in "abcdef"]
    edges = [("D::a", "D:table:t", "WRITES_TO"), ("D::b", "D:table:t", "READS_FROM"), ("D::a", "D:table:u", "WRITES_TO"), ("D::b", "D:table:u", "READS_FROM"), ("D::c", "D:table:u", "READS_FROM"), ("D::d", "D:table:v", "WRITES_TO"), ("D::d", "D:table:v", "READS_FROM")]
    more = [("D::e", "D:table:v", "READS_FROM"), ("D::f", "D:table:u", "WRITES_TO"), ("D::a", None, "WRITES_TO")]
    g0, g1 = small(spark, edges, nodes), small(spark, [*edges[:2], edges[3], *edges[5:], *more], nodes)
    monkeypatch.setattr(compare, "data_reach", lambda _: pytest.fail("all pairs are made"))
    # a reaches b over t still; c reads u no more; a writes u no more
    assert sorted(map(tuple, compare.impact_delta(g0, g1).collect())) == [("D::a", "D::c", "data", "removed"), ("D::d", "D::e", "data", "added"), ("D::f", "D::b", "data", "added")]


def test_readers_of_what_is_written_are_no_shuffled_pairs(spark, monkeypatch):
    nodes = [("D::a", "SqlObject", "a", "PROCEDURE"), ("D::b", "SqlObject", "b", "FUNCTION"), ("D::c", "SqlObject", "c", "VIEW"), ("D::d", "SqlObject", "d", "PROCEDURE")]
    edges = [("D::a", "D:table:t", "WRITES_TO"), ("D::a", "D:table:t", "READS_FROM"), ("D::b", "D:table:t", "READS_FROM"), ("D::b", "D:table:t", "READS_FROM"), ("D::c", "D:table:t", "READS_FROM"), ("D::a", "D:table:u", "WRITES_TO"), ("D::a", "D:table:u", "READS_FROM")]
    edges += [("D::a", "D:table:v", "WRITES_TO"), ("D::b", "D:table:v", "READS_FROM"), ("D::d", "D:table:v", "READS_FROM"), ("D::c", "D:table:v", "WRITES_TO"), ("D::a", None, "WRITES_TO"), ("D::b", None, "READS_FROM")]
    g = Graph.of(spark.createDataFrame(nodes, "id string, label string, name string, object_type string"), spark.createDataFrame(edges, "src string, dst string, type string"))
    monkeypatch.setattr(impact, "shared_data", lambda _: pytest.fail("all pairs are made"))
    assert sorted(map(tuple, impact.via_data(g).collect())) == [("D::a", 2, "D::b, D::d"), ("D::c", 1, "D::b, D::d")]


def test_effects_are_shuffled_as_lists(spark):
    g = small(spark, [("D::a", "D::b", "CALLS"), ("D::a", "D::c", "CALLS"), ("D::b", "D::d", "CALLS"), ("D::c", "D:table:t", "WRITES_TO"), ("D::b", "D:table:t", "WRITES_TO"), ("D::d", "D:table:t", "WRITES_TO"), ("D::d", "D:table:u", "WRITES_TO"), ("D::d", None, "WRITES_TO")])
    assert "hashpartitioning(object#" in _plan(impact.affects(g)) and not re.search(r"hashpartitioning\([^)]*table#", _plan(impact.affects(g)))
    rows = [("D::a", "D:table:t", 1, "D::b"), ("D::a", "D:table:u", 2, "D::d"), ("D::b", "D:table:t", 1, "D::d"), ("D::b", "D:table:u", 1, "D::d")]
    assert sorted(map(tuple, impact.affects(g).collect())) == rows
    assert sorted(map(tuple, impact.affects(g, table="D:table:u").collect())) == [r for r in rows if r[1] == "D:table:u"]


def test_longest_ways_take_each_edge_once(spark, monkeypatch):
    ways = [(i, i // 2) for i in range(1, 300)] + [(i, i // 3) for i in range(1, 300, 5)]
    ways = [(a, b) for a, b in ways if a != b]
    depth = {0: 0}
    for a in range(1, 300):
        depth[a] = 1 + max(depth[b] for x, b in ways if x == a)
    g = small(spark, [(f"c{a}", f"c{b}", "DERIVES_FROM") for a, b in ways])
    with monkeypatch.context() as m:
        m.setattr("loomgraph.operators.closure.closure", lambda *_: pytest.fail("all pairs are made"))
        assert {tuple(r) for r in impact.lineage_depths(g).collect()} == {(f"c{a}", depth[a]) for a in range(1, 300)}
    # two cycles, a way between them and ways in and out
    odd = [("x", "y"), ("y", "x"), ("y", "w"), ("w", "p"), ("p", "q"), ("q", "p"), ("q", "o"), ("i", "x"), ("i", "o"), ("z", "z")]
    g = small(spark, [(a, b, "DERIVES_FROM") for a, b in odd])
    assert {tuple(r) for r in impact.lineage_depths(g).collect()} == {("x", 0), ("y", 2), ("w", 1), ("p", 0), ("q", 1), ("i", 1)}


def test_risks_group_reads_and_writes_once(spark):
    class Asked(Graph):
        def type(self, *types):
            asked.extend(types)
            return super().type(*types)

    asked = []
    nodes = spark.createDataFrame([("D::a", "SqlObject", "a", None, 9), ("D::b", "SqlObject", "b", None, 1), ("D::a#step0", "Step", "s", "UPDATE", 0), ("D::a#step1", "Step", "s", "DELETE", 0), ("D::b#step0", "Step", "s", "UPDATE", 0), ("D:table:t", "Table", "t", None, 0), ("D:table:t:column:c", "Column", "c", None, 0)], "id string, label string, name string, action string, complexity bigint")
    writes = [("D::a#step0", "D:table:t", "WRITES_TO", x) for x in ("UPDATE", "UPDATE", "DELETE", None)] + [("D::b#step0", "D:table:t", "WRITES_TO", x) for x in ("UPDATE", "INSERT")]
    filters = [(s, "D:table:t:column:c", "FILTERS_ON", "UPDATE") for s in ("D::a#step0", "D::b#step0", "D::b#step0")]
    g = Graph.of(nodes, spark.createDataFrame([*writes, *filters], "src string, dst string, type string, action_type string"))
    found = {(r.rule, r.component, r.detail) for r in risks.risks(Asked(g.nodes, g.edges)).collect()}
    assert asked.count("WRITES_TO") == 1 and asked.count("READS_FROM") == 1
    assert {x for x in found if x[0] in ("change_without_where", "repeated_writes", "table_coupling", "written_never_read")} == {("change_without_where", "D::a", ""), ("repeated_writes", "D::a", "4"), ("table_coupling", "D:table:t", "4"), ("written_never_read", "D:table:t", "")}


def test_degrees_make_distinct_edges_once(spark):
    g = small(spark, [("D::a", "D::b", "CALLS"), ("D::a#step0", "D:table:t", "READS_FROM"), ("D::a#step1", "D:table:t", "READS_FROM"), ("D::a#step1", "D:table:t", "WRITES_TO"), ("D::b", "D::b", "CALLS")])
    found = audit.degrees(g)
    assert _plan(found).count("Scan ExistingRDD") == 1
    assert {tuple(r) for r in found.collect()} == {("D::a", 3), ("D::b", 3), ("D:table:t", 2)}


def test_parsing_is_spread_over_the_cores(spark):
    sql = spark.createDataFrame([(f"D::dbo.p{i}", f"CREATE PROCEDURE dbo.p{i} AS DELETE FROM dbo.t{i}") for i in range(40)], "name string, sql string").coalesce(1)
    facts = extract.extract(sql)
    assert len(facts.inputFiles()) == spark.sparkContext.defaultParallelism
    assert {r.full_name for r in facts.select("full_name").collect()} == {f"dbo.p{i}" for i in range(40)}
    rows = spark.range(5).withColumnRenamed("id", "row")
    assert extract._spread(rows, 5000).rdd.getNumPartitions() == 5 and extract._spread(rows, 0).rdd.getNumPartitions() == 1
