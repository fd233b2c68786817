"""Queries over the test graph, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, changemap, compare, impact, risks, runtime
from ..operators import views as pages
from . import build, extract, specs, testgraph
from .model import Graph

Query = Callable[[SparkSession, str], DataFrame]
TABLE, COLUMN, DEEP = "T:table:part.1", "T:table:part.1:column:c0", "T:table:part.150:column:c0"

_LISTED = "string_agg(DISTINCT {0}, ', ' ORDER BY {0})"
_ROLLUP = """r AS (SELECT split_part(id, '#', 1) AS id, count(*) AS total_steps, count(*) FILTER (WHERE is_dynamic) AS dynamic_steps,
  count(*) FILTER (WHERE is_dynamic AND dynamic_sql IS NULL) AS unresolved_steps, max(nesting) AS max_nesting FROM nodes WHERE label = 'Step' GROUP BY 1),
o AS (SELECT n.* EXCLUDE (nesting), coalesce(total_steps, 0) AS total_steps, coalesce(dynamic_steps, 0) AS dynamic_steps, coalesce(unresolved_steps, 0) AS unresolved_steps,
  coalesce(max_nesting, 0) AS max_nesting FROM nodes n LEFT JOIN r ON n.id = r.id WHERE label = 'SqlObject')"""
_MACRO = "me AS (SELECT DISTINCT owner AS src, dst, type FROM edges WHERE type IN ('CALLS', 'READS_FROM', 'WRITES_TO'))"


def _closure(edges: str, seed: str, depth: int) -> str:
    """c(node, hops) by (src, dst) of a name or subquery, from a node at 0 hops."""
    return f"w(node, hops) AS (SELECT '{seed}', 0 UNION SELECT e.dst, w.hops + 1 FROM w JOIN {edges} e ON e.src = w.node WHERE w.hops < {depth}), c AS (SELECT node, min(hops) AS hops FROM w GROUP BY node)"


def _blind(db: str) -> str:
    return f"SELECT 'unknown' AS bucket, 'unresolved dynamic SQL' AS reason FROM o WHERE unresolved_steps > 0 AND db = '{db}'"


def _summary(buckets: str) -> str:
    return f"""rc AS (SELECT bucket, reason, count(*) AS n FROM ({buckets}) x GROUP BY bucket, reason)
SELECT bucket, sum(n)::BIGINT AS objects, coalesce(string_agg(n || ' ' || reason, ', ' ORDER BY n || ' ' || reason), '') AS detail FROM rc GROUP BY bucket"""


_BACK = "(SELECT dst AS src, src AS dst FROM edges WHERE type = 'DERIVES_FROM')"
_FORTH = "(SELECT src, dst FROM edges WHERE type = 'DERIVES_FROM')"
_IMPACT = "(SELECT dst AS src, owner AS dst FROM edges WHERE type IN ('READS_FROM', 'WRITES_TO', 'CALLS', 'FK_TO', 'TARGETS', 'EXECUTES_SQL', 'DEPENDS_ON', 'REFERENCES'))"
_EVIDENCE = """ev AS (SELECT dst AS col, owner, bool_or(coalesce(resolution = 'direct', false)) AS d, bool_or(coalesce(resolution = 'via_view', false)) AS v, bool_or(coalesce(resolution = 'star_expanded', false)) AS s
  FROM edges WHERE type IN ('READS_COLUMN', 'WRITES_COLUMN', 'FILTERS_ON') GROUP BY ALL),
ce AS (SELECT col AS column_id, owner AS object, CASE WHEN d THEN 'certain' WHEN v OR s THEN 'probable' END AS bucket, CASE WHEN d THEN NULL WHEN v THEN 'through a view' WHEN s THEN 'from *' END AS reason FROM ev WHERE owner IN (SELECT id FROM nodes WHERE label = 'SqlObject'))"""
_TABLE_IMPACT = f"""h(o, hops, sure) AS (SELECT owner, 1, via_view IS NULL FROM edges WHERE type IN ('READS_FROM', 'WRITES_TO') AND dst = '{TABLE}'
  UNION SELECT e.owner, h.hops + 1, false FROM h JOIN edges e ON e.dst = h.o AND e.type = 'CALLS' WHERE h.hops < 10),
ti AS (SELECT o AS object, min(hops)::BIGINT AS hops, CASE WHEN bool_or(sure) THEN 'certain' ELSE 'probable' END AS bucket,
  CASE WHEN bool_or(sure) THEN NULL WHEN min(hops) = 1 THEN 'through a view' ELSE 'called indirectly' END AS reason FROM h WHERE o IN (SELECT id FROM nodes WHERE label = 'SqlObject') GROUP BY o)"""


def _chain_sql(edges: str, seed: str, arrow: str) -> str:
    """Each node has one shortest path here, as derivation is a tree towards its root or the path first by text wins."""
    return f"""p(node, hops, path) AS (SELECT '{seed}', 0, ['{seed}'] UNION ALL SELECT e.dst, p.hops + 1, list_append(p.path, e.dst) FROM p JOIN (SELECT DISTINCT src, dst FROM {edges}) e ON e.src = p.node WHERE p.hops < 20 AND NOT list_contains(p.path, e.dst))
SELECT node, hops::BIGINT AS hops, array_to_string(list_transform(path, lambda x: split_part(x, ':table:', 2)), '{arrow}') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS rn FROM p WHERE hops > 0) WHERE rn = 1"""


_AFFECTS = """aw(seed, node, hops) AS (SELECT DISTINCT owner, owner, 0 FROM edges WHERE type = 'CALLS' AND src <> dst UNION SELECT aw.seed, e.dst, aw.hops + 1 FROM aw JOIN edges e ON e.owner = aw.node AND e.type = 'CALLS' AND e.src <> e.dst WHERE aw.hops < 20),
ac AS (SELECT seed, node, min(hops) AS hops FROM aw GROUP BY seed, node),
af AS (SELECT seed AS object, dst AS tab, hops, node, row_number() OVER (PARTITION BY seed, dst ORDER BY hops, node) AS rn FROM ac JOIN (SELECT DISTINCT owner, dst FROM edges WHERE type = 'WRITES_TO') w ON w.owner = ac.node WHERE ac.node <> ac.seed)"""
_ROOTS = f"""rw(seed, node, hops) AS (SELECT DISTINCT src, src, 0 FROM {_FORTH} WHERE src <> dst UNION SELECT rw.seed, e.dst, rw.hops + 1 FROM rw JOIN {_FORTH} e ON e.src = rw.node AND e.src <> e.dst WHERE rw.hops < 20),
rt AS (SELECT seed AS col, node AS root, min(hops)::BIGINT AS hops FROM rw WHERE hops > 0 AND node NOT IN (SELECT src FROM {_FORTH} WHERE src <> dst) GROUP BY seed, node)"""
_SHARED = "sd AS (SELECT DISTINCT w.owner AS writer, w.dst AS tab, r.owner AS reader FROM edges w JOIN edges r ON w.dst = r.dst AND w.type = 'WRITES_TO' AND r.type = 'READS_FROM' AND w.owner <> r.owner)"
_RISKS = f"""{_ROLLUP}, st AS (SELECT split_part(n.id, '#', 1) AS id, bool_or(coalesce(select_star, false)) AS star, bool_or(action = 'TRUNCATE') AS truncates, bool_or(action IN ('UPDATE', 'DELETE') AND n.id NOT IN (SELECT src FROM edges WHERE type = 'FILTERS_ON')) AS unfiltered FROM nodes n WHERE label = 'Step' GROUP BY 1),
pw AS (SELECT owner, dst, count(*) AS n FROM edges WHERE type = 'WRITES_TO' GROUP BY ALL), wr AS (SELECT owner, count(*) AS tables_written, max(n) AS most FROM pw GROUP BY owner),
idl AS (SELECT src AS id, count(*) AS idle FROM edges WHERE type = 'DECLARES' AND dst NOT IN (SELECT dst FROM edges WHERE type IN ('USES_VARIABLE', 'BUILDS_SQL_FROM') UNION SELECT src FROM edges WHERE type = 'ASSIGNED_FROM') GROUP BY 1),
inj AS (SELECT DISTINCT b.owner AS id FROM edges b JOIN edges a ON a.type = 'ASSIGNED_FROM' AND a.src = b.dst WHERE b.type = 'BUILDS_SQL_FROM'),
f AS (SELECT o.*, coalesce(truncates, false) AS truncates, coalesce(idle, 0) AS idle, o.id IN (SELECT id FROM inj) AS injection, coalesce(star, false) AS star, coalesce(unfiltered, false) AS unfiltered, coalesce(tables_written, 0) AS tw, coalesce(most, 0) AS most, o.id IN (SELECT dst FROM edges WHERE type = 'CALLS') AS called FROM o LEFT JOIN st ON o.id = st.id LEFT JOIN idl ON idl.id = o.id LEFT JOIN wr ON wr.owner = o.id),
tf AS (SELECT t.id, coalesce(cols, 0) AS cols, coalesce(pk, false) AS pk, coalesce(alln, false) AS alln, coalesce(writers, 0) AS writers, coalesce(readers, 0) AS readers FROM nodes t
  LEFT JOIN (SELECT split_part(id, ':column:', 1) AS id, count(*) AS cols, bool_or(is_primary_key) AS pk, bool_and(is_nullable) AS alln FROM nodes WHERE label = 'Column' GROUP BY 1) c ON c.id = t.id
  LEFT JOIN (SELECT dst, count(DISTINCT action_type || owner) AS writers FROM edges WHERE type = 'WRITES_TO' GROUP BY 1) w ON w.dst = t.id
  LEFT JOIN (SELECT dst, count(*) AS readers FROM edges WHERE type = 'READS_FROM' GROUP BY 1) r ON r.dst = t.id WHERE label = 'Table'),
risk AS ({" UNION ALL ".join(f"SELECT '{s}' AS severity, '{c}' AS category, '{r}' AS rule, id AS component, {d} AS detail FROM {t} WHERE {w}" for s, c, r, t, w, d in [
    ("critical", "security", "sql_injection", "f", "injection", "''"),
    ("medium", "performance", "sp_prefix", "f", "starts_with(lower(split_part(name, '.', -1)), 'sp_')", "''"),
    ("medium", "integrity", "truncate", "f", "truncates", "''"),
    ("low", "maintainability", "unused_variable", "f", "idle > 0", "idle::VARCHAR"),
    ("low", "maintainability", "dead_code", "f", "NOT called AND tw = 0 AND total_steps > 0 AND (lower(name) LIKE '%.fn%' OR lower(name) LIKE '%.ufn%' OR lower(name) LIKE '%function%')", "''"),
    ("high", "security", "dynamic_sql", "f", "NOT injection AND dynamic_sql_calls > 0", "dynamic_sql_calls::VARCHAR"),
    ("high", "robustness", "cursor_in_transaction_without_handler", "f", "has_cursor AND has_transaction AND NOT has_error_handling", "''"),
    ("high", "robustness", "transaction_without_handler", "f", "NOT has_cursor AND has_transaction AND NOT has_error_handling", "''"),
    ("medium", "robustness", "unprotected_write", "f", "tw > 0 AND NOT has_transaction AND NOT has_error_handling", "tw::VARCHAR"),
    ("medium", "performance", "cursor", "f", "has_cursor", "''"),
    ("medium", "performance", "repeated_writes", "f", "most >= 3", "most::VARCHAR"),
    ("low", "performance", "select_star", "f", "star", "''"),
    ("high", "integrity", "change_without_where", "f", "unfiltered", "''"),
    ("medium", "maintainability", "complexity", "f", "complexity >= 10", "complexity::VARCHAR"),
    ("low", "maintainability", "complexity", "f", "complexity BETWEEN 6 AND 9", "complexity::VARCHAR"),
    ("medium", "maintainability", "nesting", "f", "max_nesting >= 4", "max_nesting::VARCHAR"),
    ("low", "maintainability", "nesting", "f", "max_nesting = 3", "max_nesting::VARCHAR"),
    ("medium", "design", "does_too_much", "f", "tw >= 5", "tw::VARCHAR"),
    ("info", "quality", "parse_error", "f", "parse_error <> ''", "parse_error"),
    ("medium", "integrity", "no_primary_key", "tf", "cols > 0 AND NOT pk", "''"),
    ("medium", "design", "table_coupling", "tf", "writers >= 4", "writers::VARCHAR"),
    ("low", "design", "written_never_read", "tf", "writers > 0 AND readers = 0 AND cols > 0", "''"),
    ("low", "integrity", "fully_nullable", "tf", "cols > 0 AND alln", "''"),
    ("low", "design", "wide_table", "tf", "cols >= 12", "cols::VARCHAR"),
])})"""


_BROKEN = """bnodes AS (SELECT CASE WHEN label = 'Workflow' THEN NULL ELSE id END AS id, label, CASE WHEN label = 'SqlObject' AND id LIKE '%4' THEN -complexity ELSE complexity END AS complexity FROM nodes WHERE NOT (label = 'SqlObject' AND id LIKE '%8') AND NOT (label = 'Table' AND id LIKE '%3')
  UNION ALL SELECT id, label, complexity FROM nodes WHERE label = 'Table' AND id LIKE '%7'), bedges AS (SELECT * FROM edges)"""


def broken(graph: Graph) -> Graph:
    """The graph with faults of each kind that the invariants look for."""
    n = graph.nodes.where("NOT (label = 'SqlObject' AND id LIKE '%8') AND NOT (label = 'Table' AND id LIKE '%3')")
    n = n.withColumn("id", F.when(F.col("label") != "Workflow", F.col("id"))).withColumn("complexity", F.when((F.col("label") == "SqlObject") & F.col("id").like("%4"), -F.col("complexity")).otherwise(F.col("complexity")))
    return Graph(n.unionByName(graph.nodes.where("label = 'Table' AND id LIKE '%7'")), graph.edges)


def later(graph: Graph) -> Graph:
    """A second version of the graph: objects whose number ends in 7 call nothing any more, those whose number ends in 11 read nothing."""
    return Graph(graph.nodes.where("NOT (label = 'SqlObject' AND id LIKE '%3')").withColumn("complexity", F.when(F.col("id").like("%5"), F.col("complexity") + 1).otherwise(F.col("complexity"))), graph.edges.where("NOT (type = 'CALLS' AND src LIKE '%7') AND NOT (type = 'READS_FROM' AND owner LIKE '%11')"))


def _oracle_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References found and expected, from orders and customers: a row of the first is lost if the order's number ends in 50."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    expected = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.concat(F.lit("m"), (F.col("o_orderkey") % 997).cast("string")).alias("module"), F.concat(F.lit("dbo.t"), F.col("c_nationkey").cast("string")).alias("entity"), F.concat(F.lit("c"), (F.col("o_custkey") % 31).cast("string")).alias("column"), "o_orderkey", "o_orderstatus"
    )
    found = expected.where("o_orderkey % 50 <> 0").withColumn("resolution", F.when(F.col("o_orderstatus") == "O", "direct").when(F.col("o_orderstatus") == "F", "star_expanded").otherwise("via_view"))
    found = found.withColumn("column", F.when(F.col("o_orderkey") % 77 == 5, F.concat("column", F.lit("x"))).otherwise(F.col("column")))
    return found.select("module", "entity", "column", "resolution"), expected.select("module", "entity", "column")


_PAIRS = """WITH ex AS (SELECT 'm' || (o_orderkey % 997) AS module, 'dbo.t' || c_nationkey AS entity, 'c' || (o_custkey % 31) AS col, o_orderkey AS k, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey),
fo AS (SELECT module, entity, CASE WHEN k % 77 = 5 THEN col || 'x' ELSE col END AS col, CASE WHEN s = 'O' THEN 'direct' WHEN s = 'F' THEN 'star_expanded' ELSE 'via_view' END AS resolution FROM ex WHERE k % 50 <> 0),
e AS (SELECT DISTINCT module, entity, col FROM ex)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as captured events: a session is a user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 4).cast("int").alias("nest_level"), F.when(F.col("event_id") % 3 == 0, "PROC").otherwise("ADHOC").alias("object_type"), F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("object_name"))


_TRACE = """WITH t AS (SELECT user_id AS session_id, ts, event_id AS seq, event_id % 4 AS lvl, event_id % 3 = 0 AS proc, 'p' || (event_id % 50) AS object_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
pr AS (SELECT a.session_id, a.rn, a.lvl, a.object_name, min(b.rn) AS ends FROM t a LEFT JOIN t b ON a.session_id = b.session_id AND b.rn > a.rn AND (CASE WHEN b.proc THEN b.lvl ELSE b.lvl + 1 END) <= a.lvl WHERE a.proc GROUP BY ALL)
SELECT t.session_id, t.seq, arg_max(pr.object_name, pr.rn) AS procedure FROM t LEFT JOIN pr ON t.session_id = pr.session_id AND pr.rn < t.rn AND (pr.ends IS NULL OR t.rn < pr.ends) WHERE NOT t.proc GROUP BY t.session_id, t.seq"""


def _on(function: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(testgraph.graph(spark, sf_dir))


def _define() -> dict[str, tuple[Query, str]]:
    g = testgraph.ctes()
    out: dict[str, tuple[Query, str]] = {}

    def add(name: str, function: Callable[[Graph], DataFrame], sql: str) -> None:
        out[name] = (_on(function), f"{g}{sql if sql.startswith(' SELECT') else ', ' + sql}")

    add("h1_step_rollup", audit.step_rollup, f"{_ROLLUP} SELECT id, total_steps, dynamic_steps, unresolved_steps, max_nesting FROM r")
    add("h2_ranking", audit.ranking, f"{_ROLLUP} SELECT name, complexity, total_steps, dynamic_steps, max_nesting, (SELECT count(*) FROM edges WHERE type = 'CALLS' AND src = o.id) AS calls_out FROM o ORDER BY complexity DESC, max_nesting DESC, name LIMIT 5")
    add("h3_coupling", audit.coupling, "x AS (SELECT n.name, (SELECT count(*) FROM edges e WHERE e.type = 'CALLS' AND e.src = n.id) AS fan_out, (SELECT count(*) FROM edges e WHERE e.type = 'CALLS' AND e.dst = n.id) AS fan_in FROM nodes n WHERE label = 'SqlObject') SELECT * FROM x WHERE fan_out + fan_in > 0")
    add("h4_criticality", audit.criticality, " SELECT n.name, count(DISTINCT e.dst) AS tables_written, n.complexity FROM edges e JOIN nodes n ON n.id = e.owner AND n.label = 'SqlObject' WHERE e.type = 'WRITES_TO' GROUP BY n.id, n.name, n.complexity ORDER BY 2 DESC, 1 LIMIT 10")
    add("h5_workflow_footprint", lambda x: audit.workflow_footprint(x, impact.workflow_writes(x)), " SELECT n.name AS workflow, count(DISTINCT w.dst) AS tables_written FROM edges w JOIN edges b ON b.type = 'BELONGS_TO' AND b.src = w.owner JOIN nodes n ON n.id = b.dst AND n.label = 'Workflow' WHERE w.type = 'WRITES_TO' GROUP BY 1")
    add("h6_hot_tables", audit.hot_tables, " SELECT n.name, count(*) AS degree FROM edges e JOIN nodes n ON n.id = e.dst AND n.label = 'Table' WHERE e.type IN ('READS_FROM', 'WRITES_TO') GROUP BY n.name ORDER BY 2 DESC, 1 LIMIT 10")
    add("h7_no_error_handling", audit.without_error_handling, " SELECT name FROM nodes WHERE label = 'SqlObject' AND NOT has_error_handling")
    add("h7_cursors", audit.with_cursors, " SELECT name FROM nodes WHERE label = 'SqlObject' AND has_cursor")
    add("h8_dynamic_sql", audit.dynamic_sql, f"{_ROLLUP} SELECT name, dynamic_steps, total_steps FROM o WHERE dynamic_steps > 0")
    add("h9_destructive_steps", audit.destructive_steps, " SELECT action, count(*) AS n FROM nodes WHERE label = 'Step' AND action IN ('DELETE', 'TRUNCATE', 'DROP') GROUP BY action")
    add("h10_inventory", audit.inventory, " SELECT object_type, schema_name, count(*) AS n FROM nodes WHERE label = 'SqlObject' GROUP BY ALL")
    add("h11_schema_governance", audit.schema_governance, " SELECT data_type, count(*) AS columns, count(*) FILTER (WHERE is_nullable) AS nullable, count(*) FILTER (WHERE is_primary_key) AS primary_keys FROM nodes WHERE label = 'Column' GROUP BY data_type")
    add("h12_h13_store_info", lambda x: audit.store_info(x, "2026-01-01", "2026-02-15"), " SELECT 'node' AS kind, label AS name, count(*) AS n, 45::BIGINT AS age_days, true AS stale FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*), 45, true FROM edges GROUP BY type")
    listed = lambda name, types, key, value: f"(SELECT {key} AS id, count(DISTINCT {value}) AS n_{name}, array_to_string(list_slice(list_sort(list_distinct(list({value}))), 1, 10), ', ') AS {name} FROM edges WHERE type = '{types}' GROUP BY 1) {name}_"
    add("h14_describe_objects", audit.describe_objects, f"{_ROLLUP} SELECT o.id, object_type, complexity, total_steps, dynamic_steps, unresolved_steps, max_nesting, has_transaction, has_error_handling, has_cursor, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in ('reads', 'writes', 'calls', 'callers'))}, reads, writes, calls, callers FROM o LEFT JOIN {listed('reads', 'READS_FROM', 'owner', 'dst')} ON reads_.id = o.id LEFT JOIN {listed('writes', 'WRITES_TO', 'owner', 'dst')} ON writes_.id = o.id LEFT JOIN {listed('calls', 'CALLS', 'src', 'dst')} ON calls_.id = o.id LEFT JOIN {listed('callers', 'CALLS', 'dst', 'src')} ON callers_.id = o.id")
    add("h15_blind_spots", audit.blind_spots, f"{_ROLLUP} SELECT id, unresolved_steps, dynamic_steps, round(100.0::DOUBLE * unresolved_steps / (SELECT sum(unresolved_steps) FROM o), 4) AS percent FROM o WHERE unresolved_steps > 0")
    add("h16_counts_by_kind", audit.counts_by_kind, " SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
    add("h17_macro_degrees", audit.degrees, f"{_MACRO} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM me UNION ALL SELECT dst FROM me) GROUP BY id")
    add("h18_hotspots", audit.hotspots, f"{_ROLLUP}, {_MACRO}, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM me UNION ALL SELECT dst FROM me) GROUP BY id) SELECT o.id, complexity * degree AS score, complexity, degree, unresolved_steps FROM o JOIN dg ON dg.id = o.id WHERE complexity * degree > 0 ORDER BY score DESC, unresolved_steps DESC, o.id LIMIT 10")
    views = f"{_ROOTS}, vw AS (SELECT tab, count(*) AS views FROM (SELECT DISTINCT lower(split_part(root, ':column:', 1)) AS tab, lower(split_part(col, ':column:', 1)) AS v FROM rt) WHERE tab <> v GROUP BY tab)"
    add("h19_blind_spot_severity", audit.blind_spot_severity, f"{_ROLLUP}, {views}, ws AS (SELECT DISTINCT owner, lower(dst) AS tab FROM edges WHERE type = 'WRITES_TO'), sv AS (SELECT owner, sum(views)::BIGINT AS views FROM ws JOIN vw ON vw.tab = ws.tab GROUP BY owner) SELECT o.id, sv.views, sv.views * unresolved_steps AS severity FROM o JOIN sv ON sv.owner = o.id WHERE unresolved_steps > 0")
    add("h20_dependent_views", audit.dependent_views, f'{views} SELECT tab AS "table", views FROM vw')
    add("h21_orphan_tables", audit.orphan_tables, "us AS (SELECT src AS id FROM edges WHERE type IN ('READS_FROM', 'WRITES_TO', 'FK_TO', 'REFERENCES') UNION SELECT dst FROM edges WHERE type IN ('READS_FROM', 'WRITES_TO', 'FK_TO', 'REFERENCES')) SELECT id, name FROM nodes WHERE label = 'Table' AND id NOT IN (SELECT id FROM us)")
    add("h22_lineage_coverage", audit.lineage_coverage, "wc AS (SELECT DISTINCT dst FROM edges WHERE type = 'WRITES_COLUMN'), cv AS (SELECT count(*) AS written, count(*) FILTER (WHERE dst IN (SELECT src FROM edges WHERE type = 'DERIVES_FROM')) AS with_lineage FROM wc) SELECT written, with_lineage, CASE WHEN written > 0 THEN round(100.0::DOUBLE * with_lineage / written, 1) END AS percent FROM cv")
    add("h23_opaque_writes", audit.opaque_writes, f"{_ROLLUP} SELECT o.id, count(DISTINCT e.dst) AS tables, o.unresolved_steps, CASE WHEN o.unresolved_steps >= 10 THEN 'critical' WHEN o.unresolved_steps >= 3 THEN 'high' ELSE 'medium' END AS severity FROM o JOIN edges e ON e.owner = o.id AND e.type = 'WRITES_TO' WHERE o.unresolved_steps > 0 GROUP BY o.id, o.unresolved_steps")
    add("h24_catalog_driven", lambda x: audit.catalog_driven(x, "part.1"), f"{_ROLLUP} SELECT o.id, string_agg(DISTINCT split_part(dst, ':table:', 2), ', ' ORDER BY split_part(dst, ':table:', 2)) AS catalog_tables FROM o JOIN edges e ON e.owner = o.id AND e.type = 'READS_FROM' WHERE o.dynamic_steps > 0 AND starts_with(split_part(dst, ':table:', 2), 'part.1') GROUP BY o.id")
    add("h25_temporal_history", lambda x: audit.temporal_history(x, "00"), """ SELECT a.id AS "table", b.id AS history FROM nodes a JOIN nodes b ON a.label = 'Table' AND b.label = 'Table' AND lower(b.name) = lower(a.name) || '00'""")
    add("h26_foreign_key_counts", audit.foreign_key_counts, """ SELECT src AS "table", count(*) AS n FROM edges WHERE type = 'FK_TO' GROUP BY src""")
    add("h29_write_hotspots", audit.write_hotspots, f""" SELECT dst AS "table", count(DISTINCT owner) AS writers, {_LISTED.format('action_type')} AS actions FROM edges WHERE type = 'WRITES_TO' GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10""")
    add("h30_invariants", audit.invariants, " SELECT * FROM (VALUES ('duplicate ids', 0::BIGINT), ('edges without an end', 0), ('null ids', 0), ('steps without an owner', 0), ('columns without a table', 0), ('writes to what is no table', 0), ('negative complexity', 0)) t(check_name, violations)")
    add("g1_resolve_object", lambda x: impact.resolve_object(x, "part.1"), "sc AS (SELECT id, label, name, CASE WHEN lower(name) = 'part.1' OR lower(id) = 'part.1' THEN 3 WHEN suffix(lower(name), '.part.1') OR suffix(lower(name), ':part.1') OR suffix(lower(id), '.part.1') OR suffix(lower(id), ':part.1') THEN 2 WHEN contains(lower(name), 'part.1') OR contains(lower(id), 'part.1') THEN 1 END AS score FROM nodes WHERE label IN ('SqlObject', 'Table', 'Column', 'Workflow')) SELECT id, label, name, score::BIGINT AS score, score = 3 AND (SELECT count(*) FROM sc WHERE score = 3) = 1 AS exact FROM sc WHERE score IS NOT NULL ORDER BY score DESC, length(name), name, id LIMIT 10")
    add("g2_impact", lambda x: impact.impact(x, TABLE, depth=3, limit=500), f"{_closure(_IMPACT, TABLE, 3)} SELECT n.id, label, name, hops::BIGINT AS hops FROM c JOIN nodes n ON n.id = c.node WHERE hops > 0 ORDER BY hops, n.id LIMIT 500")
    add("g2_impact_upstream", lambda x: impact.impact(x, "T::sup.9", "upstream", 2, 500), f"{_closure('(SELECT owner AS src, dst FROM edges WHERE type IN ' + repr(('READS_FROM', 'WRITES_TO', 'CALLS', 'FK_TO')) + ')', 'T::sup.9', 2)} SELECT n.id, label, name, hops::BIGINT AS hops FROM c JOIN nodes n ON n.id = c.node WHERE hops > 0 ORDER BY hops, n.id LIMIT 500")
    add("g3_column_provenance", lambda x: impact.column_provenance(x, DEEP, 20), f"{_closure(_FORTH, DEEP, 20)} SELECT node AS id, hops::BIGINT AS hops FROM c WHERE hops > 0")
    add("g4_column_consumers", lambda x: impact.column_consumers(x, COLUMN, 5), f"{_closure(_BACK, COLUMN, 5)} SELECT node AS id, hops::BIGINT AS hops FROM c WHERE hops > 0")
    add("g4_column_evidence", impact.column_evidence, f'{_EVIDENCE} SELECT column_id AS "column", object, bucket, reason FROM ce')
    add("g5_table_impact", lambda x: impact.table_impact(x, TABLE), f"{_TABLE_IMPACT} SELECT * FROM ti")
    add("g5_table_impact_summary", lambda x: impact.table_impact_summary(x, TABLE), f"{_ROLLUP}, {_TABLE_IMPACT}, {_summary('SELECT bucket, reason FROM ti UNION ALL ' + _blind('T'))}")
    add("g6_column_impact_summary", lambda x: impact.column_impact_summary(x, COLUMN), f"{_ROLLUP}, {_EVIDENCE}, {_summary(f'''SELECT bucket, reason FROM ce WHERE column_id = '{COLUMN}' UNION ALL ''' + _blind('T'))}")
    add("g7_derives_chain", lambda x: impact.derives_chain(x, COLUMN), _chain_sql(_BACK, COLUMN, " -> "))
    add("g8_provenance_chain", lambda x: impact.provenance_chain(x, DEEP), _chain_sql(_FORTH, DEEP, " <- "))
    add("g9_column_procedures", lambda x: impact.column_procedures(x, DEEP), f"""{_closure(_BACK, DEEP, 10)} SELECT owner AS object, node AS "column", min(hops)::BIGINT AS hops FROM c JOIN edges e ON e.dst = c.node AND type IN ('READS_COLUMN', 'WRITES_COLUMN') GROUP BY ALL""")
    add("g10_g20_lineage_roots", impact.lineage_roots, f'{_ROOTS} SELECT col AS "column", root, hops FROM rt')
    add("g11_f19_affects", impact.affects, f'{_AFFECTS} SELECT object, tab AS "table", hops::BIGINT AS hops, node AS via FROM af WHERE rn = 1')
    add("g14_via_data", impact.via_data, f"""{_SHARED} SELECT writer AS object, count(DISTINCT tab) AS tables, {_LISTED.format('reader')} AS readers FROM sd WHERE reader IN (SELECT id FROM nodes WHERE object_type IN ('PROCEDURE', 'FUNCTION')) GROUP BY writer""")
    add("g15_call_reach", compare.call_reach, "cw(seed, node, hops) AS (SELECT DISTINCT dst, dst, 0 FROM edges WHERE type = 'CALLS' UNION SELECT cw.seed, e.owner, cw.hops + 1 FROM cw JOIN edges e ON e.dst = cw.node AND e.type = 'CALLS' AND e.src <> e.dst WHERE cw.hops < 20), cm AS (SELECT seed, node, min(hops) AS hops FROM cw GROUP BY ALL) SELECT seed AS id, node AS reached, hops::BIGINT AS hops FROM cm WHERE hops > 0")
    add("g21_objects_affecting", lambda x: impact.affects(x, table=TABLE).select("object", "hops"), f"{_AFFECTS} SELECT object, hops::BIGINT AS hops FROM af WHERE rn = 1 AND tab = '{TABLE}'")
    add("g22_writes_by_rule", audit.writes_by_rule, """ SELECT e.owner AS object, e.dst AS "table", bool_and(n.nesting > 0) AS governed FROM edges e JOIN nodes n ON n.id = e.src AND n.label = 'Step' WHERE e.type = 'WRITES_TO' GROUP BY ALL""")
    add("g23_shared_data", impact.shared_data, f'{_SHARED} SELECT writer, tab AS "table", reader FROM sd')
    add("g25_columns_without_lineage", audit.columns_without_lineage, """ SELECT DISTINCT dst AS "column" FROM edges WHERE type = 'WRITES_COLUMN' AND dst NOT IN (SELECT src FROM edges WHERE type = 'DERIVES_FROM')""")
    add("f9_view_readers", lambda x: impact.view_readers(x, x.type("FK_TO").select(F.col("src").alias("view"), F.col("dst").alias("base"))), " SELECT DISTINCT r.src, v.dst, v.src AS via_view FROM edges r JOIN edges v ON r.dst = v.src AND v.type = 'FK_TO' WHERE r.type = 'READS_FROM'")
    add("f21_workflow_writes", impact.workflow_writes, """ SELECT DISTINCT b.dst AS workflow, w.dst AS "table" FROM edges w JOIN edges b ON b.type = 'BELONGS_TO' AND b.src = w.owner WHERE w.type = 'WRITES_TO'""")
    add("i_risks", risks.risks, f"{_RISKS} SELECT * FROM risk")
    add("i_risk_counts", risks.risk_counts, f"{_RISKS} SELECT severity, category, rule, count(*) AS n FROM risk GROUP BY ALL")
    old, new = "SELECT owner, dst FROM edges WHERE type = 'CALLS' AND src <> dst", "SELECT owner, dst FROM edges WHERE type = 'CALLS' AND src <> dst AND src NOT LIKE '%7'"
    reach = lambda n, e: f"{n}w(seed, node, hops) AS (SELECT DISTINCT dst, dst, 0 FROM ({e}) UNION SELECT {n}w.seed, e.owner, {n}w.hops + 1 FROM {n}w JOIN ({e}) e ON e.dst = {n}w.node WHERE {n}w.hops < 20), {n}r AS (SELECT DISTINCT seed AS id, node AS reached FROM {n}w WHERE seed <> node)"
    add("j1_object_diff", lambda x: compare.object_diff(compare.content_hash(x.label("SqlObject")), compare.content_hash(later(x).label("SqlObject"))), " SELECT id, CASE WHEN id LIKE '%3' THEN 'removed' ELSE 'changed' END AS change FROM nodes WHERE label = 'SqlObject' AND (id LIKE '%3' OR id LIKE '%5')")
    add("j2_impact_delta", lambda x: compare.impact_delta(x, later(x)), f"{_SHARED}, {reach('a', old)}, {reach('b', new)} SELECT id, reached, 'calls' AS via, 'removed' AS change FROM (SELECT * FROM ar EXCEPT SELECT * FROM br) UNION ALL SELECT id, reached, 'calls', 'added' FROM (SELECT * FROM br EXCEPT SELECT * FROM ar) UNION ALL SELECT id, reached, 'data', 'removed' FROM (SELECT writer AS id, reader AS reached FROM sd EXCEPT SELECT writer, reader FROM sd WHERE reader NOT LIKE '%11')")
    swapped = lambda x: x.type("FK_TO").where("src LIKE '%5'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    add("j5_against_catalog", lambda x: compare.against_catalog(x.type("FK_TO"), x.type("FK_TO").where("src NOT LIKE '%9'").select("src", "dst").union(swapped(x)).union(x.type("CALLS").select("src", "dst")), x.label("Table").select(F.col("id").alias("name"))), "fk AS (SELECT src, dst FROM edges WHERE type = 'FK_TO'), cat AS (SELECT src, dst FROM fk WHERE src NOT LIKE '%9' UNION SELECT dst, src FROM fk WHERE src LIKE '%5') SELECT src, dst, 'extra' AS side FROM (SELECT * FROM fk EXCEPT SELECT * FROM cat) UNION ALL SELECT src, dst, 'missing' FROM (SELECT * FROM cat EXCEPT SELECT * FROM fk)")
    add("g24_taint", audit.taint, """ SELECT DISTINCT a.dst AS "column", a.src AS variable, b.src AS step FROM edges a JOIN edges b ON a.type = 'ASSIGNED_FROM' AND b.type = 'BUILDS_SQL_FROM' AND a.src = b.dst""")
    add("h29_dynamic_surface", audit.dynamic_surface, """ SELECT n.name, count(*) AS dynamic_steps, count(*) FILTER (WHERE s.dynamic_sql IS NULL) AS unknown FROM nodes s JOIN nodes n ON n.id = split_part(s.id, '#', 1) AND n.label = 'SqlObject' WHERE s.label = 'Step' AND s.is_dynamic GROUP BY n.id, n.name""")
    add("h29_rule_frequency", audit.rule_frequency, " SELECT n.id, n.name, count(*) AS steps FROM edges e JOIN nodes n ON n.id = e.src AND n.label = 'Rule' WHERE e.type = 'GOVERNS' GROUP BY ALL")
    add("h30_broken_invariants", lambda x: audit.invariants(broken(x)), f"""{_BROKEN}, en AS (SELECT src AS id FROM bedges UNION ALL SELECT dst FROM bedges)
SELECT 'duplicate ids' AS check_name, count(*) AS violations FROM (SELECT id FROM bnodes GROUP BY id HAVING count(*) > 1) x
UNION ALL SELECT 'edges without an end', count(*) FROM en WHERE id IS NULL OR id NOT IN (SELECT id FROM bnodes WHERE id IS NOT NULL) UNION ALL SELECT 'null ids', count(*) FROM bnodes WHERE id IS NULL
UNION ALL SELECT 'steps without an owner', count(*) FROM bnodes WHERE label = 'Step' AND split_part(id, '#', 1) NOT IN (SELECT id FROM bnodes WHERE label = 'SqlObject')
UNION ALL SELECT 'columns without a table', count(*) FROM bnodes WHERE label = 'Column' AND split_part(id, ':column:', 1) NOT IN (SELECT id FROM bnodes WHERE label = 'Table' AND id IS NOT NULL)
UNION ALL SELECT 'writes to what is no table', count(*) FROM bedges WHERE type = 'WRITES_TO' AND dst NOT IN (SELECT id FROM bnodes WHERE label = 'Table' AND id IS NOT NULL)
UNION ALL SELECT 'negative complexity', count(*) FROM bnodes WHERE label = 'SqlObject' AND complexity < 0""")
    add("j9_column_references", compare.column_references, """ SELECT DISTINCT lower(n.name) AS module, lower(split_part(split_part(e.dst, ':column:', 1), ':table:', 2)) AS entity, lower(split_part(e.dst, ':column:', 2)) AS "column", e.resolution FROM edges e JOIN nodes n ON n.id = e.owner AND n.label = 'SqlObject' WHERE e.type IN ('READS_COLUMN', 'WRITES_COLUMN', 'FILTERS_ON')""")
    out["j6_recall"] = (lambda s, d: compare.recall(*_oracle_pairs(s, d)), f"{_PAIRS}, x AS (SELECT count(*) AS total, count(*) FILTER (WHERE (module, entity, col) IN (SELECT module, entity, col FROM fo)) AS strict, count(*) FILTER (WHERE (module, col) IN (SELECT module, col FROM fo)) AS loose FROM e) SELECT total, strict, loose, round(strict / total::DOUBLE, 4) AS strict_recall, round(loose / total::DOUBLE, 4) AS loose_recall FROM x")
    out["j7_precision"] = (lambda s, d: compare.precision(*_oracle_pairs(s, d)), f"{_PAIRS}, x AS (SELECT DISTINCT f.* FROM fo f WHERE module IN (SELECT module FROM e)) SELECT x.resolution, count(*) AS n, count(e.module) AS right, round(count(e.module) / count(*)::DOUBLE, 4) AS precision FROM x LEFT JOIN e ON e.module = x.module AND e.entity = x.entity AND e.col = x.col GROUP BY x.resolution".replace("AS right", 'AS "right"'))
    out["j8_control"] = (lambda s, d: (lambda f, e: compare.recall(f, compare.perturbed(e)))(*_oracle_pairs(s, d)), f"{_PAIRS} SELECT count(*) AS total, 0::BIGINT AS strict, 0::BIGINT AS loose, 0.0::DOUBLE AS strict_recall, 0.0::DOUBLE AS loose_recall FROM e")
    out["j10_blind_references"] = (lambda s, d: compare.blind_references(*_oracle_pairs(s, d)), f"""{_PAIRS} SELECT module, entity, col AS "column" FROM e EXCEPT SELECT module, entity, col FROM fo""")
    out["j13_correlate"] = (lambda s, d: runtime.correlate(trace(s, d)), _TRACE)
    out["j13_correlate_sql"] = (lambda s, d: runtime.correlate_sql(trace(s, d)), _TRACE)
    out["s_event_windows"] = (lambda s, d: runtime.event_stream(trace(s, d)), "SELECT user_id AS session_id, date_trunc('minute', ts) AS window_start, count(*) AS events, count(*) FILTER (WHERE event_id % 3 = 0) AS procedures FROM events GROUP BY ALL")
    out["c_steps"] = (lambda s, d: specs.steps(extract.extract(specs.modules(s, d))), specs.steps_sql())
    out["m3_flow_metrics"] = (_flow, specs.flows_sql())
    for name, types in PATTERN_EDGES.items():
        out[name] = (_pattern_edges(types), f"SELECT * FROM ({specs.edges_sql()}) x WHERE type IN {types!r}" if len(types) > 1 else f"SELECT * FROM ({specs.edges_sql()}) x WHERE type = '{types[0]}'")
    # depth first, callees by name: the first way to an object is the least of the simple paths to it, read as lists
    calls = "ca AS (SELECT DISTINCT owner AS src, dst FROM edges WHERE type = 'CALLS'{0})"
    callable_only = calls.format("".join(f" AND {c} NOT IN (SELECT id FROM nodes WHERE object_type IN ('VIEW', 'TRIGGER'))" for c in ("owner", "dst")))
    add("g13_via_calls", changemap.via_calls, f"{callable_only}, vp(seed, node, path) AS (SELECT src, dst, [dst] FROM ca UNION ALL SELECT seed, ca.dst, list_append(path, ca.dst) FROM vp JOIN ca ON ca.src = vp.node WHERE vp.node <> vp.seed AND NOT list_contains(path, ca.dst)), vf AS (SELECT seed, node, min(path) AS path FROM vp GROUP BY ALL) SELECT seed AS id, node AS reached, len(path)::BIGINT AS depth, seed = node AS cycle FROM vf")
    flows = lambda most, hops: f"""{callable_only}, ot AS (SELECT * FROM ca WHERE src <> dst), en AS (SELECT DISTINCT src AS entry FROM ca WHERE src NOT IN (SELECT dst FROM ot)),
wp(entry, node, path, back) AS (SELECT entry, entry, [entry], NULL::VARCHAR FROM en UNION ALL SELECT entry, ot.dst, list_append(path, ot.dst), CASE WHEN list_contains(path, ot.dst) THEN ot.dst END FROM wp JOIN ot ON ot.src = wp.node WHERE back IS NULL AND len(path) <= {hops}),
wf AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY path) - 1 AS number, count(*) OVER (PARTITION BY entry) > {most} AS truncated FROM wp WHERE back IS NOT NULL OR node NOT IN (SELECT src FROM ot) OR len(path) > {hops}),
wr AS (SELECT entry, number, array_to_string(CASE WHEN back IS NULL THEN path ELSE path[1:-2] END, ' > ') AS path, back AS cycle_back_to, truncated FROM wf WHERE number < {most})"""  # noqa: E731
    add("g12_workflows", changemap.workflows, f"{flows(200, 1_000_000)} SELECT entry, number, path, false AS conditional, cycle_back_to, truncated FROM wr")
    add("g16_model_workflows", changemap.model_workflows, f"{flows(30, 10)} SELECT entry, number, path, cycle_back_to FROM wr")
    add("g19_inlined_flow", changemap.inlined_flow, f"{calls.format('')}, fp(root, node, path, goes_on) AS (SELECT src, dst, [dst], src <> dst FROM ca UNION ALL SELECT root, ca.dst, list_append(path, ca.dst), ca.dst <> root AND NOT list_contains(path, ca.dst) FROM fp JOIN ca ON ca.src = fp.node WHERE goes_on AND len(path) < 5) SELECT root, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position, len(path)::BIGINT AS level, node AS object FROM fp")
    fine = "label = 'SqlObject' AND coalesce(parse_error, '') = ''"
    add("h28_key_figures", pages.key_figures, " " + " UNION ALL ".join(f"SELECT '{name}' AS figure, count(*) AS n FROM nodes WHERE {where}" for name, where in (("objects", "label = 'SqlObject'"), ("tables", "label = 'Table'"), ("parse errors", "label = 'SqlObject' AND parse_error <> ''"), ("with transaction", f"{fine} AND has_transaction"), ("with handler", f"{fine} AND has_error_handling"), ("with cursor", f"{fine} AND has_cursor"), ("with dynamic SQL", f"{fine} AND dynamic_sql_calls > 0"))))
    add("h28_most_complex", pages.most_complex, f" SELECT name, complexity, dynamic_sql_calls FROM nodes WHERE {fine} ORDER BY complexity DESC, name LIMIT 12")
    add("h28_most_written", pages.most_written, """ SELECT dst AS "table", count(DISTINCT owner) AS writers FROM edges WHERE type = 'WRITES_TO' GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 12""")
    add("h28_entity_relations", pages.entity_relations, " SELECT DISTINCT src AS child, dst AS parent FROM edges WHERE type = 'FK_TO'")
    add("m1_table_view", pages.table_view, f""" SELECT t.id, (SELECT count(DISTINCT dst) FROM edges e WHERE e.type = 'HAS_COLUMN' AND e.src = t.id) AS columns, coalesce(rd.x, '') AS readers, coalesce(wt.x, '') AS writers FROM nodes t LEFT JOIN (SELECT dst, {_LISTED.format('owner')} AS x FROM edges WHERE type = 'READS_FROM' GROUP BY dst) rd ON rd.dst = t.id LEFT JOIN (SELECT dst, {_LISTED.format('owner')} AS x FROM edges WHERE type = 'WRITES_TO' GROUP BY dst) wt ON wt.dst = t.id WHERE label = 'Table'""")
    add("m5_filters_by_table", pages.filters_by_table, f"""fb AS (SELECT owner, split_part(dst, ':column:', 1) AS t, {_LISTED.format("split_part(dst, ':column:', 2)")} AS cs FROM edges WHERE type = 'FILTERS_ON' GROUP BY 1, 2) SELECT owner AS object, string_agg(t || '(' || cs || ')', ', ' ORDER BY t || '(' || cs || ')') AS filters FROM fb GROUP BY owner""")
    add("m7_object_summaries", pages.object_summaries, " SELECT o.id, o.name || ' is a ' || lower(object_type) || ' of complexity ' || complexity || '; it reads ' || " + " || ".join(f"(SELECT count(DISTINCT dst) FROM edges e WHERE e.type = '{kind}' AND e.owner = o.id) || '{text}'" for kind, text in (("READS_FROM", " tables, writes "), ("WRITES_TO", " and calls "), ("CALLS", " objects"))) + " || CASE WHEN dynamic_sql_calls > 0 THEN '; it runs dynamic SQL' ELSE '' END || '.' AS summary FROM nodes o WHERE label = 'SqlObject'")
    add("m8_shares", lambda x: pages.shares(x.edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))), "tc AS (SELECT type AS name, count(*) AS n FROM edges GROUP BY type) SELECT name, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM tc), 1) AS percent, repeat('#', ceil(20.0::DOUBLE * n / (SELECT max(n) FROM tc))::INT) AS bar FROM tc")
    add("g10_lineage_depths", impact.lineage_depths, """dw(col, node, hops) AS (SELECT src, src, 0 FROM edges WHERE type = 'DERIVES_FROM' AND src <> dst UNION SELECT dw.col, e.dst, dw.hops + 1 FROM dw JOIN edges e ON e.src = dw.node AND e.type = 'DERIVES_FROM' AND e.src <> e.dst) SELECT col AS "column", max(hops)::BIGINT AS depth FROM dw GROUP BY col""")
    return out


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.flow_metrics(extract.extract(specs.modules(spark, sf_dir)))


#: Queries over the modules of specs, and the types of edges that they compare.
PATTERN_EDGES = {
    "d_derives_from": ("DERIVES_FROM",),
    "f_access": ("READS_FROM", "WRITES_TO"),
    "f_column_access": ("READS_COLUMN", "WRITES_COLUMN", "FILTERS_ON", "CONDITIONED_BY"),
    "f_links": ("CALLS", "TARGETS", "AFFECTS", "FK_TO", "CREATES", "ON", "ALIAS_OF"),
}


def _pattern_edges(types: tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: specs.edges(build.build(extract.extract(specs.modules(spark, sf_dir)))).where(F.col("type").isin(*types))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _define().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _define().items() if sql}
