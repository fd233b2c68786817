"""The reader of procedural SQL."""

import pytest

from loomgraph.functions.text import escape_like, naturalise
from loomgraph.sources.modules import object_name
from loomgraph.tsql.expressions import Values, filter_kind, operators
from loomgraph.tsql.lexer import SqlError, tokens
from loomgraph.tsql.walker import analyse


def steps(sql, catalog=None):
    return analyse("D::dbo.x", sql, catalog)["steps"]


def derives(row):
    return [(x["column"], x["table"], x["sources"]) for x in row["lineage"]]


def test_tokens_skip_comments_and_keep_quotes():
    found = tokens("SELECT [a b], 'it''s' -- x\n/* /* nested */ */ FROM #t")
    assert [t.text for t in found] == ["SELECT", "[a b]", ",", "'it''s'", "FROM", "#t"]
    with pytest.raises(SqlError):
        tokens("SELECT 1 /* open")


def test_operator_tokens():
    assert operators(tokens("a + 'x' = b * 2 AND c BETWEEN 1 AND 2 OR NOT d LIKE 'q' AND e IS NOT NULL AND f NOT IN (1)")) == [
        "arith:*", "compare:=", "concat:+", "logical:AND", "logical:NOT", "logical:OR", "null:IS NOT NULL", "pattern:LIKE", "range:BETWEEN", "set:NOT IN",
    ]
    assert operators(tokens("CASE WHEN x IS DISTINCT FROM y THEN CAST(z AS INT) ELSE UPPER(w) & 1 END")) == ["bitwise:&", "case:CASE", "cast:CAST", "compare:IS DISTINCT FROM", "func:UPPER"]


@pytest.mark.parametrize(("sql", "kind"), [("a = 1 AND b IN ('x', 'y')", "domain_filter"), ("a = @p AND b IN (@q)", "key_lookup"), ("a = @p AND b = 1", "mixed"), ("a.id = b.id", "mixed"), ("a IS NULL", "domain_filter")])
def test_filter_kind(sql, kind):
    assert filter_kind(tokens(sql)) == kind


def test_values():
    v = Values({"@t"})
    v.set("@a", "x")
    assert v.resolve(tokens("N'q' + @A + QUOTENAME('z]')")) == "qx[z]]]"
    assert v.resolve(tokens("QUOTENAME(@t)")) == "«param:@t»"
    assert v.resolve(tokens("@b + 'x'")) is None
    assert v.resolve(tokens("CASE WHEN @a = 'x' THEN 'yes' ELSE 'no' END")) == "yes"
    assert v.resolve(tokens("COALESCE(@a, 'z') + CHAR(65)")) == "xA"


def test_insert_select_by_position():
    (row,) = steps("INSERT INTO dbo.A (x, y) SELECT b.p, b.q + c.r FROM dbo.B b JOIN dbo.C c ON b.i = c.i WHERE c.k = 3")
    assert derives(row) == [("x", "dbo.B", ["p"]), ("y", "dbo.B", ["q"]), ("y", "dbo.C", ["r"])]
    assert {x["table"]: x["columns"] for x in row["filters"]} == {"dbo.B": ["i"], "dbo.C": ["i", "k"]}


def test_star_needs_known_columns():
    assert steps("INSERT INTO dbo.A SELECT * FROM dbo.B")[0]["lineage"] == []
    (row,) = steps("INSERT INTO dbo.A SELECT * FROM dbo.B", {"dbo.A": ["x", "y"], "dbo.B": ["p", "q"]})
    assert derives(row) == [("x", "dbo.B", ["p"]), ("y", "dbo.B", ["q"])] and row["select_star"]


def test_bare_names_of_several_tables_are_left_out():
    (row,) = steps("SELECT z FROM dbo.A, dbo.B")
    assert {x["table"]: x["columns"] for x in row["reads"]} == {"dbo.A": [], "dbo.B": []}
    (row,) = steps("SELECT z FROM dbo.A, dbo.B", {"dbo.B": ["z"], "dbo.A": ["y"]})
    assert {x["table"]: x["columns"] for x in row["reads"]} == {"dbo.A": [], "dbo.B": ["z"]}


def test_subqueries_apply_pivot_and_functions():
    (row,) = steps("SELECT a.x FROM dbo.A a CROSS APPLY (SELECT TOP 1 b.y FROM dbo.B b WHERE b.i = a.i) q OUTER APPLY dbo.f(a.x) g WHERE NOT EXISTS (SELECT 1 FROM dbo.C WHERE k = a.k)")
    assert [x["table"] for x in row["reads"]] == ["dbo.A", "dbo.B", "dbo.C"]
    (row,) = steps("SELECT * FROM (SELECT Y, M, V FROM dbo.S) s PIVOT (SUM(V) FOR M IN ([1], [2])) p")
    assert [x["table"] for x in row["reads"]] == ["dbo.S"]
    (row,) = steps("SELECT j.a FROM dbo.D d CROSS APPLY OPENJSON(d.Doc) WITH (a INT '$.a') j")
    assert {x["table"]: x["columns"] for x in row["reads"]} == {"dbo.D": ["Doc"]}


def test_recursive_cte():
    row = steps("WITH t AS (SELECT e.Id, e.Boss FROM dbo.E e UNION ALL SELECT c.Id, c.Boss FROM dbo.E c JOIN t ON t.Id = c.Boss) INSERT INTO dbo.O (i) SELECT Id FROM t")[-1]
    assert derives(row) == [("i", "dbo.E", ["Id"])]


def test_merge_with_output():
    out, merge = steps("MERGE dbo.T AS t USING dbo.S AS s ON t.Id = s.Id WHEN MATCHED THEN UPDATE SET t.P = s.P WHEN NOT MATCHED BY TARGET THEN INSERT (Id, P) VALUES (s.Id, s.P) OUTPUT deleted.P AS O INTO dbo.L (O);")
    assert derives(out) == [("O", "dbo.T", ["P"])] and out["action"] == "OUTPUT"
    assert set(map(str, derives(merge))) == {str(("P", "dbo.S", ["P"])), str(("Id", "dbo.S", ["Id"]))}


def test_conditions_errors_and_complexity():
    found = analyse("D::dbo.x", "CREATE PROC dbo.x @a INT AS BEGIN TRY IF @a = 1 PRINT 'a' ELSE WHILE @a > 2 BREAK; END TRY BEGIN CATCH THROW; END CATCH")
    assert found["complexity"] == 4 and found["has_error_handling"]
    assert [(s["action"], s["conditions"]) for s in found["steps"]] == [("PRINT", ["IF: @a = 1"]), ("BREAK", ["IF_ELSE: NOT (@a = 1)", "WHILE: @a > 2"]), ("THROW", ["CATCH: ON ERROR"])]


def test_dynamic_sql_is_read_where_it_is_known():
    found = steps("CREATE PROC dbo.x AS BEGIN DECLARE @s NVARCHAR(99) = 'DELETE FROM dbo.' + 'T'; IF 1 = 1 EXEC (@s); END")
    assert [(s["action"], s["target"], s["conditions"]) for s in found] == [("EXEC", "", ["IF: 1 = 1"]), ("DELETE", "dbo.T", ["IF: 1 = 1"])]
    found = steps("CREATE PROC dbo.x @t SYSNAME AS EXEC ('DELETE FROM ' + @t)")
    assert [(s["action"], s["is_dynamic"], s["dynamic_sql"]) for s in found] == [("EXEC", True, None)]


def test_raiserror_fails_closed():
    assert [s["action"] for s in steps("RAISERROR('x', 10, 1); RAISERROR('x', 16, 1); RAISERROR('x', @s, 1)")] == ["PRINT", "THROW", "THROW"]


def test_table_definition():
    t = analyse("D::dbo.T", "CREATE TABLE dbo.T (A INT IDENTITY NOT NULL, B DECIMAL(9,2) DEFAULT (0), C AS (A * B), D INT REFERENCES dbo.O (I), CONSTRAINT pk PRIMARY KEY (A), UNIQUE (B, D))")["tables"][0]
    assert [(c["name"], c["type"], c["nullable"], c["primary_key"]) for c in t["columns"]] == [("A", "INT", False, True), ("B", "DECIMAL(9,2)", True, False), ("C", "", True, False), ("D", "INT", True, False)]
    assert t["columns"][2]["computed_from"] == ["A", "B"] and t["columns"][2]["computed_ops"] == ["arith:*"]
    assert t["foreign_keys"] == [{"columns": ["D"], "to": "dbo.O", "to_columns": ["I"]}]
    assert sorted((c["kind"], tuple(c["columns"])) for c in t["constraints"]) == [("DEFAULT", ("B",)), ("UNIQUE", ("B", "D"))]


@pytest.mark.parametrize(("sql", "detail"), [("ALTER TABLE t ADD x INT", "ADD COLUMN"), ("ALTER TABLE t DROP COLUMN a, b", "DROP COLUMN"), ("ALTER TABLE t SET (SYSTEM_VERSIONING = OFF)", "SET SYSTEM_VERSIONING=OFF"), ("ALTER TABLE t ALTER COLUMN a INT", "ALTER COLUMN")])
def test_alter(sql, detail):
    assert steps(sql)[0]["detail"] == detail


def test_errors_are_noted_and_the_rest_is_read():
    found = analyse("D::dbo.x", "SELECT a FROM dbo.T; UPDATE SET; DELETE FROM dbo.U")
    assert [s["action"] for s in found["steps"]] == ["SELECT", "DELETE"] and found["parse_error"]
    assert analyse("D::dbo.x", "SELECT a FROM dbo.T; UPDATE SET", strict=True)["steps"] == []
    for sql in ("", "   ", "-- only this", "'open", "((((", "SELECT", "BEGIN", "END END", "CREATE", "é ü"):
        analyse("D::dbo.x", sql)


def test_names_and_words():
    assert object_name("CREATE OR ALTER PROCEDURE [Sales].[do it] AS SELECT 1") == "Sales.do it"
    assert object_name("CREATE VIEW v AS SELECT 1") == "dbo.v"
    assert object_name("SELECT 1") is None
    assert naturalise("(@a IS NULL) AND b >= 3") == "@a is missing and b is at least 3"
    assert naturalise("NOT EXISTS (SELECT 1 FROM dbo.T WHERE x = 1)") == "dbo.T has no matching row"
    assert escape_like("a_b%") == "a\\_b\\%"


def test_placeholder_of_a_quoted_parameter():
    found = analyse("D::dbo.x", "CREATE PROCEDURE dbo.x @t SYSNAME AS BEGIN DECLARE @s NVARCHAR(MAX); SET @s = N'DELETE FROM dbo.' + QUOTENAME(@t) + N' WHERE a = 1'; EXEC sp_executesql @s; END")
    assert found["parse_error"] is None
    assert [(s["action"], s["target"]) for s in found["steps"] if s["action"] == "DELETE"] == [("DELETE", "dbo.«param:@t»")]
    bare = analyse("D::dbo.x", "CREATE PROCEDURE dbo.x @w NVARCHAR(90) AS BEGIN DECLARE @s NVARCHAR(MAX) = N'SELECT a FROM dbo.T WHERE 1=1' + @w; EXEC sp_executesql @s; END")
    assert [s["dynamic_sql"] for s in bare["steps"] if s["is_dynamic"]] == [None]


def test_trigger_made_by_dynamic_sql_is_not_run_by_its_maker():
    found = analyse("D::dbo.x", "CREATE PROCEDURE dbo.x AS BEGIN EXEC (N'CREATE TRIGGER dbo.tr ON dbo.T AFTER INSERT AS BEGIN DELETE FROM dbo.U; END'); END")
    assert [s["action"] for s in found["steps"]] == ["EXEC"] and [(t["name"], t["table"]) for t in found["triggers"]] == [("dbo.tr", "dbo.T")]


@pytest.mark.parametrize(
    ("source", "tables"),
    [
        ("STRING_SPLIT(@list, ',') AS s", ["STRING_SPLIT(@list, ',')"]),
        ("GENERATE_SERIES(1, 10) g", ["GENERATE_SERIES(1, 10)"]),
        ("OPENQUERY(Remote, 'SELECT a FROM dbo.T') q", ["OPENQUERY(Remote)"]),
        ("OPENROWSET('MSOLEDBSQL', 'Server=x', Db1.dbo.Far) f", ["Db1.dbo.Far"]),
        ("OPENROWSET('MSOLEDBSQL', 'Server=x', 'SELECT 1') f", []),
        ("OPENROWSET(BULK 'a.csv', SINGLE_CLOB) f", []),
        ("OPENJSON(@j) WITH (a INT '$.a') o", ["OPENJSON(@j)"]),
        ("dbo.OwnFunction(1) f", []),
    ],
)
def test_what_stands_for_a_table(source, tables):
    (row,) = steps(f"SELECT x FROM {source}")
    assert [r["table"] for r in row["reads"]] == tables
    both = steps(f"SELECT 1 AS x FROM dbo.Real r JOIN {source} ON 1 = 1")[-1]
    assert [r["table"] for r in both["reads"]] == ["dbo.Real", *tables]
