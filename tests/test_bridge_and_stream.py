from loomgraph.operators import bridge
from loomgraph.plans.model import Graph
from loomgraph.streaming import events


def test_references(spark):
    nodes = [("D::dbo.Pay", "SqlObject", "dbo.Pay", "D"), ("D:table:dbo.bill", "Table", "dbo.bill", "D"), ("D:table:old.bill", "Table", "old.bill", "D"), ("D:table:dbo.log_a", "Table", "dbo.log_a", "D")]
    graph = Graph.of(spark.createDataFrame(nodes, "id string, label string, name string, db string"), spark.createDataFrame([("x", "y", "CALLS")], "src string, dst string, type string"))
    files = spark.createDataFrame([("a.cs", 'run("EXEC [dbo].[Pay] @x"); q("select 1 from dbo.Bill join bill b"); q("EXECUTE nowhere"); q($"UPDATE dbo.log_{name} SET a = 1")'), ("b.cs", None)], "path string, text string")
    found = {(r.kind, r.name, r.id, r.resolution) for r in bridge.references(files, graph).collect()}
    assert found == {("EXEC", "dbo.pay", "D::dbo.Pay", "literal"), ("TABLE", "dbo.bill", "D:table:dbo.bill", "literal"), ("EXEC", "nowhere", None, "unresolved"), ("TABLE", "dbo.log_{name}", "D:table:dbo.log_a", "ambiguous")}


def test_dispatch_and_projects(spark):
    calls = spark.createDataFrame([("A", "m"), ("B", "m"), ("C", "m")], "interface string, method string")
    registered = spark.createDataFrame([("A", "A2")], "interface string, class string")
    classes = spark.createDataFrame([("A", "A1"), ("A", "A2"), ("B", "B1"), ("C", "C1"), ("C", "C2")], "interface string, class string")
    assert {(r.interface, r.target, r.by) for r in bridge.dispatch(calls, registered, classes).collect()} == {("A", "A2", "registered"), ("B", "B1", "only implementation"), ("C", None, "unresolved")}
    assert bridge.unused_references(spark.createDataFrame([("p", "q"), ("p", "r")], "project string, refers_to string"), spark.createDataFrame([("p", "q")], "project string, used string")).first().refers_to == "r"


def test_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{i}:10", i, 0, "PROC" if i % 2 else "ADHOC", "p") for i in range(4)] + [(2, "2024-01-01 02:00:00", 9, 0, "PROC", "q")]
    spark.createDataFrame(rows, "session_id bigint, ts string, seq bigint, nest_level int, object_type string, object_name string").selectExpr("session_id", "cast(ts AS timestamp) AS ts", "seq", "nest_level", "object_type", "object_name").write.parquet(str(tmp_path / "in"))
    query = events.count_events(events.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).where("session_id = 1").collect()
    assert sorted((r.events, r.procedures) for r in found) == [(1, 0), (1, 0), (1, 1), (1, 1)]


SOURCE = '''
using System;
namespace Shop.Api;
// class Hidden { }
[Route("api/[controller]")]
public class OrdersController : ControllerBase
{
    private const string Table = "dbo.Orders";
    private readonly string _tail = " WHERE Id = @id";
    [HttpGet("{id}")]
    public async Task<Order> Get(int id)
    {
        var sql = "SELECT * FROM " + Table + _tail;
        return await _db.QueryFirstAsync<Order>(sql, new { id });
    }
    [HttpPost]
    public void Make(string area)
    {
        using var cmd = new SqlCommand("dbo.MakeOrder", con) { CommandType = CommandType.StoredProcedure };
        _ctx.Database.ExecuteSqlRaw($"EXEC dbo.Note_{area} @x = 1");
        _list.Query(x => x.Id);
    }
    public string Changed(bool b) { var q = "SELECT 1"; if (b) q = "SELECT 2 FROM dbo.T"; _db.Execute(q); return q; }
}
public class Nightly : BackgroundService
{
    protected override Task ExecuteAsync(CancellationToken t) => _http.PostAsync("https://pay.example/" + Path, null);
    static void Main(string[] a) { var s = @"DELETE FROM dbo.Log
WHERE Day < '2020'"; con.Execute(s); app.MapGet("/health", () => 1); }
}
'''


def test_source_code(spark):
    from loomgraph.sources import code

    f = code.extracted(spark.createDataFrame([("a.cs", SOURCE), ("b.cs", None)], "path string, text string")).where("path = 'a.cs'").first().f
    assert [(c.name, c.namespace, c.bases) for c in f.classes] == [("OrdersController", "Shop.Api", ["ControllerBase"]), ("Nightly", "Shop.Api", ["BackgroundService"])]
    assert [m.name for m in f.methods] == ["Get", "Make", "Changed", "ExecuteAsync", "Main"]
    assert {(e.kind, e.key, e.method) for e in f.entries} == {
        ("http_route", "GET /api/orders/{id}", "OrdersController.Get"), ("http_route", "POST /api/orders", "OrdersController.Make"), ("http_route", "GET /health", "Nightly.Main"),
        ("hosted_service", "Nightly.ExecuteAsync", "Nightly.ExecuteAsync"), ("console_main", "Nightly.Main", "Nightly.Main"),
    }
    assert {(s.method, s.sink, s.text, s.procedure) for s in f.sql} == {
        ("OrdersController.Get", "mapper", "SELECT * FROM dbo.Orders WHERE Id = @id", False), ("OrdersController.Make", "command", "dbo.MakeOrder", True),
        ("OrdersController.Make", "entity framework", "EXEC dbo.Note_{area} @x = 1", False), ("Nightly.Main", "mapper", "DELETE FROM dbo.Log\nWHERE Day < '2020'", False),
    }
    assert [(x.verb, x.url) for x in f.external] == [("POST", "https://pay.example/{Path}")]


def test_application_graph(spark):
    from loomgraph.sources import code

    nodes = [("D::dbo.MakeOrder", "SqlObject", "dbo.MakeOrder", "D"), ("D:table:dbo.orders", "Table", "dbo.orders", "D"), ("D:table:dbo.log", "Table", "dbo.log", "D"), ("D::dbo.Note_a", "SqlObject", "dbo.Note_a", "D"), ("D::dbo.Note_b", "SqlObject", "dbo.Note_b", "D")]
    graph = Graph.of(spark.createDataFrame(nodes, "id string, label string, name string, db string"), spark.createDataFrame([("x", "y", "CALLS")], "src string, dst string, type string"))
    files = code.extracted(spark.createDataFrame([("a.cs", SOURCE)], "path string, text string"))
    app = bridge.application(files, graph)
    edges = {(r.src, r.dst, r.resolution) for r in app.edges.collect() if r.type == "EXECUTES_SQL"}
    assert edges == {
        ("app::method:Shop.Api.OrdersController.Get", "D:table:dbo.orders", "literal"), ("app::method:Shop.Api.OrdersController.Make", "D::dbo.MakeOrder", "literal"),
        ("app::method:Shop.Api.OrdersController.Make", "D::dbo.Note_a", "ambiguous"), ("app::method:Shop.Api.OrdersController.Make", "D::dbo.Note_b", "ambiguous"),
        ("app::method:Shop.Api.Nightly.Main", "D:table:dbo.log", "literal"),
    }
    assert {(r.src, r.dst) for r in app.edges.collect() if r.type == "CALLS_EXTERNAL"} == {("app::method:Shop.Api.Nightly.ExecuteAsync", "app::external:https://pay.example/{Path}")}
    assert ("app::entry:console_main:Nightly.Main", "app::method:Shop.Api.Nightly.Main") in {(r.src, r.dst) for r in app.edges.collect() if r.type == "CALLS"}
    refs = code.projects(spark.createDataFrame([("p.csproj", '<ProjectReference Include="..\\\\core\\\\Core.csproj" /><PackageReference Include="Dapper" Version="2" />')], "path string, text string"))
    assert {(r.kind, r.name) for r in refs.collect()} == {("project", "Core"), ("package", "Dapper")}
