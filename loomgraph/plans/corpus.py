"""A small corpus of modules, and what is expected of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODULES: list[tuple[str, str]] = [
    ("Shop::dbo.Clients", "CREATE TABLE dbo.Clients (Id INT IDENTITY(1,1) PRIMARY KEY, Name NVARCHAR(80) NOT NULL, Mail NVARCHAR(120) NULL, Tier CHAR(1) NOT NULL DEFAULT ('C'))"),
    ("Shop::dbo.Sales", "CREATE TABLE dbo.Sales (Id INT PRIMARY KEY, ClientId INT NOT NULL REFERENCES dbo.Clients (Id), Net DECIMAL(12,2) NOT NULL, Tax DECIMAL(12,2) NOT NULL, Gross AS (Net + Tax), Day DATE NULL, CONSTRAINT ck_net CHECK (Net >= 0))"),
    ("Shop::dbo.Totals", "CREATE TABLE dbo.Totals (ClientId INT, Amount DECIMAL(14,2), Updated DATETIME)"),
    ("Shop::dbo.Journal", "CREATE TABLE dbo.Journal (Id INT IDENTITY, Note NVARCHAR(400))"),
    ("Shop::dbo.vSales", "CREATE VIEW dbo.vSales AS SELECT c.Name AS ClientName, s.Gross * 1 AS Amount, s.Day FROM dbo.Sales s INNER JOIN dbo.Clients AS c ON c.Id = s.ClientId"),
    ("Shop::dbo.AddNote", "CREATE PROCEDURE dbo.AddNote @text NVARCHAR(400) AS BEGIN INSERT INTO dbo.Journal (Note) VALUES (@text); END"),
    ("Shop::dbo.SumUp", """CREATE PROCEDURE dbo.SumUp @day DATE, @all BIT = 0 AS
BEGIN TRY
  BEGIN TRAN;
  IF @all = 1
    DELETE FROM dbo.Totals;
  ELSE
    UPDATE t SET Amount = 0 FROM dbo.Totals t JOIN dbo.Clients c ON c.Id = t.ClientId WHERE c.Tier = 'A';
  WITH x AS (SELECT ClientId, SUM(Gross) AS G FROM dbo.Sales WHERE Day = @day GROUP BY ClientId)
  MERGE dbo.Totals AS target USING x AS source ON target.ClientId = source.ClientId
  WHEN MATCHED THEN UPDATE SET target.Amount = target.Amount + source.G
  WHEN NOT MATCHED THEN INSERT (ClientId, Amount) VALUES (source.ClientId, source.G);
  EXEC dbo.AddNote N'done';
  COMMIT TRAN;
END TRY
BEGIN CATCH
  ROLLBACK TRAN;
  THROW;
END CATCH"""),
    ("Shop::dbo.Report", "CREATE PROCEDURE dbo.Report AS BEGIN SELECT ClientName, Amount FROM dbo.vSales WHERE Day IS NOT NULL; EXEC dbo.SumUp @day = '2024-01-01'; END"),
    ("Shop::dbo.Find", """CREATE PROCEDURE dbo.Find @col SYSNAME, @v NVARCHAR(50) AS
BEGIN
  DECLARE @sql NVARCHAR(MAX) = N'SELECT Name FROM dbo.Clients WHERE Mail LIKE ''%x%''';
  EXEC (@sql);
  SELECT @sql = Note FROM dbo.Journal WHERE Id = @v;
  EXEC sp_executesql @sql;
END"""),
    ("Shop::dbo.Stage", """CREATE PROCEDURE dbo.Stage AS
BEGIN
  SELECT ClientId, Net INTO #s FROM dbo.Sales WHERE Day BETWEEN '2024-01-01' AND '2024-02-01';
  INSERT INTO dbo.Totals (ClientId, Amount) SELECT q.ClientId, q.Net FROM #s AS q;
  TRUNCATE TABLE dbo.Journal;
END"""),
    ("Shop::dbo.OnSale", "CREATE TRIGGER dbo.OnSale ON dbo.Sales AFTER INSERT, UPDATE AS BEGIN INSERT INTO dbo.Journal (Note) SELECT i.Day FROM inserted i; END"),
    ("Shop::dbo.Customers", "CREATE SYNONYM dbo.Customers FOR dbo.Clients"),
    ("Shop::dbo.Mailing", "CREATE FUNCTION dbo.Mailing (@tier CHAR(1)) RETURNS TABLE AS RETURN (SELECT Id, Mail FROM dbo.Customers WHERE Tier = @tier)"),
    ("Shop::dbo.Broken", "CREATE PROCEDURE dbo.Broken AS BEGIN SELECT Name FROM dbo.Clients; UPDATE SET x; DELETE FROM dbo.Journal WHERE Id IN (SELECT Id FROM dbo.Clients WHERE Tier <> 'B'); END"),
]

#: (object, ordinal, action, target, filter kind)
STEPS = [
    ("dbo.AddNote", 0, "INSERT", "dbo.Journal", None), ("dbo.Broken", 0, "SELECT", "dbo.Clients", None), ("dbo.Broken", 1, "DELETE", "dbo.Journal", "domain_filter"),
    ("dbo.Clients", 0, "CREATE_TABLE", "dbo.Clients", None), ("dbo.Find", 0, "EXEC", "", None), ("dbo.Find", 1, "SELECT", "dbo.Clients", "domain_filter"), ("dbo.Find", 2, "SELECT", "dbo.Journal", "key_lookup"), ("dbo.Find", 3, "EXEC", "", None),
    ("dbo.Journal", 0, "CREATE_TABLE", "dbo.Journal", None), ("dbo.Mailing", 0, "SELECT", "dbo.Customers", "key_lookup"), ("dbo.OnSale", 0, "INSERT", "dbo.Journal", None),
    ("dbo.Report", 0, "SELECT", "dbo.vSales", "domain_filter"), ("dbo.Report", 1, "EXEC", "dbo.SumUp", None), ("dbo.Sales", 0, "CREATE_TABLE", "dbo.Sales", None),
    ("dbo.Stage", 0, "INSERT", "#s", "domain_filter"), ("dbo.Stage", 1, "INSERT", "dbo.Totals", None), ("dbo.Stage", 2, "TRUNCATE", "dbo.Journal", None),
    ("dbo.SumUp", 0, "BEGIN_TRAN", "", None), ("dbo.SumUp", 1, "DELETE", "dbo.Totals", None), ("dbo.SumUp", 2, "UPDATE", "dbo.Totals", "domain_filter"), ("dbo.SumUp", 3, "MERGE", "dbo.Totals", None),
    ("dbo.SumUp", 4, "EXEC", "dbo.AddNote", None), ("dbo.SumUp", 5, "COMMIT_TRAN", "", None), ("dbo.SumUp", 6, "ROLLBACK", "", None), ("dbo.SumUp", 7, "THROW", "", None),
    ("dbo.Totals", 0, "CREATE_TABLE", "dbo.Totals", None), ("dbo.vSales", 0, "SELECT", "dbo.Sales", None),
]

#: (from, to), both without "Shop:table:"
DERIVES = [
    ("dbo.journal:column:Note", "dbo.sales:column:Day"), ("dbo.mailing:column:Id", "dbo.clients:column:Id"), ("dbo.mailing:column:Mail", "dbo.clients:column:Mail"),
    ("dbo.sales:column:Gross", "dbo.sales:column:Net"), ("dbo.sales:column:Gross", "dbo.sales:column:Tax"), ("dbo.totals:column:Amount", "dbo.sales:column:Gross"),
    ("dbo.totals:column:Amount", "dbo.sales:column:Net"), ("dbo.totals:column:ClientId", "dbo.sales:column:ClientId"), ("dbo.vsales:column:Amount", "dbo.sales:column:Gross"),
    ("dbo.vsales:column:ClientName", "dbo.clients:column:Name"), ("dbo.vsales:column:Day", "dbo.sales:column:Day"),
]

#: (owner without "Shop::", type, table without "Shop:table:")
ACCESS = [
    ("dbo.AddNote", "WRITES_TO", "dbo.journal"), ("dbo.Broken", "READS_FROM", "dbo.clients"), ("dbo.Broken", "WRITES_TO", "dbo.journal"), ("dbo.Find", "READS_FROM", "dbo.clients"), ("dbo.Find", "READS_FROM", "dbo.journal"),
    ("dbo.Mailing", "READS_FROM", "dbo.clients"), ("dbo.OnSale", "READS_FROM", "dbo.sales"), ("dbo.OnSale", "WRITES_TO", "dbo.journal"), ("dbo.Report", "READS_FROM", "dbo.clients"), ("dbo.Report", "READS_FROM", "dbo.sales"),
    ("dbo.Stage", "READS_FROM", "dbo.sales"), ("dbo.Stage", "WRITES_TO", "dbo.journal"), ("dbo.Stage", "WRITES_TO", "dbo.totals"), ("dbo.SumUp", "READS_FROM", "dbo.clients"), ("dbo.SumUp", "READS_FROM", "dbo.sales"),
    ("dbo.SumUp", "WRITES_TO", "dbo.totals"), ("dbo.vSales", "READS_FROM", "dbo.clients"), ("dbo.vSales", "READS_FROM", "dbo.sales"),
]

#: (from, type, to) of calls, keys, triggers and synonyms
LINKS = [
    ("Shop::dbo.Report", "CALLS", "Shop::dbo.SumUp"), ("Shop::dbo.SumUp", "CALLS", "Shop::dbo.AddNote"), ("Shop:table:dbo.sales", "FK_TO", "Shop:table:dbo.clients"),
    ("Shop:table:dbo.sales:column:ClientId", "REFERENCES", "Shop:table:dbo.clients:column:Id"), ("Shop::dbo.Report", "TARGETS", "Shop::dbo.vSales"), ("Shop::dbo.OnSale", "ON", "Shop:table:dbo.sales"),
]


def modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODULES, "name string, sql string")
