"""Source code of applications (C#) as rows: classes, methods, entry points, and the SQL that methods run.

Files are read one by one, by tokens and braces, without a compiler: what a name means is looked for in its method and class
only. A string is resolved through literals, interpolation, `+`, constants and variables that are set once; what stays
unknown is a hole, "{name}"."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How far names are followed.
DEPTH = 12
VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH", "HttpHead": "HEAD", "HttpOptions": "OPTIONS"}
MAPPED = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
#: Calls whose first string is SQL, and what they are called.
SINKS = {
    "SqlCommand": "command", "OracleCommand": "command", "NpgsqlCommand": "command",
    **{n: "mapper" for n in ("Query", "QueryAsync", "QueryFirst", "QueryFirstAsync", "QueryFirstOrDefault", "QueryFirstOrDefaultAsync", "QuerySingle", "QuerySingleAsync", "QuerySingleOrDefault", "QuerySingleOrDefaultAsync", "QueryMultiple", "QueryMultipleAsync", "Execute", "ExecuteAsync", "ExecuteScalar", "ExecuteScalarAsync", "ExecuteReader", "ExecuteReaderAsync")},
    **{n: "entity framework" for n in ("FromSqlRaw", "FromSqlInterpolated", "FromSql", "SqlQuery", "SqlQueryRaw", "ExecuteSqlRaw", "ExecuteSqlRawAsync", "ExecuteSqlInterpolated", "ExecuteSqlInterpolatedAsync", "ExecuteSql", "ExecuteSqlAsync", "ExecuteSqlCommand")},
}
HTTP = {"GetAsync": "GET", "GetStringAsync": "GET", "GetFromJsonAsync": "GET", "PostAsync": "POST", "PostAsJsonAsync": "POST", "PutAsync": "PUT", "PutAsJsonAsync": "PUT", "DeleteAsync": "DELETE"}
HOSTED = {"BackgroundService", "ServiceBase", "IHostedService"}
JOBS = {"IJob", "IJobExecutor", "IInvocable"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\#[^\n]*)
  |(?P<raw>\$*\"\"\".*?\"\"\")
  |(?P<text>(?:\$@|@\$|\$|@)?"(?:(?<=@")(?:[^"]|"")*|(?<=@\$")(?:[^"]|"")*|(?<=\$@")(?:[^"]|"")*|(?:\\.|[^"\\])*)")
  |(?P<char>'(?:\\.|[^'\\])*')
  |(?P<word>@?[A-Za-z_]\w*)
  |(?P<number>\d[\w.]*)
  |(?P<op>=>|==|!=|<=|>=|&&|\|\||\?\?|\+=|.)""",
    re.VERBOSE | re.DOTALL,
)
_NO_METHODS = {"if", "for", "foreach", "while", "switch", "using", "lock", "catch", "fixed", "return", "new", "nameof", "typeof", "when", "await", "throw", "sizeof", "default", "base", "this"}

Tokens = list[tuple[str, str, int]]


def tokens(text: str) -> Tokens:
    """(kind, text, line); comments and directives go."""
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), line))
        line += m.group().count("\n")
    return out


def _close(part: Tokens, at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    pairs, depth = {"(": ")", "{": "}", "[": "]", "<": ">"}, 0
    opened, closed = part[at][1], pairs[part[at][1]]
    for i in range(at, len(part)):
        depth += (part[i][1] == opened) - (part[i][1] == closed)
        if not depth:
            return i + 1
    return len(part)


def _arguments(part: Tokens) -> list[Tokens]:
    out: list[Tokens] = [[]]
    depth = 0
    for t in part:
        depth += (t[1] in "([{" and t[0] == "op") - (t[1] in ")]}" and t[0] == "op")
        if t[1] == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _unescape(body: str, verbatim: bool) -> str:
    if verbatim:
        return body.replace('""', '"')
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), body)


class _Scope:
    """What names of one method stand for: locals that are set once, then constants and read-only fields of the class."""

    def __init__(self, fields: dict[str, Tokens], body: Tokens, parameters: set[str]):
        self.fields, self.parameters, seen = fields, parameters, {}
        for i in range(len(body) - 1):
            if body[i][0] == "word" and body[i + 1][1] in ("=", "+=") and (i == 0 or body[i - 1][1] != "."):
                end, depth = i + 2, 0
                while end < len(body) and not (body[end][1] in (";", ",", ")") and depth == 0):
                    depth += (body[end][1] in "([{") - (body[end][1] in ")]}") if body[end][0] == "op" else 0
                    end += 1
                seen.setdefault(body[i][1], []).append((body[i + 1][1], body[i + 2 : end]))
        self.locals = {n: v[0][1] for n, v in seen.items() if len(v) == 1 and v[0][0] == "="}
        self.changed = {n for n, v in seen.items() if len(v) > 1 or v[0][0] == "+="}

    def resolve(self, part: Tokens, depth: int = 0) -> str:
        """The text of an expression, with holes."""
        if depth > DEPTH or not part:
            return "{}"
        while part[0][1] == "(" and _close(part, 0) == len(part):
            part = part[1:-1]
            if not part:
                return "{}"
        level = 0
        for i, t in enumerate(part):
            level += (t[1] in "([{") - (t[1] in ")]}") if t[0] == "op" else 0
            if t[1] == "+" and t[0] == "op" and not level and i:
                return self.resolve(part[:i], depth + 1) + self.resolve(part[i + 1 :], depth + 1)
        kind, text, _ = part[0]
        if len(part) == 1 and kind == "raw":
            body = text.strip("$").strip('"')
            return re.sub(r"\{+([^{}]+)\}+", lambda m: self.resolve(tokens(m.group(1)), depth + 1), body) if text[0] == "$" else body
        if len(part) == 1 and kind == "text":
            prefix, body = text[: text.index('"')], text[text.index('"') + 1 : -1]
            body = _unescape(body, "@" in prefix)
            if "$" not in prefix:
                return body
            marked = body.replace("{{", "\0").replace("}}", "\1")
            marked = re.sub(r"\{([^{}]+)\}", lambda m: self.resolve(tokens(m.group(1).split(":")[0]), depth + 1), marked)
            return marked.replace("\0", "{").replace("\1", "}")
        if text == "nameof" and len(part) > 3:
            return part[-2][1]
        name = part[-1][1] if all(t[0] == "word" or t[1] == "." for t in part) else ""
        if name and len(part) == 1 and name not in self.changed and name in self.locals:
            return self.resolve(self.locals[name], depth + 1)
        if name and name not in self.changed and name not in self.parameters and name in self.fields:
            return self.resolve(self.fields[name], depth + 1)
        return "{" + (name or re.sub(r"\W", "", text)) + "}"


def _attributes(part: Tokens, at: int) -> list[tuple[str, Tokens]]:
    """(name, arguments) of the attributes that end right before a place, which is behind modifiers and a type."""
    found, i = [], at - 1
    while i >= 0 and part[i][1] not in (";", "{", "}"):
        i -= 1
    i += 1
    while i < at:
        if part[i][1] == "[":
            end = _close(part, i)
            for one in _arguments(part[i + 1 : end - 1]):
                if one and one[0][0] == "word":
                    found.append((one[0][1].removesuffix("Attribute"), one[2:-1] if len(one) > 2 and one[1][1] == "(" else []))
            i = end
        else:
            i += 1
    return found


def _text_of(part: Tokens) -> str | None:
    return _unescape(part[0][1].strip('@$"'), False) if len(part) == 1 and part[0][0] == "text" else None


def read_file(text: str) -> dict:
    """Classes, methods, entry points, SQL and calls to other services of one file."""
    part, out = tokens(text), {"classes": [], "methods": [], "entries": [], "sql": [], "external": []}
    space = next((("".join(t[1] for t in part[i + 1 : i + 1 + next((j for j, x in enumerate(part[i + 1 :]) if x[1] in "{;"), 0)])) for i, t in enumerate(part) if t[1] == "namespace"), "")
    for i, t in enumerate(part):
        if t[1] not in ("class", "interface", "record", "struct") or t[0] != "word" or i + 1 >= len(part) or part[i + 1][0] != "word":
            continue
        name, j = part[i + 1][1], i + 2
        while j < len(part) and part[j][1] not in "{;":
            j += 1
        if j >= len(part) or part[j][1] == ";":
            continue
        head = part[i + 2 : j]
        bases = []
        if any(x[1] == ":" for x in head):
            after = head[next(k for k, x in enumerate(head) if x[1] == ":") + 1 :]
            bases = [a[0][1] if len(a) == 1 or a[1][1] != "." else a[-1][1] for a in _arguments(after) if a and a[0][0] == "word"]
        body = part[j + 1 : _close(part, j) - 1]
        out["classes"].append({"name": name, "namespace": space, "kind": t[1], "bases": bases, "line": t[2]})
        _members(out, name, bases, body, _attributes(part, i))
    return out


def _members(out: dict, owner: str, bases: list[str], body: Tokens, attributes: list[tuple[str, Tokens]]) -> None:
    fields: dict[str, Tokens] = {}
    methods, i, depth = [], 0, 0
    while i < len(body):
        kind, text, line = body[i]
        if text in ("class", "interface", "record", "struct") and i + 1 < len(body) and body[i + 1][0] == "word":
            while i < len(body) and body[i][1] not in "{;":
                i += 1
            i = _close(body, i) if i < len(body) and body[i][1] == "{" else i + 1
            continue
        if text == "[" and (i == 0 or body[i - 1][1] in (";", "}", "]", "{")):
            i = _close(body, i)
            continue
        if kind == "word" and i + 1 < len(body) and body[i + 1][1] == "=" and body[i - 1][0] in ("word",):
            end = i + 2
            while end < len(body) and body[end][1] != ";":
                end = _close(body, end) if body[end][1] in ("(", "{", "[") and body[end][0] == "op" else end + 1
            back = i
            while back and body[back - 1][1] not in (";", "}", "{"):
                back -= 1
            if {"const", "readonly"} & {x[1] for x in body[back:i]}:
                fields[text] = body[i + 2 : end]
            i = end + 1
            continue
        at = i + 1
        if kind == "word" and at < len(body) and body[at][1] == "<":
            at = _close(body, at)
        if kind == "word" and text not in _NO_METHODS and at < len(body) and body[at][1] == "(":
            behind = _close(body, at)
            stop = behind
            while stop < len(body) and body[stop][1] not in ("{", ";", "=>"):
                stop += 1
            if stop < len(body) and body[stop][1] != ";":
                if body[stop][1] == "{":
                    end = _close(body, stop)
                else:
                    end = stop + 1
                    while end < len(body) and body[end][1] != ";":
                        end = _close(body, end) if body[end][1] in ("(", "{", "[") and body[end][0] == "op" else end + 1
                    end += 1
                methods.append((text, line, body[at + 1 : behind - 1], body[stop + 1 : end - 1], _attributes(body, i), i))
                i = end
                continue
            i = stop + 1
            continue
        i = _close(body, i) if text == "{" and kind == "op" else i + 1
    route = next((_text_of(a) for n, a in attributes if n == "Route"), None)
    for name, line, parameters, inside, marks, at in methods:
        out["methods"].append({"class": owner, "name": name, "line": line})
        full = f"{owner}.{name}"
        for mark, arguments in marks:
            if mark in VERBS:
                short = owner.removesuffix("Controller").lower()
                base = (route or "").replace("[controller]", short).strip("/")
                own = (_text_of(arguments[:1]) or "").strip("/")
                out["entries"].append({"kind": "http_route", "key": f"{VERBS[mark]} /" + "/".join(filter(None, (base, own))), "method": full, "line": line})
        if name == "Main":
            out["entries"].append({"kind": "console_main", "key": full, "method": full, "line": line})
        elif name in ("Execute", "ExecuteAsync") and JOBS & set(bases):
            out["entries"].append({"kind": "job", "key": full, "method": full, "line": line})
        elif name in ("ExecuteAsync", "StartAsync", "OnStart") and HOSTED & set(bases):
            out["entries"].append({"kind": "hosted_service", "key": full, "method": full, "line": line})
        _calls(out, full, inside, _Scope(fields, inside, {a[-1][1] for a in _arguments(parameters) if a}))


def _calls(out: dict, method: str, body: Tokens, scope: _Scope) -> None:
    stored = any(a[1] == "StoredProcedure" for a in body)
    for i, (kind, text, line) in enumerate(body):
        at = i + 1
        if kind != "word":
            continue
        if text == "CommandText" and at < len(body) and body[at][1] == "=":
            end = at + 1
            while end < len(body) and body[end][1] not in (";", ","):
                end = _close(body, end) if body[end][1] in ("(", "{", "[") and body[end][0] == "op" else end + 1
            out["sql"].append({"method": method, "sink": "command", "text": scope.resolve(body[at + 1 : end]), "procedure": stored, "line": line})
            continue
        if at < len(body) and body[at][1] == "<":
            at = _close(body, at)
        if at >= len(body) or body[at][1] != "(":
            continue
        arguments = _arguments(body[at + 1 : _close(body, at) - 1])
        made = i > 0 and body[i - 1][1] == "new"
        called = i > 0 and body[i - 1][1] == "."
        if text in SINKS and (made if SINKS[text] == "command" else called) and arguments[0]:
            first = arguments[0][2:] if len(arguments[0]) > 2 and arguments[0][1][1] == ":" else arguments[0]
            sql = scope.resolve(first)
            procedure = stored if SINKS[text] == "command" else any(x[1] == "StoredProcedure" for a in arguments for x in a)
            if procedure or re.search(r"\b(?:SELECT|INSERT|UPDATE|DELETE|MERGE|EXEC|EXECUTE|TRUNCATE|WITH)\b", sql, re.IGNORECASE):
                out["sql"].append({"method": method, "sink": SINKS[text], "text": sql, "procedure": procedure, "line": line})
        elif text in MAPPED and called and len(arguments) > 1 and _text_of(arguments[0]):
            out["entries"].append({"kind": "http_route", "key": f"{MAPPED[text]} /" + _text_of(arguments[0]).strip("/"), "method": method, "line": line})
        elif text in HTTP and called and arguments[0]:
            out["external"].append({"method": method, "verb": HTTP[text], "url": scope.resolve(arguments[0]), "line": line})


FILE = (
    "struct<classes:array<struct<name:string,namespace:string,kind:string,bases:array<string>,line:int>>,methods:array<struct<class:string,name:string,line:int>>,"
    "entries:array<struct<kind:string,key:string,method:string,line:int>>,sql:array<struct<method:string,sink:string,text:string,procedure:boolean,line:int>>,"
    "external:array<struct<method:string,verb:string,url:string,line:int>>>"
)


def read_folder(spark: SparkSession, path: str, pattern: str = "*.cs") -> DataFrame:
    """(path, text) of all source files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def extracted(files: DataFrame) -> DataFrame:
    """(path, f) of files (path, text): what read_file finds in each. Null texts have nothing."""

    @F.pandas_udf("string")
    def read(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(read_file(t or "")))

    return files.select("path", F.from_json(read("text"), FILE).alias("f"))


def projects(files: DataFrame) -> DataFrame:
    """(path, kind, name) of project files (path, text): the projects and packages that each refers to."""
    found = lambda pattern, kind: files.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    refers = found(r'<ProjectReference\s+Include="([^"]+)"', "project").withColumn("name", F.regexp_replace("name", r"^.*[\\/]|\.csproj$", ""))
    return refers.union(found(r'<PackageReference\s+Include="([^"]+)"', "package"))
