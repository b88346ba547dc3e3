"""Registry, built-in tools, SQL surface and the driver entry."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from graphmill import schema
from graphmill.plans.graph import PropertyGraph
from graphmill.plans.sqltool import UnsafeQuery, run_sql
from graphmill.plans.tools import Context, FunctionTool, Registry, ToolResult, builtin, check

SCHEMA = {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "number"}, "kind": {"type": "string", "enum": ["function", "class", "method"]}}}


@pytest.fixture
def registry():
    out = Registry()
    out.register(FunctionTool("echo", "says it", SCHEMA, lambda a, c: ToolResult.of(a["query"])))
    out.register(FunctionTool("bad", "fails", {}, lambda a, c: 1 / 0))
    return out


def test_registry(registry):
    assert registry.names() == ["echo", "bad"] and "echo" in registry and len(registry) == 2
    with pytest.raises(ValueError, match="already"):
        registry.register(registry.get("echo"))
    assert registry.unregister("bad") and not registry.unregister("bad")


@pytest.mark.parametrize(("args", "said"), [({}, "missing required"), ({"query": None}, "missing required"), ({"query": 3}, "must be string"), ({"query": "x", "limit": True}, "must be number"), ({"query": "x", "kind": "enum"}, "must be one of")])
def test_arguments(registry, args, said):
    result = registry.execute("echo", args, None)
    assert result.is_error and said in result.text


def test_results(registry):
    assert registry.execute("echo", {"query": "hi", "limit": 2, "kind": "class", "more": 1}, None).text == "hi"
    assert "Unknown tool" in registry.execute("nope", {}, None).text
    failed = registry.execute("bad", {}, None)
    assert failed.is_error and failed.text.startswith('Tool "bad" failed:')


def test_types():
    wants = {"integer": (3, 3.5), "boolean": (True, 1), "array": ([1], "x"), "object": ({}, [])}
    for kind, (good, wrong) in wants.items():
        rule = {"properties": {"v": {"type": kind}}}
        assert not check({"v": good}, rule) and check({"v": wrong}, rule)


@pytest.fixture(scope="module")
def context(spark):
    nodes = [(n, "function", n, f"/s/{n[0]}.ts", 1, 3) for n in ("alpha", "beta", "gamma")] + [("beta2", "class", "beta", "/s/z.ts", 1, 9)]
    nodes = spark.createDataFrame(nodes, "id string, kind string, name string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("e1", "alpha", "beta", "calls", 1.0, 2), ("e2", "beta", "gamma", "calls", 1.0, 2)], "id string, source string, target string, kind string, confidence double, line int")
    processes = spark.createDataFrame([("p", "main", "alpha", ["alpha", "beta"], "custom")], schema.PROCESSES)
    return Context(spark, PropertyGraph.of(nodes, edges), "/s", processes=processes)


def test_builtin_tools(context):
    tools = builtin()
    assert tools.names() == ["query", "context", "impact", "flow", "rename", "detect_changes", "sql"]
    say = lambda tool, /, **args: tools.execute(tool, args, context)
    assert [r["name"] for r in json.loads(say("query", query="gam").text)] == ["gamma"]
    assert say("query", query="zzz").text == "No results found"
    about = json.loads(say("context", nodeId="beta").text)
    assert [r["id"] for r in about["callers"]] == ["alpha"] and about["process"]["id"] == "p"
    hit = json.loads(say("impact", name="gamma").text)
    assert hit["totalAffected"] == 2 and [r["id"] for r in hit["byDistance"]["depth_2"]] == ["alpha"]
    assert say("flow", nodeId="alpha").content[0]["text"] == "alpha (function)\n  → beta (function)\n    → gamma (function)"
    assert len(json.loads(say("rename", name="beta", newName="x").text)["candidates"]) == 2
    clash = json.loads(say("rename", nodeId="gamma", newName="beta").text)
    assert clash["conflicts"] == ["beta", "beta2"] and clash["references"] == 1 and clash["warning"]
    assert say("sql", query="SELECT count(*) AS n FROM nodes").content[0]["text"] == "Query returned 1 rows"
    assert say("sql", query="DROP TABLE nodes").is_error and say("context").is_error and say("impact", name="none").is_error


def test_sql(context):
    g = context.graph
    assert run_sql(g, "WITH x AS (SELECT id AS updated_at FROM nodes) SELECT * FROM x;", 2).count() == 2
    assert run_sql(g, "SELECT id FROM nodes ORDER BY id LIMIT 3", 1).count() == 3
    for bad in ("CREATE TABLE t AS SELECT 1", "INSERT INTO nodes SELECT * FROM nodes", "SET x=1", "DROP VIEW nodes"):
        with pytest.raises(UnsafeQuery):
            run_sql(g, bad)
    with pytest.raises(UnsafeQuery):
        run_sql(g, "SELECT 1 AS updated_at", compat=True)
    assert [r["id"] for r in run_sql(g, "SELECT n.id FROM search('gam') s JOIN nodes n ON n.id = s.id").collect()] == ["gamma"]
    assert [r["id"] for r in run_sql(g, "SELECT id FROM neighbors('alpha', 2) ORDER BY id").collect()] == ["beta", "gamma"]
    assert [r["id"] for r in run_sql(g, "SELECT id FROM impact('gamma') WHERE distance = 2").collect()] == ["alpha"]


def test_command_line(spark, tmp_path, capsys):
    from graphmill.__main__ import main

    (tmp_path / "a.py").write_text("def run_all():\n    step()\n\ndef step():\n    pass\n")
    assert main(["analyze", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 1
    assert main(["impact", "step", "--root", str(tmp_path)]) == 0
    assert "run_all" in capsys.readouterr().out
    assert main(["stats", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["nodes"] == 3
    assert main(["sql", "SELECT count(*) AS n FROM edges", "--root", str(tmp_path)]) == 0
    assert main(["context", "nothing", "--root", str(tmp_path)]) == 1
    assert ".graphmill/" in (tmp_path / ".gitignore").read_text()


def test_driver_entry(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    rows = driver.entry(spark)
    assert rows.columns == ["id", "name", "file_path", "distance", "impact_score"] and rows.count() > 0


@pytest.mark.parametrize("statement", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT try_reflect('java.lang.System', 'exit', 1)",
    "SELECT count(*) FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM default.nodes", "SELECT * FROM secrets", "SELECT input_file_name() FROM nodes", "SELECT id FROM nodes WHERE id = (SELECT reflect('a', 'b'))",
    "WITH x AS (SELECT version() AS v) SELECT * FROM x", "SELECT transform(array(1), x -> java_method('a', 'b', x))", "SET spark.x = 1", "SHOW TABLES", "DESCRIBE nodes", "INSERT INTO nodes SELECT * FROM nodes",
    "SELECT TRANSFORM(id) USING 'cat' FROM nodes", "SELECT 1) UNION (SELECT reflect('a', 'b')", "SELECT * FROM read_files('/etc')", "EXPLAIN SELECT 1", "CACHE TABLE x AS SELECT 1", "SELECT id FROM nodes ORDER BY (SELECT reflect('a', 'b'))",
    "SELECT t.id FROM (WITH secrets AS (SELECT 1 AS x) SELECT x FROM secrets) u, secrets t", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "WITH a AS (SELECT * FROM a) SELECT * FROM a",
    "SELECT (WITH secrets AS (SELECT 1 AS x) SELECT max(x) FROM secrets) FROM secrets", "WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM secrets) SELECT * FROM a", "SELECT * FROM nodes WHERE id IN (SELECT id FROM secrets)",
    "SELECT raise_error('x')", "SELECT * FROM nodes JOIN LATERAL (SELECT reflect('a', 'b'))", "SELECT current_user()",
])
def test_sql_reads_nothing_but_the_graph(context, statement):
    from pyspark.errors import ParseException

    with pytest.raises((UnsafeQuery, ParseException)):
        run_sql(context.graph, statement)


@pytest.mark.parametrize(("statement", "want"), [
    ("WITH RECURSIVE a(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM a WHERE n < 4) SELECT count(*) AS x FROM a", 4), ("WITH nodes AS (SELECT 7 AS x) SELECT x FROM nodes", 7),
    ("WITH a AS (SELECT 1 AS x), b AS (SELECT x + 1 AS x FROM a) SELECT x FROM b", 2), ("WITH a AS (WITH b AS (SELECT 5 AS x) SELECT x FROM b), b AS (SELECT 6 AS x) SELECT a.x + b.x AS x FROM a, b", 11),
    ("WITH a AS (SELECT 1 AS x) SELECT x FROM (WITH a AS (SELECT 2 AS x) SELECT x FROM a)", 2), ("WITH a AS (SELECT 3 AS x) SELECT (SELECT max(x) FROM a) AS x", 3),
])
def test_common_tables_are_seen_in_their_scope(context, statement, want):
    assert run_sql(context.graph, statement).first()["x"] == want


def test_cut_lists_are_told(spark, context, monkeypatch):
    from graphmill.plans import tools as t

    registry = t.builtin()
    monkeypatch.setattr(t, "MOST", 2)
    texts = lambda name, **args: [c["text"] for c in registry.execute(name, args, context).content]
    assert texts("sql", query="SELECT id FROM nodes", limit=3)[0] == "Shown: the first 2 of 3 rows"
    assert texts("sql", query="SELECT id FROM nodes LIMIT 2")[0] == "Query returned 2 rows"
    many = spark.range(5).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), F.lit("function").alias("kind"), F.lit("same").alias("name"), F.concat(F.lit("/m"), F.col("id").cast("string")).alias("file_path"))
    g = context.graph.upsert_nodes(many).upsert_edges(many.select(F.concat("id", F.lit("->x")).alias("id"), F.col("id").alias("source"), F.lit("alpha").alias("target"), F.lit("calls").alias("kind")))
    shown = json.loads(registry.execute("rename", {"nodeId": "alpha", "newName": "same"}, t.Context(spark, g)).content[0]["text"])
    assert (shown["references"], shown["affectedFileCount"], len(shown["affectedFiles"]), shown["conflictCount"], len(shown["conflicts"])) == (5, 6, 2, 5, 2) and shown["warning"].startswith("5 ")
    changes = spark.createDataFrame([(f"/m{i}", "modified") for i in range(5)], "file_path string, status string")
    monkeypatch.setattr(t, "git_changes", lambda *_: changes)
    shown = json.loads(registry.execute("detect_changes", {}, t.Context(spark, g, "/")).content[0]["text"])
    assert (len(shown["changes"]), shown["changesShown"], shown["changesTotal"]) == (2, 2, 5)


def test_sql_leaves_no_views_and_keeps_graphs_apart(spark, context):
    g = context.graph
    other = PropertyGraph.of(g.nodes.where("id = 'alpha'"), g.edges.limit(0))
    before = {t.name for t in spark.catalog.listTables()}
    first, second = run_sql(g, "SELECT count(*) AS n FROM nodes"), run_sql(other, "SELECT count(*) AS n FROM nodes")
    assert (first.first()["n"], second.first()["n"]) == (4, 1)
    assert run_sql(g, "SELECT s.id FROM search('gam') s -- a remark", None).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before
    assert run_sql(g, "WITH RECURSIVE_ AS (SELECT id FROM nodes), y AS (SELECT * FROM RECURSIVE_) SELECT count(*) AS n FROM y WHERE id IN (SELECT target FROM edges)").first()["n"] == 2


@pytest.mark.parametrize(("statement", "want"), [
    ("SELECT group_concat(id, ';') AS x FROM (SELECT id FROM nodes ORDER BY id)", "alpha;beta;beta2;gamma"), ("SELECT group_concat(DISTINCT kind) AS x FROM nodes", "class,function"), ("SELECT total(line) AS x FROM edges WHERE id = 'none'", 0.0),
    ("SELECT json_extract('{\"a\": {\"b\": 5}}', '$.a.b') AS x", "5"), ("SELECT count(*) AS x FROM nodes WHERE glob('be*', id)", 2), ("SELECT count(*) AS x FROM nodes WHERE glob('[a-b]?*[^a]', name)", 0), ("SELECT iif(1 < 2, 'y', 'n') AS x", "y"), ("SELECT max(3, min(9, 7), 5) AS x", 7),
    ("SELECT count(*) AS x FROM (SELECT 'it''s' AS n) WHERE glob('it''s*', n)", 1), ("SELECT count(*) AS x FROM nodes WHERE id GLOB 'be*'", 2), ("SELECT count(*) AS x FROM nodes WHERE id NOT GLOB 'be*'", 2), ("SELECT count(*) AS x FROM (SELECT 'a]b' AS n) t WHERE t.n GLOB 'a[]x]b'", 1),
    ("SELECT count(*) AS x FROM (SELECT 'It''s' AS n) WHERE n LIKE 'IT%'", 1), ("SELECT count(*) AS x FROM nodes WHERE id NOT LIKE 'ALPHA'", 3), ("SELECT min(1, NULL) AS x", None), ("SELECT max(NULL, 2, 3) AS x", None), ("SELECT min(4, 2) AS x", 2), ("SELECT 'a like b' AS x", "a like b"),
    ("SELECT count(*) AS x FROM (SELECT 'a.c' AS n) WHERE n GLOB 'a.?' AND n GLOB '*[^b]'", 1),
    ("SELECT strftime('%Y-%m-%dT%H', '2024-03-05 06:07:08') AS x", "2024-03-05T06"), ("SELECT julianday('2000-01-01 12:00:00') AS x", 2451545.0), ("SELECT 'min(1, 2)' AS x", "min(1, 2)"), ("SELECT max(line) AS x FROM edges", 2), ("SELECT unixepoch('1970-01-02') AS x", 86400),
])
def test_sql_dialect(spark, context, statement, want):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert run_sql(context.graph, statement).first()["x"] == want


def test_long_answers_say_so(spark, monkeypatch):
    from graphmill.plans import tools

    names = [f"n{i:02d}" for i in range(12)]
    nodes = spark.createDataFrame([(n, "function", n, f"/s/{n}.ts") for n in names], "id string, kind string, name string, file_path string")
    edges = spark.createDataFrame([(f"{a}->hub", a, "n00", "calls", 1.0) for a in names[1:]] + [(f"n00->{a}", "n00", a, "calls", 1.0) for a in names[1:]], "id string, source string, target string, kind string, confidence double")
    c, run = Context(spark, PropertyGraph.of(nodes, edges), "/s"), builtin().execute
    monkeypatch.setattr(tools, "MOST", 5)
    said = json.loads(run("context", {"nodeId": "n00"}, c).text)
    assert len(said["callers"]) == 5 and said["totals"] == {"callers": 11, "callees": 11}
    assert "... 7 more" in run("flow", {"nodeId": "n00"}, c).content[0]["text"]
    rename = json.loads(run("rename", {"nodeId": "n00", "newName": "x"}, c).text)
    assert rename["affectedFileCount"] == 12 and len(rename["affectedFiles"]) == 5 and rename["references"] == 11
    monkeypatch.setattr(tools, "MOST", 1000)
    assert "totals" not in json.loads(run("context", {"nodeId": "n00"}, c).text)


def test_installation_without_the_optional_parts(tmp_path):
    """The library's entry, queries and tests do without the training-data subpackage, its tests and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(driver.__file__).parent
    for gone in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / str(len(gone))
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *gone))
        run = lambda *a: subprocess.run([sys.executable, *a], cwd=copy, capture_output=True, text=True, timeout=120)  # noqa: B023, E731
        asked = run("-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))")
        assert asked.returncode == 0, asked.stderr
        assert asked.stdout.split()[2] == "0" and int(asked.stdout.split()[0]) > 60
        assert run("-m", "pytest", "--collect-only", "-q").returncode == 0
    # Nor with a library missing that only the subpackage needs.
    hidden = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    asked = subprocess.run([sys.executable, "-c", hidden], cwd=here, capture_output=True, text=True, timeout=120)
    assert asked.returncode == 0 and asked.stdout.split()[1] == "0" and int(asked.stdout.split()[0]) > 60, asked.stderr


def test_http(context):
    import base64
    import os
    import socket
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from graphmill.plans.server import HttpServer

    server = HttpServer(builtin(), context, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host, port = server.server_address[:2]

    def ask(path, body=None):
        try:
            with urlopen(Request(f"http://{host}:{port}{path}", body if body is None or isinstance(body, bytes) else json.dumps(body).encode()), timeout=120) as r:
                return r.status, r.read().decode()
        except HTTPError as e:
            return e.code, e.read().decode()

    assert ask("/health")[0] == 200 and {t["name"] for t in json.loads(ask("/api/tools")[1])["tools"]} == set(builtin().names())
    assert json.loads(ask("/api/stats")[1]) == {"nodes": 4, "edges": 2, "communities": 0, "processes": 1}
    assert json.loads(ask("/api/nodes/alpha")[1])["name"] == "alpha" and ask("/api/nodes/none")[0] == 404 and ask("/nowhere")[0] == 404
    assert [n["id"] for n in json.loads(ask("/api/files/%2Fs%2Fa.ts")[1])["nodes"]] == ["alpha"]
    status, said = ask("/api/tools/impact", {"nodeId": "gamma"})
    assert status == 200 and json.loads(json.loads(said)["content"][0]["text"])["totalAffected"] == 2
    assert ask("/api/tools/impact", {"maxDepth": "x"})[0] == 400 and ask("/api/tools/nope", {})[0] == 400 and ask("/api/tools/impact", b"{")[0] == 400 and ask("/api/tools/impact", [1])[0] == 400
    status, said = ask("/api/stream/query?q=alpha")
    assert status == 200 and said.startswith("data: ") and said.endswith("event: done\ndata: {}\n\n") and ask("/api/stream/query")[0] == 400

    def frame(data, kind=1):
        mask = os.urandom(4)
        return bytes([0x80 | kind, 0x80 | len(data)]) + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data))

    with socket.create_connection((host, port), timeout=10) as s:
        s.sendall(f"GET /ws HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {base64.b64encode(b'0' * 16).decode()}\r\n\r\n".encode())
        f = s.makefile("rb")
        while f.readline().strip():
            pass
        read = lambda: (lambda head: (head[0] & 15, f.read(head[1])))(f.read(2))
        assert json.loads(read()[1])["type"] == "connected"
        s.sendall(frame(b"junk") + frame(b'{"type": "ping"}') + frame(b"", 8))
        assert json.loads(read()[1]) == {"type": "pong"} and read()[0] == 8
    server.shutdown()


def test_json_rpc(context):
    import io

    from graphmill.plans.server import serve_streams

    asked = [{"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "sql", "arguments": {"query": "SELECT count(*) AS n FROM nodes"}}}, {"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "other"}, [1]]
    out = io.StringIO()
    serve_streams(builtin(), context, io.StringIO("\n".join([*map(json.dumps, asked), "{", ""])), out)
    said = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines()) if r["id"]}
    assert said[1]["result"]["serverInfo"]["name"] == "graphmill" and len(said[2]["result"]["tools"]) == 7
    assert '"n": 4' in said[3]["result"]["content"][1]["text"] and not said[3]["result"]["isError"]
    assert said[4]["result"]["isError"] and said[5]["error"]["code"] == -32601 and len(out.getvalue().splitlines()) == 7


def test_joined_nodes_are_dealt_by_their_number(spark, monkeypatch):
    from graphmill.plans import sqltool

    monkeypatch.setattr(sqltool, "TASK_NODES", 4)
    n = spark.range(100).select(F.concat(F.lit("n"), F.col("id")).alias("id"), F.lit("class").alias("kind"), F.lit("x").alias("name"), F.lit("/x").alias("file_path"))
    e = spark.range(300).select(F.concat(F.lit("e"), F.col("id")).alias("id"), F.concat(F.lit("n"), F.col("id") % 100).alias("source"), F.concat(F.lit("n"), F.col("id") % 7).alias("target"), F.lit("calls").alias("kind"), F.lit(1.0).alias("confidence"))
    g = PropertyGraph.of(n, e)
    found = run_sql(g, "SELECT a.id, count(b.id) AS n, count(DISTINCT c.id) AS ends FROM nodes a LEFT JOIN edges b ON b.source = a.id FULL JOIN nodes c ON c.id = b.target GROUP BY a.id", None)
    rows = {r["id"]: (r["n"], r["ends"]) for r in found.collect()}
    assert len(rows) == 101 and rows.pop(None) == (0, 93) and all(r[0] == 3 for r in rows.values())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan(found) and ", 25" in plan(found)
    assert "RepartitionByExpression" not in plan(run_sql(g, "SELECT count(*) FROM nodes", None))
