"""Graph store, traversal, PageRank and communities on small graphs, against their definitions."""

from __future__ import annotations

import os
import random
from itertools import count, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill import schema
from graphmill.operators import communities as com
from graphmill.operators import processes as proc
from graphmill.operators import traverse
from graphmill.operators.pagerank import pagerank
from graphmill.plans import graph as store
from graphmill.plans.graph import PropertyGraph, Transaction, as_json, conform, load, save, tables_of
from graphmill.sources.scratch import materialize, spread


def graph(spark, edges, nodes=None, kind="calls", **columns):
    names = sorted(nodes if nodes is not None else {v for e in edges for v in e[:2]})
    rows = [(n, columns.get("kinds", {}).get(n, "function"), n, f"/src/{n}.ts") for n in names]
    nodes_df = spark.createDataFrame(rows, "id string, kind string, name string, file_path string")
    links = [(f"{a}->{k[0] if k else kind}->{b}@{i}", a, b, k[0] if k else kind, 1.0, i) for i, (a, b, *k) in enumerate(edges)]
    return PropertyGraph.of(nodes_df, spark.createDataFrame(links, "id string, source string, target string, kind string, confidence double, line int"))


def modularity(weights: dict[str, dict[str, float]], home: dict[str, str]) -> float:
    """Of an assignment, by its definition."""
    twice = sum(w for row in weights.values() for w in row.values()) or 1.0
    pull = {v: sum(row.values()) for v, row in weights.items()}
    names = {c: i for c, i in zip(dict.fromkeys(home.values()), count(), strict=False)}
    inside, mass = [0.0] * len(names), [0.0] * len(names)
    for v, row in weights.items():
        mass[names[home[v]]] += pull[v]
        inside[names[home[v]]] += sum(w for u, w in row.items() if home[u] == home[v])
    return sum(i / twice - (m / twice) ** 2 for i, m in zip(inside, mass, strict=True))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_round_trip_and_lookups(spark):
    g = graph(spark, [("a", "b")])
    row = g.node("a").first()
    assert (row["name"], row["file_path"]) == ("a", "/src/a.ts")
    assert [r["target"] for r in g.edges_from("a", "calls").collect()] == ["b"]
    assert [r["source"] for r in g.edges_to("b", "calls").collect()] == ["a"]
    assert g.edges_from("a", "imports").count() == 0
    assert ids(g.by_path_prefix("/SRC/A")) == ["a"] and ids(g.by_path_prefix("/SRC/A", compat=False)) == []


def test_delete_file_cascades(spark):
    g = graph(spark, [("f", "fn")])
    g = g.upsert_nodes(g.nodes.selectExpr("id", "kind", "name", "'/one.ts' as file_path"))
    assert g.counts().first()["nodes"] == 2
    after = g.delete_file("/one.ts")
    assert after.nodes.count() == 0 and after.edges.count() == 0


def test_upsert_keeps_edges_unless_cascading(spark):
    g = graph(spark, [("a", "b"), ("b", "c")])
    new = spark.createDataFrame([("b", "class", "B", "/x")], "id string, kind string, name string, file_path string")
    assert g.upsert_nodes(new).edges.count() == 2
    after = g.upsert_nodes(new, cascade_edges=True)
    assert after.edges.count() == 0 and after.node("b").first()["name"] == "B"


def apply_one_by_one(nodes, edges, log):
    nodes, edges = dict(nodes), dict(edges)
    for seq, op, key, edge_kind, node, edge in log:
        if op == "upsert_node":
            nodes[node[0]] = node
        elif op == "upsert_edge":
            edges[edge[0]] = edge
        elif op == "delete_edge":
            edges.pop(key, None)
        elif op == "delete_edges_from":
            edges = {k: e for k, e in edges.items() if not (e[1] == key and edge_kind in (None, e[3]))}
        else:
            gone = {key} if op == "delete_node" else {n for n, r in nodes.items() if r[3] == key}
            nodes = {k: v for k, v in nodes.items() if k not in gone}
            edges = {k: e for k, e in edges.items() if e[1] not in gone and e[2] not in gone}
    return nodes, edges


@pytest.mark.parametrize("seed", range(4))
def test_mutation_log_equals_one_by_one(spark, seed):
    draw = random.Random(seed)
    names = "abcdef"
    node = lambda: (draw.choice(names), "function", str(draw.random()), f"/{draw.choice('xyz')}")
    edge = lambda: (f"e{draw.randrange(8)}", draw.choice(names), draw.choice(names), draw.choice(["calls", "uses"]), 1.0)
    nodes = {n: (n, "function", n, f"/{draw.choice('xyz')}") for n in names[:4]}
    edges = {f"e{i}": (f"e{i}", draw.choice(names[:4]), draw.choice(names[:4]), "calls", 1.0) for i in range(4)}
    log = []
    for seq in range(25):
        op = draw.choice(schema.OPS)
        key = {"delete_node": draw.choice(names), "delete_edge": f"e{draw.randrange(8)}", "delete_edges_from": draw.choice(names), "delete_file_nodes": f"/{draw.choice('xyz')}"}.get(op)
        log.append((seq, op, key, draw.choice([None, "calls"]) if op == "delete_edges_from" else None, node() if op == "upsert_node" else None, edge() if op == "upsert_edge" else None))
    want_nodes, want_edges = apply_one_by_one(nodes, edges, log)
    g = PropertyGraph.of(spark.createDataFrame(list(nodes.values()), "id string, kind string, name string, file_path string"), spark.createDataFrame(list(edges.values()), "id string, source string, target string, kind string, confidence double"))
    wide = [(s, o, k, ek, (*n, *[None] * 12) if n else None, (*e, None, None, None) if e else None) for s, o, k, ek, n, e in log]
    after = g.mutate(spark.createDataFrame(wide, schema.MUTATIONS))
    assert {(r["id"], r["name"], r["file_path"]) for r in after.nodes.collect()} == {(n[0], n[2], n[3]) for n in want_nodes.values()}
    assert {(r["id"], r["source"], r["target"], r["kind"]) for r in after.edges.collect()} == {e[:4] for e in want_edges.values()}


def test_snapshots(spark, tmp_path):
    g = graph(spark, [("a", "b")])
    save(g, str(tmp_path))
    save(g.delete_nodes(g.node("a")), str(tmp_path))
    after = load(spark, str(tmp_path))
    assert ids(after.nodes) == ["b"] and after.edges.count() == 0
    for name in "pqrs":
        save(graph(spark, [(name, "z")]), str(tmp_path), {"communities": spark.createDataFrame([(1, name, 2, 0.5)], schema.COMMUNITIES)})
    # The number decides, whatever the files' times are; what is old is gone.
    for f in (tmp_path / "current").glob("*.json"):
        os.utime(f, (0, 0))
    assert ids(load(spark, str(tmp_path)).nodes) == ["s", "z"]
    found = tables_of(spark, str(tmp_path), "communities", "processes")
    assert set(found) == {"nodes", "edges", "communities"} and found["communities"].first()["label"] == "s"
    assert len([p for p in tmp_path.iterdir() if p.name != "current"]) == 3
    with pytest.raises(FileNotFoundError):
        load(spark, str(tmp_path / "nowhere"))


def test_transactions(spark, tmp_path):
    save(graph(spark, [("a", "b")]), str(tmp_path), {"communities": spark.createDataFrame([(1, "c", 2, 0.5)], schema.COMMUNITIES)})
    rows = lambda *names: spark.createDataFrame([(n, "function", n, "/x") for n in names], "id string, kind string, name string, file_path string")
    with Transaction(spark, str(tmp_path)) as tx:
        tx.upsert_nodes(rows("c"))
        tx.upsert_nodes(rows("d"))
        tx.delete_nodes(tx.node("a"))
        assert tx.nodes.count() == 3 and load(spark, str(tmp_path)).nodes.count() == 2
    assert ids(load(spark, str(tmp_path)).nodes) == ["b", "c", "d"] and load(spark, str(tmp_path)).edges.count() == 0
    with pytest.raises(RuntimeError), Transaction(spark, str(tmp_path)) as tx:
        tx.delete_nodes(tx.nodes)
        raise RuntimeError
    assert ids(load(spark, str(tmp_path)).nodes) == ["b", "c", "d"] and tables_of(spark, str(tmp_path), "communities")["communities"].count() == 1


def test_overlapping_transactions_both_take_effect(spark, tmp_path):
    save(graph(spark, [("a", "b")]), str(tmp_path))
    rows = lambda *names: spark.createDataFrame([(n, "function", n, "/x") for n in names], "id string, kind string, name string, file_path string")
    with Transaction(spark, str(tmp_path)) as first:
        first.upsert_nodes(rows("c"))
        with Transaction(spark, str(tmp_path)) as second:
            second.upsert_nodes(rows("d"))
            second.delete_nodes(rows("a"))
    after = load(spark, str(tmp_path))
    assert ids(after.nodes) == ["b", "c", "d"] and after.edges.count() == 0
    assert store.number(spark, str(tmp_path)) == 2
    # A snapshot derived from an older one is refused and leaves nothing behind.
    folders = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(store.ConcurrentWrite):
        save(after, str(tmp_path), after=1)
    assert sorted(p.name for p in tmp_path.iterdir()) == folders and ids(load(spark, str(tmp_path)).nodes) == ["b", "c", "d"]
    # Writers that start from nothing in particular take the next free number.
    save(after, str(tmp_path))
    assert store.number(spark, str(tmp_path)) == 3


def test_lookups_read_few_files(spark, tmp_path):
    key = F.lpad(F.col("id").cast("string"), 5, "0")
    nodes = spark.range(2000).select(F.concat(F.lit("n"), key).alias("id"), F.when(F.col("id") % 2 == 0, "class").otherwise("function").alias("kind"), F.concat(F.lit("name"), F.col("id") % 700).alias("name"), F.concat(F.lit("/f"), F.col("id") % 90).alias("file_path"))
    edges = spark.range(6000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.format_string("n%05d", F.col("id") % 2000).alias("source"), F.format_string("n%05d", F.col("id") * 7 % 1999).alias("target"), F.when(F.col("id") % 3 == 0, "calls").otherwise("imports").alias("kind"))
    g = PropertyGraph.of(nodes, edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save(g, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = load(spark, str(tmp_path))
    assert isinstance(stored, store.StoredGraph) and len(stored.nodes.inputFiles()) >= 4 and len(stored.edges.inputFiles()) >= 4
    for plain, own, most in (
        (g.node("n00777"), stored.node("n00777"), 1), (g.edges_from("n00777"), stored.edges_from("n00777"), 2), (g.edges_to("n00777", "calls"), stored.edges_to("n00777", "calls"), 1),
        (g.find("name7", "class"), stored.find("name7", "class"), 4), (g.by_file("/f7"), stored.by_file("/f7"), 4), (g.node("none"), stored.node("none"), 1), (g.find("none"), stored.find("none"), 1), (g.edges_to("zzz"), stored.edges_to("zzz"), 0),
    ):
        assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect())) and own.columns == plain.columns
        assert len(own.inputFiles()) <= most
    # A key's file is the only one that is opened.
    read = stored.node("n00777")
    read.collect()
    metrics = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert metrics.apply("numFiles").value() == 1
    # What is changed is no stored graph any more, so no lookup misses it.
    more = stored.upsert_nodes(g.node("n00001").withColumn("id", F.lit("new")))
    assert more.node("new").count() == 1 and not isinstance(more, store.StoredGraph)
    assert stored.delete_edges(stored.edges_to("n00777")).edges_to("n00777").count() == 0


def test_json_columns(spark):
    rows = spark.createDataFrame([("a", "file", "a", "/a", '{"k": "v"}', "[1, 2.5]"), ("b", "file", "b", "/b", None, "not json")], "id string, kind string, name string, file_path string, metadata string, embedding string")
    nodes = PropertyGraph.of(rows, spark.createDataFrame([], schema.EDGES)).nodes
    got = {r["id"]: (r["metadata"], r["embedding"]) for r in nodes.collect()}
    assert got["a"] == ({"k": "v"}, [1.0, 2.5]) and got["b"][0] is None
    text = {r["id"]: (r["metadata"], r["embedding"]) for r in as_json(nodes).collect()}
    assert text["a"] == ('{"k":"v"}', "[1.0,2.5]") and conform(as_json(nodes), schema.NODES).where("id = 'a'").first()["metadata"] == {"k": "v"}


def test_older_snapshots_are_migrated(spark, tmp_path, monkeypatch):
    save(graph(spark, [("a", "b")]), str(tmp_path))
    monkeypatch.setattr(schema, "VERSION", schema.VERSION + 1)
    with pytest.raises(ValueError, match="version"):
        load(spark, str(tmp_path))
    monkeypatch.setitem(store.MIGRATIONS, schema.VERSION - 1, lambda t: {**t, "nodes": t["nodes"].withColumn("name", F.upper("name"))})
    assert {r["name"] for r in load(spark, str(tmp_path)).nodes.collect()} == {"A", "B"}


def test_last_write_wins_within_a_batch(spark):
    g = graph(spark, [("a", "b")])
    rows = [("a", "class", "one", "/x", 2), ("a", "class", "two", "/x", 3), ("c", "class", "c", "/x", 1), ("a", "class", "zero", "/x", 1)]
    new = spark.createDataFrame(rows, "id string, kind string, name string, file_path string, seq int")
    assert {(r["id"], r["name"]) for r in g.upsert_nodes(new).nodes.collect()} == {("a", "two"), ("b", "b"), ("c", "c")}
    assert {(r["id"], r["name"]) for r in g.upsert_nodes(new.drop("seq").coalesce(1)).nodes.collect()} == {("a", "zero"), ("b", "b"), ("c", "c")}
    edge = spark.createDataFrame([("e", "a", "b", "calls", 1.0), ("e", "a", "b", "uses", 0.5)], "id string, source string, target string, kind string, confidence double").coalesce(1)
    assert [(r["id"], r["kind"]) for r in g.upsert_edges(edge).edges.where("id = 'e'").collect()] == [("e", "uses")]


def test_neighbors(spark):
    g = graph(spark, [("a", "b"), ("b", "c")])
    assert ids(traverse.neighbors(g, "a", "out")) == ["b"]
    assert ids(traverse.neighbors(g, "a", "out", depth=2)) == ["b", "c"]
    assert ids(traverse.neighbors(g, "c", "in")) == ["b"]
    assert ids(traverse.neighbors(g, "a", "both", ["imports"])) == []


def test_impact_order_and_missing_nodes(spark):
    g = graph(spark, [("b", "a"), ("ghost", "a"), ("c", "ghost"), ("d", "b"), ("a", "d")], nodes={"a", "b", "c", "d"})
    found = traverse.impact(g, "a", paths=True).collect()
    assert [(r["id"], r["distance"]) for r in found] == [("b", 1), ("c", 2), ("d", 2)]
    assert found[0]["impact_score"] == 0.5 and len(found[1]["path"]) == 2


@pytest.mark.parametrize("seed", range(3))
def test_paths_are_shortest(spark, seed):
    draw = random.Random(seed)
    pairs = {(draw.choice("abcdefgh"), draw.choice("abcdefgh")) for _ in range(14)}
    g = graph(spark, sorted(pairs), nodes=set("abcdefgh"))
    away = {"a": 0}
    for level in range(8):
        for x, y in pairs:
            if away.get(x) == level:
                away.setdefault(y, level + 1)
    for end in "bdh":
        rows = traverse.find_path(g, "a", end).collect()
        assert len(rows) == (away[end] + 1 if end in away else 0)
        assert all((x["id"], y["id"]) in pairs for x, y in zip(rows, rows[1:], strict=False))
    assert [r["id"] for r in traverse.find_path(g, "a", "a").collect()] == ["a"]


@pytest.mark.parametrize("seed", [1, 2])
def test_least_of_the_shortest_paths(spark, seed):
    """Layers with many paths of one length, and edges whose order is another than the nodes'."""
    draw = random.Random(seed)
    edges = [(f"e{draw.randrange(10**6):06}", f"{k}{x}", f"{k + 1}{y}") for k in range(5) for x in "abc" for y in "abc" if draw.random() < 0.6] + [("back", "3a", "0a"), ("self", "2b", "2b"), ("jump", "0a", "4z")]
    g = PropertyGraph.of(spark.createDataFrame([(f"{k}{x}", "function", "n") for k in range(6) for x in "abc"], "id string, kind string, name string"), spark.createDataFrame([(*e, "calls") for e in edges], "id string, source string, target string, kind string"))
    best = {"0a": []}
    for _ in range(6):
        for e, x, y in sorted(edges):
            if x in best and (y not in best or (len(best[x]) + 1, [*best[x], e]) < (len(best[y]), best[y])):
                best[y] = [*best[x], e]
    for end in ("3b", "5a", "5c", "4z"):
        rows = traverse.find_path(g, "0a", end).collect()
        assert [r["edge_id"] for r in rows[1:]] == best.get(end, []) and [r["step"] for r in rows] == list(range(len(rows)))
    assert traverse.find_path(g, "0a", "5a", max_depth=4).count() == 0 and traverse.find_path(g, "0a", "nowhere").count() == 0


def test_flow_is_depth_first_by_line(spark):
    g = graph(spark, [("a", "c"), ("a", "b"), ("c", "d"), ("d", "a"), ("b", "d"), ("b", "gone")], nodes=set("abcd"))
    rows = traverse.flow(g, "a").collect()
    assert [(r["id"], r["depth"]) for r in rows] == [("a", 0), ("c", 1), ("d", 2), ("b", 1)]
    assert [r["text"] for r in traverse.flow_lines(traverse.flow(g, "a"), g.nodes).collect()][:2] == ["a (function)", "  → c (function)"]


def test_context_and_rename(spark):
    g = graph(spark, [("a", "x"), ("x", "b"), ("a", "x", "imports"), ("x", "b")])
    g = g.with_columns_of(spark.createDataFrame([("x", 1), ("b", 1)], "id string, community_id int"))
    steps = spark.createDataFrame([("p2", "two", "a", ["x"], "custom"), ("p1", "one", "a", ["a", "x"], "custom")], schema.PROCESSES)
    rows = sorted((r["relation"], r["id"]) for r in traverse.context(g, "x", steps).collect())
    assert rows == [("callees", "b"), ("callees", "b"), ("callers", "a"), ("community_siblings", "b"), ("imported_by", "a"), ("process", "p1")]
    row = traverse.rename_preview(g, "x", "b").first()
    assert (row["references"], row["affected_files"], row["conflicts"]) == (2, ["/src/a.ts", "/src/x.ts"], ["b"])


def ranks(g, **kw):
    return {r["id"]: r["page_rank"] for r in pagerank(g, **kw).collect()}


def test_pagerank(spark):
    hub = ranks(graph(spark, [("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "leaf")]))
    assert len(hub) == 5 and hub["hub"] > hub["a"]
    cycle = ranks(graph(spark, [("x", "y"), ("y", "z"), ("z", "x")]))
    assert sum(cycle.values()) == pytest.approx(1, abs=1e-6) and cycle["x"] == pytest.approx(1 / 3)
    assert ranks(graph(spark, [("q", "q")], nodes=set()).delete_nodes(spark.createDataFrame([("q",)], "id string"))) == {}


def test_pagerank_joins_only_what_still_flows(spark, monkeypatch):
    from graphmill.operators import pagerank as module

    written = []
    monkeypatch.setattr(module, "materialize", lambda df, label="table": written.append(label) or materialize(df, label))
    chain = ranks(graph(spark, [("a", "b"), ("b", "c"), ("a", "c")]), max_iterations=20, tolerance=None)
    # By definition, 20 rounds.
    r, out = dict.fromkeys("abc", 1 / 3), {"a": "bc", "b": "c", "c": ""}
    for _ in range(20):
        got = {v: sum(r[u] / len(t) for u, t in out.items() if v in t) for v in r}
        r = {v: 0.15 / 3 + 0.85 * (got[v] + r["c"] / 3) for v in r}
    assert chain == pytest.approx(r, abs=1e-12) and written.count("flow") <= 3


def test_pagerank_by_definition(spark):
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "ghost"), ("d", "a")]
    got = ranks(graph(spark, edges, nodes=set("abcd")), max_iterations=7, tolerance=None)
    live = [(x, y) for x, y in edges if y != "ghost"]
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(7):
        loose = sum(r for v, r in rank.items() if v not in {x for x, _ in live})
        rank = {v: 0.15 / 4 + 0.85 * (loose / 4 + sum(rank[x] / sum(1 for s, _ in live if s == x) for x, y in live if y == v)) for v in rank}
    assert got == pytest.approx(rank)


TRIANGLES = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")]


def test_communities_of_two_triangles(spark):
    g = graph(spark, TRIANGLES)
    home = {r["id"]: r["community_id"] for r in com.detect_communities(g).collect()}
    assert home == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}
    about = {r["id"]: r.asDict() for r in com.describe(g, com.detect_communities(g)).collect()}
    assert about[0] == {"id": 0, "label": "src", "member_count": 3, "cohesion": 1.0}
    spread = {r["id"]: r["community_id"] for r in com.spread_communities(g).collect()}
    assert len({spread[v] for v in "abc"}) == 1 and spread["a"] != spread["x"]


def test_local_moving_improves_modularity():
    draw = random.Random(2)
    names = [f"v{i:02}" for i in range(24)]
    weights = {v: {} for v in names}
    for a, b in product(names, names):
        if a < b and draw.random() < (0.6 if int(a[1:]) // 8 == int(b[1:]) // 8 else 0.05):
            weights[a][b] = weights[b][a] = 1.0
    total = sum(w for row in weights.values() for w in row.values()) / 2
    home = com.local_moving(weights, total)
    assert modularity(weights, home) > max(0.3, modularity(weights, {v: v for v in names}))


def test_parallel_moving_is_stable_and_as_good(spark):
    """Blocks with a hub that all nodes of one block hang on, a self-loop, and nodes without ties."""
    draw = random.Random(4)
    names = [f"v{i:02}" for i in range(60)]
    edges = [(f"e{a}{b}", a, b, draw.choice(["calls", "imports"]), draw.choice([0.5, 1.0])) for a, b in product(names, names) if a < b and draw.random() < (0.5 if int(a[1:]) // 15 == int(b[1:]) // 15 else 0.03)]
    edges += [(f"h{i}", "v00", f"leaf{i}", "calls", 1.0) for i in range(40)] + [("self", "v01", "v01", "calls", 1.0)]
    nodes = [(v, "function", v) for v in [*names, *(f"leaf{i}" for i in range(40)), "alone", "apart"]]
    g = PropertyGraph.of(spark.createDataFrame(nodes, "id string, kind string, name string"), spark.createDataFrame(edges, "id string, source string, target string, kind string, confidence double"))
    found = materialize(com.detect_communities(g))
    home = {r["id"]: r["community_id"] for r in found.collect()}
    assert sorted(home) == sorted(v for v, *_ in nodes) and len({home["alone"], home["apart"], home["v00"]}) == 3
    mine, other = com.standing(g, found).first(), com.standing(g, com.sequential_communities(g)).first()
    assert mine["gaining"] == 0 and mine["modularity"] >= 0.99 * other["modularity"] > 0.3
    weights = {v: {} for v in home}
    for r in com.undirected(g).collect():
        weights[r["a"]][r["b"]] = r["weight"]
    assert abs(modularity(weights, home) - mine["modularity"]) < 1e-9
    none = PropertyGraph(g.nodes.limit(0), g.edges.limit(0))
    assert com.detect_communities(none).count() == 0
    assert com.detect_communities(PropertyGraph(g.nodes.limit(3), g.edges.limit(0))).count() == 3


def test_components(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(0, 20)] + [("z", "y")], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(21)] + [("y",), ("z",), ("alone",)], "id string")
    found = {r["id"]: r["component"] for r in com.components(nodes, edges).collect()}
    assert {found[f"n{i:02}"] for i in range(21)} == {"n00"} and found["z"] == "y" and found["alone"] == "alone"


def test_processes(spark):
    g = graph(spark, [("handleClick", "b"), ("b", "c"), ("handleClick", "d"), ("c", "handleClick"), ("initApp", "b"), ("main", "gone")], nodes={"handleClick", "b", "c", "d", "initApp", "main"})
    for strategy, want in (("bfs", ["handleClick", "b", "d", "c"]), ("dfs", ["handleClick", "b", "c", "d"]), ("hybrid", ["handleClick", "b", "c", "d"])):
        found = {r["entry_point"]: r for r in proc.detect_processes(g, strategy=strategy).collect()}
        assert set(found) == {"handleClick", "initApp"}
        assert found["handleClick"]["steps"] == want and found["handleClick"]["kind"] == "api_route" and found["handleClick"]["name"] == "handleClick" and found["initApp"]["kind"] == "lifecycle"
    short = {r["entry_point"]: r["steps"] for r in proc.detect_processes(g, max_steps=2, strategy="bfs").collect()}
    assert short["handleClick"] == ["handleClick", "b"]
    wide = graph(spark, [("main", f"n{i}") for i in range(6)] + [(f"n{i}", f"m{i}") for i in range(6)] + [(f"m{i}", f"z{i}") for i in range(6)])
    for most in (1, 3, 7, 9, 30):
        for strategy in ("bfs", "hybrid", "dfs"):
            steps = [r["steps"] for r in proc.detect_processes(wide, max_steps=most, strategy=strategy).collect()]
            calls = {"main": [f"n{i}" for i in range(6)]} | {f"n{i}": [f"m{i}"] for i in range(6)} | {f"m{i}": [f"z{i}"] for i in range(6)}
            want = proc.trace("main", calls, most, strategy)
            assert steps == ([want] if len(want) > 1 else [])


@pytest.mark.parametrize(("home", "block", "task"), [(32 << 20, 200, 1 << 20), (0, 200, 0), (32 << 20, 20, 1 << 20)])
def test_blocks_move_at_once_until_no_node_gains(spark, monkeypatch, home, block, task):
    """Packed blocks, blocks that are dealt each round, and hubs of more ties than a block; the rounds by single moves, of which
    there was one a move of a crowd, only follow hubs."""
    written = []
    monkeypatch.setattr(com, "materialize", lambda df, label="table": written.append(label) or materialize(df, label))
    monkeypatch.setattr(com, "HOME_BYTES", home)
    monkeypatch.setattr(com, "BLOCK_TIES", block)
    monkeypatch.setattr(com, "TASK_TIES", task)
    draw = random.Random(7)
    names = [f"v{i:02}" for i in range(48)]
    g = graph(spark, [(a, b) for a, b in product(names, names) if a < b and draw.random() < (0.6 if int(a[1:]) // 12 == int(b[1:]) // 12 else 0.05)] + [("v00", f"leaf{i}") for i in range(30)])
    found = materialize(com.detect_communities(g))
    assert found.count() == found.select("id").distinct().count() == 78
    mine, other = com.standing(g, found).first(), com.standing(g, com.sequential_communities(g)).first()
    assert mine["gaining"] == 0 and mine["modularity"] >= 0.99 * other["modularity"] > 0.3
    assert "best" not in written or block < 30


def test_a_crowd_of_moves_goes_as_far_as_it_gains():
    k, here, to = np.array([4.0, 4.0, 4.0, 1.0]), np.array([0, 0, 1, 0]), np.array([2, 2, 2, 3])
    # The first and the last leave room for themselves; what the second would gain, the first has taken.
    assert com.uncrowded(k, here, to, np.array([0.5, 0.1, 0.3, 0.2]), 6.0, 1.0).tolist() == [True, False, True, True]


@pytest.mark.parametrize("few", [True, False])
def test_labels_that_go_round_are_those_of_the_last_round(spark, monkeypatch, few):
    """Pairs whose ends are in one half swap labels forever: labels come back, and are those of all rounds in the end."""
    written = []
    monkeypatch.setattr(com, "materialize", lambda df, label="table": written.append(label) or materialize(df, label))
    if not few:
        monkeypatch.setattr(com, "small", lambda *_: False)
    draw = random.Random(3)
    names = [f"v{i:02}" for i in range(20)]
    g = graph(spark, [(a, b) for a, b in product(names, names) if a < b and draw.random() < 0.2] + [(f"p{i}", f"q{i}") for i in range(6)])
    half = {r["id"]: r["half"] for r in g.nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("half")).collect()}
    ties = {v: {} for v in half}
    for r in com.undirected(g).where("a <> b").collect():
        ties[r["a"]][r["b"]] = r["weight"]
    for rounds in (50, 53):
        want = {v: v for v in half}
        for k in range(rounds):
            votes = {v: {c: sum(w for u, w in ties[v].items() if want[u] == c) for c in {want[u] for u in ties[v]}} for v in ties}
            want |= {v: min(votes[v], key=lambda c: (-votes[v][c], c)) for v in ties if half[v] == k % 2}  # noqa: B023
        order = {c: i for i, c in enumerate(sorted(set(want.values())))}
        written.clear()
        assert {r["id"]: r["community_id"] for r in com.spread_communities(g, rounds).collect()} == {v: order[c] for v, c in want.items()}
        assert written.count("labels") < 20


def test_assignments_share_their_ties(spark, monkeypatch):
    """An assignment is written once and its ties are added up once, however many figures are read from them."""
    from graphmill import queries

    written = []
    note = lambda df, label="table": written.append(label) or materialize(df, label)
    monkeypatch.setattr(com, "materialize", note)
    monkeypatch.setattr(queries, "materialize", note)
    g = graph(spark, TRIANGLES)
    monkeypatch.setattr(queries, "star_graph", lambda *_: g)
    assert queries.spread_invariants(spark, "").first()["members"] == 6 and written.count("assigned") == 1
    ties, at = materialize(com.undirected(g)), g.nodes.select("id", F.lit(0).alias("community_id"))
    written.clear()
    assert com.standing(g, at, ties=ties).first() == com.standing(g, at).first() and written.count("ties") == 1


def test_rounds_of_moves_deal_no_ties(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d")]
    ties = spark.createDataFrame([(ord(x), ord(y), 1.0) for a, b in rows for x, y in ((a, b), (b, a))], "a long, b long, weight double")
    home = spark.createDataFrame([(ord(v), ord(v), k) for v, k in zip("abcd", (1.0, 2.0, 2.0, 1.0), strict=True)], "v long, c long, k double")
    kept = com.dealt(ties, 4)
    best = com.best_moves(kept, home, 3.0, 1.0, 4)
    plan = [x for x in best._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]
    assert plan and not [x for x in plan if "hashpartitioning(a#" in x or "hashpartitioning(b#" in x]
    assert {(r["v"], r["to"]) for r in best.collect()} >= {(ord("a"), ord("b")), (ord("d"), ord("c"))}
    kept.unpersist()


def test_walks_stream_instead_of_a_call_each(spark):
    g = graph(spark, [("main", "b"), ("run", "c")])
    found = proc.detect_processes(g)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["entry_point"]: list(r["steps"]) for r in found.collect()} == {"main": ["main", "b"], "run": ["run", "c"]}


@pytest.mark.parametrize("few", [True, False])
def test_mutations_order_only_the_log(spark, monkeypatch, few):
    seen, latest = [], store.latest
    monkeypatch.setattr(store, "latest", lambda rows: seen.append(rows.count()) or latest(rows))
    if not few:
        monkeypatch.setattr(store, "is_light", lambda *_: False)
        monkeypatch.setattr(store, "if_few", lambda t, _: t.hint("merge"))
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e")])
    blank = [None] * 12
    log = [(0, "upsert_node", None, None, ("b", "class", "B", "/src/a.ts", *blank), None), (1, "delete_file_nodes", "/src/a.ts", None, None, None), (2, "upsert_node", None, None, ("a", "class", "again", "/x", *blank), None), (3, "delete_edges_from", "d", "calls", None, None), (4, "upsert_edge", None, None, None, ("new", "d", "c", "uses", 1.0, None, None, None))]
    after = g.mutate(spark.createDataFrame(log, schema.MUTATIONS))
    assert {(r["id"], r["name"]) for r in after.nodes.collect()} == {("a", "again"), ("c", "c"), ("d", "d"), ("e", "e")}
    assert ids(after.edges) == ["c->calls->d@2", "new"]
    # Two nodes and an edge are put; what the graph holds is not ordered, nor sorted where it is joined with little.
    assert sorted(seen) == [1, 2]
    joins = [x for x in after.edges._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin [source" in x or "SortMergeJoin [target" in x]
    assert not few or not joins


def test_lines_are_dealt_by_their_number(spark):
    rows = spark.range(400).select((F.col("id") % 7).alias("a"), "id")
    cores = spark.sparkContext.defaultParallelism
    assert spread(rows, 400, "a", most=1 << 19).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert spread(rows, 400, "a", most=10).rdd.getNumPartitions() == 40 > cores


def test_a_stored_graph_is_computed_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda s: runs.add(1) or s, "string")
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a", "uses")])
    at = save(PropertyGraph(g.nodes, g.edges.withColumn("source", seen("source"))), str(tmp_path))
    assert runs.value == 3 and not os.path.exists(f"{at}/plain")
    stored = load(spark, str(tmp_path))
    assert ids(stored.edges_from("c")) == ["c->uses->a@2"] and ids(stored.edges_to("b")) == ["a->calls->b@0"] and ids(stored.find("b")) == ["b"]
