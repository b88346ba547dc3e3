"""The library's operators over the star-schema, text, vector, page and event tables, as the driver's queries.

Every query runs over its whole tables and texts; limits appear only where they are what is asked for (a top-k).
ORACLE has, by the same names, SQL for another engine that computes the same rows its own way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import text
from graphmill.functions.extract import extract, extract_file, parts
from graphmill.operators import communities as com
from graphmill.operators import processes as proc
from graphmill.operators import traverse
from graphmill.operators.pagerank import pagerank
from graphmill.operators.resolve import module_paths, resolve_calls, resolve_imports
from graphmill.plans import planner
from graphmill.plans.graph import PropertyGraph, load, save, upsert_rows
from graphmill.plans.pipeline import changed, index, reindex
from graphmill.plans.sqltool import run_sql
from graphmill.sources.files import page_links, parse_name_status
from graphmill.sources.scratch import materialize, shared_root
from graphmill.sources.star import star_edges, star_graph, star_nodes, table
from graphmill.streaming.watch import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

GRAPH = """
nodes AS (
    SELECT 'r:' || r_regionkey AS id, 'module' AS kind, r_name AS name, '/region' AS file_path FROM region
    UNION ALL SELECT 'n:' || n_nationkey, 'file', n_name, '/region/' || n_regionkey FROM nation
    UNION ALL SELECT 'c:' || c_custkey, 'class', c_name, '/nation/' || c_nationkey || '/customer' FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'interface', s_name, '/nation/' || s_nationkey || '/supplier' FROM supplier
    UNION ALL SELECT 'o:' || o_orderkey, 'function', o_orderpriority, '/order/' || o_orderstatus FROM orders
    UNION ALL SELECT 'p:' || p_partkey, 'constant', p_name, '/part/' || p_brand FROM part),
links AS (
    SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'contains' AS kind, 1.0::DOUBLE AS confidence, NULL::INTEGER AS line FROM nation
    UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains', 1.0, NULL FROM customer
    UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains', 1.0, NULL FROM supplier
    UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'calls', 1.0, NULL FROM orders
    UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls', 0.7, min(l_linenumber) FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'imports', 0.5, NULL FROM lineitem),
edges AS (SELECT source || '->' || kind || '->' || target AS id, * FROM links)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def graph_sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH.strip()}{', ' + more if more else ''} {body}"


def seven(c: str) -> Any:
    return F.round(c, 7)


# Statistics and lookups


@query("graph_counts", graph_sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'file') AS files, (SELECT count(*) FROM edges) AS edges"))
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).counts().select("nodes", "files", "edges")


@query("nodes_by_kind", graph_sql("SELECT kind, count(*) AS n FROM nodes GROUP BY kind"))
def nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).by_kinds("nodes")


@query("edges_by_kind", graph_sql("SELECT kind, count(*) AS n FROM edges GROUP BY kind"))
def edges_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).by_kinds("edges")


@query("files_by_language", "SELECT coalesce(lang, '') AS language, count(*) AS n FROM documents GROUP BY lang")
def files_by_language(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.lit("file").alias("kind"), F.col("source").alias("name"), F.col("source").alias("file_path"), F.col("lang").alias("language"))
    return PropertyGraph.of(nodes, star_edges(spark, d)).files_by_language().select(F.coalesce("language", F.lit("")).alias("language"), "n")


@query("node_lookup", graph_sql("SELECT * FROM nodes WHERE id = 's:7'"))
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).node("s:7").select("id", "kind", "name", "file_path")


@query("nodes_by_path_prefix", graph_sql("SELECT id, name FROM nodes WHERE file_path ILIKE '/NATION/1%'"))
def nodes_by_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).by_path_prefix("/NATION/1").select("id", "name")


@query("find_by_name", graph_sql("SELECT id, kind, name FROM nodes WHERE name = '1-URGENT'"))
def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).find("1-URGENT").select("id", "kind", "name")


@query("adjacency_out", graph_sql("SELECT id, target, line FROM edges WHERE source = 'o:7' AND kind = 'calls'"))
def adjacency_out(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).edges_from("o:7", "calls").select("id", "target", "line")


@query("adjacency_in", graph_sql("SELECT id, source, kind FROM edges WHERE target = 's:7'"))
def adjacency_in(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).edges_to("s:7").select("id", "source", "kind")


@query("stored_lookups", graph_sql("""SELECT 'node' AS lookup, id, name AS more FROM nodes WHERE id = 's:7'
    UNION ALL SELECT 'out', id, target FROM edges WHERE source = 'o:7' UNION ALL SELECT 'in', id, source FROM edges WHERE target = 's:7'
    UNION ALL SELECT 'name', id, kind FROM nodes WHERE name = '1-URGENT' UNION ALL SELECT 'file', id, name FROM nodes WHERE file_path = '/nation/3/customer'"""))
def stored_lookups(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_root(spark)}/stored-{uuid.uuid4().hex[:12]}"
    save(star_graph(spark, d), at)
    g = load(spark, at)
    rows = lambda lookup, found, more: found.select(F.lit(lookup).alias("lookup"), "id", F.col(more).alias("more"))
    out = rows("node", g.node("s:7"), "name").unionByName(rows("out", g.edges_from("o:7"), "target")).unionByName(rows("in", g.edges_to("s:7"), "source"))
    return out.unionByName(rows("name", g.find("1-URGENT"), "kind")).unionByName(rows("file", g.by_file("/nation/3/customer"), "name"))


@query("dead_code", graph_sql("SELECT id, name FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND e.kind IN ('calls', 'imports'))"))
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).unused("calls", "imports").select("id", "name")


# Mutations


@query("upsert_nodes", graph_sql("SELECT CASE WHEN id LIKE 's:%' THEN 'class' ELSE kind END AS kind, count(*) AS n, count(*) FILTER (WHERE id LIKE 's:%') AS renamed FROM (SELECT id, kind FROM nodes UNION SELECT 's:new', 'class') GROUP BY 1"))
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    new = g.by_kind("interface").withColumns({"kind": F.lit("class"), "name": F.lit("renamed")})
    new = new.unionByName(new.limit(1).withColumn("id", F.lit("s:new")))
    after = g.upsert_nodes(new).nodes
    return after.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("name") == "renamed").alias("renamed"))


@query("upsert_cascade", graph_sql("SELECT kind, count(*) AS n FROM edges WHERE source NOT LIKE 's:%' AND target NOT LIKE 's:%' GROUP BY kind"))
def upsert_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    return g.upsert_nodes(g.by_kind("interface"), cascade_edges=True).by_kinds("edges")


@query("delete_file_cascade", graph_sql("SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes, count(*) AS edges FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)", "gone AS (SELECT id FROM nodes WHERE file_path = '/nation/3/customer')"))
def delete_file_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d).delete_file("/nation/3/customer")
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


@query("delete_edges_from", graph_sql("SELECT kind, count(*) AS n FROM edges WHERE NOT (source = 'n:3' AND kind = 'contains') GROUP BY kind"))
def delete_edges_from(spark: SparkSession, d: str) -> DataFrame:
    return star_graph(spark, d).delete_edges_from("n:3", "contains").by_kinds("edges")


@query(
    "mutate_log",
    graph_sql(
        """SELECT 'node' AS what, kind, count(*) AS n, count(*) FILTER (WHERE name = 'again') AS again FROM (
            SELECT id, kind, CASE WHEN id = 's:1' THEN 'again' ELSE name END AS name FROM nodes WHERE id NOT IN (SELECT id FROM gone)) GROUP BY kind
        UNION ALL SELECT 'edge', kind, count(*), 0 FROM (
            SELECT kind FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) AND source <> 's:1' AND target <> 's:1' AND NOT (source = 'o:2' AND kind = 'calls') AND id <> 'r:1->contains->n:1'
            UNION ALL SELECT 'uses') GROUP BY kind""",
        "gone AS (SELECT id FROM nodes WHERE file_path = '/nation/3/customer')",
    ),
)
def mutate_log(spark: SparkSession, d: str) -> DataFrame:
    from graphmill.schema import MUTATIONS

    g = star_graph(spark, d)
    node = ("s:1", "interface", "again", "/nation/1/supplier", *[None] * 12)
    edge = ("e:new", "o:2", "p:1", "uses", 1.0, None, None, None)
    log = [(1, "upsert_edge", None, None, None, ("e:gone", "s:1", "p:1", "uses", 1.0, None, None, None)), (2, "delete_node", "s:1", None, None, None), (3, "upsert_node", None, None, node, None), (4, "delete_file_nodes", "/nation/3/customer", None, None, None), (5, "delete_edges_from", "o:2", "calls", None, None), (6, "upsert_edge", None, None, None, edge), (7, "delete_edge", "r:1->contains->n:1", None, None, None)]
    after = g.mutate(spark.createDataFrame(log, MUTATIONS))
    nodes = after.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("name") == "again").alias("again")).select(F.lit("node").alias("what"), "kind", "n", "again")
    return nodes.unionByName(after.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n", F.lit(0).cast("long").alias("again")))


@query("upsert_communities", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'again' ELSE n_name END AS label, CASE WHEN n_nationkey < 3 THEN 0 ELSE n_regionkey END::BIGINT AS member_count FROM nation UNION ALL SELECT 99, 'new', 1")
def upsert_communities(spark: SparkSession, d: str) -> DataFrame:
    from graphmill.schema import COMMUNITIES

    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("member_count"))
    new = old.where("id < 3").withColumns({"label": F.lit("again"), "member_count": F.lit(0)}).unionByName(spark.createDataFrame([(99, "new", 1)], "id int, label string, member_count int"))
    return upsert_rows(old, new, COMMUNITIES).select("id", "label", "member_count")


# Traversal


def reach_sql(seed: str, step: str, depth: int, body: str) -> str:
    return graph_sql(body, f"walk AS (SELECT {seed} AS id, 0 AS d UNION SELECT e.next, w.d + 1 FROM walk w JOIN ({step}) e ON e.at = w.id WHERE w.d < {depth}), found AS (SELECT id, min(d) AS distance FROM walk GROUP BY id)", True)


OUT, IN = "SELECT source AS at, target AS next, kind FROM edges", "SELECT target AS at, source AS next, kind FROM edges"
REACHED = "SELECT f.id, n.name, CAST(f.distance AS INTEGER) AS distance FROM found f JOIN nodes n ON n.id = f.id WHERE f.distance > 0"


def around(direction: str, start: str, depth: int, kinds: tuple[str, ...] | None = None) -> Query:
    return lambda spark, d: traverse.neighbors(star_graph(spark, d), start, direction, kinds, depth).select("id", "name", "distance")


query("neighbors_out_k2", reach_sql("'c:5'", OUT, 2, REACHED))(around("out", "c:5", 2))
query("neighbors_in_k2", reach_sql("'p:5'", IN, 2, REACHED))(around("in", "p:5", 2))
query("neighbors_both_k2", reach_sql("'c:5'", f"{OUT} UNION ALL {IN}", 2, REACHED))(around("both", "c:5", 2))
query("neighbors_kind_filtered", reach_sql("'p:5'", f"SELECT * FROM ({OUT} UNION ALL {IN}) WHERE kind = 'imports'", 2, REACHED))(around("both", "p:5", 2, ("imports",)))

IMPACT_IN = "SELECT target AS at, source AS next FROM edges WHERE kind IN ('calls', 'imports', 'uses', 'extends', 'implements')"


@query("impact_supplier", reach_sql("'s:7'", IMPACT_IN, 5, "SELECT f.id, n.name, n.file_path, CAST(f.distance AS INTEGER) AS distance, round(1.0::DOUBLE / (f.distance + 1), 7) AS impact_score FROM found f JOIN nodes n ON n.id = f.id WHERE f.distance > 0"))
def impact_supplier(spark: SparkSession, d: str) -> DataFrame:
    return traverse.impact(star_graph(spark, d), "s:7").select("id", "name", "file_path", "distance", seven("impact_score").alias("impact_score"))


@query("impact_by_distance", reach_sql("'p:5'", IMPACT_IN, 5, "SELECT CAST(f.distance AS INTEGER) AS distance, count(*) AS n, count(DISTINCT n.file_path) AS files FROM found f JOIN nodes n ON n.id = f.id WHERE f.distance > 0 GROUP BY f.distance"))
def impact_by_distance(spark: SparkSession, d: str) -> DataFrame:
    return traverse.impact_by_distance(traverse.impact(star_graph(spark, d), "p:5"))


@query("change_impact", reach_sql("id", IMPACT_IN, 3, "SELECT DISTINCT n.file_path FROM found f JOIN nodes n ON n.id = f.id WHERE f.distance > 0").replace("SELECT id AS id, 0 AS d", "SELECT id, 0 AS d FROM nodes WHERE file_path = '/nation/4/supplier'"))
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    return traverse.change_impact(star_graph(spark, d), spark.createDataFrame([("/nation/4/supplier",)], "file_path string"))


@query("shortest_path", graph_sql(
    "SELECT CAST(i AS INTEGER) AS step, CASE WHEN i = 0 THEN 'n:1' ELSE e.target END AS id, e.id AS edge_id FROM (SELECT min(path) AS path FROM walk WHERE id = 'p:1' AND d = (SELECT min(d) FROM walk WHERE id = 'p:1')) b, range(0, len(b.path) + 1) r(i) LEFT JOIN edges e ON e.id = b.path[i]",
    "walk AS (SELECT 'n:1' AS id, 0 AS d, []::VARCHAR[] AS path UNION ALL SELECT e.target, w.d + 1, list_append(w.path, e.id) FROM walk w JOIN edges e ON e.source = w.id WHERE w.d < 4)", True))
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return traverse.find_path(star_graph(spark, d), "n:1", "p:1")


@query("context_relations", graph_sql(
    """SELECT 'callers' AS relation, n.id, n.name, n.kind FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'p:5' AND e.kind = 'calls'
    UNION ALL SELECT 'imports', n.id, n.name, n.kind FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'p:5' AND e.kind = 'imports'
    UNION ALL SELECT 'process', 'process::' || o.id, o.name, 'custom' FROM nodes o WHERE o.id = (SELECT min(source) FROM edges WHERE target = 'p:5' AND kind = 'calls')"""))  # fmt: skip
def context_relations(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    return traverse.context(g, "p:5", order_processes(g)).select("relation", "id", "name", "kind")


def order_processes(g: PropertyGraph) -> DataFrame:
    """Each order and the parts it calls as a process."""
    steps = g.edges.where("kind = 'calls' and source like 'o:%'").groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("steps"))
    return steps.join(g.nodes, steps["source"] == g.nodes["id"]).select(F.concat(F.lit("process::"), "source").alias("id"), "name", F.col("source").alias("entry_point"), "steps", F.lit("custom").alias("kind"))


@query("process_membership", graph_sql("SELECT n.id, 'process::' || min(e.source) AS process_id FROM nodes n JOIN edges e ON e.target = n.id AND e.kind = 'calls' AND e.source LIKE 'o:%' GROUP BY n.id"))
def process_membership(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    return traverse.first_process(order_processes(g), g.nodes)


def with_nations(g: PropertyGraph, spark: SparkSession, d: str) -> tuple[PropertyGraph, DataFrame]:
    """Customers and suppliers assigned to their nation as a community."""
    of = lambda t, key, prefix, nation: table(spark, d, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(nation).alias("community_id"))
    home = of("customer", "c_custkey", "c:", "c_nationkey").unionByName(of("supplier", "s_suppkey", "s:", "s_nationkey")).unionByName(of("nation", "n_nationkey", "n:", "n_nationkey"))
    return g.with_columns_of(home), home


@query("community_siblings", "SELECT c_nationkey AS community_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT c_nationkey, id, row_number() OVER (PARTITION BY c_nationkey ORDER BY id) AS rank FROM (SELECT c_nationkey, 'c:' || c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 's:' || s_suppkey FROM supplier UNION ALL SELECT n_nationkey, 'n:' || n_nationkey FROM nation)) WHERE rank <= 20")
def community_siblings(spark: SparkSession, d: str) -> DataFrame:
    g, _ = with_nations(star_graph(spark, d), spark, d)
    return traverse.top_per_community(g.nodes, 20)


@query("community_cohesion", graph_sql(
    """SELECT h.community_id AS id, count(*) AS member_count,
        coalesce((SELECT round(avg(CASE WHEN a.community_id = b.community_id THEN 1.0 ELSE 0.0 END), 7) FROM edges e JOIN home a ON a.id = e.source JOIN home b ON b.id = e.target WHERE a.community_id = h.community_id), 0) AS cohesion
    FROM home h GROUP BY h.community_id""",
    "home AS (SELECT 'c:' || c_custkey AS id, c_nationkey AS community_id FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_nationkey FROM nation)"))
def community_cohesion(spark: SparkSession, d: str) -> DataFrame:
    g, home = with_nations(star_graph(spark, d), spark, d)
    return com.describe(g, home).select("id", "member_count", seven("cohesion").alias("cohesion"))


@query("community_labels", graph_sql(
    "SELECT community_id AS id, label FROM (SELECT h.community_id, regexp_replace(n.file_path, '/[^/]*$', '') AS dir, count(*) AS k FROM home h JOIN nodes n ON n.id = h.id GROUP BY ALL) g, LATERAL (SELECT array_to_string(list_filter(string_split(g.dir, '/'), lambda x: x <> '')[-2:], '/') AS label) QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY k DESC, dir) = 1",
    "home AS (SELECT 'c:' || c_custkey AS id, c_nationkey AS community_id FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_nationkey FROM nation)"))
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    g, home = with_nations(star_graph(spark, d), spark, d)
    return com.describe(g, home).select("id", "label")


@query("communities")
def communities(spark: SparkSession, d: str) -> DataFrame:
    return com.describe(*(lambda g: (g, com.detect_communities(g)))(star_graph(spark, d)))


def invariants(g: PropertyGraph, assigned: DataFrame) -> DataFrame:
    """One row that holds of any assignment: members, how often a node is assigned twice, numbers that are skipped, members'
    edges that describe() counts, and members whose community is in another component."""
    parts = com.components(g.nodes, com.linked(g).select("a", "b"))
    mixed = assigned.join(parts, "id").groupBy("community_id").agg(F.countDistinct("component").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn"))
    sums = assigned.agg(F.count("*").alias("members"), (F.count("*") - F.countDistinct("id")).alias("twice"), (F.max("community_id") + 1 - F.countDistinct("community_id")).cast("long").alias("skipped"))
    told = com.describe(g, assigned).agg(F.sum("member_count").alias("told"), F.count_if((F.col("cohesion") < 0) | (F.col("cohesion") > 1) | F.col("label").isNull()).alias("odd"))
    return sums.crossJoin(mixed).crossJoin(told)


INVARIANTS = "SELECT (SELECT count(*) FROM nodes) AS members, 0::BIGINT AS twice, 0::BIGINT AS skipped, 0::BIGINT AS torn, (SELECT count(*) FROM nodes) AS told, 0::BIGINT AS odd"


# Nodes alone, and every one community, fail here: the first have moves that gain, the other no modularity.
@query("community_invariants", graph_sql(f"{INVARIANTS}, 0::BIGINT AS gaining, true AS better"))
def community_invariants(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    assigned = materialize(com.detect_communities(g), "assigned")
    of = {"customer": ("c:", "c_custkey", "c_nationkey"), "supplier": ("s:", "s_suppkey", "s_nationkey")}
    places = [table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(c).cast("int").alias("community_id")) for t, (p, k, c) in of.items()]
    nations = places[0].unionByName(places[1])
    by_nation = g.nodes.select("id").join(nations, "id", "left").select("id", F.coalesce("community_id", F.lit(-1)).alias("community_id"))
    ties = materialize(com.undirected(g), "ties")
    other = com.standing(g, by_nation, ties=ties).select(F.col("modularity").alias("other"))
    found = com.standing(g, assigned, ties=ties).crossJoin(other).select("gaining", ((F.col("modularity") > F.col("other")) & (F.col("modularity") > 0.2)).alias("better"))
    return invariants(g, assigned).crossJoin(found)


@query("spread_communities")
def spread_communities(spark: SparkSession, d: str) -> DataFrame:
    return com.spread_communities(star_graph(spark, d))


@query("spread_invariants", graph_sql(INVARIANTS))
def spread_invariants(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    return invariants(g, materialize(com.spread_communities(g), "assigned"))


# Within 'contains' alone each region is a tree: local moving can't join two regions, and no node can gain by leaving.
@query("community_regions", "SELECT 'r:' || r_regionkey AS region, 1::BIGINT AS components FROM region")
def community_regions(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    g = PropertyGraph(g.nodes.where("kind in ('module', 'file', 'class', 'interface')"), g.edges.where("kind = 'contains'"))
    ties = com.undirected(g)
    parts = com.components(g.nodes, ties.select("a", "b"))
    mixed = com.detect_communities(g).join(parts, "id").groupBy("community_id").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    own = mixed.where("least = most").groupBy(F.col("least").alias("component")).agg(F.count("*").alias("communities"))
    return parts.where("id like 'r:%'").join(own, "component").select(F.col("id").alias("region"), F.lit(1).cast("long").alias("components"))


@query("connected_components", "WITH m AS (SELECT 'r:' || r_regionkey AS id, r_regionkey AS g FROM region UNION ALL SELECT 'n:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c:' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT id, min(id) OVER (PARTITION BY g) AS component FROM m")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    edges = g.edges.where("kind = 'contains'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return com.components(g.nodes.where("kind in ('module', 'file', 'class', 'interface')"), edges)


@query("flow_tree", graph_sql(
    "SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS seq, id, CAST(d AS INTEGER) AS depth FROM walk",
    "walk AS (SELECT 'r:1' AS id, 0 AS d, []::VARCHAR[] AS ord UNION ALL SELECT e.target, w.d + 1, list_append(w.ord, e.id) FROM walk w JOIN edges e ON e.source = w.id AND e.kind = 'contains' WHERE w.d < 5)", True))
def flow_tree(spark: SparkSession, d: str) -> DataFrame:
    return traverse.flow(star_graph(spark, d), "r:1", 5, ("contains",)).select("seq", "id", "depth")


# Where no cycle is, depth first by line and edge id visits each node along the least of its paths.
@query("flow_trace", graph_sql(
    "SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS seq, id, edge_id, CAST(d AS INTEGER) AS depth FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)",
    "walk AS (SELECT 'c:5' AS id, NULL::VARCHAR AS edge_id, 0 AS d, []::VARCHAR[] AS ord UNION ALL SELECT e.target, e.id, w.d + 1, list_append(w.ord, lpad(coalesce(e.line, 0)::VARCHAR, 9, '0') || '|' || e.id) FROM walk w JOIN edges e ON e.source = w.id AND e.kind IN ('calls', 'imports') WHERE w.d < 10)", True))
def flow_trace(spark: SparkSession, d: str) -> DataFrame:
    return traverse.flow(star_graph(spark, d), "c:5", 10, ("calls", "imports")).select("seq", "id", "edge_id", "depth")


@query("rename_preview", graph_sql("SELECT (SELECT count(*) FROM edges WHERE target = 'p:5') AS refs, (SELECT string_agg(DISTINCT f, ',' ORDER BY f) FROM (SELECT n.file_path AS f FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'p:5' UNION SELECT file_path FROM nodes WHERE id = 'p:5')) AS files, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM nodes WHERE name = '1-URGENT' AND id <> 'p:5'), '') AS conflicts"))
def rename_preview(spark: SparkSession, d: str) -> DataFrame:
    found = traverse.rename_preview(star_graph(spark, d), "p:5", "1-URGENT")
    return found.select(F.col("references").alias("refs"), F.array_join("affected_files", ",").alias("files"), F.array_join("conflicts", ",").alias("conflicts"))


@query("changed_symbols", graph_sql("SELECT c.file_path AS file, c.status, coalesce(string_agg(n.id, ',' ORDER BY n.id), '') AS symbols FROM (VALUES ('modified', '/nation/3/supplier'), ('deleted', '/nation/4/supplier'), ('added', '/nowhere'), ('renamed', '/nation/5/supplier')) c(status, file_path) LEFT JOIN nodes n ON n.file_path = c.file_path AND n.kind <> 'file' GROUP BY ALL"))
def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    from graphmill.plans import tools

    lines = ["M\t/nation/3/supplier", "D\t/nation/4/supplier", "A\t/nowhere", "R100\t/old\t/nation/5/supplier", "T\t/typechange"]
    found = tools.changed_symbols(star_graph(spark, d), parse_name_status(spark.createDataFrame([(x,) for x in lines], "line string")))
    return found.select("file", "status", F.array_join(F.transform("symbols", lambda s: s["id"]), ",").alias("symbols"))


# PageRank


def rank_sql(nodes: str, edges: str, rounds: int, body: str, head: str = "") -> str:
    out = f"WITH {head}v AS MATERIALIZED ({nodes}), l AS MATERIALIZED ({edges}), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), "
    out += "g AS MATERIALIZED (SELECT source, count(*)::DOUBLE AS d FROM l GROUP BY source), k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM v, n), "
    for i in range(1, rounds + 1):
        b = f"k{i - 1}"
        out += (
            f"k{i} AS MATERIALIZED (SELECT v.id, 0.15 / n.n + 0.85 * (coalesce(s.r, 0) + (SELECT coalesce(sum({b}.r), 0) FROM {b} WHERE id NOT IN (SELECT source FROM g)) / n.n) AS r "
            f"FROM n, v LEFT JOIN (SELECT l.target, sum({b}.r / g.d) AS r FROM l JOIN {b} ON {b}.id = l.source JOIN g ON g.source = l.source GROUP BY l.target) s ON s.target = v.id), "
        )
    return out.rstrip(", ") + f" {body.replace('RANKS', f'k{rounds}')}"


STAR_HEAD = GRAPH.strip() + ", "


@query("pagerank_20", rank_sql("SELECT id FROM nodes", "SELECT source, target FROM edges", 20, "SELECT id, round(r * (SELECT n FROM n), 6) AS rank FROM RANKS", STAR_HEAD))
def pagerank_20(spark: SparkSession, d: str) -> DataFrame:
    found = pagerank(star_graph(spark, d), max_iterations=20, tolerance=None)
    total = found.agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(total)).select("id", F.round(F.col("page_rank") * F.col("n"), 6).alias("rank"))


@query("pagerank_top", rank_sql("SELECT id FROM nodes", "SELECT source, target FROM edges", 10, "SELECT id, round(r * (SELECT n FROM n), 6) AS rank FROM RANKS ORDER BY r DESC, id LIMIT 20", STAR_HEAD))
def pagerank_top(spark: SparkSession, d: str) -> DataFrame:
    found = pagerank(star_graph(spark, d), max_iterations=10, tolerance=None)
    total = found.agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("page_rank"), "id").limit(20).crossJoin(F.broadcast(total)).select("id", F.round(F.col("page_rank") * F.col("n"), 6).alias("rank"))


@query("pagerank_sum", "SELECT 1.0::DOUBLE AS total, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS n")
def pagerank_sum(spark: SparkSession, d: str) -> DataFrame:
    return pagerank(star_graph(spark, d)).agg(F.round(F.sum("page_rank"), 6).alias("total"), F.count("*").alias("n"))


@query("page_link_graph", "SELECT DISTINCT url AS source, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS target FROM pages")
def page_link_graph(spark: SparkSession, d: str) -> DataFrame:
    return page_links(table(spark, d, "pages"))


LINKS = "SELECT DISTINCT url AS source, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS target FROM pages"


@query("link_pagerank", rank_sql("SELECT source AS id FROM lk UNION SELECT target FROM lk", "SELECT source, target FROM lk", 10, "SELECT id, round(r * (SELECT n FROM n), 6) AS rank FROM RANKS", f"lk AS MATERIALIZED ({LINKS}), "))
def link_pagerank(spark: SparkSession, d: str) -> DataFrame:
    links = page_links(table(spark, d, "pages"))
    ids = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    blank = lambda df: df.withColumns({"kind": F.lit("file"), "name": F.lit(""), "file_path": F.lit("")})
    edges = links.withColumns({"id": F.concat("source", F.lit("->"), "target"), "kind": F.lit("imports"), "confidence": F.lit(1.0)})
    found = pagerank(PropertyGraph.of(blank(ids), edges), max_iterations=10, tolerance=None)
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("n")))).select("id", F.round(F.col("page_rank") * F.col("n"), 6).alias("rank"))


# Entry points and processes


@query("entry_points", graph_sql(
    """SELECT id, name, CASE
        WHEN regexp_matches(name, '(?i)^(get|post|put|patch|delete|head|options|handle|route)') THEN 'api_route'
        WHEN regexp_matches(name, '^(on[A-Z]|handle[A-Z]|emit|dispatch|listen|subscribe)') THEN 'event_handler'
        WHEN regexp_matches(name, '^(init|setup|teardown|destroy|mount|unmount|ngOnInit|componentDidMount|useEffect|created|beforeCreate)') THEN 'lifecycle'
        WHEN regexp_matches(name, '^(main|run|start|bootstrap|execute)$') THEN 'lifecycle'
        WHEN regexp_matches(name, '(?i)^(cron|schedule|job|task|worker|process)') THEN 'scheduled' END AS entry_kind
    FROM f WHERE entry_kind IS NOT NULL""",
    "f AS (SELECT 'd:' || doc_id || ':' || word AS id, word AS name FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents))"))
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("name"))
    nodes = words.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string"), F.lit(":"), "name").alias("id"), "name", F.lit("function").alias("kind"))
    return proc.entry_points(nodes)


# An order calls parts, which call nothing, so a walk of any strategy is the order and its parts by line, then edge id.
@query("process_chains", graph_sql("SELECT 'process::' || n.id AS id, n.name, n.id AS entry_point, n.id || '>' || string_agg(e.target, '>' ORDER BY e.line, e.id) AS steps, 'custom' AS kind FROM nodes n JOIN edges e ON e.source = n.id AND e.kind = 'calls' WHERE n.name = '1-URGENT' AND n.kind IN ('function', 'method') GROUP BY n.id, n.name"))
def process_chains(spark: SparkSession, d: str) -> DataFrame:
    g = star_graph(spark, d)
    urgent = (proc.EntryPattern("custom", "^1-URGENT$"),)
    return proc.detect_processes(g, urgent).select("id", "name", "entry_point", F.array_join("steps", ">").alias("steps"), "kind")


def step_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """Suppliers as functions that call others by number, in circles and over several levels; every tenth handles requests."""
    s = table(spark, d, "supplier").select((F.col("s_suppkey") - 1).cast("long").alias("k"))
    n = F.broadcast(s.agg(F.count("*").alias("n")))
    name = lambda c: F.concat(F.lit("f:"), c.cast("string"))
    nodes = s.select(name(F.col("k")).alias("id"), F.lit("function").alias("kind"), F.concat(F.when(F.col("k") % 10 == 0, "handle").otherwise("step"), F.col("k").cast("string")).alias("name"))
    calls = s.crossJoin(n).select("k", F.explode(F.array(F.struct(((2 * F.col("k") + 1) % F.col("n")).alias("t"), F.lit(1).alias("line")), F.struct(((3 * F.col("k") + 2) % F.col("n")).alias("t"), F.lit(2).alias("line")), F.struct(((F.col("k") + 5) % F.col("n")).alias("t"), F.lit(3).alias("line")))).alias("e"))
    calls = calls.where("e.line < 3 or k % 7 = 0").select(F.concat_ws("/", name(F.col("k")), F.col("e.line").cast("string")).alias("id"), name(F.col("k")).alias("source"), name(F.col("e.t")).alias("target"), F.lit("calls").alias("kind"), F.col("e.line").alias("line"))
    return PropertyGraph.of(nodes, calls)


# By distance, then by the least path of lines: what a walk by queue meets first, up to 30 steps.
@query("process_levels", """WITH RECURSIVE v AS (SELECT s_suppkey - 1 AS k, count(*) OVER () AS n FROM supplier),
    e AS (SELECT k, (2 * k + 1) % n AS t, 1 AS line FROM v UNION ALL SELECT k, (3 * k + 2) % n, 2 FROM v UNION ALL SELECT k, (k + 5) % n, 3 FROM v WHERE k % 7 = 0),
    w AS (SELECT k AS entry, k AS node, []::INTEGER[] AS path FROM v WHERE k % 10 = 0 UNION ALL SELECT entry, t, list_append(path, line) FROM w JOIN e ON e.k = w.node WHERE len(path) < 11),
    b AS (SELECT entry, node, len(path) AS d, path FROM w QUALIFY row_number() OVER (PARTITION BY entry, node ORDER BY len(path), path) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY d, path) AS i FROM b)
    SELECT 'f:' || entry AS entry_point, 'handle' || entry AS name, string_agg('f:' || node, '>' ORDER BY i) AS steps FROM r WHERE i <= 30 GROUP BY entry""")  # fmt: skip
def process_levels(spark: SparkSession, d: str) -> DataFrame:
    found = proc.detect_processes(step_graph(spark, d), (proc.EntryPattern("custom", "^handle"),), max_steps=30, strategy="bfs")
    return found.select("entry_point", "name", F.array_join("steps", ">").alias("steps"))


# Text


WORDS = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("tokenize", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    words = docs(spark, d).select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("doc_lengths", f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS len FROM documents")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(text.tokens(F.col("text"))).alias("len"))


@query("postings", f"SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tf, min(first)::INTEGER AS first FROM (SELECT term, doc_id, count(*) AS tf, min(pos) - 1 AS first FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents)) GROUP BY ALL) GROUP BY term")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return text.postings(docs(spark, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"), F.min(F.element_at("positions", 1)).alias("first"))


def bm25_sql(counts: list[str], tail: str = "", where: str = "TRUE", table_: str = "documents", id_: str = "doc_id") -> str:
    """counts: SQL of each phrase's frequency in the array w."""
    tf = ", ".join(f"{c} AS t{i}" for i, c in enumerate(counts))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS f{i}" for i in range(len(counts)))
    part = " + ".join(f"(CASE WHEN ln((n - f{i} + 0.5) / (f{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - f{i} + 0.5) / (f{i} + 0.5)) END) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / m))" for i in range(len(counts)))
    live = " AND ".join(f"t{i} > 0" for i in range(len(counts)))
    return (
        f"WITH b AS (SELECT *, {WORDS} AS w FROM {table_}), c AS (SELECT *, len(w) AS l, {tf} FROM b), s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m, {df} FROM c), "
        f"h AS (SELECT {id_} AS id, ({part})::DOUBLE AS score FROM c, s WHERE {live} AND {where}) SELECT id, round(score, 7) AS score FROM h {tail}"
    )


def one(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


#: Text indices that this process has written, by application, table and the state of the table's files.
INDICES: dict[tuple[str, str, str], text.TextIndex] = {}


def index_of(spark: SparkSession, d: str, name: str, id_col: str, text_col: str) -> text.TextIndex:
    """The index of a whole table, written once for all searches of a session, and anew if the table's files change."""
    files = table(spark, d, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    state = files.distinct().select(F.xxhash64("*").cast("decimal(20,0)").alias("h")).agg(F.sum("h").alias("h")).first()
    key = (spark.sparkContext.applicationId, f"{d}/{name}", str(state["h"]))
    if key not in INDICES:
        INDICES[key] = text.TextIndex.write(table(spark, d, name), id_col, [text_col], f"{shared_root(spark)}/text-index-{name}-{uuid.uuid4().hex[:12]}")
    return INDICES[key]


def doc_index(spark: SparkSession, d: str) -> text.TextIndex:
    return index_of(spark, d, "documents", "doc_id", "text")


def bm25_query(asked: str, limit: int | None = None, where: Any = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        among = docs(spark, d).where(where()).select(F.col("doc_id").alias("id")) if where else None
        found = doc_index(spark, d).bm25(text.parse(asked), among)
        return (text.top(found, limit) if limit else found).select("id", seven("score").alias("score"))

    return run


query("bm25_scan", bm25_sql([one("was"), one("that")], "", "lang = 'en'"))(
    lambda spark, d: text.bm25(docs(spark, d), text.parse("was that"), "doc_id", ["text"], F.col("lang") == "en").select("id", seven("score").alias("score"))
)
query("bm25_prefix", bm25_sql(["len(list_filter(w, lambda x: starts_with(x, 'thing')))"]))(bm25_query("thing*"))
query("bm25_and", bm25_sql([one("thing"), one("of")]))(bm25_query("thing AND of"))
query("bm25_phrase", bm25_sql(["len(list_filter(range(1, len(w)), lambda i: w[i] = 'in' AND w[i + 1] = 'the'))", one("an")]))(
    lambda spark, d: doc_index(spark, d).bm25(text.Match((("in", "the"), ("an",)))).select("id", seven("score").alias("score"))
)
query("bm25_top", bm25_sql([one("was"), one("that")], "ORDER BY h.score DESC, id LIMIT 20"))(bm25_query("was that", 20))
query("bm25_filtered", bm25_sql([one("de"), one("la")], "", "lang = 'fr'"))(bm25_query("de la", None, lambda: F.col("lang") == "fr"))
query("search_nodes", bm25_sql([one("was")], "", "TRUE", "(SELECT p_partkey, p_name AS text FROM part)", "p_partkey").replace(one("was"), "len(list_filter(w, lambda x: starts_with(x, 's')))"))(
    lambda spark, d: index_of(spark, d, "part", "p_partkey", "p_name").bm25(text.parse("s")).select("id", seven("score").alias("score"))
)

VECTOR = [1.0 if i % 3 else -0.5 for i in range(64)]
VECTOR_SQL = f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[])"


EDITED = "(SELECT doc_id, CASE WHEN doc_id % 17 = 4 THEN coalesce(text, '') || ' the end of it' ELSE text END AS text FROM documents WHERE doc_id % 23 <> 7)"


# An index of all documents, of which then some change and others go, in several updates with merges between.
@query("bm25_after_updates", bm25_sql([one("the"), one("end")], table_=EDITED))
def bm25_after_updates(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).select("doc_id", "text")
    later = n.where("doc_id % 17 = 4 and doc_id % 23 <> 7").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" the end of it")))
    index = text.TextSegments.start(n, "doc_id", ["text"], f"{shared_root(spark)}/segments-{uuid.uuid4().hex[:12]}")
    for k in range(5):
        part = F.col("doc_id") % 5 == k
        gone = n.where(part & (F.col("doc_id") % 23 == 7)).select(F.col("doc_id").alias("id"))
        index = index.updated(later.where(part), "doc_id", ["text"], gone)
    return index.bm25(text.parse("the end")).select("id", seven("score").alias("score"))


@query("vector_topk", f"SELECT vec_id AS id, round({VECTOR_SQL}, 7) AS score FROM embeddings ORDER BY {VECTOR_SQL} DESC, vec_id LIMIT 25")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return text.vector_top(table(spark, d, "embeddings"), VECTOR, 25, "vec_id").select("id", seven("score").alias("score"))


RRF_SQL = (
    bm25_sql([one("was"), one("that")]).replace("SELECT id, round(score, 7) AS score FROM h ", "")
    + f", a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS p FROM h QUALIFY p <= 50), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {VECTOR_SQL} DESC, vec_id) AS p FROM embeddings QUALIFY p <= 50), "
    "u AS (SELECT id, sum(1.0::DOUBLE / (60 + p)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM v) GROUP BY id) SELECT id, round(score, 7) AS score FROM u ORDER BY u.score DESC, id LIMIT 50"
)


@query("hybrid_search", RRF_SQL)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    words = doc_index(spark, d).bm25(text.parse("was that"))
    vectors = text.vector_top(table(spark, d, "embeddings"), VECTOR, 50, "vec_id")
    return text.rrf([words, vectors], 50).select("id", seven("score").alias("score"))


# Planning and fusion


def fuse_sql(w: tuple[float, float, float, float]) -> str:
    base = bm25_sql([one("was"), one("that")]).replace("SELECT id, round(score, 7) AS score FROM h ", "")
    return base + (
        ", near AS (SELECT item_id AS id, max(p) AS p FROM (SELECT item_id, item_id % 7 + 1 AS p FROM benchmark UNION ALL SELECT item_id, item_id % 5 + 1 FROM benchmark) GROUP BY item_id), "
        "top AS (SELECT greatest(max(abs(score)), 1e-9) AS t FROM h), "
        "j AS (SELECT coalesce(h.id, near.id) AS id, coalesce(h.score / t, 0) AS x, coalesce(1.0::DOUBLE / (60 + near.p), 0) AS y FROM h FULL JOIN near ON near.id = h.id CROSS JOIN top), "
        f"z AS (SELECT j.id, {w[0]}::DOUBLE * x + {w[1]}::DOUBLE * y + {w[2]}::DOUBLE * least(1, 1000 * d.n_chars / 1e7::DOUBLE) + {w[3]}::DOUBLE * CASE WHEN d.source IN ('src0', 'src3') THEN 1 ELSE 0 END AS score FROM j JOIN documents d ON d.doc_id = j.id) "
        "SELECT id, round(score, 7) AS score FROM z ORDER BY z.score DESC, id LIMIT 50"
    )


def fused(weights: planner.Weights) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        words = doc_index(spark, d).bm25(text.parse("was that"))
        items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
        near = items.withColumn("position", F.col("id") % 7 + 1).unionByName(items.withColumn("position", F.col("id") % 5 + 1))
        nodes = docs(spark, d).select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1e7).alias("page_rank"), F.col("source").alias("community_id"))
        asked = spark.createDataFrame([("src0",), ("src3",)], "community_id string")
        return planner.fuse(words, near, nodes, 50, weights, asked).select("id", seven("score").alias("score"))

    return run


query("fused_rank_default", fuse_sql((0.4, 0.3, 0.2, 0.1)))(fused(planner.Weights()))
query("fused_rank_plan", fuse_sql((0.2, 0.5, 0.2, 0.1)))(fused(planner.PLANS["impact"].weights))


@query("fuse_impact", reach_sql("'p:5'", IMPACT_IN, 5, "SELECT f.id, round(0.2::DOUBLE * coalesce(1.0::DOUBLE / (60 + t.p), 0) + 0.5 * ((1.0::DOUBLE / (f.distance + 1)) / (1 + 1.0::DOUBLE / (f.distance + 1))), 7) AS fused_score FROM found f JOIN nodes n ON n.id = f.id LEFT JOIN (SELECT 'c:' || c_custkey AS id, c_custkey AS p FROM customer) t ON t.id = f.id WHERE f.distance > 0"))
def fuse_impact(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("position"))
    return planner.fuse_impact(traverse.impact(star_graph(spark, d), "p:5"), texts).select("id", seven("fused_score").alias("fused_score"))


ASKED = ["what breaks here", "src/app.ts", "where is it", "parser", "one two three four five", "a b", "Blast  radius", "find.", "upstream x"]


@query("classify_query", """SELECT q AS asked, CASE
    WHEN regexp_matches(q, '(?i)\\b(impact|affects?|breaks?|depends?|downstream|upstream|blast\\s*radius)\\b') THEN 'impact'
    WHEN regexp_matches(q, '[./\\\\]') THEN 'structural'
    WHEN regexp_matches(q, '(?i)\\b(what|where|how|why|which|find|show|list|all|the|is|are|does|can)\\b') OR len(regexp_split_to_array(q, '\\s+')) > 4 THEN 'natural_language'
    ELSE 'keyword' END AS class FROM (SELECT unnest(""" + str(ASKED) + ") AS q)")  # fmt: skip
def classify_query(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(q, planner.classify(q)) for q in ASKED], "asked string, class string")


HOME = "SELECT 'c:' || c_custkey AS id, c_nationkey AS community_id FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_nationkey FROM nation"


# The name is one customer's; its nation's first twenty members and all within three steps of it take part.
@query("unified_query", reach_sql("'c:5'", f"{OUT} UNION ALL {IN}", 3, f""", home AS ({HOME}), own AS (SELECT community_id FROM home WHERE id = 'c:5'),
    near AS (SELECT id, max(p) AS p FROM (
        SELECT id, row_number() OVER (ORDER BY id) AS p FROM home WHERE community_id = (SELECT community_id FROM own) QUALIFY p <= 20
        UNION ALL SELECT id, 100 + row_number() OVER (ORDER BY distance, id) FROM found WHERE distance > 0) GROUP BY id),
    j AS (SELECT n.id, n.name, n.kind, 0.4::DOUBLE * CASE WHEN n.id = 'c:5' THEN 1 ELSE 0 END + 0.3::DOUBLE * coalesce(1.0::DOUBLE / (60 + near.p), 0) + 0.1::DOUBLE * CASE WHEN h.community_id = (SELECT community_id FROM own) THEN 1 ELSE 0 END AS score
        FROM nodes n LEFT JOIN near ON near.id = n.id LEFT JOIN home h ON h.id = n.id WHERE near.id IS NOT NULL OR n.id = 'c:5')
    SELECT id, name, kind, round(score, 7) AS score FROM j ORDER BY j.score DESC, id LIMIT 30"""))
def unified_query(spark: SparkSession, d: str) -> DataFrame:
    g, _ = with_nations(star_graph(spark, d), spark, d)
    return planner.query(g, "Customer#000000005", 30, plan=planner.PLANS["impact"]).select("id", "name", "kind", seven("score").alias("score"))


# Extraction and resolution


@query("extract_symbols", "SELECT '/src/' || doc_id || '.py::function::body::0' AS id, 'function' AS kind, 'body' AS name, 1::INTEGER AS start_line, CAST(greatest(len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))), 1) + 2 AS INTEGER) AS end_line, 'def body()' AS signature, TRUE AS exported FROM documents WHERE text IS NOT NULL")
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    symbols, _, _ = parts(extract(pseudo_code(spark, d), backend=partial(extract_file, calls=False)))
    return symbols.select("id", "kind", "name", "start_line", "end_line", "signature", "exported")


# Words that are no callees, spelled out here so that the SQL doesn't depend on the library's own list.
NO_CALLEES = """'if', 'else', 'for', 'while', 'do', 'switch', 'case', 'return', 'catch', 'throw', 'typeof', 'instanceof', 'new', 'delete', 'void', 'await', 'yield', 'in', 'of', 'with', 'finally', 'try',
    'print', 'elif', 'except', 'lambda', 'assert', 'pass', 'raise', 'range', 'select', 'defer', 'go', 'match', 'loop', 'let', 'mut', 'ref', 'move', 'synchronized', 'extends', 'implements'"""


@query("extract_calls", f"SELECT '/src/' || doc_id || '.py' AS file_path, count(*) AS calls FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents) WHERE w NOT IN ({NO_CALLEES}) GROUP BY doc_id")
def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    _, calls, _ = parts(extract(pseudo_code(spark, d)))
    return calls.where("callee_name <> 'body'").groupBy("file_path").agg(F.count("*").alias("calls"))


def pseudo_code(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a module: one function that calls each of the document's distinct words."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    body = F.array_join(F.transform(words, lambda w: F.concat(F.lit("    "), w, F.lit("()"))), "\n")
    return docs(spark, d).select(F.concat(F.lit("/src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def body():\n"), body, F.lit("\n")).alias("content"))


#: A file of each language by document: its suffix, its text with the document's number, and its symbols (kind, name, first
#: and last line) in the clean mode.
SAMPLES = [
    ("ts", "export async function load%s(a) {\n  run(a);\n}\nexport class Box%s {\n}\nexport interface Shape%s {\n}\nexport type Pair%s = string;\n", [("function", "load", 1, 3), ("class", "Box", 4, 5), ("interface", "Shape", 6, 7), ("type_alias", "Pair", 8, 8)]),
    ("js", "function load%s(a) {\n  const s = '}';\n  run(a);\n}\nclass Box%s {\n}\n", [("function", "load", 1, 4), ("class", "Box", 5, 6)]),
    ("py", "def load%s(a):\n    run(a)\n\nclass Box%s:\n    pass\n", [("function", "load", 1, 3), ("class", "Box", 4, 6)]),
    ("go", "package x\nfunc Load%s(a int) {\n\trun(a)\n}\ntype Box%s struct {\n}\n", [("function", "Load", 2, 4), ("type_alias", "Box", 5, 6)]),
    ("rs", "pub fn load%s(a: i32) {\n    run(a);\n}\npub struct Box%s {\n}\npub trait Shape%s {\n}\nenum Kind%s {\n}\n", [("function", "load", 1, 3), ("class", "Box", 4, 5), ("interface", "Shape", 6, 7), ("enum", "Kind", 8, 9)]),
    ("java", "public class Box%s {\n  public void load%s(int a) {\n    run(a);\n  }\n}\ninterface Shape%s {\n}\n", [("class", "Box", 1, 5), ("method", "load", 2, 4), ("interface", "Shape", 6, 7)]),
]
SAMPLE_ROWS = ", ".join(f"({k}, '{suffix}', '{kind}', '{name}', {a}, {b})" for k, (suffix, _, symbols) in enumerate(SAMPLES) for kind, name, a, b in symbols)


@query("extract_languages", f"SELECT '/src/' || doc_id || '.' || suffix AS file_path, kind, name || doc_id AS name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM documents JOIN (VALUES {SAMPLE_ROWS}) s(k, suffix, kind, name, start_line, end_line) ON s.k = doc_id % 6")
def extract_languages(spark: SparkSession, d: str) -> DataFrame:
    key, path, content = F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (suffix, said, _) in enumerate(SAMPLES):
        mine = F.col("doc_id") % 6 == k
        path = F.when(mine, F.concat(F.lit("/src/"), key, F.lit(f".{suffix}"))).otherwise(path)
        content = F.when(mine, F.replace(F.lit(said), F.lit("%s"), key)).otherwise(content)
    symbols, _, _ = parts(extract(docs(spark, d).select(path.alias("path"), content.alias("content")), mode="clean", backend=partial(extract_file, calls=False)))
    return symbols.select("file_path", "kind", "name", "start_line", "end_line")


@query("resolve_calls", """WITH s AS (SELECT p_name AS name, '/part/' || p_brand AS file_path, 'p:' || p_partkey AS id FROM part),
    c AS (SELECT 'o:' || l_orderkey AS caller_id, p.p_name AS callee_name, '/part/' || (SELECT min(p_brand) FROM part) AS file_path, l_linenumber AS line FROM lineitem JOIN part p ON p_partkey = l_partkey),
    r AS (SELECT c.*, coalesce(min(s.id) FILTER (WHERE s.file_path = c.file_path), min(s.id)) AS target, count(DISTINCT s.id) AS k FROM c JOIN s ON s.name = c.callee_name GROUP BY ALL)
    SELECT DISTINCT caller_id || '->calls->' || target || '@' || line AS id, caller_id AS source, target, CASE WHEN k = 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM r WHERE target <> caller_id""")  # fmt: skip
def resolve_calls_query(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    symbols = part.select(F.col("p_name").alias("name"), F.concat(F.lit("/part/"), "p_brand").alias("file_path"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    first = part.agg(F.concat(F.lit("/part/"), F.min("p_brand")).alias("file_path"))
    line = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).crossJoin(F.broadcast(first))
    calls = line.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("caller_id"), F.col("p_name").alias("callee_name"), "file_path", F.col("l_linenumber").alias("line"))
    return resolve_calls(calls, symbols).select("id", "source", "target", "confidence")


def module_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as files that import their region's and their successor's module."""
    n = table(spark, d, "nation")
    files = n.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("/src/n"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".ts").otherwise("/index.ts")).alias("path"))
    own = F.concat(F.lit("/src/n"), F.col("n_nationkey").cast("string"), F.lit(".ts"))
    spec = lambda name: F.array(F.struct(name.alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("is_type")))
    next_ = ((F.col("n_nationkey") + 1) % 25).cast("string")
    near = n.select(own.alias("file_path"), F.concat(F.lit("./n"), next_).alias("module"), F.concat(F.lit("/src/n"), next_).alias("base"), F.lit("relative").alias("form"), spec(F.concat(F.lit("f"), next_)).alias("specifiers"))
    far = n.select(own.alias("file_path"), F.concat(F.lit("pkg"), F.col("n_regionkey").cast("string")).alias("module"), F.lit(None).cast("string").alias("base"), F.lit("package").alias("form"), spec(F.col("n_name")).alias("specifiers"))
    imports = near.unionByName(far).withColumns({"line": F.lit(1), "is_type_only": F.lit(False)})
    symbols = files.select(F.col("path").alias("file_path"), F.concat(F.lit("f"), F.regexp_extract("path", "n([0-9]+)", 1)).alias("name"), F.concat("path", F.lit("::function")).alias("id"))
    return imports, files, symbols


MODULES = """WITH f AS (SELECT n_nationkey AS k, '/src/n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.ts' ELSE '/index.ts' END AS path FROM nation WHERE n_nationkey % 3 <> 0),
    i AS (SELECT '/src/n' || n_nationkey || '.ts' AS file_path, './n' || (n_nationkey + 1) % 25 AS module, coalesce(f.path, '/src/n' || (n_nationkey + 1) % 25) AS resolved_path, f.path, 'f' || (n_nationkey + 1) % 25 AS name FROM nation LEFT JOIN f ON f.k = (n_nationkey + 1) % 25
        UNION ALL SELECT '/src/n' || n_nationkey || '.ts', 'pkg' || n_regionkey, NULL, NULL, n_name FROM nation)"""


@query("module_paths", f"{MODULES} SELECT DISTINCT file_path, module, resolved_path FROM i")
def module_paths_query(spark: SparkSession, d: str) -> DataFrame:
    imports, files, _ = module_tables(spark, d)
    return module_paths(imports, files)


@query("resolve_imports", f"{MODULES} SELECT file_path AS source, CASE WHEN path IS NOT NULL THEN path || '::function' ELSE 'external::' || module || '::' || name END AS target, 'imports' AS kind, CASE WHEN resolved_path IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM i")
def resolve_imports_query(spark: SparkSession, d: str) -> DataFrame:
    return resolve_imports(*module_tables(spark, d)).select("source", "target", "kind", "confidence")


# Incremental work and streams


def two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and what was known of them: every third had another text, every fifth none."""
    n = docs(spark, d)
    path = F.concat(F.lit("/doc/"), F.col("doc_id").cast("string"))
    files = n.select(path.alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id"))
    old = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    nodes = n.where("doc_id % 5 <> 0").select(path.alias("id"), F.lit("file").alias("kind"), path.alias("file_path"), F.sha2(old, 256).alias("content_hash"))
    return files, nodes


@query("file_hash_skip", "SELECT '/doc/' || doc_id AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def file_hash_skip(spark: SparkSession, d: str) -> DataFrame:
    return changed(*two_versions(spark, d)).select("path", "content_hash")


@query("incremental_merge", "SELECT doc_id % 5 = 0 AS added, doc_id % 3 = 0 AS altered, count(*) AS n, count(DISTINCT sha256(text)) AS hashes FROM documents GROUP BY ALL")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    files, nodes = two_versions(spark, d)
    new = changed(files, nodes).select(F.col("path").alias("id"), F.lit("file").alias("kind"), F.lit("").alias("name"), F.col("path").alias("file_path"), "content_hash")
    after = PropertyGraph.of(nodes.withColumn("name", F.lit("")), star_edges(spark, d)).upsert_nodes(new).nodes
    key = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    return after.groupBy((key % 5 == 0).alias("added"), (key % 3 == 0).alias("altered")).agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("hashes"))


def modules_of(n: DataFrame, edited: bool) -> DataFrame:
    """Documents as source files that define a function, call another and import a third; edited: with other calls, and
    lines moved down in every third."""
    key, text_length = F.col("doc_id").cast("string"), F.char_length(F.coalesce("text", F.lit("")))
    called = text_length if edited else text_length + F.col("doc_id") % 3
    moved = F.when(F.col("doc_id") % 3 == 1, "// moved\n").otherwise("") if edited else F.lit("")
    after = F.col("doc_id") + 1
    asked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), (after % 89).cast("string"))).otherwise("none")
    content = F.concat(
        moved, F.lit("import { "), asked, F.lit(" } from './"), after.cast("string"), F.lit("';\nexport function f"), (F.col("doc_id") % 89).cast("string"), F.lit("() {\n  f"), (called % 89).cast("string"), F.lit("();\n}\n"),
    )
    return n.select(F.concat(F.lit("/src/"), key, F.lit(".ts")).alias("path"), content.alias("content"), F.lit("typescript").alias("language"), F.sha2(content, 256).alias("content_hash"))


@query("reindex_edges", """WITH v AS (
        SELECT doc_id, '/src/' || doc_id || '.ts' AS path, 'f' || doc_id % 89 AS own, 'f' || length(coalesce(text, '')) % 89 AS called, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS line,
               '/src/' || (doc_id + 1) || '.ts' AS other, CASE WHEN doc_id % 2 = 0 THEN 'f' || (doc_id + 1) % 89 ELSE 'none' END AS asked
        FROM documents WHERE doc_id % 11 <> 3),
    s AS (SELECT *, path || '::function::' || own || '::' || line AS id FROM v),
    n AS (SELECT own AS name, min(id) AS target, count(*) AS k FROM s GROUP BY own),
    c AS (SELECT s.*, CASE WHEN called = own THEN id ELSE n.target END AS target, k FROM s JOIN n ON n.name = s.called)
    SELECT path || '->contains->' || id AS id, path AS source, id AS target, 'contains' AS kind, 1.0::DOUBLE AS confidence, -1::INTEGER AS line FROM s
    UNION ALL SELECT id || '->calls->' || target || '@' || (line + 2), id, target, 'calls', CASE WHEN k = 1 THEN 1.0 ELSE 0.7 END, line + 2 FROM c WHERE target <> id
    UNION ALL SELECT s.path || '->imports->' || coalesce(t.id, 'external::./' || (s.doc_id + 1) || '::' || s.asked), s.path, coalesce(t.id, 'external::./' || (s.doc_id + 1) || '::' || s.asked), 'imports', 1.0, s.line
        FROM s LEFT JOIN s t ON t.path = s.other AND t.own = s.asked""")  # fmt: skip
def reindex_edges(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d)
    before = index(modules_of(n.where("doc_id % 5 <> 0"), False), "/src", "clean")
    gone = n.where("doc_id % 11 = 3").select(F.concat(F.lit("/src/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"))
    after = reindex(before, modules_of(n.where("doc_id % 11 <> 3"), True), gone, "/src", "clean")
    return after.graph.edges.select("id", "source", "target", "kind", "confidence", F.coalesce("line", F.lit(-1)).alias("line"))


@query("debounce_events", "SELECT user_id, event_type, epoch_us(ts) AS us FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS after FROM events) WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) > 3600000000")
def debounce_events(spark: SparkSession, d: str) -> DataFrame:
    found = debounce(table(spark, d, "events"), 3_600_000, "user_id", "ts", "event_type")
    return found.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


# SQL surface


SQL_NODES = "SELECT kind, count(*) AS n, min(name) AS first FROM nodes GROUP BY kind HAVING count(*) > 5"


@query("sql_tool_select", graph_sql(SQL_NODES))
def sql_tool_select(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(star_graph(spark, d), SQL_NODES)


SQL_WINDOW = "WITH d AS (SELECT source, count(*) AS degree FROM edges WHERE kind = 'calls' GROUP BY source), r AS (SELECT source, degree, rank() OVER (ORDER BY degree DESC) AS place FROM d) SELECT source, degree, place FROM r WHERE place <= 10"


@query("sql_tool_window", graph_sql("SELECT source, degree, CAST(place AS INTEGER) AS place FROM (SELECT source, count(*) AS degree, rank() OVER (ORDER BY count(*) DESC) AS place FROM edges WHERE kind = 'calls' GROUP BY source) WHERE place <= 10"))
def sql_tool_window(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(star_graph(spark, d), SQL_WINDOW, None)


SQL_EXISTS = "SELECT n.id FROM nodes n WHERE n.kind = 'class' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = n.id AND e.kind = 'calls')"


@query("sql_tool_exists", graph_sql(SQL_EXISTS))
def sql_tool_exists(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(star_graph(spark, d), SQL_EXISTS, None)


SQL_SETS = "(SELECT source AS id FROM edges WHERE kind = 'calls' INTERSECT SELECT target FROM edges WHERE kind = 'calls') UNION (SELECT id FROM nodes WHERE kind = 'module' EXCEPT SELECT source FROM edges)"


@query("sql_tool_sets", graph_sql(f"SELECT * FROM ({SQL_SETS})"))
def sql_tool_sets(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(star_graph(spark, d), SQL_SETS, None)


SQL_JOINS = "SELECT a.kind AS k, coalesce(b.kind, '-') AS via, count(*) AS n, count(DISTINCT c.id) AS ends FROM nodes a LEFT JOIN edges b ON b.source = a.id FULL JOIN nodes c ON c.id = b.target GROUP BY a.kind, coalesce(b.kind, '-')"


@query("sql_tool_joins", graph_sql(SQL_JOINS))
def sql_tool_joins(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(star_graph(spark, d), SQL_JOINS, None)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Everything that depends on a supplier, nearest first."""
    return impact_supplier(spark, d)


__all__ = ["ORACLE", "QUERIES", "flagship", "star_nodes"]
