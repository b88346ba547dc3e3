"""Level-synchronous traversal: one frontier engine for neighbours, impact, paths, context, flow and renames."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.plans.graph import PropertyGraph
from graphmill.sources.scratch import if_small, materialize

#: Edge kinds that carry an impact, and the depths that operators allow.
IMPACT_KINDS = ("calls", "imports", "uses", "extends", "implements")
NEIGHBOR_DEPTH, FLOW_DEPTH = 10, 50


def adjacency(edges: DataFrame, direction: str, kinds: Iterable[str] | None = None) -> DataFrame:
    """(at, next, edge_id, kind, line) to follow in a direction: out, in or both. Kinds hold for both ways."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    ways = {"out": [("source", "target")], "in": [("target", "source")], "both": [("source", "target"), ("target", "source")]}[direction]
    out = None
    for at, to in ways:
        part = edges.select(F.col(at).alias("at"), F.col(to).alias("next"), F.col("id").alias("edge_id"), "kind", "line")
        out = part if out is None else out.unionByName(part)
    return out  # type: ignore[return-value]


def expand(edges: DataFrame, seeds: DataFrame, direction: str = "out", kinds: Iterable[str] | None = None, depth: int = 1, paths: bool = False, until: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """(id, distance) of everything within `depth` steps of seeds (id), at its least distance; with paths also path,
    the edge ids of the least such path in the order of arrays.

    A level is one join of the frontier with the edges, an aggregate and an anti-join with what was seen, written to
    the shared folder; frontiers are broadcast while their counted size allows. until stops at the level that has this
    id. within keeps the walk to ids of that table.
    """
    # Every level reads the edges again; they are kept for as long as this runs, and recomputed if an executor is lost.
    steps = adjacency(edges, direction, kinds).select("at", "next", *(["edge_id"] if paths else []))
    steps = steps.persist(StorageLevel.MEMORY_AND_DISK) if depth > 1 else steps
    level = seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), *([F.array().cast("array<string>").alias("path")] if paths else []))
    level = materialize(level, "level")
    seen, size = level, level.count()
    for distance in range(1, depth + 1):
        if not size or (until is not None and not level.where(F.col("id") == until).isEmpty()):
            break
        frontier = if_small(level.withColumnRenamed("id", "at"), size, 64 + 64 * distance * paths)
        reached = steps.join(frontier, "at").select(F.col("next").alias("id"), *([F.concat("path", F.array("edge_id")).alias("path")] if paths else []))
        reached = reached.groupBy("id").agg(F.min("path").alias("path")) if paths else reached.distinct()
        if within is not None:
            reached = reached.join(within.select("id"), "id", "left_semi")
        level = reached.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(distance)).select(level.columns)
        level = materialize(level, "level")
        size = level.count()
        seen = seen.unionByName(level)
    if depth > 1:
        steps.unpersist()
    return seen


def _ids(graph: PropertyGraph, *ids: str) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def neighbors(graph: PropertyGraph, node_id: str, direction: str = "both", kinds: Iterable[str] | None = None, depth: int = 1) -> DataFrame:
    """The distinct nodes within depth (10 at most), the start excluded, with their distance."""
    found = expand(graph.edges, _ids(graph, node_id), direction, kinds, min(depth, NEIGHBOR_DEPTH))
    return found.where("distance > 0").join(graph.nodes, "id")


def impact(graph: PropertyGraph, node_id: str | DataFrame, max_depth: int = 5, kinds: Iterable[str] = IMPACT_KINDS, paths: bool = False) -> DataFrame:
    """Who depends on a node, or on any node of a column id: reverse steps, nearest first.

    impact_score = 1 / (distance + 1) + 10 page_rank. Ids without a node are walked through but not reported.
    """
    seeds = _ids(graph, node_id) if isinstance(node_id, str) else node_id
    found = expand(graph.edges, seeds, "in", kinds, max_depth, paths).where("distance > 0").join(graph.nodes, "id")
    score = 1 / (F.col("distance") + 1) + 10 * F.coalesce("page_rank", F.lit(0.0))
    return found.withColumn("impact_score", score).orderBy(F.desc("impact_score"), "distance", "id")


def impact_by_distance(found: DataFrame) -> DataFrame:
    return found.groupBy("distance").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files")).orderBy("distance")


def change_impact(graph: PropertyGraph, changed_files: DataFrame, depth: int = 3) -> DataFrame:
    """(file_path) that changes of files (file_path) reach: one walk from all nodes of those files but the file nodes."""
    nodes = graph.nodes.join(changed_files.select("file_path"), "file_path", "left_semi").where("kind <> 'file'")
    return impact(graph, nodes, depth).select("file_path").distinct()


def find_path(graph: PropertyGraph, start: str, end: str, max_depth: int = 10, kinds: Iterable[str] | None = None) -> DataFrame:
    """(step, id, edge_id) of a shortest directed path, none if there is none; of several the least in edge ids.

    Frontiers grow from both ends, always the smaller one, until they meet, so each goes about half as deep. Then the nodes
    before the meeting that lead to it are marked, level by level; after it every node of a level leads to the end. A walk
    from the start takes the least edge into each next level, which gives the least path. Levels hold ids alone.
    """
    spark = graph.nodes.sparkSession
    steps = adjacency(graph.edges, "out", kinds).select("at", "next", "edge_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        levels = _corridor(steps, spark, start, end, max_depth)
        rows = [(0, start, None)] if levels is not None else []
        for k, (level, n) in enumerate(levels or [], 1):
            into = if_small(level.withColumnRenamed("id", "next"), n)
            best = steps.where(F.col("at") == rows[-1][1]).join(into, "next", "left_semi").agg(F.min(F.struct("edge_id", "next")).alias("x")).first()["x"]
            rows.append((k, best["next"], best["edge_id"]))
    finally:
        steps.unpersist()
    return spark.createDataFrame(rows, "step int, id string, edge_id string")


def _corridor(steps: DataFrame, spark: SparkSession, start: str, end: str, most: int) -> list[tuple[DataFrame, int]] | None:
    """The levels that shortest paths pass, after the start's own, with their sizes; None if there is no path of `most` steps."""
    if start == end:
        return []
    ways = {False: ("at", "next"), True: ("next", "at")}
    sides = {}
    for back, node in ((False, start), (True, end)):
        first = materialize(spark.createDataFrame([(node,)], "id string"), "level")
        sides[back] = ([(first, 1)], first)
    while True:
        back = sides[True][0][-1][1] < sides[False][0][-1][1]
        (levels, seen), (others, known) = sides[back], sides[not back]
        if not levels[-1][1] or len(levels) + len(others) - 2 >= most:
            return None
        near, far = ways[back]
        level, n = levels[-1]
        reached = steps.join(if_small(level.withColumnRenamed("id", near), n), near).select(F.col(far).alias("id")).distinct()
        grown = materialize(reached.join(seen, "id", "left_anti"), "level")
        levels.append((grown, grown.count()))
        sides[back] = (levels, seen.unionByName(grown))
        # Both sides hold all nodes of their levels, so they can only meet in the last level of each.
        met = materialize(grown.join(others[-1][0], "id", "left_semi"), "met")
        if n := met.count():
            break
    ahead, behind = sides[False][0], sides[True][0]
    marked = [(met, n)]
    for level, _ in ahead[-2:0:-1]:
        later, m = marked[-1]
        leads = steps.join(if_small(later.withColumnRenamed("id", "next"), m), "next").select(F.col("at").alias("id"))
        before = materialize(level.join(leads, "id", "left_semi"), "marked")
        marked.append((before, before.count()))
    return marked[::-1] + behind[-2::-1]


def context(graph: PropertyGraph, node_id: str, processes: DataFrame | None = None, siblings: int = 20) -> DataFrame:
    """(relation, id, name, kind, file_path): callers, callees, imports, importers, at most `siblings` others of the
    node's community and the first process that has it. A node that several edges reach is listed for each."""
    nodes = graph.nodes.select("id", "name", "kind", "file_path")
    ways = [("callers", "target", "source", "calls"), ("callees", "source", "target", "calls"), ("imports", "source", "target", "imports"), ("imported_by", "target", "source", "imports")]
    out = None
    for relation, at, to, kind in ways:
        part = graph.edges.where((F.col(at) == node_id) & (F.col("kind") == kind)).select(F.col(to).alias("id")).join(nodes, "id")
        part = part.select(F.lit(relation).alias("relation"), *nodes.columns)
        out = part if out is None else out.unionByName(part)
    own = graph.node(node_id).select("community_id").where("community_id is not null")
    near = graph.nodes.where(F.col("id") != node_id).join(F.broadcast(own), "community_id").select(nodes.columns).orderBy("id").limit(siblings)
    out = out.unionByName(near.select(F.lit("community_siblings").alias("relation"), *nodes.columns))  # type: ignore[union-attr]
    if processes is not None:
        held = processes.where(F.array_contains("steps", node_id)).orderBy("id").limit(1)
        out = out.unionByName(held.select(F.lit("process").alias("relation"), "id", "name", "kind", F.lit(None).cast("string").alias("file_path")))
    return out


def preorder(start: str, children: dict[str, list[tuple[str, str]]], depth: int, exists: set[str]) -> list[tuple[str, str | None, int]]:
    """(id, edge, depth): each node once, children in their given order, nodes that don't exist dropped unexpanded."""
    out: list[tuple[str, str | None, int]] = []
    seen: set[str] = set()
    stack: list[tuple[str, str | None, int]] = [(start, None, 0)]
    while stack:
        node, edge, level = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        if node not in exists:
            continue
        out.append((node, edge, level))
        if level < depth:
            stack += [(to, by, level + 1) for to, by in reversed(children.get(node, [])) if to not in seen]
    return out


def flow(graph: PropertyGraph, node_id: str, max_depth: int = 10, kinds: Iterable[str] = ("calls",)) -> DataFrame:
    """(seq, id, edge_id, depth): the calls below a node in depth-first order, by line, then edge id.

    The reachable part is found by joins; only its edges go to the one task that orders them, as the order of a
    depth-first walk depends on everything visited before.
    """
    depth = min(max_depth, FLOW_DEPTH)
    reached = expand(graph.edges, _ids(graph, node_id), "out", kinds, depth)
    known = graph.nodes.select("id").join(reached, "id", "left_semi")
    steps = adjacency(graph.edges, "out", kinds).join(reached.select(F.col("id").alias("at")), "at", "left_semi")
    rows = steps.select(F.col("at"), F.col("next"), "edge_id", F.coalesce("line", F.lit(0)).alias("line")).unionByName(known.select(F.col("id").alias("at"), F.lit(None).cast("string").alias("next"), F.lit(None).cast("string").alias("edge_id"), F.lit(-1).alias("line")))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        exists = set(pdf.loc[pdf.line == -1, "at"])
        children: dict[str, list[tuple[str, str]]] = {}
        for at, to, edge in pdf[pdf.line != -1].sort_values(["line", "edge_id"], kind="stable")[["at", "next", "edge_id"]].itertuples(index=False):
            children.setdefault(at, []).append((to, edge))
        found = preorder(node_id, children, depth, exists)
        return pd.DataFrame([(i, *x) for i, x in enumerate(found)], columns=["seq", "id", "edge_id", "depth"])

    return rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(order, "seq int, id string, edge_id string, depth int").orderBy("seq")


def flow_lines(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The flow as indented lines."""
    named = found.join(nodes.select("id", "name", "kind", "file_path", "start_line"), "id")
    indent = F.when(F.col("depth") > 0, F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("→ "))).otherwise("")
    return named.withColumn("text", F.concat(indent, "name", F.lit(" ("), "kind", F.lit(")"))).orderBy("seq")


def rename_parts(graph: PropertyGraph, node_id: str, new_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a rename of the node touches, as tables of any length: the edges that refer to it (id), the files (file_path),
    and other nodes named new_name (id)."""
    own = graph.node(node_id).select("file_path")
    refs = graph.edges.where(F.col("target") == node_id).join(graph.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path")), "source")
    clash = graph.nodes.where((F.col("name") == new_name) & (F.col("id") != node_id)).select("id")
    return refs.select("id"), refs.select(F.col("path").alias("file_path")).unionByName(own).where("file_path is not null").distinct(), clash


def rename_preview(graph: PropertyGraph, node_id: str, new_name: str) -> DataFrame:
    """One row: how many edges refer to the node, the files that a rename touches, and other nodes named new_name. For a node
    with more of them than a row should hold see rename_parts."""
    refs, files, clash = rename_parts(graph, node_id, new_name)
    row = refs.agg(F.count("*").alias("references")).crossJoin(files.agg(F.array_sort(F.collect_set("file_path")).alias("affected_files")))
    return row.crossJoin(clash.agg(F.array_sort(F.collect_list("id")).alias("conflicts")))


def first_process(processes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, process_id): the process with the least id that has a node among its steps."""
    steps = processes.select(F.col("id").alias("process_id"), F.explode("steps").alias("id"))
    return nodes.select("id").join(steps, "id").groupBy("id").agg(F.min("process_id").alias("process_id"))


def top_per_community(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """(community_id, rank, id): the first members of each community by id."""
    w = Window.partitionBy("community_id").orderBy("id")
    return nodes.where("community_id is not null").select("community_id", F.row_number().over(w).alias("rank"), "id").where(F.col("rank") <= limit)
