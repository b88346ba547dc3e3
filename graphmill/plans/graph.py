"""PropertyGraph: node and edge tables with lookups, statistics, mutations and versioned snapshots."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill import schema
from graphmill.sources.scratch import FEW, TASK_ROWS, if_few, is_light


def conform(df: DataFrame, into: T.StructType) -> DataFrame:
    """df with exactly the columns and types of `into`; those it lacks are null, others go. Text is read as JSON where an
    array or a map is wanted."""
    have = {f.name: f.dataType for f in df.schema}

    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType | T.MapType) and isinstance(have.get(f.name), T.StringType):
            return F.from_json(f.name, f.dataType).alias(f.name)
        return (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*map(column, into))


def as_json(df: DataFrame) -> DataFrame:
    """df with its arrays and maps as JSON text, as conform reads it."""
    wide = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType)}
    return df.select(*(F.to_json(c).alias(c) if c in wide else F.col(c) for c in df.columns))


def incident(edges: DataFrame, ids: DataFrame, keep: bool = False) -> DataFrame:
    """edges without (or, with keep, only) those that touch an id of ids; one column, id."""
    if keep:
        out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        other = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        return out.unionByName(other).dropDuplicates(["id"]).select(edges.columns)
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(edges.columns)
    return edges


#: A number above all of an operation log; its negative is below them.
LAST = 1 << 62


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_of_each(rows: DataFrame, into: T.StructType) -> DataFrame:
    """rows conformed, of those that share an id the last: by a column seq if there is one, else by the rows' order."""
    order = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
    rows = conform(rows.withColumn("_order", order), T.StructType([*into.fields, T.StructField("_order", T.LongType())]))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*into.names), "_order").alias("row"))
    return conform(last.select("row.*"), into)


@dataclass(frozen=True)
class PropertyGraph:
    """Immutable: every mutation gives a new graph whose tables are planned, not run."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        return cls(conform(nodes, schema.NODES), conform(edges, schema.EDGES))

    # Lookups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("id") == edge_id)

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """The nodes of a column id; ids without a node are dropped, repeated ids repeat their node."""
        return ids.select("id").join(self.nodes, "id")

    def by_kind(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind)

    def by_file(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("file_path") == path)

    def by_path_prefix(self, prefix: str, compat: bool = True) -> DataFrame:
        """compat: as SQL LIKE, without regard to ASCII case and with % and _ live; else a plain prefix."""
        path = F.col("file_path")
        return self.nodes.where(path.ilike(f"{prefix}%") if compat else path.startswith(prefix))

    def find(self, name: str, kind: str | None = None) -> DataFrame:
        """Nodes of exactly this name, in the order of their ids."""
        found = self.nodes.where(F.col("name") == name)
        return (found.where(F.col("kind") == kind) if kind else found).orderBy("id")

    def edges_from(self, node_id: str, kind: str | None = None) -> DataFrame:
        found = self.edges.where(F.col("source") == node_id)
        return found.where(F.col("kind") == kind) if kind else found

    def edges_to(self, node_id: str, kind: str | None = None) -> DataFrame:
        found = self.edges.where(F.col("target") == node_id)
        return found.where(F.col("kind") == kind) if kind else found

    # Statistics

    def counts(self) -> DataFrame:
        """One row: nodes, edges, files and languages."""
        n = self.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.countDistinct("language").alias("languages"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("edges")))

    def by_kinds(self, of: str = "nodes") -> DataFrame:
        return getattr(self, of).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")

    def files_by_language(self) -> DataFrame:
        return self.by_kind("file").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")

    def unused(self, *kinds: str) -> DataFrame:
        """Nodes that no edge of these kinds, or of any, points to."""
        edges = self.edges.where(F.col("kind").isin(*kinds)) if kinds else self.edges
        return self.nodes.join(edges.select(F.col("target").alias("id")), "id", "left_anti")

    # Mutations

    def upsert_nodes(self, new: DataFrame, cascade_edges: bool = False) -> PropertyGraph:
        """Whole rows are replaced; of new rows with the same id the last counts, see last_of_each. cascade_edges also
        drops all edges of nodes that were there before."""
        new = last_of_each(new, schema.NODES)
        keys = new.select("id")
        edges = self.edges
        if cascade_edges:
            edges = incident(edges, self.nodes.select("id").join(keys, "id", "left_semi"))
        return PropertyGraph(self.nodes.join(keys, "id", "left_anti").unionByName(new), edges)

    def upsert_edges(self, new: DataFrame) -> PropertyGraph:
        new = last_of_each(new, schema.EDGES)
        return PropertyGraph(self.nodes, self.edges.join(new.select("id"), "id", "left_anti").unionByName(new))

    def delete_nodes(self, ids: DataFrame) -> PropertyGraph:
        """ids: a column id. Their edges go, too."""
        ids = ids.select("id")
        return PropertyGraph(self.nodes.join(ids, "id", "left_anti"), incident(self.edges, ids))

    def delete_file(self, path: str | DataFrame) -> PropertyGraph:
        """All nodes of a file, or of a column of file_path, with their edges."""
        if isinstance(path, str):
            return self.delete_nodes(self.by_file(path))
        return self.delete_nodes(self.nodes.join(path.select("file_path"), "file_path", "left_semi"))

    def delete_edges(self, ids: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.join(ids.select("id"), "id", "left_anti"))

    def delete_edges_from(self, source: str, kind: str | None = None) -> PropertyGraph:
        gone: Column = F.col("source") == source
        return PropertyGraph(self.nodes, self.edges.where(~(gone & (F.col("kind") == kind) if kind else gone)))

    def mutate(self, log: DataFrame) -> PropertyGraph:
        """Applies an operation log, see schema.MUTATIONS, as if one by one in the order of seq.

        What a row of the log or of the graph becomes depends only on the last upsert of its id and on deletions that
        come after, so the log is folded by key. An edge goes with a deletion of either end, of its file's nodes, or of
        its source's edges, unless it is upserted again later. Only the log's rows are put in order: the graph's are older
        than all of them and stay unless the log touches them. What touches them is counted here: a little of it is
        broadcast, much is shuffled and hashed, so that the graph is never sorted.
        """
        rows = log.limit(FEW + 1).count()
        few = lambda t: if_few(t, rows)
        put_nodes, put_edges = log.where("op = 'upsert_node'").select("node.*", "seq"), log.where("op = 'upsert_edge'").select("edge.*", "seq")
        gone = log.where("op = 'delete_node'").select(F.col("key").alias("id"), F.col("seq").alias("at"))
        files = few(log.where("op = 'delete_file_nodes'").select(F.col("key").alias("file_path"), F.col("seq").alias("at")))
        # A file's deletion hits the nodes that are in it at that moment: versions that it ends, and nothing before it.
        until = F.coalesce(F.lead("seq").over(Window.partitionBy("id").orderBy("seq")), F.lit(LAST))
        hits = put_nodes.select("id", "file_path", "seq", until.alias("until")).join(files, "file_path").where("at > seq and at < until").select("id", "seq", "at")
        first = put_nodes.groupBy("id").agg(F.min("seq").alias("until"))
        old = self.nodes.select("id", "file_path").join(files, "file_path").join(few(first), "id", "left").where(F.col("until").isNull() | (F.col("at") < F.col("until")))
        by_file = hits.unionByName(old.select("id", F.lit(-LAST).alias("seq"), "at")).groupBy("id", "seq").agg(F.min("at").alias("at"))
        sooner = by_file.join(few(gone.withColumnRenamed("at", "other")), "id").where("other > seq and other < at").select("id", "seq")
        by_file = by_file.join(sooner, ["id", "seq"], "left_anti")
        gone = gone.unionByName(by_file.select("id", "at")).groupBy("id").agg(F.max("at").alias("at"))
        light = rows <= FEW and is_light(gone, "id")
        near = lambda t: F.broadcast(t) if light else t.hint("shuffle_hash")
        of = lambda **names: near(gone.select(*(F.col(c).alias(n) for n, c in names.items())))

        kept = self.nodes.join(near(gone.select("id").unionByName(first.select("id"))), "id", "left_anti")
        put = latest(put_nodes).join(near(gone), "id", "left").where(F.col("at").isNull() | (F.col("at") < F.col("seq")))
        nodes = kept.unionByName(conform(put, schema.NODES))

        single = log.where("op = 'delete_edge'").groupBy(F.col("key").alias("id")).agg(F.max("seq").alias("e"))
        cut = log.where("op = 'delete_edges_from'")
        cut_all = few(cut.where("edge_kind is null").groupBy(F.col("key").alias("source")).agg(F.max("seq").alias("f")))
        cut_kind = few(cut.where("edge_kind is not null").groupBy(F.col("key").alias("source"), F.col("edge_kind").alias("kind")).agg(F.max("seq").alias("k")))
        kept = self.edges.join(few(single.select("id").unionByName(put_edges.select("id"))), "id", "left_anti").join(cut_all, "source", "left_anti").join(cut_kind, ["source", "kind"], "left_anti")
        kept = kept.join(of(source="id"), "source", "left_anti").join(of(target="id"), "target", "left_anti").select(self.edges.columns)
        put = latest(put_edges).join(of(source="id", s="at"), "source", "left").join(of(target="id", t="at"), "target", "left")
        put = put.join(few(single), "id", "left").join(cut_all, "source", "left").join(cut_kind, ["source", "kind"], "left")
        last = F.greatest(*(F.coalesce(c, F.lit(-LAST)) for c in "stefk"))
        return PropertyGraph(nodes, kept.unionByName(conform(put.where(last < F.col("seq")), schema.EDGES)))

    def with_columns_of(self, values: DataFrame) -> PropertyGraph:
        """Node columns page_rank or community_id replaced by those of values (id, ...); null where it has no row."""
        names = [c for c in values.columns if c != "id"]
        return PropertyGraph(conform(self.nodes.drop(*names).join(values, "id", "left"), schema.NODES), self.edges)


def upsert_rows(old: DataFrame, new: DataFrame, into: T.StructType) -> DataFrame:
    """A table of communities or processes with new rows in place of those with their ids."""
    new = last_of_each(new, into)
    return conform(old, into).join(new.select("id"), "id", "left_anti").unionByName(new)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("seq long, snapshot string, version int").json(f"{root}/current")


def current(spark: SparkSession, root: str) -> Any:
    """The pointer that was written last, by number; None if there is none."""
    try:
        return pointers(spark, root).orderBy(F.desc("seq"), F.desc("snapshot")).first()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


class ConcurrentWrite(RuntimeError):
    """Another writer has made a snapshot after the one that this one is derived from."""


def point(spark: SparkSession, root: str, seq: int, name: str) -> None:
    """Makes a snapshot the one of number seq; raises ConcurrentWrite if there is one. The pointer is a file that only one
    writer can create; a store must grant that of creating without overwriting."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/current/{seq:012d}.json")
    line = json.dumps({"seq": seq, "snapshot": name, "version": schema.VERSION}) + "\n"
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        os.makedirs(os.path.dirname(local := path.toUri().getPath()), exist_ok=True)
        try:
            with open(local, "x") as out:
                out.write(line)
        except FileExistsError as taken:
            raise ConcurrentWrite(f"snapshot {seq} of {root} exists") from taken
        return
    try:
        out = fs.create(path, False)
    except Py4JJavaError as taken:
        if "AlreadyExists" not in str(taken.java_exception):
            raise
        raise ConcurrentWrite(f"snapshot {seq} of {root} exists") from taken
    out.write(line.encode())
    out.close()


#: A snapshot's tables that lookups read: label to its table, columns and the column that it is clustered by.
CLUSTERED = {
    "nodes": ("nodes", None, "id"),
    "edges": ("edges", None, "source"),
    "edges_by_target": ("edges", None, "target"),
    "nodes_by_name": ("nodes", ("name", "kind", "id"), "name"),
    "nodes_by_file": ("nodes", ("file_path", "id"), "file_path"),
}


def cluster(graph: PropertyGraph, at: str) -> None:
    """Writes CLUSTERED below `at`: dealt by ranges of the key and sorted, so that a key is in one file or a few; and ranges
    (label, file, low, high), the keys that each file holds. Edges lie by kind besides. The graph is computed once, into plain
    files that go again: to find ranges reads all rows, and to deal them reads them once more."""
    spark, ranges = graph.nodes.sparkSession, []
    plain, parts = {}, {}
    for table in ("nodes", "edges"):
        df = getattr(graph, table)
        df.write.parquet(f"{at}/plain/{table}")
        plain[table] = spark.read.schema(df.schema).parquet(f"{at}/plain/{table}")
        n = -(-plain[table].count() // TASK_ROWS)
        parts[table] = (n,) if n > spark.sparkContext.defaultParallelism else ()
    for label, (table, columns, key) in CLUSTERED.items():
        df = plain[table]
        df = df.select(*columns) if columns else df
        first = ("kind", key) if label == "edges" else (key,)
        out = df.repartitionByRange(*parts[table], *first).sortWithinPartitions(*first).write.option("compression", "zstd")
        (out.partitionBy("kind") if label == "edges" else out).parquet(f"{at}/{label}")
        held = spark.read.schema(df.schema).parquet(f"{at}/{label}").where(F.col(key).isNotNull())
        ranges.append(held.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high")).select(F.lit(label).alias("label"), "file", "low", "high"))
    every = ranges[0]
    for more in ranges[1:]:
        every = every.unionByName(more)
    every.write.parquet(f"{at}/ranges")
    delete(spark, f"{at}/plain")


@dataclass(frozen=True)
class StoredGraph(PropertyGraph):
    """A stored snapshot. Lookups by id, name, file, source and target read only files whose range of keys has the key;
    mutations give plain graphs."""

    at: str
    ranges: DataFrame

    def rows(self, label: str, *keys: str) -> DataFrame:
        """The rows of a clustered table with one of these keys."""
        table, columns, key = CLUSTERED[label]
        wanted = None
        for k in keys:
            one = (F.col("low") <= k) & (F.col("high") >= k)
            wanted = one if wanted is None else wanted | one
        files = [] if wanted is None else [r["file"] for r in self.ranges.where((F.col("label") == label) & wanted).select("file").collect()]
        into = schema.NODES if table == "nodes" else schema.EDGES
        kind = T.StructType([into[c] for c in columns]) if columns else into
        spark = self.nodes.sparkSession
        if not files:
            return spark.createDataFrame([], kind)
        return spark.read.option("basePath", f"{self.at}/{label}").schema(kind).parquet(*files).select(kind.names).where(F.col(key).isin(*keys))

    def node(self, node_id: str) -> DataFrame:
        return self.rows("nodes", node_id)

    def by_file(self, path: str) -> DataFrame:
        return self.of_ids(self.rows("nodes_by_file", path)).where(F.col("file_path") == path)

    def find(self, name: str, kind: str | None = None) -> DataFrame:
        found = self.rows("nodes_by_name", name)
        return self.of_ids(found.where(F.col("kind") == kind) if kind else found).orderBy("id")

    def of_ids(self, found: DataFrame) -> DataFrame:
        """The nodes of a column id: looked up if they are few, else joined."""
        some = [r["id"] for r in found.select("id").limit(FEW_IDS + 1).collect()]
        return self.rows("nodes", *some) if len(some) <= FEW_IDS else self.nodes.join(found.select("id"), "id", "left_semi").select(self.nodes.columns)

    def edges_from(self, node_id: str, kind: str | None = None) -> DataFrame:
        found = self.rows("edges", node_id)
        return found.where(F.col("kind") == kind) if kind else found

    def edges_to(self, node_id: str, kind: str | None = None) -> DataFrame:
        found = self.rows("edges_by_target", node_id)
        return found.where(F.col("kind") == kind) if kind else found


#: Nodes that are looked up one by one.
FEW_IDS = 100


def save(graph: PropertyGraph, root: str, tables: dict[str, DataFrame] | None = None, keep: int = 3, after: int | None = None) -> str:
    """Writes a snapshot below root, then makes it the one of the next number; readers see the old or the new one, never a
    mix. after: the number of the snapshot that graph is derived from; if another has come since, ConcurrentWrite is raised
    and nothing stays. tables are written along. The last `keep` snapshots stay, for readers that have begun."""
    spark, name = graph.nodes.sparkSession, uuid.uuid4().hex[:12]
    cluster(graph, f"{root}/{name}")
    for label, df in (tables or {}).items():
        df.write.option("compression", "zstd").parquet(f"{root}/{name}/{label}")
    while True:
        seq = number(spark, root) + 1 if after is None else after + 1
        try:
            point(spark, root, seq, name)
            break
        except ConcurrentWrite:
            if after is not None:
                delete(spark, f"{root}/{name}")
                raise
    delete_old(spark, root, keep)
    return f"{root}/{name}"


def number(spark: SparkSession, root: str) -> int:
    """That of the current snapshot; -1 if there is none."""
    last = current(spark, root)
    return last["seq"] if last else -1


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def delete_old(spark: SparkSession, root: str, keep: int) -> None:
    """Deletes all snapshots but the last `keep`, and their pointers."""
    rows = pointers(spark, root).select("seq", "snapshot", F.col("_metadata.file_path").alias("file")).orderBy(F.desc("seq"), F.desc("snapshot")).offset(keep).collect()
    for row in rows:
        delete(spark, f"{root}/{row['snapshot']}")
        delete(spark, row["file"])


#: How to bring a snapshot's tables from a version to the next: label to its change.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {}


def tables_of(spark: SparkSession, root: str, *more: str) -> dict[str, DataFrame]:
    """The current snapshot's nodes and edges and, where it has them, tables of the labels `more`, brought up to this
    version by MIGRATIONS."""
    row = current(spark, root)
    if row is None:
        raise FileNotFoundError(f"no snapshot below {root}")
    steps = range(row["version"], schema.VERSION)
    if row["version"] > schema.VERSION or any(v not in MIGRATIONS for v in steps):
        raise ValueError(f"snapshot of version {row['version']}; this code reads {schema.VERSION}")
    at, known = f"{root}/{row['snapshot']}", {"nodes": schema.NODES, "edges": schema.EDGES, "communities": schema.COMMUNITIES, "processes": schema.PROCESSES}
    out: dict[str, DataFrame] = {}
    for label in ("nodes", "edges", *more):
        try:
            reader = spark.read.schema(known[label]) if label in known and not steps else spark.read
            out[label] = reader.parquet(f"{at}/{label}")
        except AnalysisException as missing:
            if label in ("nodes", "edges") or "PATH_NOT_FOUND" not in str(missing):
                raise
    for v in steps:
        out = MIGRATIONS[v](out)
    return out


def load(spark: SparkSession, root: str) -> PropertyGraph:
    """The snapshot that was pointed at last; a StoredGraph if it was written with ranges of keys and by this version."""
    row, found = current(spark, root), tables_of(spark, root, "ranges")
    graph = PropertyGraph.of(found["nodes"], found["edges"])
    if row["version"] == schema.VERSION and "ranges" in found:
        return StoredGraph(graph.nodes, graph.edges, f"{root}/{row['snapshot']}", found["ranges"])
    return graph


class Transaction:
    """Mutations of a store's graph that become visible together, by one snapshot when the block ends; an error in it
    leaves the store as it was. Inside, reads see what the block has done.

        with Transaction(spark, root) as tx:
            tx.upsert_nodes(rows)
            tx.delete_file("/src/a.ts")

    Writers don't lock each other. If another has made a snapshot meanwhile, the block's mutations are made once more on
    that one, so of two that overlap both take effect, one after the other; after ATTEMPTS such losses ConcurrentWrite is
    raised. What a mutation was given from reads inside the block stays as it was read.
    """

    MUTATIONS = ("upsert_nodes", "upsert_edges", "delete_nodes", "delete_file", "delete_edges", "delete_edges_from", "mutate", "with_columns_of")
    ATTEMPTS = 5

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.done: list[tuple[str, tuple, dict[str, Any]]] = []
        self.open()

    def open(self) -> None:
        self.seq = number(self.spark, self.root)
        self.found = tables_of(self.spark, self.root, *KEPT)
        self.graph = PropertyGraph.of(self.found["nodes"], self.found["edges"])

    def __enter__(self) -> Transaction:
        return self

    def __getattr__(self, name: str) -> Any:
        own = getattr(self.graph, name)
        if name not in self.MUTATIONS:
            return own

        def act(*args: Any, **named: Any) -> None:
            self.graph = getattr(self.graph, name)(*args, **named)
            self.done.append((name, args, named))

        return act

    def __exit__(self, kind: type | None, *_: Any) -> None:
        if kind is not None:
            return
        for attempt in range(self.ATTEMPTS):
            try:
                save(self.graph, self.root, {k: v for k, v in self.found.items() if k not in ("nodes", "edges")}, after=self.seq)
                return
            except ConcurrentWrite:
                if attempt == self.ATTEMPTS - 1:
                    raise
                self.open()
                for name, args, named in self.done:
                    self.graph = getattr(self.graph, name)(*args, **named)


#: Tables of a snapshot that a transaction carries on.
KEPT = ("communities", "processes", "source_files", "source_symbols", "source_calls", "source_imports")
