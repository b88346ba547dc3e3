"""The star-schema tables as a property graph: regions contain nations, customers call orders, orders call parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.plans.graph import PropertyGraph
from graphmill.sources.scratch import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, file_path)."""
    parts = [
        ("region", "r:", "r_regionkey", "module", "r_name", F.lit("/region")),
        ("nation", "n:", "n_nationkey", "file", "n_name", _key("/region/", "n_regionkey")),
        ("customer", "c:", "c_custkey", "class", "c_name", F.concat(_key("/nation/", "c_nationkey"), F.lit("/customer"))),
        ("supplier", "s:", "s_suppkey", "interface", "s_name", F.concat(_key("/nation/", "s_nationkey"), F.lit("/supplier"))),
        ("orders", "o:", "o_orderkey", "function", "o_orderpriority", _key("/order/", "o_orderstatus")),
        ("part", "p:", "p_partkey", "constant", "p_name", _key("/part/", "p_brand")),
    ]
    out = None
    for name, prefix, key, kind, label, path in parts:
        rows = table(spark, sf_dir, name).select(_key(prefix, key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("name"), path.alias("file_path"))
        out = rows if out is None else out.unionByName(rows)
    return out  # type: ignore[return-value]


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, target, kind, confidence, line)."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.count()
    called = spread(line.select("l_orderkey", "l_partkey", "l_linenumber"), rows, "l_orderkey", "l_partkey")
    supplied = spread(line.select("l_partkey", "l_suppkey"), rows, "l_partkey", "l_suppkey")
    no_line = F.lit(None).cast("int")
    parts = [
        (table(spark, sf_dir, "nation"), _key("r:", "n_regionkey"), _key("n:", "n_nationkey"), "contains", 1.0, no_line),
        (table(spark, sf_dir, "customer"), _key("n:", "c_nationkey"), _key("c:", "c_custkey"), "contains", 1.0, no_line),
        (table(spark, sf_dir, "supplier"), _key("n:", "s_nationkey"), _key("s:", "s_suppkey"), "contains", 1.0, no_line),
        (table(spark, sf_dir, "orders"), _key("c:", "o_custkey"), _key("o:", "o_orderkey"), "calls", 1.0, no_line),
        (called.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n")), _key("o:", "l_orderkey"), _key("p:", "l_partkey"), "calls", 0.7, F.col("n")),
        (supplied.distinct(), _key("p:", "l_partkey"), _key("s:", "l_suppkey"), "imports", 0.5, no_line),
    ]
    out = None
    for rows, source, target, kind, confidence, at in parts:
        rows = rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), at.alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.concat("source", F.lit("->"), "kind", F.lit("->"), "target").alias("id"), "source", "target", "kind", "confidence", "line")  # type: ignore[union-attr]


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
