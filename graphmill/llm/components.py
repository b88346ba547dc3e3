"""Connected components by rounds of random contraction, over tables in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, if_small


def spanning(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..n-1 joined over the links (a, b): each is the least index of its component. labels: a start."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not (labels[labels] == labels).all():
            labels = labels[labels]
    return labels


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, root) for every id that an edge (a, b) of longs touches; root is one id of the component.

    In each round every node points to the neighbour, or itself, that comes first in an order drawn for that round,
    and pointed-to nodes stand for those that point. That leaves a constant share of the nodes on average, whatever
    the shape of the graph, so rounds grow with the logarithm of the largest component. A hub costs no more than its
    edges: its minimum is combined map-side, and both sides of every join are written tables, whose skewed partitions
    AQE splits. Nothing is collected but counts.
    """
    link = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, k = scratch.write(link(edges), "edges-0"), 0
    points: list[tuple[DataFrame, int]] = []
    while live.count():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("best")).select(F.col("a").alias("id"), F.least("best", order("a"))["v"].alias("to"))
        first = scratch.write(first, f"points-{k}")
        n = first.count()
        points.append((first, n))
        at = lambda c: if_small(first.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")), n, 32)  # noqa: E731, B023
        live = scratch.write(link(live.join(at("a"), "a").join(at("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))), f"edges-{k + 1}")
        scratch.drop(f"edges-{k}")
        k += 1
    if not points:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found, _ = points[0]
    for step, n in points[1:]:
        found = found.join(if_small(step.select(F.col("id").alias("to"), F.col("to").alias("next")), n, 32), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    roots = scratch.write(found.withColumnRenamed("to", "root"), "roots")
    scratch.drop(f"edges-{k}", *(f"points-{i}" for i in range(k)))
    return roots
