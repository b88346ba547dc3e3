"""Near-duplicates by SimHash fingerprints, and besides by exact Jaccard similarity of word shingles.

This is the form of operator 6 with a similarity: fingerprints link by a vantage-point tree as they do without one. Pairs of
similarity 0.8 may differ in about ten of 64 bits, a reach at which no tree can prune, so candidates for what the tree
leaves apart come by bands of minima of hashes."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, binary_slices, if_small, map_rows, settle, text_bytes, without
from graphmill.llm.components import connected_components
from graphmill.llm.simhash import SEED, fingerprint, hamming_links, shingle_hashes, word_blocks

#: A pair of similarity s shares a band with probability 1 - (1 - s ** DEEP) ** BANDS: 0.99994 at 0.8. A sketch has a
#: byte for each of the minima.
BANDS, DEEP = 32, 6
MINIMA = BANDS * DEEP
DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, MINIMA, 1), np.uint32, endpoint=False)
TIMES, PLUS = DRAWN[0] | np.uint32(1), DRAWN[1]
#: Standard deviations by which a sketch's estimate may be too low.
SLACK = 4.5
#: Shingles of a cell that one task compares, and that a task takes on average; larger cells are dealt anew by their
#: sketches up to LEVELS times, and what is still larger by pairs of blocks.
SHINGLES, LEVELS = 1 << 20, 3


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than `width` are one shingle, none give none."""
    found, tail, short = [], [], True
    for words in word_blocks(data):
        words = tail + words
        if len(words) >= width:
            found.append(np.unique(shingle_hashes(words, width)))
            short, tail = False, words[len(words) - width + 1 :]
        else:
            tail = words
    return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0]) if not short else shingle_hashes(tail, width)


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, (1 << 32) - 1, np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 1024):
        np.minimum(least, (TIMES * folded[None, at : at + 1024] + PLUS).min(axis=1), out=least)
    return least


def cells_of(least: np.ndarray) -> np.ndarray:
    """The cells of rows of minima: a hash of each band."""
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for k in range(DEEP):
        x = x * np.uint64(0x2545F4914F6CDD1D) + least[:, k * BANDS : (k + 1) * BANDS]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    return x


def sketches_of(least: np.ndarray) -> np.ndarray:
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    return zip(batch.column("id").to_pylist(), (shingle_set(x, width) for x in binary_slices(batch.column("data"))), strict=True)


def named(shingles: np.ndarray) -> int:
    """The same number for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def printed(rows: DataFrame, width: int) -> DataFrame:
    """(id, fp, size, cells, sketch, print) of every row of (id, data); print is the SimHash fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, fps, sizes, least = [], [], [], []
                prints = np.fromiter((fingerprint(x) for x in binary_slices(part.column("data"))), np.uint64, part.num_rows)
                for i, found in sets_of(part, width):
                    ids.append(i)
                    fps.append(named(found))
                    sizes.append(len(found))
                    least.append(minima(found))
                table = np.array(least)
                cells, sketches = cells_of(table).view(np.int64), sketches_of(table)
                yield {"id": ids, "fp": fps, "size": sizes, "cells": [c if n else [] for c, n in zip(cells, sizes, strict=True)], "sketch": [s.tobytes() for s in sketches], "print": prints.view(np.int64)}

    return map_rows(rows, "id long, fp long, size long, cells array<long>, sketch binary, print long", run)


def shingled(rows: DataFrame, width: int) -> DataFrame:
    """(fp, held): the shingles of every row of (id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for _, found in sets_of(batch, width):
                yield {"fp": [named(found)], "held": [found.view(np.int64)]}

    return map_rows(rows, "fp long, held array<long>", run)


def alike(sketch: np.ndarray, size: np.ndarray, comp: np.ndarray, least: float) -> np.ndarray:
    """Which of a cell's rows have a partner of another component whose estimate may reach `least`."""
    low = MINIMA * (least - SLACK * sqrt(least * (1 - least) / MINIMA))
    keep = np.zeros(len(sketch), bool)
    for i in range(len(sketch) - 1):
        a, b = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        j = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (a >= least * b))
        j = j[np.count_nonzero(sketch[j] == sketch[i], axis=1) >= low]
        keep[j] = True
        keep[i] |= len(j) > 0
    return keep


def spanned(size: np.ndarray, comp: np.ndarray, bounds: np.ndarray, flat: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of a cell's rows of similarity `least` or more that join all components which such pairs join. flat: the rows'
    sets one after another, each row's from its bound to the next.

    The rows that have each shingle are listed; adding up a row's lists gives what it shares with every other, exactly. So a
    row costs what its lists hold, and no pair is held on to."""
    rows = np.repeat(np.arange(len(size), dtype=np.int32), np.diff(bounds))
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    lists, begin = rows[order], np.r_[0, np.cumsum(often)]
    label = np.unique(comp, return_inverse=True)[1]
    links = []
    for x in range(len(size)):
        if (label == label[x]).all():
            break
        mine = which[bounds[x] : bounds[x + 1]]
        parts = [lists[begin[s] : begin[s + 1]] for s in mine[often[mine] > 1].tolist()]
        if not parts:
            continue
        shared = np.bincount(np.concatenate(parts), minlength=len(size))[x + 1 :]
        near = x + 1 + np.flatnonzero(shared >= least * (size[x] + size[x + 1 :] - shared))
        while len(near := near[label[near] != label[x]]):
            links.append((x, int(near[0])))
            label[label == label[near[0]]] = label[x]
    return links


def cells_in(group: pa.Table) -> tuple[pa.Table, np.ndarray, Iterator[tuple[int, int]]]:
    """A task's rows by cell, their sketches, and where each cell begins and ends."""
    group = group.sort_by([("cell", "ascending"), ("fp", "ascending")])
    sketch = np.frombuffer(b"".join(binary_slices(group.column("sketch"))), np.uint8).reshape(-1, MINIMA)
    cuts = np.flatnonzero(np.r_[True, np.diff(group.column("cell").to_numpy()) != 0, True]).tolist()
    return group, sketch, zip(cuts[:-1], cuts[1:], strict=True)


def with_partners(rows: DataFrame, least: float) -> DataFrame:
    """The rows (cell, fp, size, comp, sketch) that have a partner in their cell by the sketches."""

    def run(group: pa.Table) -> pa.Table:
        group, sketch, cells = cells_in(group)
        size, comp = group.column("size").to_numpy(), group.column("comp").to_numpy()
        keep = np.zeros(len(group), bool)
        for at, end in cells:
            keep[at:end] = alike(sketch[at:end], size[at:end], comp[at:end], least)
        out = group.filter(pa.array(keep)).drop_columns(["task"])
        settle()
        return out

    return in_tasks(rows).groupBy("task").applyInArrow(run, rows.schema)


def joining(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of similarity `least` or more that join all components which pairs within cells of the rows (cell,
    fp, size, comp, sketch, held) join, see spanned."""

    def run(group: pa.Table) -> pa.Table:
        group, _, cells = cells_in(group)
        fp, size, comp = (group.column(c).to_numpy() for c in ("fp", "size", "comp"))
        held = group.column("held").combine_chunks()
        bounds, flat = held.offsets.to_numpy(), held.values.to_numpy()
        links: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for at, end in cells:
            own = bounds[at : end + 1]
            found = spanned(size[at:end], comp[at:end], own - own[0], flat[own[0] : own[-1]], least)
            for i, j in found:
                a, b = top(int(comp[at + i])), top(int(comp[at + j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(fp[at + i]), int(fp[at + j])))
        settle()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return in_tasks(rows).groupBy("task").applyInArrow(run, "a long, b long")


def in_tasks(rows: DataFrame) -> DataFrame:
    """The rows dealt by cell to tasks that hold SHINGLES shingles on average."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return rows.withColumn("task", F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(1 + total // SHINGLES)).cast("int"))


def undecided(scratch: Scratch, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows (cell, fp, size, comp, ...) in cells that hold several components, with the cell's shingles n, and the
    most shingles of a cell."""
    cells = rows.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("size").alias("n")).where("low < high")
    cells = scratch.write(cells.select("cell", "n"), f"{name}-cells")
    total = cells.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    return rows.drop("n").join(if_small(cells, total[0], 16), "cell"), total[1]


def dealt_anew(scratch: Scratch, rows: DataFrame, largest: int, name: str) -> DataFrame:
    """The rows of undecided cells, cells of over SHINGLES split by further bands, taken from the sketches, and what is
    larger even then by pairs of blocks, so that all pairs of a cell meet in some task."""
    done = rows.where(F.col("n") <= SHINGLES)
    draw = np.random.default_rng(SEED)
    for level in range(LEVELS):
        if largest <= SHINGLES:
            break
        bands = [draw.choice(MINIMA, DEEP, replace=False).tolist() for _ in range(BANDS)]
        keys = F.array(*(F.xxhash64("cell", F.lit(k), *(F.substring("sketch", p + 1, 1) for p in band)) for k, band in enumerate(bands)))
        split = rows.where(F.col("n") > SHINGLES).withColumn("cell", F.explode(keys))
        rows, largest = undecided(scratch, scratch.write(split, f"{name}-{level}"), f"{name}-{level}")
        done = done.unionByName(rows.where(F.col("n") <= SHINGLES))
    if largest > SHINGLES:
        blocks = F.ceil(F.col("n") / F.lit(SHINGLES // 2)).cast("long")
        mine, every = F.pmod(F.xxhash64("fp"), blocks), F.sequence(F.lit(0).cast("long"), blocks - 1)
        large = rows.where(F.col("n") > SHINGLES).withColumns({"mine": mine, "other": F.explode(every)})
        done = done.unionByName(large.withColumn("cell", F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other"))).drop("mine", "other"))
    return scratch.write(done.drop("n"), f"{name}-dealt")


def by_fingerprint(scratch: Scratch, prints: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) between values of fp in prints (fp, print) that join all whose fingerprints reach each other by steps of
    at most `reach` bits: a star for each fingerprint, and the forests of the vantage-point tree between the stars."""
    stars = scratch.write(prints.groupBy("print").agg(F.min("fp").alias("centre")), "stars")
    n = stars.count()
    tree = hamming_links(scratch, stars.select(F.col("print").alias("fp")), reach)
    tree = scratch.write(tree, "tree")
    centre = lambda c: if_small(stars.select(F.col("print").alias(c), F.col("centre").alias(f"{c}_at")), n, 16)
    between = tree.join(centre("a"), "a").join(centre("b"), "b").select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    own = prints.select("fp", "print").distinct().join(if_small(stars, n, 16), "print").select(F.col("centre").alias("a"), F.col("fp").alias("b"))
    return scratch.write(between.unionByName(own).where("a <> b"), "by-fingerprint")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, reach: int = 2) -> DataFrame:
    """(id, fp, component_id, kept) for every row of docs: component_id is the smallest id that links reach, kept marks that
    row. Links are pairs whose SimHash fingerprints differ in at most `reach` bits, found by a vantage-point tree, and pairs of
    Jaccard similarity `least` (0.8 or more) between sets of word shingles. Texts without a word link by fingerprint alone.

    Equal sets are one node; those that fingerprints join are compared no more. Nodes that share a band of minima are in a
    cell. First each node is compared with the
    leader, first in a fixed order, of its cells, which joins most of any large group of near copies by one link a row.
    Then only cells that still hold several components matter: a task compares the sketches of a cell's rows, and a
    second one the sets of those rows that may be similar enough, the most similar pairs first; a pair is skipped only if
    it is joined already. Cells of many shingles are dealt anew by further bands, or by pairs of blocks. So no link
    between components is missed but those whose pair shares no band or is underrated by its sketch (6e-5 and 4e-6 of
    pairs at the threshold, fewer above).

    Null and empty texts are equal. Null ids never name a component, unless no other id is there. Repeated rows are
    repeated in the result. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("data"))
    prints = scratch.write(printed(texts, width), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch"))
    nodes = scratch.write(nodes, "nodes")
    close = by_fingerprint(scratch, prints, reach)
    cells = nodes.select("fp", "size", F.explode("cells").alias("cell"))
    leader = F.min(F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("v"), F.col("size").alias("s"))).alias("leader")
    full = scratch.write(cells.groupBy("cell").agg(F.count("*").alias("n"), leader).where("n > 1").select("cell", "leader"), "full")
    live = scratch.write(cells.join(if_small(full, full.count(), 40), "cell"), "live")

    wanted = scratch.write(live.select("fp").distinct(), "wanted")
    many = wanted.count()
    ids = scratch.write(nodes.join(if_small(wanted, many, 16), "fp", "left_semi").select(F.col("first").alias("id")).distinct(), "ids")
    sets = scratch.write(shingled(without(texts, [F.col("id")], ids, "left_semi"), width).dropDuplicates(["fp"]), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.select("a", "b").join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
        shared, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
        return scratch.write(both.where(shared >= F.lit(least) * (total - shared)).select("a", "b"), name)

    led = live.groupBy("fp", "size").agg(F.min("leader").alias("leader")).select(F.col("leader.v").alias("a"), F.col("fp").alias("b"), F.col("leader.s").alias("s"), "size")
    led = led.where((F.col("a") != F.col("b")) & (F.least("s", "size") >= F.lit(least) * F.greatest("s", "size")))
    links = close.unionByName(verified(scratch.write(led.select("a", "b"), "pairs"), "similar"))
    roots = connected_components(scratch, links).withColumnRenamed("id", "fp")
    labelled = live.select("cell", "fp", "size").join(if_small(roots, roots.count(), 32), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")
    rows, largest = undecided(scratch, scratch.write(labelled, "labelled"), "mixed")
    if largest:
        mixed = scratch.write(rows.join(nodes.select("fp", "sketch"), "fp"), "mixed")
        rows = scratch.write(with_partners(dealt_anew(scratch, mixed, largest, "split"), least), "partners")
        links = links.unionByName(scratch.write(joining(rows.join(sets, "fp"), least), "joining"))
        roots = connected_components(Scratch(docs.sparkSession, "near-again"), links).withColumnRenamed("id", "fp")
    n = roots.count()

    joined = scratch.write(nodes.select("fp", "first").join(if_small(roots, n, 32), "fp"), "joined")
    lowest = joined.groupBy("root").agg(F.min("first").alias("lowest"))
    moved = scratch.write(joined.join(if_small(lowest, n, 32), "root").select("fp", "lowest"), "moved")
    called = scratch.write(nodes.select("fp", "first").join(if_small(moved, n, 32), "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")), "named")
    scratch.drop("stars", "tree", "by-fingerprint", "similar", "nodes", "full", "live", "wanted", "ids", "sets", "pairs", "links", "labelled", "mixed", "mixed-cells", "split-dealt", "partners", "joining", "joined", "moved", "roots")
    out = prints.select("id", "fp").join(if_small(called, called.count(), 32), "fp")
    return out.select(F.col("id").alias(id_col), "fp", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
