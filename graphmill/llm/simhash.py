"""SimHash near-duplicates: fingerprints, and exact links by vantage-point trees over Hamming space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, binary_slices, if_small, map_rows, text_bytes
from graphmill.llm.components import connected_components, spanning

SEED = 42
#: Distinct fingerprints that a shard holds; of a sample for each shard, and of the whole sample at most, which the shards'
#: tree is fitted on. Beyond SHARD * SAMPLE / EACH fingerprints, 5e8, shards grow.
SHARD, EACH, SAMPLE = 8192, 16, 1 << 20
#: Stored fingerprints at which a local tree stops splitting; bytes that words are cut in at a time.
LEAF, BLOCK = 32, 4 << 20
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The lower-cased words, in lists from about `size` bytes each, so that a long text's words never all exist."""
    at = 0
    while at < len(data):
        cut = BLANK.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(data: bytes, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats included; fewer words
    than `width` are one shingle, none give zero."""
    ones, n, tail, short = np.zeros(64, np.int64), 0, [], True
    for words in word_blocks(data):
        words = tail + words
        if len(words) >= width:
            hashes = shingle_hashes(words, width)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n, short, tail = n + len(hashes), False, words[len(words) - width + 1 :]
        else:
            tail = words
    if short:
        return int(shingle_hashes(tail, width)[0]) if tail else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = np.fromiter((fingerprint(x, width) for x in binary_slices(batch.column("data"))), np.uint64, batch.num_rows)
            yield {"id": batch.column("id"), "fp": found.view(np.int64)}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(F.col(text_col)).alias("data")), "id long, fp long", run)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """Fingerprints within `radius` of `point` are in the inner branch, others in the outer one; a leaf has neither."""

    leaf: int = -1
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None


def split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves points best, of a few tried points that with the widest spread of
    distances; None if no radius separates them."""
    tried = points[np.linspace(0, len(points) - 1, 5).astype(int)]
    away = [distance(points, p) for p in tried]
    best = max(range(len(tried)), key=lambda i: away[i].var())
    radii = np.sort(away[best])
    radius = int(radii[(len(radii) - 1) // 2])
    if radius == radii[-1]:
        below = radii[radii < radius]
        if not len(below):
            return None
        radius = int(below[-1])
    return tried[best], radius


def grow(points: np.ndarray, depth: int, leaves: list[Node]) -> Node:
    cut = split(points) if depth and len(points) > 1 else None
    if cut is None:
        leaves.append(node := Node(leaf=len(leaves)))
        return node
    near = distance(points, cut[0]) <= cut[1]
    return Node(point=cut[0], radius=cut[1], inner=grow(points[near], depth - 1, leaves), outer=grow(points[~near], depth - 1, leaves))


def route(node: Node, points: np.ndarray, which: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices of points) whose ball of radius `reach` overlaps the leaf, by the triangle inequality."""
    if not len(which):
        return
    if node.inner is None or node.outer is None:
        yield node.leaf, which
        return
    away = distance(points[which], node.point).astype(int)
    yield from route(node.inner, points, which[away - reach <= node.radius], reach)
    yield from route(node.outer, points, which[away + reach > node.radius], reach)


class Linker:
    """Joins points within `reach` bits; holds labels, not pairs."""

    def __init__(self, points: np.ndarray, reach: int):
        self.points, self.reach, self.labels = points, reach, np.arange(len(points))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def flush(self) -> None:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.labels, self.waiting, self.held = spanning(len(self.points), a, b, self.labels), [], 0

    def compare(self, stored: np.ndarray, asking: np.ndarray) -> None:
        step = max(1, 1_000_000 // len(stored))
        for at in range(0, len(asking), step):
            part = asking[at : at + step]
            q, s = np.nonzero(distance(self.points[part][:, None], self.points[stored][None, :]) <= self.reach)
            a, b = part[q], stored[s]
            ok = a != b
            self.waiting.append((a[ok], b[ok]))
            self.held += int(ok.sum())
            if self.held > 1_000_000:
                self.flush()

    def search(self, stored: np.ndarray, asking: np.ndarray) -> None:
        """Grows a vantage-point tree over stored and runs all queries through it, branch by branch."""
        if not len(stored) or not len(asking):
            return
        cut = split(self.points[stored]) if len(stored) > LEAF else None
        if cut is None:
            self.compare(stored, asking)
            return
        point, radius = cut
        home, away = distance(self.points[stored], point), distance(self.points[asking], point).astype(int)
        self.search(stored[home <= radius], asking[away - self.reach <= radius])
        self.search(stored[home > radius], asking[away + self.reach > radius])


def hamming_links(scratch: Scratch, fps: DataFrame, reach: int = 2) -> DataFrame:
    """(a, b) links among the distinct longs fp of fps that join exactly what pairs within `reach` bits join.

    A vantage-point tree, fitted on a bounded sample of at most SAMPLE rows, has a leaf for about SHARD fingerprints. Each is
    stored in its own leaf and asks in those later leaves that its ball overlaps; a shard then runs both through a
    local tree and emits a spanning forest, so at most one link a row, never all pairs of a group. For random
    fingerprints each level sends about 0.4 of the queries both ways, so copies grow as a power of about 0.5 of the
    number of shards; clustered ones cost less.
    """
    rows = fps.count()
    depth = max(0, ceil(log2(max(1, rows) / SHARD)))
    depth = min(depth, int(log2(SAMPLE // EACH)))
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, EACH << depth) if depth else 0).collect()], np.int64).view(np.uint64)
    leaves: list[Node] = []
    tree = grow(sample, depth, leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            everyone, own = np.arange(len(points)), np.zeros(len(points), int)
            for leaf, which in route(tree, points, everyone, 0):
                own[which] = leaf
                yield {"shard": np.full(len(which), leaf, np.int32), "stored": np.ones(len(which), bool), "fp": points[which].view(np.int64)}
            for leaf, which in route(tree, points, everyone, reach):
                which = which[own[which] < leaf]
                yield {"shard": np.full(len(which), leaf, np.int32), "stored": np.zeros(len(which), bool), "fp": points[which].view(np.int64)}

    def link(group: pa.Table) -> pa.Table:
        points, stored = group.column("fp").to_numpy().view(np.uint64), group.column("stored").to_numpy()
        links = Linker(points, reach)
        own = np.flatnonzero(stored)
        links.search(own, np.arange(len(points)))
        links.flush()
        linked = np.flatnonzero(links.labels != np.arange(len(points)))
        return pa.table({"a": points[linked].view(np.int64), "b": points[links.labels[linked]].view(np.int64)})

    dealt = map_rows(fps.select("fp"), "shard int, stored boolean, fp long", deal)
    return scratch.write(dealt.groupBy("shard").applyInArrow(link, "a long, b long"), "links")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id, kept) for every row of docs: component_id is the smallest id that links of at most
    `reach` differing bits reach, kept marks that row. With `similarity`, pairs of that Jaccard similarity or more, between sets
    of shingles of `width` words, are links besides, as no reach that a tree can search covers 0.8; fingerprints are of three
    words then, and fp tells sets of shingles apart, see near_dedup.

    Exact copies share a fingerprint and are one node. Null and empty texts have fingerprint zero, which links like any
    other. Null ids belong to components but never name one, unless no other id is there: then component_id is null.
    Repeated rows are repeated in the result. An empty table gives an empty result. Other columns are ignored.
    """
    if similarity is not None:
        from graphmill.llm.near_dedup import near_dedup

        return near_dedup(docs, id_col, text_col, width, similarity, reach)
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, width), "prints")
    fps = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("first")), "fps")
    roots = connected_components(scratch, hamming_links(scratch, fps, reach)).withColumnRenamed("id", "fp")
    n = roots.count()
    joined = scratch.write(fps.join(if_small(roots, n, 32), "fp"), "joined")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    moved = scratch.write(joined.join(if_small(least, n, 32), "root").select("fp", "least"), "moved")
    named = scratch.write(fps.join(if_small(moved, n, 32), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    scratch.drop("fps", "links", "joined", "moved", "roots")
    out = prints.join(if_small(named, named.count(), 32), "fp")
    return out.select(F.col("id").alias(id_col), "fp", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
