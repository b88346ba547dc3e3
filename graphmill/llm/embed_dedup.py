"""Near-duplicate vectors: a hierarchical navigable small-world graph per shard, searched by every vector."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, if_small, settle
from graphmill.llm.components import connected_components, spanning

#: Neighbours of a node in upper layers, twice as many in the lowest; beam that construction uses, and that searches
#: begin with; beam nodes that are expanded together; queries that audits ask.
DEGREE, BUILD, BEAM, WIDE, AUDIT = 12, 40, 32, 4, 1024
#: Bytes of vectors that a shard holds, and a block of queries, on average.
SHARD = 16 << 20
#: Share of its true links that a search must have found for an audited query on average, else all beams are doubled; the
#: beam from which queries that fill it with links are compared with the whole shard; the share of a shard from which a
#: beam takes longer than that.
RECALL, DENSE, WHOLE = 0.999, 128, 1 / 128
#: What single precision may take off a cosine or add to it; candidates this close to the threshold are verified in double.
SLACK = 1e-4


def beam_search(points: np.ndarray, graph: np.ndarray, asking: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), best first, of the `beam` best nodes that a best-first search from entry (a row of node ids
    for each query) meets; -1 where there are fewer. All queries advance together, WIDE nodes a step."""
    rows, n = len(asking), len(points)
    ids, sims = np.full((rows, beam), -1, np.int32), np.full((rows, beam), -2, np.float32)
    final = ids.copy(), sims.copy()
    mark = np.full((rows, n), -1, np.int16)
    active, done = np.arange(rows), np.ones((rows, beam), bool)
    fresh_ids = entry.astype(np.int32)
    while True:
        b, width = fresh_ids.shape
        r, c = np.nonzero(fresh_ids >= 0)
        node = fresh_ids[r, c]
        new = mark[active[r], node] < 0
        r, c, node = r[new], c[new], node[new]
        mark[active[r], node] = c
        once = mark[active[r], node] == c
        r, c, node = r[once], c[once], node[once]
        near = np.full((b, width), -2, np.float32)
        near[r, c] = np.einsum("ij,ij->i", points[node], asking[active[r]])
        every, names = np.concatenate([sims, near], axis=1), np.concatenate([ids, np.where(near > -2, fresh_ids, -1)], axis=1)
        order = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(every, order, 1), axis=1, kind="stable"), 1)
        ids, sims = np.take_along_axis(names, order, 1), np.take_along_axis(every, order, 1)
        done = np.take_along_axis(np.concatenate([done, near <= -2], axis=1), order, 1)
        over = done.all(axis=1)
        if over.any():
            final[0][active[over]], final[1][active[over]] = ids[over], sims[over]
            active, ids, sims, done = active[~over], ids[~over], sims[~over], done[~over]
            if not len(active):
                return final
        first = np.argsort(done, axis=1, kind="stable")[:, :WIDE]
        open_ = ~np.take_along_axis(done, first, 1)
        np.put_along_axis(done, first, True, 1)
        chosen = np.take_along_axis(ids, first, 1)
        fresh_ids = np.where(open_[..., None], graph[chosen], -1).reshape(len(active), -1)


def diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row's node than to any candidate taken before, then
    the best of the others, up to `degree`."""
    rows, n = ids.shape
    cells = points[np.maximum(ids, 0)]
    among = np.matmul(cells, cells.transpose(0, 2, 1))
    taken, count = np.zeros((rows, n), bool), np.zeros(rows, int)
    for i in range(n):
        ok = (ids[:, i] >= 0) & (count < degree) & ~(taken & (among[:, i] > sims[:, i, None])).any(axis=1)
        taken[:, i] = ok
        count += ok
    rank = np.where(ids < 0, 2 * n, np.where(taken, 0, n) + np.arange(n)[None])
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(ids, order, 1)


@dataclass
class Layer:
    """members: indices of the layer's points, those of the layer above first; graph: of positions among members."""

    members: np.ndarray
    graph: np.ndarray


@dataclass
class Hnsw:
    points: np.ndarray  # unit length, single precision
    layers: list[Layer] = field(default_factory=list)  # the top one first

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 5) -> Hnsw:
        """Levels are drawn as in the published algorithm; layers are built from the top, each point entering at what
        the layers above find. Points enter in batches no larger than what is already there."""
        index = cls(points)
        n = len(points)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-levels, kind="stable")
        for level in range(int(levels.max(initial=0)), -1, -1):
            members = order[: int((levels >= level).sum())]
            known = len(index.layers[-1].members) if index.layers else 0
            index.layers.append(Layer(members, np.full((len(members), DEGREE * (1 if level else 2)), -1, np.int32)))
            index.fill(known)
        return index

    def fill(self, known: int) -> None:
        layer = self.layers[-1]
        points, at = self.points[layer.members], 0
        while at < len(points):
            size = min(len(points) - at, max(known, 256) if not at else min(at, 1024))
            batch = np.arange(at, at + size)
            asking = points[batch]
            inside = asking @ asking.T
            np.fill_diagonal(inside, -2)
            k = min(BUILD, size)
            own = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            ids, sims = own + at, np.take_along_axis(inside, own, 1)
            if at:
                step = max(32, min(1024, (1 << 26) // at))
                parts = [beam_search(points[:at], layer.graph[:at], q, self.enter(q, at), BUILD) for q in (asking[i : i + step] for i in range(0, size, step))]
                ids, sims = (np.concatenate([x, np.concatenate(y)], axis=1) for x, y in zip((ids, sims), zip(*parts, strict=True), strict=True))
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            ids = np.where(sims > -2, ids, -1).astype(np.int32)
            degree = min(DEGREE, ids.shape[1])
            layer.graph[batch, :degree] = diverse(points, ids, sims, degree)
            self.link_back(points, layer.graph, batch)
            at += size

    def link_back(self, points: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
        """The new nodes' neighbours link to them, too; lists that overflow keep a diverse choice."""
        new = np.repeat(batch, graph.shape[1])
        old = graph[batch].ravel()
        new, old = new[old >= 0], old[old >= 0]
        near = np.einsum("ij,ij->i", points[new], points[old])
        order = np.lexsort((-near, old))
        new, old = new[order], old[order]
        nodes, begin, counts = np.unique(old, return_index=True, return_counts=True)
        more = min(int(counts.max(initial=0)), BUILD)
        slot = np.arange(len(old)) - np.repeat(begin, counts)
        added = np.full((len(nodes), more), -1, np.int32)
        row = np.repeat(np.arange(len(nodes)), counts)
        added[row[slot < more], slot[slot < more]] = new[slot < more]
        added[(added[:, :, None] == graph[nodes][:, None, :]).any(axis=2)] = -1
        for at in range(0, len(nodes), 1024):
            some = nodes[at : at + 1024]
            ids = np.concatenate([graph[some], added[at : at + 1024]], axis=1)
            sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", points[np.maximum(ids, 0)], points[some]), -2)
            order = np.argsort(-sims, axis=1, kind="stable")
            graph[some] = diverse(points, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), graph.shape[1])

    def enter(self, asking: np.ndarray, below: int | None = None) -> np.ndarray:
        """Positions in the lowest layer built (or being built, with `below` points in it) to begin at."""
        layers = self.layers[:-1]
        if not layers:
            return np.zeros((len(asking), 1), np.int64)
        entry = np.zeros((len(asking), 1), np.int64)
        for layer in layers:
            # Members of a layer come first, in the same order, in the layer below, so positions carry over.
            entry = beam_search(self.points[layer.members], layer.graph, asking, entry, 8)[0]
        return entry if below is None else np.where(entry < below, entry, -1)

    def search(self, asking: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first."""
        beam = min(beam, len(self.points))
        lowest = self.layers[-1]
        step = max(32, min(1024, (1 << 26) // len(self.points)))
        points = self.points[lowest.members]
        parts = [beam_search(points, lowest.graph, q, self.enter(q), beam) for q in (asking[i : i + step] for i in range(0, len(asking), step))]
        ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.where(ids >= 0, lowest.members[np.maximum(ids, 0)], -1), sims


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times the power of two that makes its largest component 1 or so: no square can
    overflow or vanish then, and cosines are what they were."""
    wide = x.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    wide = scaled(x)
    return (wide / np.sqrt((wide**2).sum(axis=1))[:, None]).astype(np.float32)


class Links:
    """What queries link with in a shard: weights added up, and labels that join queries and points, but no pairs. own: each
    query's place in the shard, -1 for none."""

    def __init__(self, index: Hnsw, raw: np.ndarray, weight: np.ndarray, asking: np.ndarray, own: np.ndarray, threshold: float):
        self.index, self.raw, self.weight, self.own, self.threshold = index, raw, weight.astype(np.float64), own, threshold
        self.exact, self.asking = asking, unit(asking)
        self.links = np.zeros(len(asking))
        self.labels = np.arange(len(asking) + len(raw))

    def linked(self, q: np.ndarray, p: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Which pairs reach the threshold, by single precision where that is clear, else in double."""
        ok = (sims >= self.threshold) & (p != self.own[q])
        close = np.flatnonzero((np.abs(sims - self.threshold) < SLACK) & (p != self.own[q]))
        for i in range(0, len(close), 1 << 15):
            some = close[i : i + (1 << 15)]
            a, b = scaled(self.exact[q[some]]), scaled(self.raw[p[some]])
            dot = np.einsum("ij,ij->i", a, b)
            ok[some] = dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))) >= self.threshold
        return ok

    def join(self, q: np.ndarray, p: np.ndarray) -> None:
        p = p + len(self.asking)
        apart = self.labels[q] != self.labels[p]
        if apart.any():
            self.labels = spanning(len(self.labels), q[apart], p[apart], self.labels)

    def add(self, q: np.ndarray, p: np.ndarray, sims: np.ndarray) -> None:
        ok = self.linked(q, p, sims)
        q, p = q[ok], p[ok]
        self.links += np.bincount(q, self.weight[p], len(self.links))
        self.join(q, p)

    def add_whole(self, queries: np.ndarray) -> None:
        """Compares queries with all points, by blocks of a matrix product that is dropped again."""
        points, n = self.index.points, len(self.asking)
        for i in range(0, len(queries), 256):
            some = queries[i : i + 256]
            sims = self.asking[some] @ points.T
            hit = sims >= self.threshold
            row, p = np.nonzero(np.abs(sims - self.threshold) < SLACK)
            hit[row, p] = self.linked(some[row], p, sims[row, p])
            inside = np.flatnonzero(self.own[some] >= 0)
            hit[inside, self.own[some[inside]]] = False
            self.links[some] = hit @ self.weight
            row, p = np.nonzero(hit & (self.labels[some][:, None] != self.labels[n:][None, :]))
            for at in range(0, len(row), 1 << 20):
                self.join(some[row[at : at + (1 << 20)]], p[at : at + (1 << 20)])

    def search(self) -> float:
        """Finds all links, and returns the recall of the graph alone. Where points within reach fill a query's beam, it is
        widened, and from DENSE on the query is compared with all points: it is in a crowd. Audits compare AUDIT
        queries with all points; while a query misses a share of its links above 1 - RECALL on average, every beam is
        doubled, and at a share of WHOLE of the shard, it is the whole shard."""
        least, n = self.threshold - SLACK, len(self.index.points)
        audit = np.unique(np.linspace(0, len(self.asking) - 1, min(AUDIT, len(self.asking))).astype(int))
        beam, crowd = BEAM, np.zeros(len(self.asking), bool)
        while True:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            open_, width = np.flatnonzero(~crowd), beam
            while len(open_):
                ids, sims = self.index.search(self.asking[open_], width)
                hit = (sims >= least) & (ids >= 0)
                full = hit.all(axis=1) & (ids.shape[1] < n)
                q, c = np.nonzero(hit & ~full[:, None])
                found.append((open_[q], ids[q, c].astype(np.int64), sims[q, c]))
                open_, width = open_[full], 4 * width
                if width > max(DENSE, beam):
                    crowd[open_] = True
                    break
            q, p, sims = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
            got, true = np.zeros(len(audit)), np.zeros(len(audit))
            asked = audit[~crowd[audit]]
            place = np.searchsorted(audit, q)
            of = (place < len(audit)) & (audit[np.minimum(place, len(audit) - 1)] == q) if len(audit) else np.zeros(0, bool)
            got += np.bincount(place[of], minlength=len(audit))
            for i in range(0, len(asked), 256):
                true[np.searchsorted(audit, asked[i : i + 256])] = np.count_nonzero(self.asking[asked[i : i + 256]] @ self.index.points.T >= least, axis=1)
            some = true > 0
            recall = float((np.minimum(got[some], true[some]) / true[some]).mean()) if some.any() else 1.0
            if recall >= RECALL or beam >= n:
                break
            beam *= 2
            if beam >= WHOLE * n:
                self.add_whole(np.arange(len(self.asking)))
                return recall
        missed = np.zeros(len(self.asking), bool)
        missed[audit[got < true]] = True
        keep = ~missed[q]
        self.add(q[keep], p[keep], sims[keep])
        self.add_whole(np.flatnonzero(crowd | missed))
        return recall


def usable(vector: Column) -> Column:
    """Neither null, nor zero, nor with a component that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, shard_bytes: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: how many other rows have a cosine of at least `threshold`, the
    smallest id that links reach, and whether that is the row's own.

    Equal vectors become one weighted node first. Nodes are dealt by a hash to shards of `shard_bytes` of vectors; each
    shard's graph is built once and written, and blocks of as many nodes ask every shard (more and smaller blocks while
    there are fewer tasks than cores), so a task holds a shard and a block. Links in question are verified in double
    precision and leave a task as counts and a spanning forest, never as pairs. The nodes of a crowd, whose links fill
    wide beams, are compared with a whole shard by matrix products. Vectors of different lengths never link.

    Vectors that are not usable, and rows without an id, link with nothing and are their own component. Rows that
    repeat an id are one item: it has the links of all its rows, which count as rows. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "hnsw")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).withColumn("ok", F.col("id").isNotNull() & usable(F.col("v")))
    nodes = rows.where("ok").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("weight"))
    nodes = scratch.write(nodes.withColumns({"dim": F.size("v"), "part": F.xxhash64("v")}), "nodes")
    kind = np.float64 if "double" in nodes.schema["v"].dataType.simpleString() else np.float32
    total, cells = nodes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = -(-max(1, cells * 4) // shard_bytes)
    blocks = max(shards, -(-spark.sparkContext.defaultParallelism // shards))

    def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        group = group.sort_by("part")
        raw = matrix(group.column("v"), dim)
        index = Hnsw.build(unit(raw))
        out = pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "raw": [raw.tobytes()],
            "node": [group.column("node").to_numpy().tobytes()], "part": [group.column("part").to_numpy().tobytes()], "weight": [group.column("weight").to_numpy().tobytes()],
            "members": [[x.members.astype("<i4").tobytes() for x in index.layers]], "graphs": [[x.graph.tobytes() for x in index.layers]],
        })
        settle()
        return out

    dealt = nodes.withColumn("shard", F.pmod("part", F.lit(shards)).cast("int"))
    schema = "dim int, shard int, raw binary, node binary, part binary, weight binary, members array<binary>, graphs array<binary>"
    indices = scratch.write(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "indices")

    def ask(block: pa.Table, stored: pa.Table) -> pa.Table:
        out = {"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)}
        if len(block) and len(stored):
            cell = {c: stored.column(c)[0].as_py() for c in stored.column_names}
            dim = cell["dim"]
            raw = np.frombuffer(cell["raw"], kind).reshape(-1, dim)
            members = [np.frombuffer(x, "<i4") for x in cell["members"]]
            index = Hnsw(unit(raw), [Layer(m, np.frombuffer(g, np.int32).reshape(len(m), -1)) for m, g in zip(members, cell["graphs"], strict=True)])
            node, weight, part = (np.frombuffer(cell[c], np.int64) for c in ("node", "weight", "part"))
            mine, asked = block.column("node").to_numpy(), block.column("part").to_numpy()
            place = np.minimum(np.searchsorted(part, asked), len(part) - 1)
            found = Links(index, raw, weight, matrix(block.column("v"), dim), np.where(part[place] == asked, place, -1), threshold)
            found.search()
            links, labels = found.links.astype(np.int64), found.labels
            names = np.concatenate([mine, node])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            linked = np.flatnonzero(links)
            out = {
                "node": np.concatenate([mine[linked], names[moved]]), "links": np.concatenate([links[linked], np.zeros(len(moved), np.int64)]),
                "other": np.concatenate([mine[linked], names[labels[moved]]]),
            }
        settle()
        return pa.table(out)

    block = F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int").alias("block")
    asking = nodes.select("node", "part", "v", F.col("dim").alias("d"), block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    stored = indices.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asking.groupBy("d", "s", "block").cogroup(stored.groupBy("dim", "shard", "b")).applyInArrow(ask, "node long, links long, other long")
    asked = scratch.write(asked, "asked")

    roots = connected_components(scratch, asked.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    m = roots.count()
    least = scratch.write(roots.groupBy("root").agg(F.min("id").alias("least")), "least")
    named = roots.join(if_small(least, m, 32), "root").select(F.col("id").alias("node"), "least")
    found = asked.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    heavy = nodes.groupBy("node").agg(F.sum(F.col("weight") - 1).alias("copies")).where("copies > 0")
    info = scratch.write(named.join(found, "node", "full").join(heavy, "node", "full").select("node", "least", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("n_links")), "info")
    copies = scratch.write(nodes.where("weight > 1").select("v", "node"), "copies")
    width = copies.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    scratch.drop("nodes", "indices", "asked", "least", "roots")
    # Rows that can't link take no part in the joins, so they meet on no key.
    placed = rows.where("ok").join(if_small(copies, width[1], 8 * width[0] + 32), "v", "left").select("id", F.coalesce("node", "id").alias("node"))
    out = placed.join(if_small(info, info.count(), 48), "node", "left")
    alone = rows.where(~F.col("ok")).select("id", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("least"), F.lit(0).cast("long").alias("n_links"))
    out = out.select("id", "node", "least", "n_links").unionByName(alone)
    component = F.coalesce("least", "node", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
