"""Approximate nearest neighbours by cosine: inverted lists whose vectors are scanned a block of dimensions at a time.

A random rotation spreads a vector's length evenly over its dimensions, so the distance within the first t of d dimensions
times d / t estimates the whole. After each block of dimensions a hypothesis test abandons the candidates whose estimate is
beyond the best distance so far by more than chance allows; the few that are left are compared exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, arrow_schema, map_rows, settle

#: Vectors of a list on average, rows of a block of a list, and queries that a block is scanned for at a time.
LIST, BLOCK, TOGETHER = 1024, 4096, 256
#: Rows after which a scan's bounds are brought up to date.
STEP = 512
#: Queries that are compared with everything, and the part of their neighbours that the lists to be read must hold.
AUDITED, RECALL = 64, 0.98
#: The sample that the lists' centres are fitted on: rows, bytes of doubles, and rounds. There are a sixteenth as many
#: centres at most.
SAMPLE, SAMPLE_BYTES, ROUNDS = 65_536, 64 << 20, 6
#: Dimensions of a column block, and the test's width: an estimate may be 1 + WIDTH / sqrt(t) times too long.
COLUMNS, WIDTH = 16, 2.1
#: Distances that differ by less may be the same.
CLOSE = 1e-9
#: A squared distance beyond all.
FAR = 8.0
#: Vectors that this share or more of the queries have are answered in as many parts.
SHARE = 64


def scaled(vectors: list[list[float] | None]) -> tuple[np.ndarray, list[bytes]]:
    """Which vectors can be compared, and these as bytes of doubles, zeros at the end left out and scaled by a power of two,
    which is exact."""
    good, out = [], []
    for i, x in enumerate(vectors):
        if x is None or None in x:
            continue
        v = np.array(x, np.float64)
        top = np.abs(v).max(initial=0)
        if top > 0 and np.isfinite(top):
            v = np.ldexp(v, -int(np.frexp(top)[1])) + 0.0
            good.append(i)
            out.append(v[: np.flatnonzero(v)[-1] + 1].tobytes())
    return np.array(good, np.int64), out


def opened(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim))
    for i, x in enumerate(blobs):
        v = np.frombuffer(x)
        out[i, : len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means of unit vectors by cosine, started at vectors of the sample; a centre that loses all starts anew at one."""
    rng = np.random.default_rng(11)
    x = unit(sample)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        lost = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", sums, sums)) < 1e-12)
        sums[lost] = x[rng.choice(len(x), len(lost))]
        centres = unit(sums)
    return centres


def scan(block: np.ndarray, queries: np.ndarray, far: np.ndarray, keep: int, columns: int = COLUMNS, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) of rotated unit vectors that may be among each query's `keep` nearest of the block and within
    far, its squared distance that counts, and how many numbers were compared. The first rows are compared in full, the
    others STEP at a time, after each of which far is what the best so far allow."""
    n, dim = block.shape
    best = np.full((len(queries), keep), np.inf)
    pairs, compared, begin = [], 0, 0
    while begin < n:
        rows = block[begin : begin + (STEP if begin else max(4 * keep, 64))]
        to = min(columns, dim) if begin else dim
        a, b = queries[:, :to], rows[:, :to]
        part = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
        compared += part.size * to
        allowed = lambda t: (far if t == dim else far * (t / dim) * (1 + width / np.sqrt(t)) ** 2) + CLOSE  # noqa: E731, B023
        q, r = np.nonzero(part <= allowed(to)[:, None])
        part = part[q, r]
        while to < dim and len(q):
            at, to = to, min(to + columns, dim)
            gap = queries[q, at:to] - rows[r, at:to]
            part += np.einsum("ij,ij->i", gap, gap)
            compared += gap.size
            live = part <= allowed(to)[q]
            q, r, part = q[live], r[live], part[live]
        found = np.full((len(queries), len(rows)), np.inf)
        found[q, r] = np.maximum(part, 0)
        best = np.partition(np.concatenate([best, found], axis=1), keep - 1, axis=1)[:, :keep]
        far = np.minimum(far, best.max(axis=1))
        pairs.append((q, r + begin, part))
        begin += len(rows)
    q, r, part = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(3))
    near = part <= far[q] + CLOSE
    return q[near], r[near], compared


def nearest(vectors: DataFrame, asked: DataFrame, keep: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): to each query the `keep` rows with the largest cosine that the index finds, itself
    left out, ties to the smaller id; all if there are fewer. asked: the ids (column id_col) of rows that are queries.

    Equal vectors are searched as one: it keeps the keep + 1 least ids, as no others can be among anyone's nearest. Lists
    of about LIST distinct vectors have centres from k-means over a sample of at most SAMPLE vectors and SAMPLE_BYTES; all
    vectors are indexed. AUDITED queries are compared with all vectors, which tells how many lists hold `recall` of what is
    nearest: few if the vectors lie in clusters, half of them or more if they lie at random. A query reads its nearest
    list first, and then, with the distance that this gives as a bound, the others, and on until the lists hold more
    vectors than keep. Lists are dealt in blocks of BLOCK rows, so a crowded one is scanned by several tasks. Scores are
    cosines of the original vectors in doubles.

    Vectors that are null, zero, or hold null or non-finite components take no part; of unlike lengths the shorter counts
    as if padded with zeros. Rows with a null id take no part either. Rows that are alike in both are
    one; rows that share an id but not the vector are queries and candidates each by itself. Queries without any candidate, and an empty table, give no rows. Other columns are
    ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    more = keep + 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, values = (batch.column(c).slice(at, 1024).to_pylist() for c in ("id", "v"))
                good, blobs = scaled(values)
                yield {"id": np.array([ids[i] for i in good], np.int64), "v": blobs, "dim": np.array([len(b) // 8 for b in blobs], np.int32)}

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = scratch.write(map_rows(rows, "id long, v binary, dim int", parse).withColumn("hash", F.xxhash64("v")), "rows")
    # The least ids of each distinct vector; a row's number within a group ends early in every task.
    order = Window.partitionBy("hash", "v").orderBy("id")
    least = rows.select("hash", "v", "id", "dim").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= more)
    groups = least.groupBy("hash", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim"))
    groups = scratch.write(groups, "groups")
    dims, count = groups.agg(F.coalesce(F.max("dim"), F.lit(1)), F.count("*")).first()
    dim = int(dims)
    width = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    cut = (1 << 40) if count <= width else int((1 << 40) * (width - 4 * width**0.5) / count)
    drawn = [r["v"] for r in groups.where(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 40)) < cut).select("v").limit(width).collect()]
    lists = max(1, min(count // LIST, width // 16))
    centres = centres_of(opened(drawn, dim), lists) if drawn else np.ones((1, dim))
    lists = len(centres)
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(opened(part.column("v").to_pylist(), dim))
                yield {"list": np.argmax(x @ centres.T, axis=1).astype(np.int32), "v": part.column("v"), "ids": part.column("ids"), "hash": part.column("hash")}

    index = scratch.write(map_rows(groups.select("hash", "v", "ids"), "list int, v binary, ids array<long>, hash long", deal), "index")
    held = np.zeros(lists, np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():
        held[r["list"]] = r["n"]
    blocks = np.maximum(1, -(-held // BLOCK))

    wanted = asked.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    queries = rows.join(wanted, "id", "left_semi").select("id", "hash", "v").distinct()
    distinct = queries.groupBy("hash", "v").agg(F.count("*").alias("n")).withColumn("gid", F.monotonically_increasing_id())
    distinct = scratch.write(distinct, "asked")
    queries = scratch.write(queries.join(distinct.select("hash", "v", "gid"), ["hash", "v"]).select("id", "gid"), "queries")
    near = probes(index, distinct, centres, more, recall)

    def probe(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[dict]:
        """A row for every list and block that a query is to read."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blobs, fars = part.column("v").to_pylist(), part.column("far").to_pylist()
                ranked = np.argsort(-(unit(opened(blobs, dim)) @ centres.T), axis=1, kind="stable")
                out: dict[str, list] = {"list": [], "block": [], "gid": [], "q": [], "far": []}
                for i, gid in enumerate(part.column("gid").to_pylist()):
                    enough = 1 + int(np.searchsorted(np.cumsum(held[ranked[i]]), more))
                    for of in ranked[i, :1] if first else ranked[i, 1 : max(near, enough)]:
                        for b in range(blocks[of]):
                            for c, x in zip(out.values(), (int(of), b, gid, blobs[i], fars[i]), strict=True):
                                c.append(x)
                yield out

    schema = "gid long, vec_id long, score double, d double, same boolean"
    into = arrow_schema(schema)

    def answer(asking: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows or not asking.num_rows:
            return into.empty_table()
        ids, own = block.column("ids").to_pylist(), block.column("v").to_pylist()
        kept = opened(own, dim)
        lengths = np.sqrt(np.einsum("ij,ij->i", kept, kept))
        turned = (kept / lengths[:, None]) @ rotation(dim)
        found: dict[str, list] = {f.name: [] for f in into}
        for at in range(0, asking.num_rows, TOGETHER):
            part = asking.slice(at, TOGETHER)
            blobs, gids = part.column("q").to_pylist(), part.column("gid").to_pylist()
            q = opened(blobs, dim)
            qn = np.sqrt(np.einsum("ij,ij->i", q, q))
            a, b, _ = scan(turned, (q / qn[:, None]) @ rotation(dim), part.column("far").to_numpy().astype(np.float64), more)
            score = np.einsum("ij,ij->i", q[a], kept[b]) / (qn[a] * lengths[b])
            by = np.lexsort((b, -score, a))
            a, b, score = a[by], b[by], score[by]
            begin = np.searchsorted(a, np.arange(len(q) + 1))
            for i in range(len(q)):
                mine = slice(begin[i], begin[i + 1])
                best = score[mine]
                # Rows as near as the last that counts stay: which ids they have decides.
                best = best[: int(np.searchsorted(-best, -best[more - 1], "right"))] if len(best) > more else best
                told = sorted((-s, x, own[r] == blobs[i]) for s, r in zip(best.tolist(), b[mine].tolist()) for x in ids[r])[:more]
                for less, x, same in told:
                    for c, y in zip(found.values(), (gids[i], x, -less, 2 + 2 * less, same), strict=True):
                        c.append(y)
        out = pa.table([pa.array(found[f.name], f.type) for f in into], schema=into)
        settle()
        return out

    salted = index.withColumn("block", F.pmod(F.xxhash64("hash", F.lit(3)), F.element_at(F.lit(blocks.tolist()), F.col("list") + 1)).cast("int"))

    def search(asking: DataFrame, first: bool, name: str) -> DataFrame:
        pairs = map_rows(asking, "list int, block int, gid long, q binary, far double", lambda batches: probe(batches, first))
        found = pairs.groupBy("list", "block").cogroup(salted.groupBy("list", "block")).applyInArrow(answer, schema)
        return scratch.write(found, name)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("gid").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= more)

    near_by = search(distinct.select("gid", "v", F.lit(FAR).alias("far")), True, "first")
    bound = best(near_by).groupBy("gid").agg(F.when(F.max("rank") == more, F.greatest(F.max("d"), F.lit(0.0)) + CLOSE).otherwise(FAR).alias("far"))
    known = distinct.join(bound, "gid", "left").select("gid", "v", F.coalesce("far", F.lit(FAR)).alias("far"))
    found = near_by.unionByName(search(known, False, "further")) if lists > 1 else near_by
    merged = best(found).groupBy("gid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "same"))).alias("found"))
    # At most SHARE vectors can each be those of so many queries; their answers are dealt to as many parts.
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = [r["gid"] for r in distinct.where(F.col("n") * SHARE >= max(total, SHARE * 100)).select("gid").collect()]
    wide = F.col("gid").isin(crowded) if crowded else F.lit(False)
    parts = F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(SHARE - 1))).otherwise(F.array(F.lit(0)))).alias("part")
    dealt = queries.withColumn("part", F.when(wide, F.pmod(F.xxhash64("id"), F.lit(SHARE)).cast("int")).otherwise(0))
    told = dealt.join(merged.select("gid", "found", parts), ["gid", "part"])
    others = F.slice(F.filter("found", lambda x: ~(x["same"] & (x["vec_id"] == F.col("id")))), 1, keep)
    return told.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def probes(index: DataFrame, asked: DataFrame, centres: np.ndarray, keep: int, recall: float) -> int:
    """How many lists, nearest first, hold `recall` of the keep nearest vectors of AUDITED queries. Every batch of the index
    tells its nearest to each."""
    if len(centres) == 1:
        return 1
    dim = centres.shape[1]
    drawn = [r["v"] for r in asked.orderBy(F.xxhash64("v", F.lit(5)), "v").limit(AUDITED).select("v").collect()]
    q = unit(opened(drawn, dim)) if drawn else np.zeros((0, dim))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scores, lists = np.full((len(q), 0), -2.0), np.zeros((len(q), 0), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                more = q @ unit(opened(part.column("v").to_pylist(), dim)).T
                of = np.broadcast_to(part.column("list").to_numpy(), more.shape)
                scores, lists = np.concatenate([scores, more], axis=1), np.concatenate([lists, of], axis=1)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                scores, lists = np.take_along_axis(scores, best, 1), np.take_along_axis(lists, best, 1)
        n = scores.shape[1]
        yield {"q": np.repeat(np.arange(len(q), dtype=np.int32), n), "list": lists.reshape(-1), "score": scores.reshape(-1)}

    told = map_rows(index.select("list", "v"), "q int, list int, score double", near)
    best = told.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).where(F.col("rank") <= keep)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    needed = sorted(int(place[r["q"], r["list"]]) + 1 for r in best.collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1
