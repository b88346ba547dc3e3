"""Exact and near copies, and components, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from graphmill.llm import embed_dedup, simhash
from graphmill.llm.common import Scratch
from graphmill.llm.components import connected_components, spanning
from graphmill.llm.exact_dedup import exact_dedup
from graphmill.llm.queries import QUERIES
from tests.llm.conftest import SMALL, TEXTS


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_edges(docs, digest_all):
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup(docs, digest_all=digest_all).collect())
    groups: dict[str, list] = {}
    for i, t, *_ in TEXTS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for members in groups.values():
        keep = min(members)[3]
        want += [(str(m[3]), str(keep), len(members), m[3] == keep) for m in members]
    assert got == sorted(want)
    digests = {r["doc_id"]: r["digest"] for r in exact_dedup(docs, digest_all=digest_all).collect()}
    assert bytes(digests[1]).hex() == hashlib.sha256(norm(TEXTS[0][1]).encode()).hexdigest()
    assert (digests[11] is None) != digest_all


def test_exact_hot_group(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t', id) end as text")
    found = exact_dedup(rows)
    assert found.where("kept").count() == 2001 and found.where("group_size = 1000 and keep_id = 0").count() == 1000


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    texts = [t for _, t, *_ in TEXTS if len(t or "") < 1000]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [brute_fingerprint(t) for t in texts]
    cut = list(simhash.word_blocks(b" a bb\tccc  dddd " * 30, 7))
    assert len(cut) > 20 and [w for part in cut for w in part] == (b" a bb\tccc  dddd " * 30).split()


def test_simhash_edges(docs, no_docs):
    rows = simhash.simhash_dedup(docs).collect()
    prints = {}
    for i, t, *_ in TEXTS:
        prints.setdefault(i, simhash.fingerprint((t or "").encode()))
    assert len(rows) == len(TEXTS) and all(r["fp"] & (1 << 64) - 1 == prints[r["doc_id"]] for r in rows)
    near = [(a, b) for a in prints for b in prints if a and b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots([i for i in prints if i], near)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"]} == want and want[4] == want[5] == 3 and want[13] == 6
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert simhash.simhash_dedup(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_vantage_point_links_are_exact(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "LEAF", 4)
    draw = random.Random(seed)
    points = [draw.getrandbits(64) for _ in range(500)]
    for _ in range(600):
        points.append(draw.choice(points) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) * draw.randrange(2))
    points += [points[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    scratch = Scratch(spark, "test")
    links = simhash.hamming_links(scratch, spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5))
    assert links.count() < 3 * len(points)
    found = {r["id"]: r["root"] for r in connected_components(scratch, links).collect()}
    all_points = np.array(points, np.uint64)
    near = [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(all_points ^ all_points[i]) <= 2) if j != i]
    want = roots(range(len(points)), near)
    ours: dict = {}
    for i, s in enumerate(signed):
        ours.setdefault(found.get(s, s), set()).add(i)
    theirs: dict = {}
    for i, r in want.items():
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(80)] + [(draw.randrange(2000, 2100), draw.randrange(2000, 2100)) for _ in range(70)] + [(5, 5)]
    scratch = Scratch(spark, "test")
    found = {r["id"]: r["root"] for r in connected_components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({i for e in edges for i in e if e[0] != e[1]}, edges)
    assert len({(found[i], want[i]) for i in want}) == len(set(found.values())) == len(set(want.values()))
    assert connected_components(scratch, spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    labels = spanning(6, np.array([5, 4, 1]), np.array([4, 3, 0]))
    assert labels.tolist() == [0, 0, 2, 3, 3, 3]


def links_by_force(ids, vectors, threshold=0.95):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return near.sum(axis=1), roots(ids, [(ids[i], ids[j]) for i, j in np.argwhere(near)])


def test_vectors_against_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(0)
    base = draw.normal(size=(700, 24))
    near = base[draw.integers(0, 20, 500)] + draw.normal(scale=0.06, size=(500, 24))
    crowd = base[30] + draw.normal(scale=0.01, size=(400, 24))
    vectors = np.concatenate([base, near, crowd]).astype(np.float32)
    ids = draw.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors.tolist(), strict=True)), "vec_id long, embedding array<float>").repartition(3)
    degree, want = links_by_force(ids, vectors)
    monkeypatch.setattr(embed_dedup, "AUDIT", 50)
    rows = {r["vec_id"]: r for r in embed_dedup.similar_vectors(df, shard_bytes=50_000).collect()}
    got = np.array([rows[i]["n_links"] for i in ids])
    assert (got <= degree).all() and got.sum() >= 0.99 * degree.sum()
    assert np.mean([rows[i]["component_id"] == want[i] for i in ids]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows.values())


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, []), (8, [1.0, 0.0]), (12, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "'x' as v", "2 as id", "3 as label")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.similar_vectors(df, shard_bytes=50).collect())
    alone = [(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11)]
    assert got == sorted([("1", 4, 1, True), ("2", 4, 1, False), ("8", 4, 1, False), ("8", 4, 1, False), ("12", 4, 1, False), ("None", 0, None, True), *alone])
    assert embed_dedup.similar_vectors(df.limit(0)).count() == 0


def test_graph_alone_and_crowds():
    draw = np.random.default_rng(2)
    base = draw.normal(size=(6000, 32))
    near = base[draw.integers(0, 2000, 3000)] + draw.normal(scale=0.1, size=(3000, 32))
    crowd = base[7] + draw.normal(scale=0.2, size=(2500, 32))
    x = np.concatenate([base, near, crowd]).astype(np.float32)
    index = embed_dedup.Hnsw.build(embed_dedup.unit(x))
    found = embed_dedup.Links(index, x, np.ones(len(x), np.int64), x, np.arange(len(x)), 0.95)
    assert found.search() > 0.99
    degree, want = links_by_force(range(len(x)), x)
    assert (found.links <= degree).all() and (found.links == degree).mean() > 0.998 and (found.links[8500:] == degree[8500:]).all()


def test_huge_and_tiny_doubles(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [1.0, 2.0]), (4, [-1e300, 2e300])]
    got = sorted(tuple(r) for r in embed_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_copy_queries_on_whole_tables(spark, sample):
    rows = {r["doc_id"]: r for r in QUERIES["op6_simhash_dedup"](spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in sample.select("doc_id", "text").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    want = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {i: r["component_id"] for i, r in rows.items()} == want
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    degree, comp = links_by_force([r["vec_id"] for r in vectors], [r["embedding"] for r in vectors])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op2_embed_dedup"](spark, SMALL).collect()}
    assert got == {r["vec_id"]: (int(d), comp[r["vec_id"]]) for r, d in zip(vectors, degree, strict=True)}
