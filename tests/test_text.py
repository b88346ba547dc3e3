"""Retrieval, planning and fusion."""

from __future__ import annotations

import random
from math import log

import pytest
from pyspark.sql import functions as F

from graphmill.functions import text
from graphmill.plans import planner
from graphmill.plans.graph import PropertyGraph


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("1", "function", "authenticateUser", "/src/auth.ts", "function authenticateUser(token)", "checks a token"),
        ("2", "class", "PaymentProcessor", "/src/pay.ts", "class PaymentProcessor", None),
        ("3", "function", "café_Crème", "/lib/x.ts", None, "the in the middle in the end"),
    ]
    return spark.createDataFrame(rows, "id string, kind string, name string, file_path string, signature string, docstring string")


def found(df):
    return [r["id"] for r in df.orderBy(F.desc("score"), "id").collect()]


def test_search(spark, nodes):
    g = PropertyGraph.of(nodes, spark.createDataFrame([], "id string, source string, target string, kind string, confidence double"))
    assert found(planner.search_text(g, "authenticate")) == ["1"]
    assert found(planner.search_text(g, "token")) == ["1"]
    assert found(planner.search_text(g, "nonsense")) == []
    for odd in ("", "()*\"", "AND OR", "{}[]^~"):
        assert found(planner.search_text(g, odd)) == []
    assert found(planner.search_text(g, "p", kind="class")) == ["2"]
    assert found(planner.search_text(g, "cafe creme")) == ["3"]
    assert found(planner.search_text(g, "c", file_path="/LIB")) == ["3"]
    assert found(planner.search_text(g, "p", mode="both")) == ["2"]


def test_tokens(spark, nodes):
    row = nodes.where("id = '3'").select(text.tokens(F.col("name")).alias("t")).first()
    assert row["t"] == ["cafe", "creme"] == text.plain_tokens("café_Crème")


def test_phrases_and_score(spark, nodes):
    match = text.Match((("in", "the"),))
    row = text.bm25(nodes, match, "id", ["docstring"]).first()
    lengths = [3, 0, 7]
    idf = log((3 - 1 + 0.5) / (1 + 0.5))
    mean = sum(lengths) / 3
    assert row["score"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 7 / mean)))
    assert text.bm25(nodes, text.Match((("the", "end"),)), "id", ["docstring"]).count() == 1
    assert text.bm25(nodes, text.Match((("end", "the"),)), "id", ["docstring"]).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0])], "id string, embedding array<float>")
    rows = text.vector_top(v, [1.0, 0.0], 5).collect()
    assert [(r["id"], round(r["score"], 6)) for r in rows] == [("a", 1.0), ("b", 0.707107)]


def test_rrf(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 9.0)], "id string, score double")
    rows = {r["id"]: r["score"] for r in text.rrf([a, b], 10).collect()}
    assert rows == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})


@pytest.mark.parametrize(("asked", "want"), [("what breaks if x", "impact"), ("src/app.ts", "structural"), ("Ends here.", "structural"), ("where is it", "natural_language"), ("a b c d e", "natural_language"), (" a b c ", "natural_language"), ("parser", "keyword")])
def test_classes(asked, want):
    assert planner.classify(asked) == want


def test_plans():
    plan = planner.plan_for("upstream of x", radius=1)
    assert (plan.query_class, plan.radius, plan.communities, plan.weights.graph) == ("impact", 1, True, 0.5)


def test_fusion_takes_the_last_position(spark):
    texts = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "id string, score double")
    near = spark.createDataFrame([("b", 1), ("b", 3), ("c", 2)], "id string, position int")
    nodes = spark.createDataFrame([("a", 0.0005, 1), ("b", None, 2), ("c", 9.0, 1)], "id string, page_rank double, community_id int")
    asked = spark.createDataFrame([(1,)], "community_id int")
    rows = {r["id"]: r["score"] for r in planner.fuse(texts, near, nodes, 10, communities=asked).collect()}
    assert rows == pytest.approx({"a": 0.4 + 0.2 * 0.5 + 0.1, "b": 0.4 * 0.5 + 0.3 / 63, "c": 0.3 / 62 + 0.2 + 0.1})


def test_unified_query(spark, nodes):
    edges = spark.createDataFrame([("e1", "1", "2", "calls", 1.0), ("e2", "2", "3", "calls", 1.0)], "id string, source string, target string, kind string, confidence double")
    g = PropertyGraph.of(nodes.withColumn("community_id", F.lit(1)), edges)
    assert [r["id"] for r in planner.query(g, "authenticateUser").collect()] == ["1"]
    wide = planner.query(g, "authenticateUser", plan=planner.PLANS["impact"]).collect()
    assert {r["id"] for r in wide} == {"1", "2", "3"} and wide[0]["id"] == "1"
    strict = planner.query(g, "authenticateUser", kind="function", strict_filter=True, plan=planner.PLANS["impact"]).collect()
    assert {r["id"] for r in strict} == {"1", "3"}


def test_index_equals_scan(spark, nodes, tmp_path):
    columns = planner.TEXT_COLUMNS
    rows = lambda df: sorted((r["id"], round(r["score"], 9)) for r in df.collect())
    matches = [text.parse("token"), text.parse("p"), text.parse("cafe creme"), text.parse("auth*"), text.Match((("in", "the"),)), text.Match((("the", "in", "th"),), True), text.Match((("the",), ("end",))), text.parse("nonsense"), None]
    index = text.TextIndex.write(nodes, "id", columns, str(tmp_path / "one"))
    for match in matches:
        assert rows(index.bm25(match)) == rows(text.bm25(nodes, match, "id", columns))
    only = nodes.where("kind = 'function'").select("id")
    assert rows(index.bm25(text.parse("p"), only)) == rows(text.bm25(nodes, text.parse("p"), "id", columns, F.col("kind") == "function"))
    changed = spark.createDataFrame([("2", "class", "Parser", "/src/pay.ts", "class Parser in the end", None), ("4", "class", "Token", "/t", None, None)], nodes.schema)
    gone = spark.createDataFrame([("1",)], "id string")
    after = nodes.where("id = '3'").unionByName(changed)
    index = index.updated(changed, "id", columns, gone, str(tmp_path / "two"))
    for match in matches:
        assert rows(index.bm25(match)) == rows(text.bm25(after, match, "id", columns))
    plan = index.bm25(text.parse("token class"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term" in text.TextIndex.read(spark, index.path).found(("token",), False)._jdf.queryExecution().executedPlan().toString() and plan
    g = PropertyGraph.of(after, spark.createDataFrame([], "id string, source string, target string, kind string, confidence double"))
    assert found(planner.search_text(g, "token", index=index)) == found(planner.search_text(g, "token")) == ["4"]


def test_segments_equal_a_fresh_index(spark, tmp_path):
    """After random updates, with merges; an update writes what it brings."""
    rng = random.Random(3)
    words = ["red", "green", "blue", "reddish", "grey"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    now = {i: some(rng.randrange(12)) for i in range(60)}
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "id long, text string")
    index = text.TextSegments.start(frame(now), "id", ["text"], str(tmp_path))
    asked = [text.parse(q) for q in ("red", "green blue", "re*")] + [text.Match((("red", "green"),)), text.Match((("gre",),), True)]
    for k in range(6):
        new = {i: some(rng.randrange(9)) for i in rng.sample(range(80), 6)}
        gone = rng.sample(range(60), 2)
        index = index.updated(frame(new), "id", ["text"], spark.createDataFrame([(i,) for i in gone], "id long"))
        if k == 0:
            first, last = (s.index.postings.count() for s in index.segments)
            assert last < 0.25 * first
        now = {i: t for i, t in now.items() if i not in gone} | new
        assert sum(s.count for s in index.segments) == len(now)
    assert len(index.segments) < 6
    fresh = text.TextIndex.write(frame(now), "id", ["text"], str(tmp_path / "fresh"))
    for match in asked:
        score = lambda found: {r["id"]: round(r["score"], 9) for r in found.collect()}
        assert score(index.bm25(match)) == score(fresh.bm25(match)) and score(fresh.bm25(match))


def test_postings_are_grouped_in_their_document(spark, tmp_path, monkeypatch):
    """No token is shuffled; rows that share an id and a length are one document, as a grouping of all tokens has it."""
    monkeypatch.setattr(text, "AT_A_TIME", 5)
    rows = [(1, "b a b Été"), (2, ""), (3, None), (4, "a"), (5, "c c c c c c b"), (None, "a b")]
    plain = lambda df: sorted(df.collect(), key=str)
    for more in ([], [(4, "b"), (None, "b a"), (5, "c")]):
        df = spark.createDataFrame(rows + more, "id long, text string").repartition(2)
        words = df.select("id", text.tokens(F.col("text")).alias("w")).select("id", F.size("w").alias("len"), F.posexplode("w").alias("position", "term"))
        want = plain(words.groupBy("term", "id", "len").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions")))
        found = text.postings(df, "id", "text")
        assert plain(found) == want and found.columns == ["term", "id", "len", "tf", "positions"]
        index = text.TextIndex.write(df, "id", ["text"], str(tmp_path / str(len(more))))
        assert plain(index.postings) == want
        assert plain(index.lengths) == plain(df.select("id", F.size(text.tokens(F.col("text"))).alias("len")))
        if not more:
            plan = text.postings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
