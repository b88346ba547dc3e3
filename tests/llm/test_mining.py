"""Phrases, conversation repair and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import collocations, nearest, turns
from graphmill.llm.collocations import mine_phrases
from graphmill.llm.queries import QUERIES
from tests.llm.conftest import SMALL, TEXTS


def brute_phrases(rows, longest=3, least=10, share=50, top=2000):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        of = counts.setdefault(lang if lang is not None else "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                of.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        over: Counter = Counter()
        for w, a in found.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    over[w[i : i + k]] = max(over[w[i : i + k]], a)
        rows = []
        for w, a in found.items():
            if 100 * over[w] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def told(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("longest", "tokens", "slices"), [(2, 40, 64), (3, 7, 16), (4, 50, 1 << 20), (3, 1_000_000, 4 << 20)])
def test_phrases_against_brute_force(spark, monkeypatch, longest, tokens, slices):
    """Chunks that end inside texts, pieces and phrases change nothing."""
    rng = random.Random(longest)
    words = ["a", "b", "B", "c", "dd", "ée", "x\x00", " "]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice([None, "", " \t "]) if rng.random() < 0.1 else rng.choice([" ", "\t", "  "]).join(rng.choice(words) + rng.choice([""] * 9 + [".", ",", "\n", "!?", "\x0b"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += rows[:5]
    monkeypatch.setattr(collocations, "TOKENS", tokens)
    monkeypatch.setattr(collocations, "SLICE", slices)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("chunk", "n", "seq", "id", "f", "word", "phrase")}).coalesce(1)
    for least, share, top in ((3, 50, 2000), (2, 80, 7)):
        assert told(mine_phrases(df, longest=longest, least=least, share=share, top=top)) == brute_phrases(rows, longest, least, share, top)


def test_chunks_end_anywhere():
    """By hand, without Spark: a long text in small slices gives the same tokens."""
    text = "Aa bb,cc\tdd. " * 50
    whole = [w for part in collocations.split(text.encode()) for w in part if w]
    before = collocations.SLICE
    collocations.SLICE = 10
    try:
        assert [w for part in collocations.split(text.encode()) for w in part if w] == whole
    finally:
        collocations.SLICE = before
    assert whole[:6] == [b"aa", b"bb", b"\n", b"cc", b"dd", b"\n"]


def test_phrases_of_odd_tables(docs, no_docs, spark):
    assert mine_phrases(no_docs).count() == 0
    assert told(mine_phrases(docs, least=2)) == brute_phrases([(lang, t) for _, t, lang, _ in TEXTS], least=2)
    # Numbers whose products pass 64 bits.
    big = 3 * 10**12
    one = spark.createDataFrame([(big, [big + 5, big], [big + 9, big])], "a long, begin array<long>, finish array<long>")
    row = one.select(collocations.best(2).alias("b")).first()["b"]
    assert (row["score"], row["k"], row["l"], row["r"]) == (1_000_000 * big * big // ((big + 5) * (big + 9)), 1, big + 5, big + 9)


def test_phrase_query(spark, sample):
    rows = [(r["lang"], r["text"]) for r in sample.select("lang", "text").collect()]
    assert told(QUERIES["op11_collocations"](spark, SMALL)) == brute_phrases(rows)


def brute_repair(rows):
    """rows (turn, role, text) after damage: the contract's columns without conv_id, by search over all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    told = [t for t, _, _ in rows if t is not None]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @lru_cache(None)
    def best(i, made, inserts):
        """The least (cost, audit, repaired) of rows from i after the initials made, of which two are enough to go on."""
        options = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            options.append((0, "", ()))
        if inserts:
            for role in ("user", "assistant"):
                c, a, r = best(i, grown(made, role[0]), inserts - 1)
                options.append((3 + c, "I" + a, (f"{role}:", *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, made, 2)
            options.append((4 + c, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                c, a, r = best(i + 1, grown(made, role[:1] or "?"), 2)
                options.append((more + c, "K" + a, (f"{role}:{text}", *r)))
                for other in ("user", "assistant"):
                    c, a, r = best(i + 1, grown(made, other[0]), 2)
                    options.append((3 + more + c, "R" + a, (f"{other}:{text}", *r)))
        return min(options, default=(1 << 40, "", ()))

    def grown(made, x):
        out = made + x
        if not re.fullmatch("s?(ua)*u?", out):
            return "!"
        return out[:-2] if len(out) > 3 and out.endswith("ua") else out

    # From the end, so that no call goes deep.
    states, new = {""}, [""]
    while new:
        found = {grown(made, x) for made in new for x in "sua?"} - states
        states, new = states | found, list(found)
    for i in range(len(rows), -1, -40):
        for made in states:
            best(i, made, 2)
    cost, audit, repaired = best(0, "", 2)
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()


def brute_damage(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        group = out.setdefault(conv, [])
        spaced = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else spaced[2], "" if kind == 1 else re.sub("[.!?]", "", spaced[3]) if kind == 2 else spaced[3])
            group += [row] * (2 if kind == 3 else 1)
    return out


ODD = [
    (None, 0, "user", "a null id."), (None, None, None, None), (None, 0, "user", "a null id."), (2, None, "assistant", "no turn"), (2, 3, "user", None), (2, 9, "", "x."), (2, 9, "system", "x."), (2, 9, "system", "x."), (2, -4, "User", "ü? \n"),
    (3, 0, "system", "s."), (4, 0, "user", ""), (5, 7, "assistant", "."), (6, 1, "user", "one."), (6, 2, "user", "two"), (6, 3, "assistant", "three"), (6, 4, "assistant", "four."), (6, 4, "umpire", "four."), (6, 5, "system", "late."),
]


@pytest.mark.parametrize(("rows", "size"), [(4096, 1 << 20), (1, 1), (3, 40)])
def test_repair_against_brute_force(spark, monkeypatch, rows, size):
    """However conversations are cut into segments."""
    rng = random.Random(rows)
    made = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", "u", None]), rng.choice(["a.", "b", "c?", " ", "", "a.\n", None, "d!"])) for c in range(20, 45) for _ in range(rng.randrange(9))]
    monkeypatch.setattr(turns, "ROWS", rows)
    monkeypatch.setattr(turns, "BYTES", size)
    table = spark.createDataFrame([*ODD, *made, *made[:9]], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("part", "seg", "said", "copies", "new", "place")})
    found = turns.with_lost(turns.repair_conversations(turns.damage(table)), table)
    got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {c: brute_repair(group) for c, group in brute_damage([*ODD, *made, *made[:9]]).items()}
    assert turns.repair_conversations(table.limit(0)).count() == 0


def test_repaired_turns_and_one_large_conversation(spark):
    """Half of all rows in one conversation, many of them alike."""
    table = spark.range(1200).selectExpr("if(id % 2 = 0, -7, id) as conv_id", "id div 4 as turn", "if(id % 8 < 4, 'user', 'assistant') as role", "if(id % 16 = 2, 'said again.', concat('t', id div 4, '.')) as text")
    found = {r["conv_id"]: r for r in turns.repair_conversations(table).collect()}
    rows = [(r["turn"], r["role"], r["text"]) for r in table.where("conv_id = -7").collect()]
    want = brute_repair(rows)
    assert tuple(found[-7])[1:] == want and len(found) == 601
    kept = turns.repaired_turns(table.where("conv_id = -7")).orderBy("place").collect()
    assert [r["place"] for r in kept] == list(range(len(kept)))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == want[-1]
    assert "".join(r["edit"] for r in kept) == want[-2].replace("D", "")


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_turns"](spark, SMALL).collect()}
    assert got == {c: brute_repair(group) for c, group in brute_damage(rows).items()}


def brute_nearest(rows, asked, keep):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    good = sorted({(i, tuple(v)) for i, v in good})
    width = max((len(v) for _, v in good), default=1)
    pad = np.array([[*v, *[0] * (width - len(v))] for _, v in good])
    pad /= np.abs(pad).max(axis=1, keepdims=True)
    pad /= np.linalg.norm(pad, axis=1, keepdims=True)
    out = []
    for k, (i, _) in enumerate(good):
        if i in asked:
            s = pad @ pad[k]
            best = sorted((-round(float(x), 9), good[j][0]) for j, x in enumerate(s) if j != k)[:keep]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(best, 1)]
    return sorted(out)


def near(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9) + 0.0) for r in found.collect())


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (8, [0.0, 4.0]), (9, [2.0**1000, 2.0**1000]), (10, [2.0**-1000, 0.0]), (11, []), (12, [1.0]), (13, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])]
    rows += [(1, [1.0, 0.0]), (2, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "hash", "list", "gid", "block", "score", "rank")})
    for keep in (1, 5, 50):
        got = near(nearest.nearest(df, df, keep=keep))
        assert got == brute_nearest(rows, {i for i, _ in rows}, keep)
    assert nearest.nearest(df.limit(0), df, keep=5).count() == 0
    assert nearest.nearest(df, df.limit(0), keep=5).count() == 0
    assert nearest.nearest(df.where("vec_id = 1"), df, keep=5).count() == 0


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n // 50, dim))[rng.integers(0, n // 50, n)] + 0.4 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("spread", [True, False])
def test_nearest_recall_and_crowds(spark, monkeypatch, spread):
    """Clusters and vectors at random, a third of the rows one and the same vector, many lists and several blocks a list."""
    monkeypatch.setattr(nearest, "LIST", 100)
    monkeypatch.setattr(nearest, "BLOCK", 60)
    x = clustered(3000, 24, 3) if spread else np.random.default_rng(3).standard_normal((3000, 24))
    rows = [(i, (x[7] if i % 3 == 0 else x[i]).astype(np.float32).tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = near(nearest.nearest(df, df.where("vec_id % 50 = 0"), keep=5))
    want = brute_nearest([(i, [float(y) for y in v]) for i, v in rows], set(range(0, 3000, 50)), 5)
    assert len(got) == len(want)
    assert len({(a, b) for a, _, b, _ in got} & {(a, b) for a, _, b, _ in want}) >= 0.93 * len(want)
    crowd = [g for g in got if g[0] % 3 == 0]
    assert crowd == [w for w in want if w[0] % 3 == 0] and all(s == 1 for *_, s in crowd)


def test_scan_abandons_and_keeps():
    """The test leaves out little of what is near and compares a part of all numbers."""
    x = nearest.unit(clustered(4000, 128, 5)) @ nearest.rotation(128)
    q = x[:40]
    a, b, compared = nearest.scan(x, q, np.full(40, nearest.FAR), 6)
    kept = set(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-(x @ q[i]))[:6]}
    assert len(want & kept) >= 0.98 * len(want) and compared < 0.6 * 40 * x.size
    assert np.allclose(nearest.rotation(128) @ nearest.rotation(128).T, np.eye(128))


def test_nearest_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = near(QUERIES["op13_nearest"](spark, SMALL))
    assert got == brute_nearest(rows, {i for i, _ in rows if i % 50 == 0}, 5)
