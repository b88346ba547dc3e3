"""The corpus pipeline's stages on odd rows, and the whole of it on the smallest tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from graphmill.llm import near_dedup
from graphmill.llm.common import BLANKS, Scratch
from tests.llm.conftest import SMALL, TEXTS
from tests.llm.test_copies import norm, roots
from tests.llm.test_texts import check_pieces


def run_stage(spark, docs, name):
    return Scratch(spark, "test").write(dict(pipeline.STAGES)[name](spark, docs, SMALL), name)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty(spark, no_docs, name):
    out = run_stage(spark, no_docs, name)
    assert out.count() == 0 and (name == "packing" or out.columns == no_docs.columns)


def test_odd_rows(spark, docs):
    letters = run_stage(spark, docs, "language_id")
    assert letters.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in letters.collect()) == sorted(str(i) for i, t, *_ in TEXTS if t and any(c.isalpha() for c in t))
    once = run_stage(spark, docs, "exact_dedup")
    assert once.columns == docs.columns and once.count() == len({norm(t) for _, t, *_ in TEXTS})
    assert {r["doc_id"] for r in once.where("doc_id in (1, 2)").collect()} == {2}
    near = run_stage(spark, docs, "simhash_dedup")
    assert near.columns == docs.columns and near.where("doc_id in (6, 13)").count() == 1
    shown = run_stage(spark, docs, "pii")
    row = shown.where("doc_id = 14").first()
    assert shown.columns == docs.columns and shown.count() == len(TEXTS) and "@" not in row["text"] and row["n_chars"] == len(row["text"])
    assert shown.where("text is null").count() == 1 and shown.where("doc_id = 6").first()["text"] == docs.where("doc_id = 6").first()["text"]


def test_repeated_ids_are_judged_by_text(spark):
    rows = [(1, "a b"), (1, "ab"), (1, "other"), (2, "other"), (2, "third"), (3, "third"), (3, "third")]
    df = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, tag string")
    got = sorted((r["doc_id"], r["text"]) for r in run_stage(spark, df, "exact_dedup").collect())
    assert got == [(1, "a b"), (1, "other"), (2, "third")]


def brute_kept(texts):
    sets = {}
    for i, t in texts:
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = roots(sets, [(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b])])
    return sorted(i for i in sets if root[i] == i)


@pytest.mark.parametrize("shingles", [1 << 20, 900])
def test_near_copies_down_to_four_fifths(spark, sample, monkeypatch, shingles):
    monkeypatch.setattr(near_dedup, "SHINGLES", shingles)
    draw = random.Random(3)
    texts = [(r["doc_id"], r["text"]) for r in sample.collect()]
    for k in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        for edits in range(8):
            changed = [f"c{k}x{edits}" if draw.random() < edits / 200 else w for w in words]
            texts.append((10_000 + 10 * k + edits, " ".join(changed)))
    texts += [(20_000, "one two"), (20_001, "One  two"), (20_002, "one two three four five"), (20_003, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in run_stage(spark, df, "simhash_dedup").collect())
    # With small limits, cells are dealt anew and by pairs of blocks; nothing is missed either way.
    assert 145 not in kept and 177 not in kept and kept == brute_kept(texts)


def test_whole_pipeline(spark, sample):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "pii", "packing"] and "20" in BLANKS
    rows = pipeline.run(spark, SMALL).collect()
    groups: dict = {}
    for r in sample.collect():
        if any(c.isalpha() for c in r["text"]):
            groups.setdefault(norm(r["text"]), []).append((-len(r["text"]), r["doc_id"], r["text"]))
    kept = {min(g)[1]: min(g)[2] for g in groups.values()}
    kept = {i: kept[i] for i in brute_kept(kept.items())}
    from graphmill.llm import pii

    def mask(text):
        base, added = pii.find_spans(pii.trained(), text)
        out, end, at = "", 0, -1
        for kind, a, b in sorted(base + added, key=lambda s: (s[1], pii.ORDERED.index(s[0]))):
            if a < at:
                at = end = max(at, b)
                continue
            out += text[end:a] + f"[{kind.upper()}]"
            end = at = b
        return out + text[end:]

    check_pieces(rows, [(i, mask(t)) for i, t in kept.items()])


@pytest.mark.parametrize(("least", "links"), [(0.8, 0), (0.7, 1499)])
def test_families_below_the_threshold(least, links):
    """1500 sets of 48 that share 40, a similarity of 0.71: no pair is held on to, and pairs that reach the threshold join all."""
    import numpy as np

    sets = [np.r_[np.arange(40), 1000 + 8 * i + np.arange(8)] for i in range(1500)]
    bounds, flat = np.arange(1501) * 48, np.concatenate(sets)
    found = near_dedup.spanned(np.full(1500, 48), np.arange(1500), bounds, flat, least)
    assert len(found) == links and len(set(roots(range(1500), found).values())) == 1500 - links


def test_spanned_against_brute_force():
    import numpy as np

    draw = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(draw.integers(0, 12, draw.integers(0, 9))) for _ in range(25)]
        comp = draw.integers(0, 25, 25)
        bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
        found = near_dedup.spanned(np.diff(bounds), comp, bounds, np.concatenate(sets), 0.6)
        same = [(i, j) for i in range(25) for j in range(i) if comp[i] == comp[j]]
        like = lambda a, b: len(a) and len(b) and len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b))
        assert roots(range(25), found + same) == roots(range(25), same + [(i, j) for i in range(25) for j in range(i) if like(sets[i], sets[j])])


def test_languages_are_filled_in(spark):
    draw = random.Random(5)
    words = {"en": "the of and to in that is was he for it with as his on be at by had not".split(), "fr": "le la les des est une dans que pour qui sur pas avec tout mais nous vous elle".split()}
    rows = [(i, " ".join(draw.choices(words[lang], k=60)), lang if i > 9 else None, "a", 1) for i in range(400) for lang in [("fr", "en")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r["doc_id"] % 2, r["lang"]) for r in run_stage(spark, docs, "language_id").collect()} == {(1, "en"), (0, "fr")}


def test_near_copies_by_fingerprint(spark):
    """Long texts that repeat the same words share a fingerprint, whatever their sets of shingles are."""
    tail = lambda c: " ".join(f"{c}{i}" for i in range(20))
    texts = [(1, "red green blue " * 300 + tail("x")), (2, "red green blue " * 300 + tail("y")), (3, tail("z")), (4, None)]
    assert brute_kept([(i, t or "") for i, t in texts]) == [1, 2, 3, 4]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in run_stage(spark, df, "simhash_dedup").collect()) == [1, 3, 4]
