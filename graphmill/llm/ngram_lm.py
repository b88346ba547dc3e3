"""Language-model scores by a weighted backoff automaton over the n-grams of the corpus.

States are histories, arcs the n-grams that occur KEPT times or more, and a failure arc leads from each history to the
one without its first word. The automaton is dealt by hash to buckets; each chunk of texts asks the buckets for the arcs
and failure weights that its traversal meets, and then traverses all its texts at once."""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, arrow_schema, binary_slices, forget_finished, map_rows, settle, text_bytes
from graphmill.llm.langid import held_out

#: Longest n-grams, and how often training rows must have one that has several words.
ORDER, KEPT = 3, 2
#: Taken off every kept n-gram's count; added to every unigram's.
DISCOUNT, ADDED = 0.5, 0.1
#: Tokens and text bytes of a scoring chunk and, on average, text bytes of a bucket of n-grams.
GRAMS, CHUNK, BUCKET = 1_500_000, 9 << 20, 16 << 20
#: Histories of this share in a sample of about SAMPLE texts, of LEAD bytes each, have their n-grams dealt one by one.
HOT, SAMPLE, LEAD = 1e-4, 4000, 1 << 14
#: Hashes of the empty history and of the end and the start of a text; local ids of the latter.
ROOT, MARKS, SEED = 0x9E3779B97F4A7C15, (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7), 4
START = 1
END = 0


def words_of(data: bytes) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased; bytes.lower and bytes.split do just that."""
    return data.lower().split()


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 as their count, their width in bytes, and the bytes, compressed, the lowest of each first."""
    wide = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<QB", len(x), width) + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def joined(blobs: list[bytes], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpacked(x).astype(kind) for x in blobs)])


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of histories a followed by words b."""
    x = a * np.uint64(0x2545F4914F6CDD1D) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


@dataclass
class Level:
    """A chunk's distinct n-grams of one order, sorted by history. known: hashes of histories, all of the order below;
    first: index of the history; last: the last word's local id; key: hash of all; which: the n-gram at each token, -1 for
    none; past: the history at each token, -1 where it is too short or can't have a kept n-gram."""

    known: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    which: np.ndarray
    past: np.ndarray

    def dealt(self, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams' order by bucket, and their buckets in it; buckets, histories and lengths of the runs of n-grams of
        one bucket and history. A history's n-grams share a bucket, except a hot one's; other histories that a token has
        stand for an empty run at least."""
        filled, asked = np.zeros(len(self.known), bool), np.zeros(len(self.known), bool)
        filled[self.first] = True
        asked[self.past[self.past >= 0]] = True
        used = np.flatnonzero(filled | asked)
        history = self.known[used]
        spread = among(history, hot)
        # Of the histories that matter, their places in `used`, buckets, and order.
        place = np.zeros(len(self.known), np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        rank = np.empty(len(used), np.int64)
        rank[np.argsort(history)] = np.arange(len(used))
        home = (history % np.uint64(buckets)).astype(np.int64)
        alone = np.flatnonzero(~filled[used] & ~spread)
        at = np.concatenate([place[self.first], alone.astype(np.int32)])
        bucket = home[at]
        dealt = np.flatnonzero(spread[at[: len(self.first)]])
        bucket[dealt] = (self.key[dealt] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket * max(1, len(used)) + rank[at], kind="stable").astype(np.int32)
        bucket, whose = bucket[order], used.astype(np.int32)[at[order]]
        real = order < len(self.first)
        begin = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(whose) != 0)][: len(order)])
        return order[real], bucket[real], bucket[begin], whose[begin], np.add.reduceat(real.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)


def levels(tokens: np.ndarray, hashes: np.ndarray, order: int, kept: dict[int, np.ndarray]) -> Iterator[Level]:
    """By order, from 1, of texts of local ids that each begin with START and end with END. kept: which n-grams of two
    words or more are kept, by order, put there before the next order is asked for; an n-gram with a part that isn't kept
    is left out, as it can't be more frequent than its parts."""
    at = np.flatnonzero(tokens != START)
    word, before = tokens[at].astype(np.int32), tokens[at - 1].astype(np.int32)
    past, known, key = np.zeros(len(at), np.int32), np.array([ROOT], np.uint64), hashes
    del at
    which = past
    for k in range(1, order + 1):
        if k == 2:
            past, known = before, hashes
        elif k > 2:
            known, shorter = key, which
            past = np.where(before != START, np.r_[np.int32(-1), which[:-1]], np.int32(-1))
            if k - 1 in kept:
                good = np.r_[kept[k - 1], False]
                past = np.where(good[past], past, np.int32(-1))
                shorter = np.where(good[which], which, np.int32(-1))
            ok = (past >= 0) & (shorter >= 0)
            del shorter
        if k == 1:
            present = np.bincount(word, minlength=len(hashes)) > 0
            distinct, which = np.flatnonzero(present), (np.cumsum(present, dtype=np.int32) - np.int32(1))[word]
        else:
            if k == 2:
                ok = np.ones(len(word), bool)
            distinct, found = np.unique(past[ok].astype(np.int64) * len(hashes) + word[ok], return_inverse=True)
            which = np.full(len(word), -1, np.int32)
            which[ok] = found
            del found, ok
        first, last = (x.astype(np.int32) for x in np.divmod(distinct, len(hashes)))
        del distinct
        key = mixed(known[first], hashes[last])
        # Nothing but the level itself stays while it is worked on.
        yield (level := Level(known, first, last, key, which, past))
        del level, first, last


def chunks_of(rows: DataFrame) -> DataFrame:
    """Rows of (id, held, data) in chunks of bounded size, each a row of local word ids, the words' hashes, and by text
    the id, held and the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunk = TaskContext.get().partitionId() << 24  # type: ignore[union-attr]

        def blank() -> tuple[defaultdict, list, list, list, list]:
            local: defaultdict[bytes | int, int] = defaultdict()
            local.default_factory = local.__len__
            return local, [], [], [], []

        def closed() -> dict:
            hashes = np.array([*MARKS, *(xxhash.xxh64_intdigest(w, SEED) for w in list(local)[2:])], "<u8")
            trained = sum(n for n, h in zip(lengths, held, strict=True) if not h)
            row = {"chunk": chunk, "id": ids, "held": held, "length": lengths, "tokens": packed(np.concatenate(tokens)), "hashes": hashes.tobytes(), "trained": trained}
            return {k: [v] for k, v in row.items()}

        local, ids, held, lengths, tokens = blank()
        size = count = 0
        for batch in batches:
            for doc_id, out, data in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), binary_slices(batch.column("data")), strict=True):
                if not local:
                    local[END], local[START]
                words = words_of(data)
                ids_of = np.empty(len(words) + 2, "<i4")
                ids_of[0], ids_of[-1] = START, END
                ids_of[1:-1] = np.fromiter(map(local.__getitem__, words), np.int32, len(words))
                tokens.append(ids_of)
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(words) + 1)
                size, count = size + len(data), count + len(words) + 1
                if size > CHUNK or count > GRAMS:
                    yield closed()
                    local, ids, held, lengths, tokens = blank()
                    size, count, chunk = 0, 0, chunk + 1
        if ids:
            yield closed()

    return map_rows(rows, "chunk long, id array<long>, held array<boolean>, length array<int>, tokens binary, hashes binary, trained long", run)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(row["tokens"]).astype(np.int32), np.frombuffer(row["hashes"], "<u8"), np.array(row["held"], bool), np.array(row["length"], np.int64)


def hot_histories(rows: DataFrame, texts: int, order: int) -> np.ndarray:
    """Hashes of histories that a sample shows to be frequent. They decide where n-grams are counted, not which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, hashes, _, lengths = opened(row)
                yield {"history": np.array([ROOT], np.uint64).view(np.int64), "n": [int(lengths.sum())]}
                for k, level in enumerate(levels(tokens, hashes, order - 1, {}), 1):
                    n = np.bincount(level.which[level.which >= 0], minlength=len(level.key))
                    yield {"history": (hashes[level.last] if k == 1 else level.key)[n > 1].view(np.int64), "n": n[n > 1]}
                yield {"history": hashes[START : START + 1].view(np.int64), "n": [len(lengths)]}

    part = rows.where(F.pmod(F.xxhash64("id", "data"), F.lit(max(1, texts // SAMPLE))) == 0).withColumn("data", F.substring("data", 1, LEAD))
    seen = map_rows(chunks_of(part), "history long, n long", run).groupBy("history").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("history") == int(np.array([ROOT], np.uint64).view(np.int64)[0]), F.col("n")))
    frequent = seen.orderBy(F.desc("n")).limit(int(order / HOT))
    least = HOT * (seen.agg(total).first()[0] or 0) if texts else 0
    return np.array(sorted({int(np.int64(r["history"]).view(np.uint64)) for r in frequent.where(F.col("n") >= least).collect()} | {ROOT}), np.uint64)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; learned from rows
    whose crc32(id as text) mod folds is not 0.

    All words count, and all n-grams of up to `order` (2 or more) words that training rows have KEPT times or more, at any
    size of the corpus. A chunk of rows sends its distinct n-grams, with how often its training rows have each, to buckets
    by the hash of the history; a bucket adds up and answers each chunk with the counts and with how many kept n-grams
    follow a history, and how often. Words and pairs go first; longer n-grams are sent only if both their parts are kept,
    an order at a time. So neither texts nor single occurrences are shuffled. Histories that a sample shows to be frequent
    have their n-grams dealt one by one and what follows them added up at the end. Chunks and buckets are of bounded size
    on average. N-grams are told apart by 64-bit hashes: of 5e9 distinct ones, a pair or so is expected to share one.

    The kept n-grams are arcs, P(w | h) = (c(hw) - DISCOUNT) / c(h) + rest(h) P(w | h'), and the failure arc of h costs
    rest(h), what the discounts and dropped n-grams leave; so the probabilities of a history add up to 1. A traversal is in
    the state of the longest history that has a kept n-gram, and fails to shorter ones until one has an arc.

    Null and empty texts are the end alone. Null ids count as training rows. Repeated rows count and are scored as
    often as they occur. Without training rows every token has the same probability. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, folds).alias("held"), text_bytes(F.col(text_col)).alias("data"))
    texts, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    buckets, hot = 1 + size // BUCKET, hot_histories(rows, texts, order)
    chunks = scratch.write(chunks_of(rows), "chunks")
    total = chunks.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]

    def message(row: dict, hashes: np.ndarray, k: int, level: Level, train: np.ndarray) -> Iterator[dict]:
        n = np.bincount(level.which[train & (level.which >= 0)], minlength=len(level.key)).astype(np.int32)
        by, bucket, run_bucket, run, long = level.dealt(hot, buckets)
        n, word, history = n[by], hashes[level.last[by]], level.known[run]
        named = np.unique(run_bucket)
        cuts, starts = np.searchsorted(bucket, np.r_[named, buckets]), np.searchsorted(run_bucket, np.r_[named, buckets])
        for j, b in enumerate(named.tolist()):
            part, runs = slice(cuts[j], cuts[j + 1]), slice(starts[j], starts[j + 1])
            words, at_word = np.unique(word[part], return_inverse=True)
            yield {
                "chunk": row["chunk"], "k": k, "bucket": b, "history": packed(np.diff(history[runs], prepend=np.uint64(0))), "long": packed(long[runs]), "n": packed(n[part]),
                "words": packed(np.diff(words, prepend=np.uint64(0))), "word": packed(at_word),
            }

    asking = "chunk long, k int, bucket int, history binary, long binary, n binary, words binary, word binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens, hashes, held, lengths = opened(row)
                train = np.repeat(~held, lengths)
                for k, level in enumerate(levels(tokens, hashes, 2, {}), 1):
                    for sent in message(row, hashes, k, level, train):
                        yield {c: [v] for c, v in sent.items()}

    def told_counts(told: pa.Table, k: int, level: Level) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Counts of the level's n-grams, the histories of the runs, and the answers."""
        mine = told.filter(pa.compute.equal(told.column("k"), k))
        by, _, _, run, _ = level.dealt(hot, buckets)
        counts = np.zeros(len(level.key), np.int64)
        counts[by] = joined(mine.column("sums").to_pylist())
        return counts, run, mine

    def ask_more(k: int):
        def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
            row, told, kept = chunk.to_pylist()[0], answers.sort_by("bucket"), {}
            tokens, hashes, held, lengths = opened(row)
            sent: list[dict] = []
            for j, level in enumerate(levels(tokens, hashes, k, kept), 1):
                if j == k:
                    sent = list(message(row, hashes, k, level, np.repeat(~held, lengths)))
                elif j > 1:
                    kept[j] = told_counts(told, j, level)[0] >= KEPT
            settle()
            return pa.Table.from_pylist(sent, schema=into)

        into = arrow_schema(asking)
        return run

    def count(group: pa.Table) -> pa.Table:
        k, bucket = group.column("k")[0].as_py(), group.column("bucket")[0].as_py()
        column = lambda c: group.column(c).to_pylist()
        undone = lambda blob: np.cumsum(unpacked(blob), dtype=np.uint64)
        parts = [undone(x) for x in column("history")]
        runs, history = [len(x) for x in parts], np.concatenate(parts)
        parts = [undone(x)[unpacked(y).astype(np.int64)] for x, y in zip(column("words"), column("word"), strict=True)]
        grams, word = [len(x) for x in parts], np.concatenate(parts)
        del parts
        distinct, of = np.unique(history, return_inverse=True)
        of_each = np.repeat(of, joined(column("long")))
        _, at, found = np.unique(mixed(distinct[of_each], word), return_index=True, return_inverse=True)
        sums = np.bincount(found, joined(column("n")), len(at)).astype(np.int64)
        sums = np.where(sums >= (KEPT if k > 1 else 1), sums, 0)
        follow = np.bincount(of_each[at], sums > 0, len(distinct)).astype(np.int64)
        mass = np.bincount(of_each[at], sums, len(distinct)).astype(np.int64)
        wide = np.flatnonzero(np.isin(distinct, hot))
        cut = lambda x, parts: [packed(y) for y in np.split(x, np.cumsum(parts)[:-1])]
        m, w = group.num_rows, len(wide)
        out = pa.table({
            "chunk": pa.array(group.column("chunk").to_pylist() + [None] * w, pa.int64()), "k": pa.array([k] * (m + w), pa.int32()), "bucket": pa.array([bucket] * (m + w), pa.int32()),
            "sums": pa.array(cut(sums[found], grams) + [None] * w, pa.binary()), "follow": pa.array(cut(follow[of], runs) + [None] * w, pa.binary()), "mass": pa.array(cut(mass[of], runs) + [None] * w, pa.binary()),
            "history": pa.array([None] * m + distinct[wide].view(np.int64).tolist(), pa.int64()), "wide": pa.array([None] * m + follow[wide].tolist(), pa.int64()), "heavy": pa.array([None] * m + mass[wide].tolist(), pa.int64()),
        })
        settle()
        return out

    answered = "chunk long, k int, bucket int, sums binary, follow binary, mass binary, history long, wide long, heavy long"
    tell = lambda asked, name: scratch.write(asked.groupBy("k", "bucket").applyInArrow(count, answered), name)
    answers = tell(map_rows(chunks, asking, ask), "answers-2")
    for k in range(3, order + 1):
        forget_finished(spark)
        told = answers.where(F.col("chunk").isNotNull()).select(F.col("chunk").alias("of"), "k", "bucket", "sums")
        asked = chunks.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(ask_more(k), asking)
        answers = answers.unionByName(tell(asked, f"answers-{k}"))
    forget_finished(spark)
    # Words and longer histories hash apart, so one table holds those of all orders.
    summed = answers.where(F.col("chunk").isNull()).groupBy("history").agg(F.sum("wide").alias("n"), F.sum("heavy").alias("m")).collect()
    wide = {int(np.int64(r["history"]).view(np.uint64)): (r["n"], r["m"]) for r in summed}
    after, heavy = (np.array([wide.get(h, (0, 0))[j] for h in hot.tolist()], np.int64) for j in (0, 1))
    known_words = wide.get(ROOT, (0, 0))[0]

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        tokens, hashes, held, lengths = opened(row)
        told, kept = answers.sort_by("bucket"), {}
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        counts = by_word = prob = base = known = np.zeros(0)
        for k, level in enumerate(levels(tokens, hashes, order, kept), 1):
            below = counts
            counts, run, mine = told_counts(told, k, level)
            if k == 1:
                prob = ((counts + ADDED) / (total + ADDED * (known_words + 1)))[level.which]
                base, known = np.log10(prob), counts[level.which] > 0
                by_word = np.zeros(len(hashes), np.int64)
                by_word[tokens[tokens != START]] = counts[level.which]
                by_word[START] = by_word[END]
                continue
            kept[k] = counts >= KEPT
            follow, mass = np.zeros(len(level.known), np.int64), np.zeros(len(level.known), np.int64)
            follow[run], mass[run] = joined(mine.column("follow").to_pylist()), joined(mine.column("mass").to_pylist())
            spread = np.flatnonzero(among(level.known, hot))
            place = np.searchsorted(hot, level.known[spread])
            follow[spread], mass[spread] = after[place], heavy[place]
            # A history that training rows don't have, or not followed by a kept n-gram, leaves all to the shorter one.
            seen = np.maximum(by_word if k == 2 else below, 1)
            rest = 1 - (mass - DISCOUNT * follow) / seen
            at = level.past >= 0
            state, arc = level.past[at], level.which[at]
            own = np.where(arc >= 0, np.maximum(np.r_[counts, 0][arc] - DISCOUNT, 0) / seen[state], 0)
            prob[at] = own + rest[state] * prob[at]
        add = lambda x: np.bincount(owner, x, len(lengths))
        out = pa.table({
            "id": pa.array(row["id"], pa.int64()), "held_out": held, "n_tokens": lengths, "n_known": add(known).astype(np.int64),
            "train_tokens": np.full(len(lengths), total, np.int64), "base_score": add(base), "score": add(np.log10(prob)),
        })
        settle()
        return out

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = answers.where(F.col("chunk").isNotNull()).drop("history", "wide", "heavy").withColumnRenamed("chunk", "of")
    return chunks.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
