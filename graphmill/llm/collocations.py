"""Phrases whose words keep together, mined by naming adjacent pairs level by level.

A frequent word gets an id; a frequent phrase of k words is the pair of the ids of its first and of its last k - 1 words,
and gets an id of its own from a table of all such pairs. The pair is also a pair of parent pointers: following the left
ones gives a phrase's beginnings, following the right ones its ends, and a phrase lies inside longer ones exactly if
pointers lead to it."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, arrow_schema, binary_slices, forget_finished, map_rows, settle, text_bytes
from graphmill.llm.ngram_lm import packed, unpacked

#: Tokens of a chunk; bytes of a text that are split at a time; parts that a language's candidates are ranked in at first.
TOKENS, SLICE, PARTS = 1_000_000, 4 << 20, 16
#: Bits of a local number, and of a chunk's number within its partition; a partition's number has the other 23.
PLACES = 20
#: What a table of a level has besides what its names are told apart by: a chunk's row has seq and echo, the others the rest.
CHUNK = "chunk long, seq binary, echo int, local int, n long"
#: Lower-cases A-Z; ends of pieces become line ends and tabs blanks.
_FROM, _TO = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" "
TABLE = bytes.maketrans(_FROM, _TO)
END, NOTHING = b"\n", b""


def split(data: bytes) -> Iterator[list[bytes]]:
    """A text's words, END between its pieces and NOTHING at will, in lists of bounded size."""
    at = 0
    while at < len(data):
        to = at + SLICE
        if to < len(data):
            # The next place where no word is cut.
            while to < len(data) and data[to] not in b" \t\n.,;:!?\x0b\x0c\r":
                to += 1
        yield data[at:to].translate(TABLE).replace(b"\n", b" \n ").split(b" ")
        at = to


def chunks_of(rows: DataFrame, longest: int) -> DataFrame:
    """Rows (lang, data) in chunks of TOKENS tokens: a row with the local word numbers by position (seq; 0 ends a piece),
    and a row a word. A chunk that ends inside a piece is followed by the next longest - 1 tokens (echo), with which the
    phrases that begin in it end; what begins there counts in the next chunk."""
    into = f"{CHUNK}, lang string, word string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunk = TaskContext.get().partitionId() << PLACES  # type: ignore[union-attr]

        def closed(seq: np.ndarray, echo: int, words: dict[str, dict[bytes, int]]) -> Iterator[dict]:
            yield {"chunk": [chunk], "seq": [packed(seq)], "echo": [echo], "local": [None], "n": [None], "lang": [None], "word": [None]}
            counts = np.bincount(seq[: len(seq) - echo], minlength=int(seq.max(initial=0)) + 1)
            for lang, numbers in words.items():
                names = {w: i for w, i in numbers.items() if i > 0 and i < len(counts)}
                local = np.fromiter(names.values(), np.int32, len(names))
                none = pa.nulls(len(names))
                yield {"chunk": np.full(len(names), chunk), "seq": none, "echo": none, "local": local, "n": counts[local], "lang": [lang] * len(names), "word": pa.array(list(names), pa.binary()).cast(pa.string())}

        def blank() -> tuple[dict[str, dict[bytes, int]], list[np.ndarray], int]:
            number = itertools.count(1).__next__
            return defaultdict(lambda: defaultdict(number, {END: 0, NOTHING: -1})), [], 0

        words, parts, held = blank()
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), binary_slices(batch.column("data")), strict=True):
                texts = [*split(data), [END]] if len(data) <= SLICE else itertools.chain(split(data), [[END]])
                for tokens in texts:
                    numbers = np.fromiter(map(words[lang].__getitem__, tokens), np.int32, len(tokens))
                    numbers = numbers[numbers >= 0]
                    parts.append(numbers)
                    held += len(numbers)
                    while held >= TOKENS + longest:
                        seq = np.concatenate(parts)
                        yield from closed(seq[: TOKENS + longest - 1], longest - 1, words)
                        rest = seq[TOKENS:]
                        # The next chunk numbers its words anew.
                        spelled = {i: (of, w) for of, named in words.items() for w, i in named.items() if i > 0}
                        words, parts, held = blank()
                        chunk += 1
                        parts = [np.fromiter((0 if i == 0 else words[spelled[i][0]][spelled[i][1]] for i in rest.tolist()), np.int32, len(rest))]
                        held = len(rest)
        if held:
            yield from closed(np.concatenate(parts), 0, words)

    return map_rows(rows, into, run)


def named(pairs: DataFrame, keys: list[str], least: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """A table of ids and counts f of the keys that occur `least` times or more, and the ids as (of, at, id) for the chunks
    and local numbers that have them. All chunks' rows of a key meet once, which counts it and names it by the least of
    their places."""
    together = Window.partitionBy(*keys)
    place = F.shiftleft("chunk", PLACES) + F.col("local")
    met = pairs.select("chunk", "local", *keys, F.sum("n").over(together).alias("f"), F.min(place).over(together).alias("id")).where(F.col("f") >= least)
    own = F.col("id") == place
    told = met.select(F.col("chunk").alias("of"), F.col("local").alias("at"), "id", *(F.when(own, F.col(c)).alias(c) for c in (*keys, "f")))
    told = scratch.write(told, name)
    return told.where(F.col("f").isNotNull()).select("id", *keys, "f"), told.select("of", "at", "id")


def paired(seqs: DataFrame, told: DataFrame) -> DataFrame:
    """A level's chunks and pairs from the one below: positions whose numbers and the next ones' have ids are numbered
    by pair."""
    schema = f"{CHUNK}, left long, right long"
    into = arrow_schema(schema)

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return into.empty_table()
        key, seq, echo = chunk.column("chunk")[0].as_py(), unpacked(chunk.column("seq")[0].as_py()).astype(np.int32), chunk.column("echo")[0].as_py()
        ids = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
        ids[told.column("at").to_numpy()] = told.column("id").to_numpy()
        good = ids[seq] > 0
        start = np.flatnonzero(good[:-1] & good[1:])
        distinct, found = np.unique(seq[start].astype(np.int64) * len(ids) + seq[start + 1], return_inverse=True)
        counts = np.bincount(found[start < len(seq) - echo], minlength=len(distinct)).astype(np.int64)
        # As many positions as below, so that the echo is as long.
        numbers = np.zeros(len(seq), np.int32)
        numbers[start] = found + 1
        left, right = np.divmod(distinct, len(ids))
        m = len(distinct)
        head = pa.table([[key], [packed(numbers)], [echo], [None], [None], [None], [None]], schema=into)
        none = pa.nulls(m)
        rows = [np.full(m, key), none.cast(pa.binary()), none.cast(pa.int32()), np.arange(1, m + 1, dtype=np.int32), counts, ids[left], ids[right]]
        out = pa.concat_tables([head, pa.table([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(rows, into, strict=True)], schema=into)])
        settle()
        return out

    return seqs.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(run, schema)


def best(k: int) -> Column:
    """The lowest-scoring cut of phrases of k words as a struct (score, k, l, r), ties to the smallest k. Decimals of 38
    digits hold the products exactly for counts below 10^16."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (F.lit(1_000_000).cast("decimal(7,0)") * (wide(F.col("a")) * wide(F.col("a"))).cast("decimal(38,0)")).cast("decimal(38,0)")
    cuts = []
    for j in range(1, k):
        part, rest = F.col("begin")[j - 1], F.col("finish")[k - j - 1]
        cuts.append(F.struct(F.call_function("div", above, (wide(part) * wide(rest)).cast("decimal(38,0)")).alias("score"), F.lit(j).alias("k"), part.alias("l"), rest.alias("r")))
    return F.array_min(F.array(*cuts))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score, cut): each language's phrases of 2 to `longest` words that occur
    `least` times or more, by score descending, a descending, phrase ascending in byte order; all if top is null.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces, and those at blanks and tabs into words. a is how
    often the phrase occurs within pieces, overlaps included, n the language's words. Cut after k words, a phrase has l
    occurrences of its beginning and r of its rest; the cut with the lowest floor(1000000 a a / (l r)) counts, of equal ones
    the first. A phrase that lies inside a longer one (within `longest`) which has share % of its occurrences or more is
    left out.

    Each chunk of about TOKENS tokens tells its distinct names with their counts, so neither texts nor occurrences are
    shuffled; a name has at most one row a chunk. Chunks get back the ids of what is frequent and tell the adjacent pairs
    of those. Chunks end anywhere, also inside long texts and pieces. Sums are of 64 bits and products of 38 digits, exact
    for counts below 10^16, beyond which Spark's ANSI mode raises.

    Null languages count as `und` (as does that value itself), null texts as empty. Repeated rows count as often as they
    occur. Pieces without words, and an empty table, give nothing. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(F.col(text_col)).alias("data"))
    level = scratch.write(chunks_of(rows, longest), "level-1")
    pairs = level.where(F.col("seq").isNull())
    sizes = scratch.write(pairs.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    kept, told = named(pairs, ["lang", "word"], least, scratch, "names-1")
    once = F.array("f")
    phrases = [kept.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", once.alias("begin"), once.alias("finish"))]
    for k in range(2, longest + 1):
        level = scratch.write(paired(level.where(F.col("seq").isNotNull()).select("chunk", "seq", "echo"), told), f"level-{k}")
        scratch.drop(f"level-{k - 1}")
        forget_finished(spark)
        kept, told = named(level.where(F.col("seq").isNull()), ["left", "right"], least, scratch, f"names-{k}")
        before = phrases[-1]
        first = before.select(F.col("id").alias("left"), "lang", "phrase", "begin")
        rest = before.select(F.col("id").alias("right"), "last", "finish")
        grown = kept.join(first, "left").join(rest, "right")
        phrases.append(scratch.write(grown.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("begin", F.array("f")).alias("begin"), F.concat("finish", F.array("f")).alias("finish"), "left", "right"), f"phrases-{k}"))
    scratch.drop(f"level-{longest}")
    found = None
    for k in range(2, longest + 1):
        told = phrases[k - 1].withColumn("a", F.col("f")).withColumn("best", best(k))
        if k < longest:
            # All longer phrases with this one inside are at most as frequent as one that is a word longer.
            above = phrases[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            told = told.join(above, "id", "left").where(F.col("over").isNull() | (F.lit(100) * F.col("over") < F.lit(share) * F.col("a")))
        told = told.select("lang", "phrase", F.lit(k).alias("words"), "a", "best.l", "best.r", "best.score", F.col("best.k").alias("cut"))
        found = told if found is None else found.unionByName(told)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        near = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
        found = near.where(F.col("rank") <= top).drop("part", "rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score", "cut")
