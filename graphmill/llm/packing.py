"""Sequence packing controlled by a mixture of sources: deficit round-robin with exact carries."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache as once
from sys import getsizeof
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, binary_slices, map_rows, settle, text_bytes

#: Tokens of a sequence; tokens that a chunk of documents holds on average; id that ends a document.
WINDOW, CHUNK, END = 2048, 1 << 21, 1
#: A source with less credit than this waits for the next round, unless its document ends sooner; the share of its part
#: of a round that a source may catch up or give back.
LEAST, SWAY = 32, 0.1
#: Bytes of words that a Python worker remembers, a third more being for their pieces; what an entry takes besides its key
#: and value; the longest word that is kept.
WORDS, ENTRY, LONGEST = 240 << 20, 180, 48
#: Chunks whose sums are added up together before running sums go over all of them.
BATCH = 1024
#: The tokenizer's split, words whose lower case and NFC are plain, and how byte-level BPE shows bytes.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u024f]*")
VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = [b for b in range(256) if b not in VISIBLE]
SHOWN = {b: 256 + i for i, b in enumerate(HIDDEN)}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts, for word_bpe_49k.json and tokenizers built like it: NFC, white space, lower case, then a
    split that never joins anything across ASCII white space, then BPE by piece. `encode` gives little-endian ids of
    `self.kind`.

    Words are remembered. A new word of letters and marks below U+0250, which are NFC already and whose lower case
    needs no context, goes piece by piece to the library's BPE model; any other word goes to the library as it is.
    """

    def __init__(self, path: str, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.pieces = Memory(self.word, words), Memory(self.piece, words // 3)

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
        return array(self.kind.char, [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def word(self, word: bytes) -> bytes:
        if word.isalpha() and word.isascii():
            return self.pieces[word.decode().lower()]
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            if text.isalpha():
                return self.pieces[text]
            head, tail = text[:-1], text[-1]
            if head.isalpha() and tail in ".,":
                return self.pieces[head] + self.pieces[tail]
            return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text)))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def forget(self) -> None:
        self.words.clear()
        self.pieces.clear()

    def encode(self, data: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, data.split()))


class Memory(dict):
    """Values of `make` by key, all forgotten when they take more than `limit` bytes; long keys are never kept."""

    def __init__(self, make: Callable, limit: int = WORDS):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        if len(key) <= LONGEST:
            if self.held >= self.limit:
                self.clear()
            self[key] = value
            self.held += ENTRY + len(key) + getsizeof(value)
        return value

    def clear(self) -> None:
        super().clear()
        self.held = 0


@once
def encoder(path: str, words: int = WORDS) -> WordEncoder:
    return WordEncoder(path, words)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", words: int = WORDS) -> DataFrame:
    """(row, id, source, tokens, ids): the ids of each text and END, little-endian; row tells all rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        code = encoder(path, words)
        end, width = np.array([END], code.kind).tobytes(), code.kind.itemsize
        at = TaskContext.get().partitionId() << 36  # type: ignore[union-attr]
        for batch in batches:
            size, begun, ids = 0, 0, []
            for row, data in enumerate(binary_slices(batch.column("data"))):
                ids.append(code.encode(data) + end)
                size += len(ids[-1])
                if size > 8 << 20 or row + 1 == batch.num_rows:
                    part = batch.slice(begun, row + 1 - begun)
                    yield {"row": np.arange(at, at + len(ids)), "id": part.column("id"), "source": part.column("source"), "tokens": [len(x) // width for x in ids], "ids": ids}
                    at, ids, size, begun = at + len(ids), [], 0, row + 1
        code.forget()

    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), text_bytes(F.col(text_col)).alias("data")), "row long, id long, source string, tokens long, ids binary", run)


def running(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df (chunk, keys, value) with the sum of value over all earlier chunks of the same keys. Chunks are added up in
    batches first, so that no task sorts them all."""
    earlier = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("batch", F.floor(F.col("chunk") / BATCH))
    sums = df.groupBy(*keys, "batch").agg(F.sum(value).alias("s"))
    sums = sums.select(*keys, "batch", earlier("s", Window.partitionBy(*keys).orderBy("batch")).alias("s"))
    inside = df.withColumn("inside", earlier(value, Window.partitionBy(*keys, "batch").orderBy("chunk")))
    return inside.join(sums, [*keys, "batch"]).withColumn(out, F.col("inside") + F.col("s")).drop("inside", "s", "batch")


def carries(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(chunk, source, target, carry): what each source of a chunk is owed from all earlier chunks, in tokens: its
    target share of what they hold, less what they hold of it. Sums by chunk and source stand for the rows."""
    held = tokens.groupBy("chunk", "source").agg(F.sum("tokens").alias("n")).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    earlier = running(held.groupBy("chunk").agg(F.sum("n").alias("n")), [], "n", "total").select("chunk", "total")
    owed = running(held, ["key"], "n", "served").join(earlier, "chunk").join(targets, F.col("source").eqNullSafe(F.col("name")), "left")
    share = F.coalesce("target", F.lit(0.0))
    return owed.select("chunk", "source", share.alias("target"), (share * F.col("total") - F.col("served")).cast("double").alias("carry"))


def serve(lengths: list[list[int]], target: list[float], carry: list[float], window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """(source, document, start, length) pieces in the order in which they are packed; they end at every window's end.

    lengths: of each source's queued documents. In each round every source that has documents left gets its share of a
    window as credit, shares being taken among such sources, and spends what credit it has; credit and debt go on to
    the next round and window. The carry from earlier chunks is paid off in parts of at most SWAY of a round's credit,
    so that it sways no window far from the targets.
    """
    credit, owed, head, done = [0.0] * len(lengths), list(carry), [0] * len(lengths), [0] * len(lengths)
    active, room = [s for s in range(len(lengths)) if lengths[s]], window
    while active:
        whole = sum(target[s] for s in active)
        for s in active:
            quantum = window * (target[s] / whole if whole else 1 / len(active))
            paid = min(max(owed[s], -SWAY * quantum), SWAY * quantum)
            owed[s] -= paid
            credit[s] += quantum + paid
            while head[s] < len(lengths[s]):
                left = lengths[s][head[s]] - done[s]
                take = min(left, int(credit[s]))
                if left - take < LEAST <= credit[s]:
                    take = left
                if take < min(LEAST, left) or take <= 0:
                    break
                credit[s] -= take
                while take:
                    n = min(take, room)
                    yield s, head[s], done[s], n
                    done[s] += n
                    take -= n
                    room = room - n or window
                if done[s] == lengths[s][head[s]]:
                    head[s], done[s] = head[s] + 1, 0
        active = [s for s in active if head[s] < len(lengths[s])]


def sequences(pieces: list[tuple[int, int, int, int]], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source, document, start, length, sequence, offset). All sequences are full windows but those of the rest, which
    is cut by its binary digits, so that the last sequences are of 1024, 512, ... tokens and none needs padding."""
    total = sum(p[3] for p in pieces)
    full, rest = divmod(total, window)
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    sequence, offset, size = 0, 0, window if full else (sizes or [0])[0]
    for source, doc, start, length in pieces:
        while length:
            n = min(length, size - offset)
            yield source, doc, start, n, sequence, offset
            start, length, offset = start + n, length - n, offset + n
            if offset == size:
                sequence, offset = sequence + 1, 0
                size = window if sequence < full else (sizes[sequence - full] if sequence - full < len(sizes) else 0)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, float] | None = None, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """The pieces of all documents, see PIECES; each id of a document, its end included, is in exactly one.

    targets: the wanted share of tokens by source; without it, shares are those that the sources have. Documents are
    dealt by a hash of their place to chunks of `chunk` tokens on average, so that each holds its part of every source,
    however the table is laid out. Windows follow the targets as long as the sources of a chunk last; what a chunk over-
    or underserves is in the next one's carry, known from sums by chunk and source. words: bytes of words that a worker
    remembers; more save time. Sequence ids hold the chunk and a number in it, so chunks are packed apart.

    Null texts are empty and give the single id END; null sources are a source; a source without a target is served
    when no other is left. Equal and repeated ids are separate documents. An empty table gives no rows. Other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    tokens = scratch.write(tokenize(docs, path, id_col, text_col, source_col, words), "tokens")
    total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    tokens = tokens.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(1 + total // chunk)))
    if targets is None:
        share = tokens.groupBy("source").agg(F.sum("tokens").alias("n"))
        goal = share.crossJoin(share.agg(F.sum("n").alias("all"))).select(F.col("source").alias("name"), (F.col("n") / F.col("all")).alias("target"))
    else:
        goal = docs.sparkSession.createDataFrame(list(targets.items()), "name string, target double")
    owed = scratch.write(carries(tokens, scratch.write(goal, "targets")), "carries")
    scratch.drop("targets")

    def fill(group: pa.Table, carry: pa.Table) -> pa.Table:
        sizes, ids, names = group.column("tokens").to_pylist(), group.column("ids"), group.column("id").to_pylist()
        kind = np.dtype(f"<u{len(ids[0].as_py()) // sizes[0]}") if sizes else np.dtype("<u4")
        debt = {s: (t, c) for s, t, c in zip(*(carry.column(n).to_pylist() for n in ("source", "target", "carry")), strict=True)}
        order = group.append_column("at", pa.array(np.arange(len(group)))).select(["source", "id", "tokens", "at"]).sort_by([("source", "ascending"), ("id", "ascending"), ("tokens", "ascending")])
        queues: dict[str | None, list[int]] = {}
        for s, row in zip(order.column("source").to_pylist(), order.column("at").to_pylist(), strict=True):
            queues.setdefault(s, []).append(row)
        rows = list(queues.values())
        shares = [debt.get(s, (0.0, 0.0)) for s in queues]
        pieces = list(serve([[sizes[r] for r in q] for q in rows], [t for t, _ in shares], [c for _, c in shares]))
        base = (group.column("chunk")[0].as_py() if len(group) else 0) << 26
        out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
        wide: dict[int, memoryview] = {}
        for s, d, start, length, sequence, offset in sequences(pieces):
            r = rows[s][d]
            if r not in wide:
                wide[r] = memoryview(np.frombuffer(ids[r].as_py(), kind).astype("<u4").tobytes())
            for k, v in zip(out, (names[r], start, length, zlib.crc32(wide[r][4 * start : 4 * (start + length)]), sizes[r], base + sequence, offset), strict=True):
                out[k].append(v)
            if start + length == sizes[r]:
                del wide[r]
        settle()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return tokens.groupBy("chunk").cogroup(owed.groupBy("chunk")).applyInArrow(fill, PIECES).withColumnRenamed("doc_id", id_col)
