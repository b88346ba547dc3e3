"""Exact byte-level BPE by dynamic programming over prefixes, and its inverse."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache as once
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_rows
from graphmill.llm.packing import HIDDEN, Memory

#: The pre-tokenizer's pattern, with its white space spelled out, as libraries differ about controls.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NEVER = 1 << 62
#: Bytes of words, and pairs, that a Python worker remembers.
WORDS, PAIRS = 120 << 20, 1_000_000


class Codec:
    """Encodes and decodes like the tokenizer of a byte-level BPE file without normalizer.

    A byte string's BPE encoding is the one token sequence in which every neighbouring pair is compatible, that is, in
    which BPE of the pair's joined bytes gives the pair again. So each prefix has one last token: the only token that
    is a suffix of it, and compatible with the last token of the prefix before. An automaton with suffix links over the
    vocabulary lists the tokens that end at each position; back-pointers then give the ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        model = parsed["model"]
        byte_of = {chr(256 + i): b for i, b in enumerate(HIDDEN)}
        self.shown = {b: 256 + i for i, b in enumerate(HIDDEN)}
        vocabulary: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = {i: bytes(byte_of.get(c, ord(c) & 255) for c in t) for t, i in vocabulary.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for at, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            self.rank.setdefault(pair, at)
            self.parts.setdefault(whole, (*pair, at))
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            if token not in self.special and self.stands(i):
                self.suffixes.add_word(token, (i, len(token)))
        self.suffixes.make_automaton()
        self.size = {i: len(t) for t, i in vocabulary.items()}
        self.pairs: dict[int, bool] = {}
        self.words = Memory(self.word, WORDS)
        self.decimal = {i: str(i) for i in self.bytes}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token, smallest first, each with the rank of the merge that takes it up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def crossing(self, left: int, right: int) -> tuple[int, int] | None:
        """The first merge across the border of two neighbours that BPE of their joined bytes would make, if any.

        Edge pieces change when a merge takes them up; merges go by rank and, of equal rank, from the left. So a merge
        across the border comes before one inside the left neighbour if its rank is lower, and before one inside the
        right neighbour also if it is the same."""
        lefts, rights = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            rank = self.rank.get((a, b))
            if rank is not None and rank < a_until and rank <= b_until:
                return a, b
            if a_until == b_until == NEVER:
                return None
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    @once  # noqa: B019  one codec a process
    def stands(self, token: int) -> bool:
        """Whether BPE of the token's own bytes gives the token."""
        if token not in self.parts:
            return self.size_one(token)
        a, b, _ = self.parts[token]
        return self.stands(a) and self.stands(b) and self.crossing(a, b) == (a, b)

    def size_one(self, token: int) -> bool:
        return len(self.bytes[token]) == 1

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.crossing(left, right) is None
        return known

    def word(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        shown = piece.encode().decode("latin-1").translate(self.shown)
        last = [-1] * (len(shown) + 1)
        pairs, compatible = self.pairs, self.compatible
        for at, (token, size) in self.suffixes.iter(shown):
            if last[at + 1] < 0:
                before = at + 1 - size
                if not before:
                    last[at + 1] = token
                elif last[before] >= 0:
                    known = pairs.get(last[before] << 32 | token)
                    if known if known is not None else compatible(last[before], token):
                        last[at + 1] = token
        at, out = len(shown), []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        if self.special_split is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.words.__getitem__, SPLIT.findall(text))))
        out: list[int] = []
        for part in self.special_split.split(text):
            out += [self.special[part]] if part in self.special else chain.from_iterable(map(self.words.__getitem__, SPLIT.findall(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@once
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of docs: the ids of whole texts, special tokens' strings as their ids.

    Null and empty texts have no ids. Null ids and repeated rows give rows of their own. An empty table gives an empty
    result. Other columns are ignored. Texts of any length take linear time; a worker keeps what it learned about
    words and pairs, within fixed bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        code = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield {"id": part.column("id"), "ids": [code.encode(x.as_py() or "") for x in part.column("text")]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id long, ids array<int>", run).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row: what the ids spell; bytes that are no UTF-8 become U+FFFD, null arrays an empty text. Ids that
    the vocabulary doesn't have, and nulls in an array, spell nothing. Repeated rows give rows of their own, an empty table
    an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        code = codec(path)
        for batch in batches:
            yield {"id": batch.column("id"), "text": [code.decode([i for i in x.as_py() or [] if i in code.bytes]) for x in batch.column("ids")]}

    return map_rows(rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), "id long, text string", run).withColumnRenamed("id", id_col)
