"""Chat formatting by incremental black-box rendering, with loss masks, and its inverse."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import map_rows

Turn = tuple[str, str]
#: Turns before a turn that a prefix of an append-only template is rendered with.
CONTEXT = 16
SPAN = "role string, start long, end long, text_start long, text_end long"
FORMATTED = f"conv_id long, formatted string, rewritten_at long, spans array<struct<{SPAN.replace(' string', ': string').replace(' long', ': long')}>>"

ESCAPE = re.compile(r"([<\[]/?\\*)(s>|INST\])")
UNESCAPE = re.compile(r"([<\[]/?\\*)\\(s>|INST\])")
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """Control strings get one more backslash before their last part, also those that have some already."""
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def inst_template(turns: list[Turn]) -> str:
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


def parse_inst(formatted: str) -> list[Turn]:
    """The turns of inst_template's output."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def locate(render: Callable[[list[Turn]], str], turns: list[Turn], append_only: bool = False) -> tuple[str, int | None, list[tuple]]:
    """The rendered conversation; the first turn (from 0) whose rendering rewrites what stood before, or None; and
    (role, start, end, text start, text end) of each turn, empty if history is rewritten.

    render is a black box. Prefixes of each length are rendered whole and compared; what a turn adds is its span. Two
    renderings with different one-character texts in the turn's place tell where its text begins and ends. That takes
    the square of a conversation's length. A template that is declared append_only, one that only ever adds turns to what
    it has rendered, is rendered without turns older than CONTEXT, in proportion to the length; it is checked all the
    same: the parts must add up to the whole, and whole prefixes of doubling length must begin it, or else all prefixes are
    compared.
    """
    whole = render(turns)

    def spans(width: int) -> tuple[int | None, list[tuple], str]:
        out, at, parts = [], 0, []
        for k, (role, _) in enumerate(turns):
            old = turns[max(0, k - width) : k]
            before, after = render(old), render([*old, turns[k]])
            if not after.startswith(before):
                return k, [], ""
            if not k:
                at, parts = len(before), [before]
            a, b = render([*old, (role, "")]), render([*old, (role, "")])
            begin, tail = common(a, b), common(a[::-1], b[::-1])
            end = at + len(after) - len(before)
            out.append((role, at, end, at + begin - len(before), end - tail))
            parts.append(after[len(before) :])
            at = end
        return None, out, "".join(parts)

    if append_only and len(turns) > CONTEXT:
        rewritten, out, joined = spans(CONTEXT)
        sizes = [CONTEXT << i for i in range(len(turns).bit_length()) if CONTEXT << i < len(turns)]
        if rewritten is None and joined == whole and all(whole.startswith(render(turns[:n])) for n in sizes):
            return whole, None, out
    rewritten, out, joined = spans(len(turns))
    if rewritten is None and turns and joined != whole:
        rewritten = len(turns) - 1
    return whole, rewritten, out if rewritten is None else []


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv_id, group in groupby(rows, key=lambda x: x[0]):
        yield conv_id, [(role or "", text or "") for _, role, text in group]


def format_chats(turns: DataFrame, render: Callable[[list[Turn]], str] = inst_template, append_only: bool = False) -> DataFrame:
    """A row per conv_id: the conversation rendered by `render`, and its turns' spans in code points, see FORMATTED.
    append_only: a promise about `render`, see locate.

    Turns are dealt by conversation, sorted on disk and streamed; a task holds one conversation at a time, which is
    the least that rendering it as one text needs. Turns are taken by turn, then role, then text; repeated rows are
    turns of their own. Null texts and roles are empty; rows with a null conv_id form one conversation. An empty table
    gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("conv_id", "formatted", "rewritten_at", "spans")}
        size = 0
        for conv_id, group in conversations_of(batches):
            whole, rewritten, spans = locate(render, group, append_only)
            for k, v in zip(out, (conv_id, whole, rewritten, [dict(zip(("role", "start", "end", "text_start", "text_end"), s, strict=True)) for s in spans]), strict=True):
                out[k].append(v)
            size += len(whole)
            if size > 4 << 20:
                yield out
                out, size = {k: [] for k in out}, 0
        yield out

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role"), F.col("text"))
    return map_rows(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"), FORMATTED, run)
