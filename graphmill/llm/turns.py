"""Conversations brought into the form (system)? (user assistant)+ by the cheapest edits.

Costs to go are worked out backward over turns and grammar states; a forward walk then takes, of the edits that keep to
the least cost, the one with the least letter. Long conversations are cut into segments: a segment's costs between states
are a matrix, matrices of consecutive segments are combined, and each segment is then walked by itself."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import Scratch, map_rows

#: Rows and text bytes of a segment.
ROWS, BYTES = 4096, 1 << 20
#: What the edits cost, and what a truncated turn that stays costs more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: White space, and characters that end a whole turn.
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after system, after user, after assistant. What comes next in each, besides system at the start.
NEXT, SAYS = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: A cost that no sequence of edits has, and costs to go at a conversation's end.
NEVER, FINAL = 1 << 60, (0, 2 * INSERT, INSERT, 0)
FAR = [tuple(0 if p == q else NEVER for p in range(4)) for q in range(4)]
#: Faults: none, no text, said before, cut short. The first two must go.
FINE, BLANK, DUPLICATE, CUT = range(4)
FORCED = (BLANK, DUPLICATE)

Costs = tuple[int, int, int, int]
#: A run of equal rows: fault, role, text, how many.
Item = tuple[int, str, str, int]


def damage(turns: DataFrame, parts: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with faults for trying the repair: by crc32 of `conv_id:turn` modulo parts a row is
    dropped (0), emptied (1), loses its `[.!?]` (2), comes twice (3) or becomes a user's (4). Nulls of any column are one
    space here; conv_id and turn stay null."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(parts))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.drop("col")


#: By state and initial of a role: the state that a kept turn leads to.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def relaxed(c: Costs) -> Costs:
    """Costs to go if turns may be inserted first."""
    u, a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + u), min(c[1], INSERT + u), u, a


def before(item: Item, c: Costs) -> Costs:
    """Costs to go before a run of equal rows from those after it."""
    fault, role, _, copies = item
    if fault in FORCED:
        return tuple(x + DELETE * copies for x in c)  # type: ignore[return-value]
    more = TRUNCATED if fault == CUT else 0
    initial, out = role[:1], []
    for state in range(4):
        least = min(DELETE + c[state], REROLE + more + c[NEXT[state]])
        to = KEEP.get((state, initial))
        out.append(least if to is None else min(least, more + c[to]))
    return relaxed(tuple(out))  # type: ignore[arg-type]


def matrix(items: list[Item]) -> list[int]:
    """By state before, then after: the least cost of the items' edits, as 16 numbers."""
    columns = []
    for far in FAR:
        c = relaxed(far)
        for item in reversed(items):
            c = before(item, c)
        columns.append(c)
    return [min(columns[q][p], NEVER) for p in range(4) for q in range(4)]


def walk(items: list[Item], state: int, ends: Costs, last: bool) -> tuple[int, list[tuple[str, str | None, str | None]]]:
    """The state after the ASCII-least cheapest edits, and the edits as (letters, role, text); ends: costs to go after
    the items. Turns that are missing after them are inserted by what follows, or, if nothing does, here."""
    togo = [ends]
    for item in reversed(items):
        togo.append(before(item, togo[-1]))
    togo.reverse()
    done: list[tuple[str, str | None, str | None]] = []
    at = 0
    while at < len(items) or last:
        c = togo[at][state]
        if at == len(items):
            if state in (0, 3):
                break
            done.append(("I", SAYS[state], ""))
            state = NEXT[state]
            continue
        fault, role, text, copies = items[at]
        free = fault not in FORCED
        more = TRUNCATED if fault == CUT else 0
        after = togo[at + 1]
        to = KEEP.get((state, role[:1]))
        if DELETE * copies + after[state] == c:
            done.append(("D" * copies, None, None))
            at += 1
        elif INSERT + togo[at][NEXT[state]] == c:
            done.append(("I", SAYS[state], ""))
            state = NEXT[state]
        elif free and to is not None and more + after[to] == c:
            done.append(("K", role, text))
            state, at = to, at + 1
        else:
            done.append(("R", SAYS[state], text))
            state, at = NEXT[state], at + 1
    return state, done


def items_of(row: dict) -> list[Item]:
    return list(zip(row["fault"], row["role"], row["text"], row["copies"], strict=True))


SEGMENT = "conv_id long, part long, seg long, fault array<int>, role array<string>, text array<string>, copies array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string, turns long, least long, most long, opens long, closes long, costs array<long>"


def segments_of(rows: DataFrame) -> DataFrame:
    """Sorted rows (conv_id, turn, role, text, copies, new) cut into segments of bounded size, each within one
    conversation, with their matrices and counts. part and seg give their order."""

    def segment(conv_id: int | None, part: int, seg: int, rows: list[tuple]) -> dict:
        items: list[Item] = []
        n = [0, 0, 0, 0]
        illegal = 0
        for k, (_, role, text, copies, new) in enumerate(rows):
            body = text.rstrip(WHITE)
            fault = BLANK if not body else DUPLICATE if not new else FINE if body[-1] in STOPS else CUT
            once = 1 if fault in (FINE, CUT) else copies
            items.append((fault, role, text, once))
            n[fault] += once
            if copies > once:
                items.append((DUPLICATE, role, text, copies - once))
                n[DUPLICATE] += copies - once
            illegal += copies - 1 + (k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au"))
        told = [r[0] for r in rows if r[0] is not None]
        fault, role, text, copies = (list(x) for x in zip(*items, strict=True))
        out = {
            "conv_id": conv_id, "part": part, "seg": seg, "fault": fault, "role": role, "text": text, "copies": copies, "blank": n[BLANK], "duplicate": n[DUPLICATE], "truncated": n[CUT], "illegal": illegal,
            "head": rows[0][1][:1], "tail": rows[-1][1][:1], "turns": len(set(told)), "least": min(told, default=None), "most": max(told, default=None), "opens": told[0] if told else None, "closes": told[-1] if told else None, "costs": matrix(items),
        }
        return {k: [v] for k, v in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, seg = TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
        held, size, of = [], 0, None
        for batch in batches:
            for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "new")), strict=True):
                if held and (conv_id != of or len(held) >= ROWS or size >= BYTES):
                    yield segment(of, part, seg, held)
                    held, size, seg = [], 0, seg + 1
                of = conv_id
                held.append(row)
                size += len(row[2])
        if held:
            yield segment(of, part, seg, held)

    return map_rows(rows, SEGMENT, merged(run))


def merged(run, rows: int = 512):
    """Rows that are told one by one, in batches."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, list] = {}
        for row in run(batches):
            for k, v in row.items():
                held.setdefault(k, []).extend(v)
            if len(held[k]) >= rows:
                yield held
                held = {}
        if held:
            yield held

    return out


def by_conversation(rows: DataFrame, schema: str, each) -> DataFrame:
    """each(conv_id, rows in order as dicts) gives dicts of the schema; a conversation's rows, one a segment, are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        told = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
        for conv_id, group in groupby(told, key=lambda row: row["conv_id"]):
            for out in each(conv_id, group):
                yield {k: [v] for k, v in out.items()}

    return map_rows(rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"), schema, merged(run))


def costs_to_go(conv_id: int | None, group: Iterator[dict]) -> Iterator[dict]:
    """By segment the costs to go after it, and with the first one the conversation's counts and cost."""
    rows = list(group)
    ends: Costs = FINAL
    found = []
    for row in reversed(rows):
        found.append(ends)
        m = row["costs"]
        ends = tuple(min(m[4 * p + q] + ends[q] for q in range(4)) for p in range(4))  # type: ignore[assignment]
    found.reverse()
    summed = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    distinct, last = sum(r["turns"] for r in rows), None
    for k, row in enumerate(rows):
        if k:
            summed["illegal"] += rows[k - 1]["tail"] + row["head"] not in ("su", "ua", "au")
        # A turn whose rows lie in two segments is one.
        distinct -= last is not None and row["opens"] == last
        last = row["closes"] if row["closes"] is not None else last
    told = [r for r in rows if r["least"] is not None]
    gaps = max(r["most"] for r in told) - min(r["least"] for r in told) + 1 - distinct if told else 0
    for k, row in enumerate(rows):
        first = summed | {"gaps": gaps, "cost": ends[0]} if k == 0 else dict.fromkeys((*summed, "gaps", "cost"))
        yield {"conv_id": conv_id, "part": row["part"], "seg": row["seg"], "ends": list(found[k]), "last": k == len(rows) - 1, "alone": len(rows) == 1, **first}


def starts(conv_id: int | None, group: Iterator[dict]) -> Iterator[dict]:
    """By segment the state that its walk begins in, and how many turns come before."""
    state = place = 0
    for row in group:
        yield {"part": row["part"], "seg": row["seg"], "state": state, "place": place}
        state, place = row["states"][state], place + row["sizes"][state]


def repaired(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Counts by conversation that has rows, and the segments' edits: (conv_id, part, seg, place, done array of (edit,
    role, text)), edit a letter or a run of D, role and text null where rows are deleted."""
    spark = turns.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    # Equal rows are one with their number, so that no sort has to hold a crowd of them in one task.
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = scratch.write(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("said", said), "rows")
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.col("at.turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & F.col("turn").eqNullSafe(F.col("t"))
    marked = rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", F.col("s").isNotNull().alias("new"))
    order = ("conv_id", "turn", "role", "text")
    ordered = marked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    segments = scratch.write(segments_of(ordered), "segments")
    told = segments.drop("fault", "role", "text", "copies")
    counts = "blank long, duplicate long, truncated long, illegal long, gaps long, cost long"
    ends = scratch.write(by_conversation(told, f"conv_id long, part long, seg long, ends array<long>, last boolean, alone boolean, {counts}", costs_to_go), "ends")

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [walk(items_of(row), state, tuple(row["ends"]), row["last"]) for state in range(4)]
                sizes = [sum(role is not None for _, role, _ in done) for _, done in found]
                yield {"conv_id": [row["conv_id"]], "part": [row["part"]], "seg": [row["seg"]], "states": [[s for s, _ in found]], "sizes": [sizes]}

    content = segments.select("conv_id", "part", "seg", "fault", "role", "text", "copies")
    several = content.join(ends.where(~F.col("alone")).select("part", "seg", "ends", "last"), ["part", "seg"])
    led = map_rows(several, "conv_id long, part long, seg long, states array<int>, sizes array<long>", merged(leads))
    begun = scratch.write(by_conversation(led, "part long, seg long, state int, place long", starts), "starts")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                _, done = walk(items_of(row), row["state"], tuple(row["ends"]), row["last"])
                told = [{"edit": edit, "role": role, "text": text} for edit, role, text in done]
                yield {"conv_id": [row["conv_id"]], "part": [row["part"]], "seg": [row["seg"]], "place": [row["place"]], "done": [told]}

    known = ends.select("part", "seg", "ends", "last").join(begun, ["part", "seg"], "left")
    known = known.select("part", "seg", "ends", "last", F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("place", F.lit(0)).alias("place"))
    pieces = map_rows(content.join(known, ["part", "seg"]), "conv_id long, part long, seg long, place long, done array<struct<edit: string, role: string, text: string>>", merged(edits, 64))
    return ends.where(F.col("cost").isNotNull()).select("conv_id", *(c.split()[0] for c in counts.split(", "))), scratch.write(pieces, "pieces")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations by place from 0. edit: K kept, R given
    another role, I inserted without text. See repair_conversations."""
    _, pieces = repaired(turns, Scratch(turns.sparkSession, "turns"))
    stay = F.filter("done", lambda d: d["role"].isNotNull())
    rows = pieces.select("conv_id", "place", F.posexplode(stay).alias("at", "turn"))
    return rows.select("conv_id", (F.col("place") + F.col("at")).alias("place"), "turn.edit", "turn.role", "turn.text")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of rows
    (conv_id, turn, role, text).

    Rows are taken by turn (nulls first), then role, then text. The first fault of each counts: blank (nothing but white
    space), duplicate (role and text came earlier in the conversation), truncated (its last other character is none of
    `.!?`). gaps are turns missing between the least and the largest; illegal are neighbours whose roles' initials aren't
    su, ua or au. Edits: keep (K, costs 0), change the role to user or assistant (R, 3), delete (D, 4; blank and duplicate
    rows must be), insert a user's or assistant's empty turn (I, 3); truncated rows that stay cost 3 more. audit is the
    least string of letters among the cheapest edits after which the initials match `(s?(ua)+)?`; repaired_sha256 is that
    of the repaired `role:text`, joined by newlines.

    A conversation's rows are dealt by order, so even one that holds most rows is worked on in segments by all tasks: its
    matrices, some hundred bytes a segment of ROWS rows, meet in one task, and in the end its audit, which is one value of a
    letter a row, and its text, which streams through the digest. Equal rows travel as one with their number.

    Null roles and texts are one space; rows with a null conv_id form one conversation; an empty table gives no rows.
    Turns and ids are read as 64-bit numbers. Other columns are ignored.
    """
    counts, pieces = repaired(turns, Scratch(turns.sparkSession, "turns"))

    def told(conv_id: int | None, group: Iterator[dict]) -> Iterator[dict]:
        audit, digest, first = [], hashlib.sha256(), True
        for row in group:
            for turn in row["done"]:
                audit.append(turn["edit"])
                if turn["role"] is not None:
                    digest.update(("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
                    first = False
        yield {"of": conv_id, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    spelled = by_conversation(pieces.drop("place"), "of long, audit string, repaired_sha256 string", told)
    found = counts.join(spelled, F.col("conv_id").eqNullSafe(F.col("of")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def with_lost(found: DataFrame, ids: DataFrame) -> DataFrame:
    """found and, for conversations of ids (conv_id) that have no rows any more, rows of nothing: zeros, an empty audit, no text's digest."""
    known = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = known.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
