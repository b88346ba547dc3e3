"""Plain-text forms of numbers, scores, nodes and tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a score bar, the marks of exported and other nodes, and the width of a kind.
CELLS, MARKS, KIND = 20, ("◆", "○"), 12


def humanized(n: int) -> str:
    """1234 as 1.2K, 5600000 as 5.6M."""
    for size, unit in ((1_000_000, "M"), (1000, "K")):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return str(n)


def humanized_column(n: Column) -> Column:
    big = lambda size, unit: F.concat(F.format_string("%.1f", n / size), F.lit(unit))
    return F.when(n >= 1_000_000, big(1_000_000, "M")).when(n >= 1000, big(1000, "K")).otherwise(n.cast("string"))


def score_bar(score: float) -> str:
    full = min(CELLS, max(0, int(score * CELLS + 0.5)))
    return f"{'█' * full}{'░' * (CELLS - full)} {score * 100:.1f}%"


def node_line(node: dict[str, Any]) -> str:
    """One line on a node; of its file and line either name will do."""
    file, line = node.get("file_path") or node.get("file") or "", node.get("start_line") or node.get("line") or 0
    said = f" — {node['signature']}" if node.get("signature") else ""
    return f"{MARKS[0] if node.get('exported') else MARKS[1]} {node['kind']:<{KIND}} {node['name']} {file}:{line}{said}"


def text_table(headers: Sequence[str], rows: Iterable[Sequence[Any]]) -> str:
    cells = [["" if c is None else str(c) for c in row] + [""] * (len(headers) - len(row)) for row in rows]
    widths = [max(len(h), *(len(r[i]) for r in cells)) if cells else len(h) for i, h in enumerate(headers)]
    line = lambda row: "│".join(f" {c:<{w}} " for c, w in zip(row, widths, strict=True))
    return "\n".join([line(headers), "┼".join("─" * (w + 2) for w in widths), *map(line, cells)])
