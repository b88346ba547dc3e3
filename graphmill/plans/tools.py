"""A registry of tools with checked arguments, and the seven built-in tools."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions.text import TextIndex
from graphmill.operators import traverse
from graphmill.plans import planner
from graphmill.plans.graph import PropertyGraph
from graphmill.plans.sqltool import run_sql
from graphmill.sources.files import git_changes
from graphmill.sources.scratch import materialize

_TYPES: dict[str, Callable[[Any], bool]] = {
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list | tuple),
    "object": lambda v: isinstance(v, dict),
}


@dataclass
class ToolResult:
    content: list[dict[str, Any]]
    is_error: bool = False

    @property
    def text(self) -> str:
        return "\n".join(c["text"] for c in self.content if c.get("type") == "text")

    @classmethod
    def of(cls, *texts: str, error: bool = False) -> ToolResult:
        return cls([{"type": "text", "text": t} for t in texts], error)


@dataclass
class Context:
    spark: SparkSession
    graph: PropertyGraph
    root: str = "."
    communities: DataFrame | None = None
    processes: DataFrame | None = None
    index: TextIndex | None = None


class Tool(Protocol):
    name: str
    description: str
    input_schema: dict[str, Any]

    def execute(self, args: dict[str, Any], context: Context) -> ToolResult: ...


@dataclass
class FunctionTool:
    name: str
    description: str
    input_schema: dict[str, Any]
    function: Callable[[dict[str, Any], Context], ToolResult]

    def execute(self, args: dict[str, Any], context: Context) -> ToolResult:
        return self.function(args, context)


def check(args: dict[str, Any], schema: dict[str, Any]) -> list[str]:
    """What is wrong with the arguments. Null counts as absent."""
    wrong = [f"missing required argument: {name}" for name in schema.get("required", []) if args.get(name) is None]
    for name, value in args.items():
        rule = schema.get("properties", {}).get(name)
        if rule is None or value is None:
            continue
        kind = rule.get("type")
        if kind in _TYPES and not _TYPES[kind](value):
            wrong.append(f'argument "{name}" must be {kind}')
        elif "enum" in rule and value not in rule["enum"]:
            wrong.append(f'argument "{name}" must be one of: {", ".join(map(str, rule["enum"]))}')
    return wrong


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f'Tool "{tool.name}" is already registered')
        self.tools[tool.name] = tool

    def unregister(self, name: str) -> bool:
        return self.tools.pop(name, None) is not None

    def get(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def names(self) -> list[str]:
        return list(self.tools)

    def __contains__(self, name: str) -> bool:
        return name in self.tools

    def __len__(self) -> int:
        return len(self.tools)

    def execute(self, name: str, args: dict[str, Any], context: Context) -> ToolResult:
        """Never raises: unknown tools, bad arguments and failures are error results."""
        tool = self.get(name)
        if tool is None:
            return ToolResult.of(f"Unknown tool: {name}", error=True)
        if wrong := check(args, tool.input_schema):
            return ToolResult.of(f"Invalid arguments: {'; '.join(wrong)}", error=True)
        try:
            return tool.execute(args, context)
        except Exception as e:  # noqa: BLE001
            return ToolResult.of(f'Tool "{name}" failed: {e}', error=True)


#: Rows of a list that an answer holds; what is beyond is counted and told.
MOST = 1000


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A result that a limit bounds, on the driver."""
    return [r.asDict(recursive=True) for r in df.limit(MOST).collect()]


def _told(rows: list[dict[str, Any]], df: DataFrame) -> dict[str, int]:
    """What to say of a list that may be longer than MOST: nothing if it is whole."""
    return {"shown": len(rows), "total": df.count()} if len(rows) == MOST else {}


def _json(value: Any) -> ToolResult:
    return ToolResult.of(json.dumps(value, ensure_ascii=False, default=str, indent=2))


def _listed(rows: list[dict[str, Any]], df: DataFrame, head: str | None = None) -> ToolResult:
    """A list, after a line of how many of how many there are if it isn't whole, or after head if it is."""
    more = _told(rows, df)
    cut = more and more["total"] > more["shown"]
    said = f"Shown: the first {more['shown']} of {more['total']} rows" if cut else head
    return ToolResult.of(*([said] if said else []), _json(rows).text)


def _schema(required: tuple[str, ...] = (), **properties: str | dict[str, Any]) -> dict[str, Any]:
    return {"type": "object", "required": list(required), "properties": {k: {"type": v} if isinstance(v, str) else v for k, v in properties.items()}}


def _lines() -> Any:
    return F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))


def _pick(args: dict[str, Any], context: Context, several: bool = False) -> tuple[str | None, ToolResult | None]:
    """The node that nodeId or name means, or what to answer instead."""
    if args.get("nodeId"):
        found = _rows(context.graph.node(args["nodeId"]).select("id").limit(1))
    elif args.get("name"):
        found = _rows(context.graph.find(args["name"], args.get("kind")).select("id", "name", "kind", "file_path").limit(20))
        if several and len(found) > 1:
            return None, _json({"ambiguous": True, "candidates": found})
    else:
        return None, ToolResult.of("Either nodeId or name is required", error=True)
    return (found[0]["id"], None) if found else (None, ToolResult.of("Symbol not found", error=True))


def query_tool(args: dict[str, Any], context: Context) -> ToolResult:
    limit = int(args.get("limit") or 20)
    found = planner.query(context.graph, args["query"], limit, args.get("kind"), args.get("filePath"), index=context.index)
    rows = _rows(found.select("name", "kind", F.col("file_path").alias("file"), _lines().alias("lines"), "signature", F.round("score", 3).alias("score"), "exported"))
    return _listed([{"rank": i, **r} for i, r in enumerate(rows, 1)], found) if rows else ToolResult.of("No results found")


def context_tool(args: dict[str, Any], context: Context) -> ToolResult:
    node, other = _pick(args, context)
    if node is None:
        return other  # type: ignore[return-value]
    own = _rows(context.graph.node(node).select("id", "name", "kind", F.col("file_path").alias("file"), _lines().alias("lines"), "signature", "docstring", "exported", F.col("community_id").alias("community"), F.col("page_rank").alias("pageRank")))
    found = materialize(traverse.context(context.graph, node, context.processes), "context")
    w = Window.partitionBy("relation").orderBy("id")
    related = [r.asDict() for r in found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST).drop("rank").collect()]
    totals = {r["relation"]: r["n"] for r in found.groupBy("relation").agg(F.count("*").alias("n")).collect() if r["n"] > MOST}
    of = lambda relation: [{k: r[k] for k in ("id", "name", "kind", "file_path")} for r in related if r["relation"] == relation]
    return _json({"symbol": own[0], "callers": of("callers"), "callees": of("callees"), "imports": of("imports"), "importedBy": of("imported_by"), "communitySiblings": of("community_siblings")[:10], "process": next(iter(of("process")), None), **({"totals": totals} if totals else {})})


def impact_tool(args: dict[str, Any], context: Context) -> ToolResult:
    node, other = _pick(args, context)
    if node is None:
        return other  # type: ignore[return-value]
    found = traverse.impact(context.graph, node, int(args.get("maxDepth") or 5), paths=True)
    shown = _rows(found.select("id", "name", "kind", F.col("file_path").alias("file"), "distance", F.round("impact_score", 3).alias("impactScore"), F.size("path").alias("pathLength")).limit(int(args.get("limit") or 30)))
    depths: dict[str, list[dict[str, Any]]] = {}
    for r in shown:
        depths.setdefault(f"depth_{r['distance']}", []).append(r)
    return _json({"totalAffected": found.count(), "shown": len(shown), "affectedFiles": len({r["file"] for r in shown}), "byDistance": depths})


def flow_tool(args: dict[str, Any], context: Context) -> ToolResult:
    node, other = _pick(args, context)
    if node is None:
        return other  # type: ignore[return-value]
    found = materialize(traverse.flow(context.graph, node, min(int(args.get("maxDepth") or 10), traverse.FLOW_DEPTH)), "flow")
    named = found.join(context.graph.nodes, "id").orderBy("seq")
    rows = _rows(named.select("depth", F.repeat(F.lit("  "), F.col("depth")).alias("indent"), "name", "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "signature", F.when(F.col("depth") > 0, "calls").alias("edgeKind")))
    tree = "\n".join(f"{r['indent']}{'→ ' if r['depth'] else ''}{r['name']} ({r['kind']})" for r in rows)
    more = _told(rows, found)
    return ToolResult.of(tree + (f"\n... {more['total'] - more['shown']} more" if more else ""), _json(rows).text)


def rename_tool(args: dict[str, Any], context: Context) -> ToolResult:
    node, other = _pick(args, context, several=True)
    if node is None:
        return other  # type: ignore[return-value]
    references, files, clashes = (materialize(t, "rename") for t in traverse.rename_parts(context.graph, node, args["newName"]))
    details = _rows(context.graph.edges_to(node).select("source", "kind", "file_path", "line").orderBy("id").limit(100))
    conflicts, clash = clashes.count(), [r["id"] for r in _rows(clashes.orderBy("id"))] or None
    return _json({
        "symbol": _rows(context.graph.node(node).select("id", "name", "kind", "file_path"))[0], "references": references.count(), "affectedFiles": [r["file_path"] for r in _rows(files.orderBy("file_path"))], "affectedFileCount": files.count(),
        "referenceDetails": details, "referenceDetailsShown": len(details),
        "conflicts": clash, "conflictCount": conflicts, "warning": f"{conflicts} symbol(s) are already named {args['newName']}" if clash else None,
    })


def detect_changes_tool(args: dict[str, Any], context: Context) -> ToolResult:
    since = args.get("since") or "HEAD~1"
    changes = git_changes(context.spark, context.root, since)
    full = changes.withColumn("file_path", F.concat(F.lit(context.root.rstrip("/") + "/"), "file_path"))
    found = materialize(changed_symbols(context.graph, full), "changes")
    rows = _rows(found.orderBy("file"))
    impact = None
    if args.get("includeImpact"):
        hit = materialize(traverse.change_impact(context.graph, full), "impact")
        files = [r["file_path"] for r in _rows(hit.orderBy("file_path"))]
        impact = {"totalFilesImpacted": hit.count(), "files": files}
    more = _told(rows, found)
    return _json({"since": since, "changes": rows, **({"changesShown": more["shown"], "changesTotal": more["total"]} if more else {}), "impact": impact})


def changed_symbols(graph: PropertyGraph, changes: DataFrame) -> DataFrame:
    """(file, status, symbols): each changed file with its symbols, also files without any."""
    nodes = graph.nodes.where("kind <> 'file'").select("file_path", F.struct("id", "name", "kind").alias("symbol"))
    found = changes.join(nodes, "file_path", "left").groupBy("file_path", "status").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    return found.select(F.col("file_path").alias("file"), "status", "symbols").orderBy("file")


def sql_tool(args: dict[str, Any], context: Context) -> ToolResult:
    found = run_sql(context.graph, args["query"], int(args.get("limit") or 100), communities=context.communities, processes=context.processes)
    rows = _rows(found)
    return _listed(rows, found, f"Query returned {len(rows)} rows")


def builtin() -> Registry:
    node = {"nodeId": "string", "name": "string", "kind": "string"}
    out = Registry()
    for name, said, schema, function in (
        ("query", "Ranked search over symbols", _schema(("query",), query="string", kind="string", filePath="string", limit="number"), query_tool),
        ("context", "All relations of a symbol", _schema(**node), context_tool),
        ("impact", "What a change to a symbol affects", _schema(**node, maxDepth="number", limit="number"), impact_tool),
        ("flow", "The calls that a symbol sets off", _schema(**node, maxDepth="number"), flow_tool),
        ("rename", "What a rename touches", _schema(("newName",), **node, newName="string"), rename_tool),
        ("detect_changes", "Symbols in files changed since a revision", _schema(since="string", includeImpact="boolean"), detect_changes_tool),
        ("sql", "Read-only SQL over nodes, edges, communities and processes", _schema(("query",), query="string", limit="number"), sql_tool),
    ):
        out.register(FunctionTool(name, said, schema, function))
    return out
