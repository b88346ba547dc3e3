"""Read-only SQL over the graph's tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphmill.operators import traverse
from graphmill.plans import planner
from graphmill.plans.graph import PropertyGraph
from graphmill.sources.scratch import spread

# Words that the strict text check rejects anywhere in a statement.
UNSAFE = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "DETACH", "REINDEX", "ANALYZE", "VACUUM", "PRAGMA")

#: What a query's parsed plan may consist of, and the functions that it may call. Nothing here reads files, settings or
#: classes of the JVM, or has an effect.
PLANS = frozenset(
    "Project Filter Aggregate Join LateralJoin UnresolvedRelation SubqueryAlias Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except UnresolvedWith "
    "UnresolvedSubqueryColumnAliases UnresolvedHaving WithWindowDefinition UnresolvedInlineTable OneRowRelation Generate Pivot Unpivot UnresolvedTableValuedFunction".split()
)
FUNCTIONS = frozenset(
    "abs ceil ceiling floor round bround sqrt cbrt exp ln log log10 log2 power pow mod pmod sign signum greatest least rand degrees radians sin cos tan asin acos atan atan2 pi width_bucket conv bin hex unhex "
    "count sum avg mean min max min_by max_by any_value first last count_if bool_and bool_or every some stddev stddev_pop stddev_samp variance var_pop var_samp corr covar_pop covar_samp median mode percentile "
    "percentile_approx approx_count_distinct collect_list collect_set array_agg listagg string_agg grouping grouping_id row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value "
    "length char_length character_length octet_length lower upper lcase ucase trim ltrim rtrim btrim substr substring substring_index left right instr locate position replace translate concat concat_ws repeat reverse "
    "lpad rpad initcap ascii chr char split split_part regexp_extract regexp_extract_all regexp_replace regexp_like regexp_count regexp regexp_instr rlike like ilike startswith endswith contains format_string printf format_number "
    "levenshtein soundex base64 unbase64 md5 sha1 sha sha2 crc32 xxhash64 hash coalesce ifnull nvl nvl2 nullif if iff case when isnull isnotnull isnan cast try_cast typeof try_divide try_add "
    "date to_date to_timestamp timestamp date_format date_trunc trunc date_add date_sub datediff add_months months_between year month day dayofmonth dayofweek dayofyear weekofyear quarter hour minute second extract "
    "date_part unix_timestamp unix_micros unix_millis unix_seconds from_unixtime make_date current_date current_timestamp now last_day next_day "
    "array map struct named_struct size cardinality array_contains array_distinct array_join array_position array_sort sort_array array_union array_intersect array_except array_max array_min array_remove flatten slice "
    "sequence element_at get explode explode_outer posexplode posexplode_outer inline stack transform filter exists forall aggregate reduce zip_with map_keys map_values map_entries arrays_zip "
    "get_json_object json_tuple from_json to_json json_array_length json_object_keys schema_of_json not and or in between range".split()
)


#: What is run as a join of tables.
JOINS = ("Join", "LateralJoin", "Exists", "ListQuery")

#: Nodes that a task of a join gets, with their edges, which are several each: about 100 MB.
TASK_NODES = 1 << 17


class UnsafeQuery(ValueError):
    """Raised for anything but a query of the graph's tables."""


def seq(items: Any) -> list[Any]:
    return [items.apply(i) for i in range(items.size())]


def below(node: Any) -> list[Any]:
    """A parsed plan's or expression's parts, those of subqueries included; common tables are left to their scope."""
    out = seq(node.children())
    names = {m.getName() for m in node.getClass().getMethods()}
    out += seq(node.expressions()) if "expressions" in names else []
    kind = node.getClass().getSimpleName()
    if "innerChildren" in names and kind != "UnresolvedWith":
        out += seq(node.innerChildren())
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        out.append(node.plan())
    return out


def walk(node: Any, own: frozenset[str] = frozenset()) -> Iterator[tuple[Any, frozenset[str]]]:
    """A parsed plan's nodes and expressions, each with the common tables that it can see. A WITH's tables are seen by those
    after them and by its own query, and nowhere else; a recursive one also sees itself."""
    yield node, own
    if node.getClass().getSimpleName() == "UnresolvedWith":
        recursive = any(m.getName() == "allowRecursion" for m in node.getClass().getMethods()) and node.allowRecursion()
        seen = own
        for named in seq(node.cteRelations()):
            name = named._1().lower()
            yield from walk(named._2(), seen | {name} if recursive else seen)
            seen |= {name}
        yield from walk(node.child(), seen)
        return
    for part in below(node):
        yield from walk(part, own)


def check_plan(spark: SparkSession, statement: str, tables: set[str]) -> tuple[str, bool]:
    """Raises unless the statement is a query of `tables`, by their plain names, and of common tables where these are seen,
    with nothing but FUNCTIONS. Gives the name of the plan's root, and whether anything in it is joined."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    logical = plan.getClass().getClassLoader().loadClass("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
    joined = False
    for n, own in walk(plan):
        kind = n.getClass().getSimpleName()
        joined |= kind in JOINS
        if logical.isInstance(n) and kind not in PLANS:
            raise UnsafeQuery(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = seq(n.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in tables | own:
                raise UnsafeQuery(f"unknown table {'.'.join(parts)}; there are {', '.join(sorted(t for t in tables if '_' not in t))}")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            parts = seq(n.nameParts() if kind == "UnresolvedFunction" else n.name()) if kind != "UnresolvedGenerator" else [n.name().funcName()]
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise UnsafeQuery(f"function {'.'.join(parts)} is not allowed")
    return plan.getClass().getSimpleName(), joined


#: search('words'), neighbors('id', depth) and impact('id', depth) as tables in a FROM clause.
CALL = re.compile(r"\b(search|neighbors|impact)\(\s*'((?:[^']|'')*)'(?:\s*,\s*(\d+))?\s*\)", re.IGNORECASE)


def call(graph: PropertyGraph, m: re.Match) -> DataFrame:
    """The rows of a table function: (id, score) for search, (id, name, kind, file_path, distance) for neighbors, and
    impact_score besides for impact."""
    name, said, number = m[1].lower(), m[2].replace("''", "'"), int(m[3]) if m[3] else None
    columns = ["id", "name", "kind", "file_path", "distance"]
    if name == "search":
        return planner.search_text(graph, said, number or 50)
    if name == "neighbors":
        return traverse.neighbors(graph, said, depth=number or 1).select(columns)
    return traverse.impact(graph, said, number or 5).select(*columns, "impact_score")


def quoted(text: str) -> str:
    """A string literal of exactly this text, whatever it holds."""
    return "'" + "".join(c if c not in "\\'" else f"\\{c}" for c in text) + "'"


def glob(pattern: str, text: str) -> str:
    """A condition for a literal glob pattern: * and ?, and sets in brackets, of which a leading ^ takes the complement."""
    if not re.fullmatch(r"'(?:[^']|'')*'", pattern):
        raise UnsafeQuery("glob needs a literal pattern")

    def part(p: str) -> str:
        if len(p) == 1:
            return {"*": ".*", "?": "."}.get(p, re.escape(p))
        inner = p[2:-1] if p[1] == "^" else p[1:-1]
        return f"[{'^' if p[1] == '^' else ''}{re.sub(r'([^A-Za-z0-9 -])', lambda m: chr(92) + m[1], inner)}]"

    parts = re.findall(r"\[\^?\]?[^\]]*\]|.", pattern[1:-1].replace("''", "'"), re.DOTALL)
    return f"({text} RLIKE {quoted('(?s)' + chr(92) + 'A' + ''.join(map(part, parts)) + chr(92) + 'z')})"


def extreme(name: str, *x: str) -> str:
    """The least or greatest of several arguments, null if any is; of one, the aggregate."""
    if len(x) == 1:
        return f"{name}({x[0]})"
    return f"(CASE WHEN {' OR '.join(f'({y}) IS NULL' for y in x)} THEN NULL ELSE {'least' if name == 'min' else 'greatest'}({', '.join(x)}) END)"


def infix_glob(before: str, pattern: str) -> str:
    """What stands before GLOB with its left side, a column or a call, put into a condition."""
    m = re.search(r"((?:[A-Za-z_]\w*\.)?(?:[A-Za-z_]\w*|\"[^\"]*\"|`[^`]*`)(?:\([^()]*\))?)\s*(\bnot\s+)?\Z", before, re.IGNORECASE)
    if not m or m[1].lower() == "not":
        raise UnsafeQuery("GLOB needs a column or a call on its left; use glob(pattern, text)")
    return f"{before[: m.start()]}{'NOT ' if m[2] else ''}{glob(pattern, m[1])}"


def time_format(said: str, when: str = "now()") -> str:
    if not re.fullmatch(r"'[^']*'", said):
        raise UnsafeQuery("strftime needs a literal format")
    # The same parts in both notations.
    parts = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "ss.SSS", "%j": "DDD"}
    if said == "'%s'":
        return f"CAST(unix_timestamp(CAST({when} AS timestamp)) AS string)"
    text = "".join(parts.get(p, re.sub(r"([A-Za-z]+)", r"''\1''", p)) for p in re.findall(r"%.|[^%]+", said[1:-1]))
    return f"date_format(CAST({when} AS timestamp), '{text}')"


def group_concat(what: str, by: str = "','") -> str:
    distinct = re.match(r"distinct\s+(.*)", what, re.IGNORECASE | re.DOTALL)
    return f"array_join(array_sort(collect_set(CAST({distinct[1]} AS string))), {by})" if distinct else f"array_join(collect_list(CAST({what} AS string)), {by})"


#: Functions of the embedded dialect that this engine calls otherwise.
DIALECT: dict[str, Callable[..., str]] = {
    "group_concat": group_concat,
    "total": lambda x: f"coalesce(sum(CAST({x} AS double)), 0.0D)",
    "json_extract": lambda j, p: f"get_json_object({j}, {p})",
    "glob": glob,
    "iif": lambda c, a, b="NULL": f"if({c}, {a}, {b})",
    "julianday": lambda t="now()": f"(unix_micros(CAST({t} AS timestamp)) / 86400000000.0D + 2440587.5D)",
    "unixepoch": lambda t="now()": f"unix_timestamp(CAST({t} AS timestamp))",
    "strftime": time_format,
    "datetime": lambda t="now()": f"date_format(CAST({t} AS timestamp), 'yyyy-MM-dd HH:mm:ss')",
    "min": lambda *x: extreme("min", *x),
    "max": lambda *x: extreme("max", *x),
}
TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|.", re.DOTALL)


def translated(statement: str) -> str:
    """The statement with calls of DIALECT's functions written as this engine has them."""
    tokens, at = TOKEN.findall(statement), 0

    def literal() -> str:
        """The next token but blanks."""
        nonlocal at
        while at < len(tokens) and not tokens[at].strip():
            at += 1
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def until(end: str | None) -> tuple[str, list[str]]:
        nonlocal at
        out, args = "", []
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t == end:
                return out, [*args, out.strip()]
            if end and t == ",":
                args.append(out.strip())
                out = ""
            elif t.lower() in DIALECT and at < len(tokens) and tokens[at] == "(":
                at += 1
                inner = until(")")[1]
                out += DIALECT[t.lower()](*inner)
            elif t.lower() == "like":
                # The embedded dialect's LIKE is blind to ASCII case.
                out += "ilike"
            elif t.lower() == "glob":
                out = infix_glob(out, literal())
            elif t == "(":
                out += "(" + ", ".join(until(")")[1]) + ")"
            else:
                out += t
        return out, args

    return until(None)[0]


def run_sql(graph: PropertyGraph, statement: str, limit: int | None = 100, compat: bool = False, communities: DataFrame | None = None, processes: DataFrame | None = None) -> DataFrame:
    """A query's rows, `limit` at most unless the query limits itself or limit is None.

    The parsed plan decides what is a query: PLANS over the tables nodes, edges, communities and processes, calling
    FUNCTIONS; so common table expressions and columns named like commands are fine. Calls of DIALECT are translated.
    compat applies the text checks besides. Where tables are joined, nodes are counted and dealt by id, and so is what meets them. The tables are views of this statement alone, so graphs don't mix and no view
    stays.
    """
    statement = statement.strip().rstrip(";").strip()
    if compat:
        upper = statement.upper()
        if not upper.startswith("SELECT") or any(w in upper for w in UNSAFE):
            raise UnsafeQuery("only SELECT statements are allowed")
    spark, mark = graph.nodes.sparkSession, uuid.uuid4().hex[:12]
    tables = {name: df for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("communities", communities), ("processes", processes)) if df is not None}

    def named(m: re.Match) -> str:
        tables[name := f"{m[1].lower()}_{len(tables)}_{mark}"] = call(graph, m)
        return name

    statement = translated(CALL.sub(named, statement))
    root, joined = check_plan(spark, statement, set(tables))
    if joined:
        tables["nodes"] = spread(graph.nodes, graph.nodes.count(), "id", most=TASK_NODES)
    views = {name: f"{name}_{mark}_view" for name in tables}
    try:
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        # Tables are names of the statement's own, around whatever it says; a view is gone once the query is analysed.
        heads = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        found = spark.sql(f"WITH {heads} ({statement}\n)")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    limited = root in ("GlobalLimit", "LocalLimit") or re.search(r"\blimit\s+\d+(\s+offset\s+\d+)?\s*$", statement, re.IGNORECASE)
    return found if limit is None or limited else found.limit(limit)
