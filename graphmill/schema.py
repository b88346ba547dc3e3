"""Fixed schemas and value domains of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def struct(fields: str) -> T.StructType:
    """A schema from "name type, ..."; an exclamation mark after the type forbids nulls. Needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t.rstrip("!")], not t.endswith("!")) for n, t in (f.split() for f in fields.split(", "))])


NODES = struct(
    "id string!, kind string!, name string!, file_path string!, start_line int, end_line int, content_hash string, "
    "language string, signature string, docstring string, exported boolean, last_indexed timestamp, community_id int, page_rank double, "
    "embedding array<float>, metadata map<string,string>"
)
EDGES = struct("id string!, source string!, target string!, kind string!, confidence double!, file_path string, line int, metadata map<string,string>")
COMMUNITIES = struct("id int!, label string, member_count long, cohesion double")
PROCESSES = struct("id string!, name string, entry_point string, steps array<string>, kind string")
#: An operation log entry: seq orders it, op is one of OPS, node and edge hold what is upserted.
MUTATIONS = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("key", T.StringType()), T.StructField("edge_kind", T.StringType()),
    T.StructField("node", NODES), T.StructField("edge", EDGES),
])

# The domains of kinds and operations.
NODE_KINDS = ("file", "function", "class", "method", "interface", "type_alias", "variable", "constant", "enum", "module", "namespace", "property", "parameter")
EDGE_KINDS = ("calls", "imports", "exports", "extends", "implements", "contains", "type_of", "returns", "parameter_of", "overrides", "uses", "member_of")
PROCESS_KINDS = ("api_route", "event_handler", "scheduled", "lifecycle", "custom")
OPS = ("upsert_node", "delete_node", "upsert_edge", "delete_edge", "delete_edges_from", "delete_file_nodes")
#: Version of the table layout, stored with every snapshot.
VERSION = 1
