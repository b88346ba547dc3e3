"""Changes of a source tree as a streaming data source: spark.readStream.format("source_changes").load(root)."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from graphmill.functions.extract import language_of
from graphmill.sources.files import IGNORED_FOLDERS, IGNORED_SUFFIXES

NAME = "source_changes"
SCHEMA = "type string, file_path string, ts timestamp"
#: Fixed value: how long a file must have been left alone before it is told, as its writer may not be done.
STABLE_MS = 200


def listing(root: str) -> dict[str, list[int]]:
    """Modification time in nanoseconds, and size, of the source files below a folder; ignored folders aren't entered."""
    out = {}
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in IGNORED_FOLDERS and not d.startswith(".graphmill"))
        for name in names:
            path = os.path.join(folder, name)
            if language_of(path) and not name.endswith(IGNORED_SUFFIXES):
                try:
                    at = os.stat(path)
                except FileNotFoundError:
                    continue
                out[path] = [at.st_mtime_ns, at.st_size]
    return out


def difference(old: dict[str, list[int]], new: dict[str, list[int]], now_ms: int, stable_ms: int = STABLE_MS) -> tuple[list[tuple[str, str]], dict[str, list[int]]]:
    """(type, path) events between two listings, and the listing that they lead to: files written within the last
    stable_ms wait for the next look."""
    events, seen = [], dict(old)
    for path, state in sorted(new.items()):
        if old.get(path) != state and state[0] // 1_000_000 + stable_ms <= now_ms:
            events.append(("change" if path in old else "add", path))
            seen[path] = state
    for path in sorted(old.keys() - new.keys()):
        events.append(("unlink", path))
        del seen[path]
    return events, seen


class ChangesReader(SimpleDataSourceStreamReader):
    """An offset is what was seen of the tree, so a restarted query tells what changed while it was down."""

    def __init__(self, root: str, initial: bool):
        self.root, self.initial = root, initial

    def initialOffset(self) -> dict[str, Any]:  # noqa: N802
        return {"seen": {} if self.initial else listing(self.root)}

    def rows(self, events: list[tuple[str, str]]) -> Iterator[tuple]:
        now = datetime.now(timezone.utc)
        return iter([(kind, path, now) for kind, path in events])

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple], dict[str, Any]]:
        events, seen = difference(start["seen"], listing(self.root), time.time_ns() // 1_000_000)
        return self.rows(events), {"seen": seen}

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple]:  # noqa: N802
        return self.rows(difference(start["seen"], end["seen"], 1 << 62)[0])


class SourceChanges(DataSource):
    """Events (type add, change or unlink; file_path; ts) of source files below a folder that the driver sees. Option
    initial: whether files that are there at the start are told as added."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: Any) -> ChangesReader:  # noqa: N802
        return ChangesReader(self.options["path"], self.options.get("initial", "false").lower() == "true")


def source_changes(spark: SparkSession, root: str, initial: bool = False) -> Any:
    """The stream of changes below root, for watch()."""
    spark.dataSource.register(SourceChanges)
    return spark.readStream.format(NAME).option("initial", str(initial).lower()).load(root)
