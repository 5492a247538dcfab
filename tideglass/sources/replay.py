"""A Python data source that replays recorded posts, batch or stream: the connector interface.

A connector is any class with `search(query, limit)` giving dicts that have at least id, date, rawContent
and user. `ReplayBackend` gives those of JSON-lines files; register the source with
`spark.dataSource.register(ReplaySource)` and read it by `spark.read.format("replay")`."""

from __future__ import annotations

import glob
import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class Backend(ABC):
    """What a collector needs of a source of posts."""

    name = "backend"

    @abstractmethod
    def search(self, query: str, limit: int) -> Iterator[dict]:
        """Raw posts whose text has `query`, `limit` at most."""

    def close(self) -> None:
        """Frees what the backend holds."""


class ReplayBackend(Backend):
    name = "replay"

    def __init__(self, path: str):
        self.path = path

    def search(self, query: str, limit: int) -> Iterator[dict]:
        given = 0
        for file in sorted(glob.glob(self.path)):
            with open(file, encoding="utf-8") as lines:
                for line in lines:
                    if given >= limit:
                        return
                    try:
                        record = json.loads(line)
                    except ValueError:
                        continue
                    if query.lower() in str(record.get("rawContent", "")).lower():
                        given += 1
                        yield record


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.query, self.limit = options["path"], options.get("query", ""), int(options.get("limit", 1 << 62))

    def partitions(self):
        return [InputPartition(f) for f in sorted(glob.glob(self.path))] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            for record in ReplayBackend(partition.value).search(self.query, self.limit):
                yield (json.dumps(record, ensure_ascii=False),)


class _StreamReader(SimpleDataSourceStreamReader):
    """One file per batch, in order of names."""

    def __init__(self, options):
        self.path = options["path"]

    def initialOffset(self):
        return {"files": 0}

    def _lines(self, first: int, end: int):
        # a list's iterator, since rows of this kind of reader are sent from the driver
        return iter([(json.dumps(r, ensure_ascii=False),) for f in sorted(glob.glob(self.path))[first:end] for r in ReplayBackend(f).search("", 1 << 62)])

    def read(self, start):
        at = start["files"]
        end = min(at + 1, len(glob.glob(self.path)))
        return self._lines(at, end), {"files": end}

    def readBetweenOffsets(self, start, end):
        return self._lines(start["files"], end["files"])


class ReplaySource(DataSource):
    @classmethod
    def name(cls):
        return "replay"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)
