"""A streaming Python data source that follows the cursors of recorded answers.

``spark.readStream.format("recorded_cursors")`` gives one row per item (page, cursor, index, item, warning). The answer to
cursor ``c`` is the file ``<c, percent-encoded>.json`` of the folder, the first one ``page-1.json``; an answer has its items in
``servers`` or ``items`` and the next cursor in ``nextCursor`` or ``next_page_cursor``. An answer without a next cursor is
followed by the next page number, at most up to MAX_PAGES, until one has no items.

Offsets are the cursors: (cursor, page, skip, done pages). Spark writes them to its checkpoint before a batch and commits
them after it, so that a restarted query goes on where the last one ended and reads each item once. ``limit`` is a run's
hard ceiling on items; a page that it cuts goes on at the next item in the next run (``skip``). An answer that is not there
or no JSON gives one row with a warning, and its run ends before it; the next run asks again.

Options: path, limit (items a run), pages (answers a batch). Register it with ``register(spark)``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages that are asked for by number when no cursor comes; items a run; answers a batch.
MAX_PAGES, LIMIT, PAGES = 10, 1_000_000, 8
SCHEMA = "page int, cursor string, index int, item string, warning string"


class _Answer(InputPartition):
    def __init__(self, number: int, page: int, cursor: str, path: str, first: int, last: int, warning: str | None = None) -> None:
        super().__init__(number)
        self.page, self.cursor, self.path, self.first, self.last, self.warning = page, cursor, path, first, last, warning


def _items(answer: dict) -> list:
    return answer.get("servers") or answer.get("items") or []


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.limit = options["path"], int(options.get("limit", LIMIT))
        self.pages = int(options.get("pages", PAGES))
        self.here: dict | None = None
        self.read_items, self.asked = 0, False

    def _path(self, at: dict) -> str:
        return os.path.join(self.root, (quote(at["cursor"], safe="") if at["cursor"] else f"page-{at['page']}") + ".json")

    def _load(self, at: dict) -> dict:
        with open(self._path(at), encoding="utf-8") as f:
            found = json.load(f)
        if not isinstance(found, dict):
            raise ValueError("an answer is an object")
        return found

    def _step(self, at: dict, room: int) -> tuple[dict, _Answer | None]:
        """From one position the next, and what to read between; the same one and nothing at the end."""
        if at["end"] or room <= 0:
            return at, None
        try:
            answer = self._load(at)
        except (OSError, ValueError) as e:
            if at["skip"] == 0 and not at["cursor"] and at["page"] > 1 and isinstance(e, FileNotFoundError):
                return at | {"end": True}, None
            return at | {"failed": at["failed"] + 1}, _Answer(0, at["page"], at["cursor"], "", 0, 0, f"{type(e).__name__}: {os.path.basename(self._path(at))}")
        items = _items(answer)
        last = min(len(items), at["skip"] + room)
        part = _Answer(0, at["page"], at["cursor"], self._path(at), at["skip"], last)
        if last < len(items):
            return at | {"skip": last, "failed": 0}, part
        cursor = answer.get("nextCursor") or answer.get("next_page_cursor") or ""
        number = at["page"] + 1
        end = not items or not cursor and number > MAX_PAGES
        return {"cursor": cursor, "page": number, "skip": 0, "failed": 0, "end": end}, part

    def _walk(self, start: dict, stop: dict | None, room: int) -> tuple[dict, list[_Answer]]:
        at, parts = start, []
        while at != stop and (stop is not None or len(parts) < self.pages):
            new, part = self._step(at, room)
            if stop is not None and part is not None and (new["page"], new["skip"]) > (stop["page"], stop["skip"]) and stop["skip"] > at["skip"]:
                part, new = _Answer(0, at["page"], at["cursor"], part.path, at["skip"], stop["skip"]), stop
            if part is not None:
                part.number = len(parts)
                parts.append(part)
                room -= part.last - part.first
            if new == at or new["failed"] != at["failed"] and new["failed"]:
                return new, parts
            at = new
        return at, parts

    def initialOffset(self) -> dict:
        return {"cursor": "", "page": 1, "skip": 0, "failed": 0, "end": False}

    def latestOffset(self) -> dict:
        if self.here is None:
            self.here = self.initialOffset()
        if not (self.asked and self.here["failed"]):
            before = self.here
            self.here, parts = self._walk(before, None, self.limit - self.read_items)
            self.read_items += sum(p.last - p.first for p in parts)
            self.asked = True
        return self.here

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.here is None:  # a restart plans its last batch first; the run goes on from there
            self.here = end
        return self._walk(start, end, 1 << 60)[1]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.warning:
            yield partition.page, partition.cursor, None, None, partition.warning
            return
        with open(partition.path, encoding="utf-8") as f:
            items = _items(json.load(f))
        for i in range(partition.first, partition.last):
            yield partition.page, partition.cursor, i, json.dumps(items[i], ensure_ascii=False), None

    def commit(self, end: dict) -> None:
        """Nothing is kept besides Spark's own checkpoint."""


class RecordedCursors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_cursors"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CursorReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedCursors)
