"""Versioned Parquet snapshots with a pointer, and a lock that ends by itself.

A table's next version is written beside the one that is being read; then the pointer moves in one rename. Readers see
either version whole. All paths go through Hadoop's file system, so any store that Spark writes will do.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCK_SECONDS = 1200


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def _read(self, path) -> str | None:
        fs = self._fs(path)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_new(self, path, content: str) -> bool:
        """Creates a whole file at once; False if there is one already.

        It is written under another name, then linked (local files) or renamed into place, of which a file system lets
        one writer do. A store without an atomic rename needs a lock service instead.
        """
        fs = self._fs(path)
        made = self._jvm.org.apache.hadoop.fs.Path(path.getParent().getParent(), f".{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        stream = fs.create(made, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":
                try:
                    os.link(made.toUri().getPath(), path.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not fs.exists(path) and bool(fs.rename(made, path))
        finally:
            fs.delete(made, False)

    def version(self, table: str) -> int:
        """The current version; 0 before the first write."""
        files = self._list(table, "_versions")
        return max((int(f) for f in files), default=0)

    def _list(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def names(self, path: str) -> list[str]:
        """Names in a folder of the store."""
        folder = self._jvm.org.apache.hadoop.fs.Path(path)
        fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def remove(self, path: str) -> None:
        folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs(folder).delete(folder, True)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.version(table) if version is None else version
        if not version:
            raise FileNotFoundError(f"{table} has no version yet")
        return self.spark.read.parquet(self._read(self._path(table, "_versions", f"{version:012d}")))

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Writes the next version and moves the pointer: whoever creates its file first wins, another writer fails."""
        number = self.version(table) + 1
        data = "/".join([self.root, table, f"v{number:012d}-{uuid.uuid4().hex}"])
        df.write.partitionBy(*(partition_by or [])).parquet(data)
        if not self._write_new(self._path(table, "_versions", f"{number:012d}"), data):
            raise RuntimeError(f"another writer made version {number} of {table}")
        return number

    def state(self, name: str) -> tuple[int, dict | None]:
        """Number and content of a state's last version; 0 and None before the first."""
        number = self.version(name)
        return number, json.loads(self._read(self._path(name, "_versions", f"{number:012d}"))) if number else None

    def commit(self, name: str, number: int, content: dict) -> None:
        """Makes ``content`` version ``number`` of a state at once; fails if another writer has made it."""
        if not self._write_new(self._path(name, "_versions", f"{number:012d}"), json.dumps(content)):
            raise RuntimeError(f"another writer made version {number} of {name}")

    def append(self, table: str, df: DataFrame) -> None:
        """Append-only logs (runs, checks, clicks) need no versions."""
        df.write.mode("append").parquet("/".join([self.root, table, "log"]))

    def log(self, table: str) -> DataFrame:
        return self.spark.read.parquet("/".join([self.root, table, "log"]))

    def _lock(self, name: str) -> tuple[int, dict]:
        """Number and content of a lock's last file; files are only added."""
        numbers = [int(f) for f in self._list("_locks", name) if f.isdigit()]
        if not numbers:
            return 0, {"holder": None, "expires": 0.0}
        return max(numbers), json.loads(self._read(self._path("_locks", name, f"{max(numbers):012d}")))

    def _next_lock(self, name: str, number: int, holder: str | None, expires: float) -> bool:
        content = json.dumps({"holder": holder, "expires": expires})
        done = self._write_new(self._path("_locks", name, f"{number + 1:012d}"), content)
        if done and number:  # the last file says all; one before it stays for readers that have just listed it
            path = self._path("_locks", name, f"{number - 1:012d}")
            self._fs(path).delete(path, False)
        return done

    def acquire(self, name: str, holder: str, now: float | None = None, ttl: int = LOCK_SECONDS) -> bool:
        """Takes a lock that is free or has ended (its last second counts as ended). Of several that try, one does."""
        now = time.time() if now is None else now
        number, held = self._lock(name)
        return held["expires"] <= now and self._next_lock(name, number, holder, now + ttl)

    def release(self, name: str, holder: str) -> bool:
        """Gives back a lock; only its holder can."""
        number, held = self._lock(name)
        return held["holder"] == holder and self._next_lock(name, number, None, 0.0)


def holder_id(agent: str, run: str | None = None) -> str:
    return f"{agent}@{run or 'local'}"
