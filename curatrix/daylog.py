"""An append log in days (or months) whose old ones can go: folders named by a manifest.

Each append writes its rows by day and names the new folders in one version of a `Store` state. ``trim`` drops the folders
of days before the boundary from the manifest without reading them; of the boundary's own day it rewrites what is not
older. A reader keeps the folders of the version that it began with: they are removed by ``vacuum``, and only those that
no version younger than a given age names. ``rollup`` replaces old days by mergeable monthly partials in one commit.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.checks import RETENTION_DAYS
from curatrix.store import Store

#: Rows without a time; they are never old.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
GRACE_SECONDS = 86_400


class DayLog:
    """The log ``name``, by the day, or by the month, of ``at``; months for logs that are kept for years."""

    def __init__(self, store: Store, name: str, at: str = "checked_at", monthly: bool = False) -> None:
        self.store, self.spark, self.name, self.at = store, store.spark, name, at
        self.form, self.digits = ("yyyy-MM", 7) if monthly else ("yyyy-MM-dd", 10)

    def manifest(self) -> dict:
        """{days: {day: [folder]}, months: [folder], dropped: [[folder, time]]} of the last commit."""
        return self.store.state(self.name)[1] or {"days": {}, "months": [], "dropped": []}

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        path = f"{self.store.root}/{self.name}/rows-{uuid.uuid4().hex}"
        # Rows of a day meet in few files; adaptive execution splits days with very many.
        rows.withColumn("_day", F.date_format(F.col(self.at), self.form)).hint("rebalance", "_day").write.partitionBy("_day").parquet(path)
        return {n.split("=")[1]: [f"{path}/{n}"] for n in self.store.names(path) if n.startswith("_day=")}

    def append(self, rows: DataFrame) -> None:
        made = self._write(rows)
        number, manifest = self.store.state(self.name)
        manifest = manifest or self.manifest()
        days = {d: [*manifest["days"].get(d, []), *made.get(d, [])] for d in {**manifest["days"], **made}}
        self.store.commit(self.name, number + 1, manifest | {"days": days})

    def read(self, manifest: dict | None = None, since: str | None = None) -> DataFrame | None:
        """The rows, of days from ``since`` on if given; None if there are none. Folders of other days are not opened."""
        days = (manifest or self.manifest())["days"]
        folders = [f for d, each in sorted(days.items()) if since is None or d == NO_DAY or d >= since for f in each]
        return self.spark.read.parquet(*folders) if folders else None

    def trim(self, now: str, days: int = RETENTION_DAYS, clock: float | None = None) -> dict:
        """Deletes rows older than ``days`` before ``now`` (one exactly that old stays): {dropped, rewritten, deleted}.

        Dropped days are not read; rows of the boundary's day are split exactly. ``deleted`` counts what went, from file
        footers and the one day.
        """
        number, manifest = self.store.state(self.name)
        if not number:
            return {"dropped": [], "rewritten": None, "deleted": 0}
        edge = dt.datetime.fromisoformat(now) - dt.timedelta(days=days)
        day = edge.date().isoformat()[: self.digits]
        dropped = sorted(d for d in manifest["days"] if d != NO_DAY and d < day)
        gone = [f for d in dropped for f in manifest["days"][d]]
        deleted = self.spark.read.parquet(*gone).count() if gone else 0
        kept = {d: f for d, f in manifest["days"].items() if d not in dropped}
        rewritten = None
        if day in kept:
            rows = self.spark.read.parquet(*kept[day])
            young = F.col(self.at) >= F.lit(edge.isoformat(sep=" ")).cast("timestamp")
            old = rows.filter(~young).count()
            if old:
                rewritten, gone = day, [*gone, *kept.pop(day)]
                kept |= self._write(rows.filter(young))
                deleted += old
        if gone:
            clock = time.time() if clock is None else clock
            self.store.commit(self.name, number + 1, manifest | {"days": kept, "dropped": [*manifest["dropped"], *([f, clock] for f in gone)]})
        return {"dropped": dropped, "rewritten": rewritten, "deleted": deleted}

    def vacuum(self, clock: float | None = None, grace: float = GRACE_SECONDS) -> int:
        """Removes folders that were dropped ``grace`` seconds ago or longer; readers that began before are done by then."""
        clock = time.time() if clock is None else clock
        number, manifest = self.store.state(self.name)
        old = [f for f, at in (manifest or {"dropped": []})["dropped"] if at + grace <= clock]
        if old:
            self.store.commit(self.name, number + 1, manifest | {"dropped": [x for x in manifest["dropped"] if x[0] not in old]})
            for f in old:
                self.store.remove(f)
        return len(old)

    def rollup(self, now: str, keep_days: int, by: list[str], sums: list[str], clock: float | None = None) -> int:
        """Whole months that ended ``keep_days`` before ``now`` become partials (month, by, n, sums); their days go.

        Partials of a month that already has some are merged with them, so late rows and repeated runs give the same table;
        partials and the missing days show in one commit. Returns how many days went.
        """
        number, manifest = self.store.state(self.name)
        if not number:
            return 0
        edge = (dt.datetime.fromisoformat(now) - dt.timedelta(days=keep_days)).date().replace(day=1).isoformat()[: self.digits]
        old = sorted(d for d in manifest["days"] if d != NO_DAY and d < edge)
        if not old:
            return 0
        gone = [f for d in old for f in manifest["days"][d]]
        rows = self.spark.read.parquet(*gone).withColumn("month", F.date_format(self.at, "yyyy-MM"))
        made = rows.groupBy("month", *by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in sums))
        if manifest["months"]:
            made = made.unionByName(self.spark.read.parquet(*manifest["months"]))
            made = made.groupBy("month", *by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
        path = f"{self.store.root}/{self.name}/months-{uuid.uuid4().hex}"
        made.write.parquet(path)
        clock = time.time() if clock is None else clock
        days = {d: f for d, f in manifest["days"].items() if d not in old}
        dropped = [*manifest["dropped"], *([f, clock] for f in [*gone, *manifest["months"]])]
        self.store.commit(self.name, number + 1, manifest | {"days": days, "months": [path], "dropped": dropped})
        return len(old)

    def months(self) -> DataFrame | None:
        paths = self.manifest()["months"]
        return self.spark.read.parquet(*paths) if paths else None
