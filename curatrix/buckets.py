"""A keyed table in buckets: a merge writes the buckets that its batch touches and no others.

Rows lie in buckets by a hash of their key, each bucket in folders of its own. One version of a `Store` state (the manifest)
names the folders of every bucket, the log rows and the index changes of a commit; all of them show at once when the
version's file is created, and a reader keeps the files of the version that it began with. A commit may carry a batch
number of a stream: a batch that is in the table is not merged again, so a stream that fails anywhere between its writes
and repeats the batch leaves one version, one run row and one log entry of it.

Files of replaced buckets stay for readers until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.lineage import cut
from curatrix.operators import upsert
from curatrix.store import Store

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketedTable:
    def __init__(self, store: Store, name: str, key: str = "source_url", buckets: int = BUCKETS) -> None:
        self.store, self.spark, self.name, self.key, self.buckets = store, store.spark, name, key, buckets

    def manifest(self) -> dict:
        """{buckets, schema, folders: {bucket: [path]}, runs: [path], batches: {stream: number}} of the last commit."""
        number, found = self.store.state(self.name)
        if not number:
            raise FileNotFoundError(f"{self.name} has no version yet")
        return found

    def _write(self, rows: DataFrame, parts: list[int], split: int) -> dict[str, list[str]]:
        """Writes rows of the given buckets, ``split`` files a bucket; the folder of each (none: no rows)."""
        path = f"{self.store.root}/{self.name}/data-{uuid.uuid4().hex}"
        spread = rows.withColumn("_bucket", bucket_of(self.key, self.manifest_buckets)).withColumn("_part", F.pmod(F.xxhash64(self.key, F.lit("part")), F.lit(split)))
        spread.repartition(max(1, len(parts) * split), "_bucket", "_part").drop("_part").write.partitionBy("_bucket").parquet(path)
        there = {name.split("=")[1] for name in self.store.names(path) if name.startswith("_bucket=")}
        return {str(b): [f"{path}/_bucket={b}"] if str(b) in there else [] for b in parts}

    @property
    def manifest_buckets(self) -> int:
        """The table's own number of buckets once it is there."""
        found = self.store.state(self.name)[1]
        return found["buckets"] if found else self.buckets

    def create(self, rows: DataFrame, split: int = 1) -> None:
        number, found = self.store.state(self.name)
        folders = self._write(rows, list(range(self.manifest_buckets)), split)
        self.store.commit(self.name, number + 1, {"buckets": self.manifest_buckets, "schema": rows.schema.json(), "folders": folders, "runs": (found or {}).get("runs", []), "batches": (found or {}).get("batches", {})})

    def read(self, parts: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some of its buckets: files of others are not listed."""
        manifest = manifest or self.manifest()
        folders = [p for b, paths in manifest["folders"].items() if parts is None or int(b) in parts for p in paths]
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame | None:
        """The run rows of all commits; None before the first."""
        paths = self.manifest()["runs"]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(
        self, batch: DataFrame, now: str, content: list[str], pos: str = "pos", stream: str | None = None, number: int | None = None,
        evidence: Callable[[DataFrame], DataFrame] | None = None, split: int = 1, between: Callable[[str], None] = lambda step: None,
    ) -> list[int]:
        """Merges a batch as `upsert.snapshot` does and returns the buckets that were rewritten.

        ``stream`` and ``number``: which batch of which stream this is; one that the table has is left out.
        ``evidence`` makes run rows of the batch's outcomes, which are committed with it. ``between`` is called between
        the writes (tests make it fail).
        """
        version, manifest = self.store.state(self.name)
        if stream is not None and number is not None and manifest["batches"].get(stream, -1) >= number:
            return []
        touched = sorted(r[0] for r in batch.select(bucket_of(self.key, manifest["buckets"])).distinct().collect())
        stored = self.read(touched, manifest)
        # Slugs are unique in the whole table: one column of it is read.
        slugs = self.read(manifest=manifest).select("slug")
        done = cut(upsert.outcomes(batch, stored, self.key, pos, slugs))
        folders = self._write(upsert.applied(done, stored, now, content, self.key, pos), touched, split)
        between("data")
        runs = list(manifest["runs"])
        if evidence is not None:
            path = f"{self.store.root}/{self.name}/runs-{uuid.uuid4().hex}"
            evidence(done).coalesce(1).write.parquet(path)
            runs.append(path)
        between("evidence")
        batches = manifest["batches"] | ({stream: number} if stream is not None and number is not None else {})
        self.store.commit(self.name, version + 1, manifest | {"folders": manifest["folders"] | folders, "runs": runs, "batches": batches})
        between("commit")
        return touched

    def vacuum(self) -> int:
        """Removes folders that the last version does not name; to be called when no reader of older ones is left."""
        manifest = self.manifest()
        used = {p.rsplit("/_bucket=", 1)[0] for paths in manifest["folders"].values() for p in paths}
        kept = {p.rsplit("/", 1)[1] for p in [*used, *manifest["runs"]]}
        named = {p for paths in manifest["folders"].values() for p in paths}
        gone = 0
        for name in self.store.names(f"{self.store.root}/{self.name}"):
            if name.startswith(("data-", "runs-")) and name not in kept:
                self.store.remove(f"{self.store.root}/{self.name}/{name}")
                gone += 1
            elif name.startswith("data-"):
                for part in self.store.names(f"{self.store.root}/{self.name}/{name}"):
                    path = f"{self.store.root}/{self.name}/{name}/{part}"
                    if part.startswith("_bucket=") and path not in named:
                        self.store.remove(path)
                        gone += 1
        return gone
