"""A stored inverted index: segments of sorted postings, a dictionary with stems, tombstones, one manifest.

A segment has its postings in blocks (`blocks`), rows of a token and field with some ids and positions, sorted by token over
all its files, so that a file has a range of tokens; where one token fills several files they split it by id. Its fences say
which file has which tokens, and its dictionary has each token with its stem. A search looks up the tokens of its stems in
the dictionaries, then the files of these tokens in the fences, and opens no other file.

Changes work as triggers would: a changed or deleted record's id goes to the tombstones with the number of the change, and
postings of segments before that number no longer count; what is inserted or changed comes in a new segment. The manifest
that names segments and tombstones is one version of a `Store` state, so a change shows whole or not at all, and a reader
keeps the version that it began with. ``compact`` writes live postings into one segment.

Texts are tokenised once for an index; stems are made for the distinct tokens of each chunk that a task inverts.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators import blocks
from curatrix.operators import search as S
from curatrix.store import Store

#: Postings of a file, about: of a large segment, and at least, where there would be fewer files than cores.
FILE_POSTINGS, LEAST_POSTINGS = 2_000_000, 100_000
#: Tokens of a dictionary's file, about.
FILE_TOKENS = 500_000
#: Segments from which ``change`` compacts.
MOST_SEGMENTS = 8


class SearchIndex:
    """The index ``name`` in a store, over ``fields`` of records with ``id``."""

    def __init__(self, store: Store, name: str, fields: list[str] | None = None, id: str = "id", file_postings: int = FILE_POSTINGS) -> None:
        self.store, self.spark, self.name = store, store.spark, name
        self.fields, self.id, self.file_postings = fields or S.FIELDS, id, file_postings

    def manifest(self) -> dict:
        """{segments: [{number, path, apart}], tombstones: [path]} of the last committed change."""
        return self.store.state(self.name)[1] or {"segments": [], "tombstones": []}

    def _new(self, what: str) -> str:
        return f"{self.store.root}/{self.name}/{what}-{uuid.uuid4().hex}"

    def _write(self, found: DataFrame) -> str:
        """Writes blocks as a segment; its folder."""
        path = self._new("segment")
        # Stored before they are dealt, as a range partitioning reads its input twice.
        found.write.parquet(f"{path}/_raw")
        found = self.spark.read.parquet(f"{path}/_raw")
        n, cores = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], self.spark.sparkContext.defaultParallelism
        files = max(1, -(-n // self.file_postings), min(cores, n // LEAST_POSTINGS))
        # By token, then by id: a token with very many postings fills several files.
        order = ["token", "first"]
        spread = found.repartitionByRange(files, *order) if files > 1 else found.coalesce(1)
        spread.sortWithinPartitions(*order, "field", F.col("pos")[0]).write.parquet(f"{path}/postings")
        stored = self.spark.read.parquet(f"{path}/postings")
        file = F.col("_metadata.file_path").alias("file")
        stored.select("token", file).groupBy("file").agg(F.min("token").alias("first"), F.max("token").alias("last")).coalesce(1).write.parquet(f"{path}/fences")
        stored.select("token", "stem").distinct().write.parquet(f"{path}/_stems")
        known = self.spark.read.parquet(f"{path}/_stems")
        parts = -(-known.count() // FILE_TOKENS)
        (known.repartitionByRange(parts, "stem") if parts > 1 else known.coalesce(1)).sortWithinPartitions("stem", "token").write.parquet(f"{path}/dictionary")
        for done in ("_raw", "_stems"):
            self.store.remove(f"{path}/{done}")
        return path

    def _commit(self, number: int, manifest: dict) -> None:
        self.store.commit(self.name, number, manifest)

    def build(self, rows: DataFrame) -> None:
        """The index of ``rows``, in place of what there is."""
        number = self.store.state(self.name)[0] + 1
        # An id of several rows may be in several chunks.
        apart = rows.groupBy(self.id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        self._commit(number, {"segments": [{"number": number, "path": self._write(self._inverted(rows)), "apart": apart}], "tombstones": []})

    def _inverted(self, rows: DataFrame) -> DataFrame:
        """Blocks of records, in one tokenising pass."""
        return blocks.of_records(S.words(rows, self.fields, self.id), self.id, self.fields, self._most())

    def _most(self) -> int:
        return max(1, min(blocks.BLOCK, self.file_postings))

    def change(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Takes in inserted or updated records and takes out deleted ones (ids), in one commit."""
        number, manifest = self.store.state(self.name)
        manifest = manifest or {"segments": [], "tombstones": []}
        number += 1
        gone = [f.select(self.id) for f in (changed, deleted) if f is not None]
        if not gone:
            return
        dead = self._new("tombstones")
        ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        ids.distinct().withColumn("_until", F.lit(number)).write.parquet(dead)
        segments = [*manifest["segments"]]
        if changed is not None:
            segments.append({"number": number, "path": self._write(self._inverted(changed)), "apart": False})
        self._commit(number, {"segments": segments, "tombstones": [*manifest["tombstones"], dead]})
        if len(segments) > MOST_SEGMENTS:
            self.compact()

    def compact(self) -> None:
        """One segment of all live postings, no tombstones."""
        number, manifest = self.store.state(self.name)
        if manifest and (len(manifest["segments"]) > 1 or manifest["tombstones"]):
            live = self._live(manifest, [(s, None) for s in manifest["segments"]])
            live = self._write(blocks.of_occurrences(live, self.id, self._most()))
            self._commit(number + 1, {"segments": [{"number": number + 1, "path": live, "apart": False}], "tombstones": []})

    def _blocks(self, parts: list[tuple[dict, list[str] | None]]) -> DataFrame:
        """Blocks of the given files of segments (all of a segment: None), with the segment's number."""
        found = None
        for s, files in parts:
            # The files are read by name; unread ones are not opened.
            f = self.spark.read.parquet(*(files or [f"{s['path']}/postings"])).withColumn("_number", F.lit(s["number"]))
            found = f if found is None else found.unionByName(f)
        return found

    def _alive(self, manifest: dict, found: DataFrame) -> DataFrame:
        """Rows whose id was not changed or deleted after their segment (``_number``)."""
        if not manifest["tombstones"]:
            return found
        dead = self.spark.read.parquet(*manifest["tombstones"]).groupBy(self.id).agg(F.max("_until").alias("_until"))
        return found.join(dead, self.id, "left").filter(F.col("_until").isNull() | (F.col("_number") >= F.col("_until")))

    def _live(self, manifest: dict, parts: list[tuple[dict, list[str] | None]]) -> DataFrame:
        """Live postings of the given files of segments, a row each."""
        found = blocks.occurrences(self._blocks(parts), self.id, ["token", "stem", "field", "_number"])
        return self._alive(manifest, found).select("token", "stem", "field", self.id, "pos")

    def dictionary(self) -> DataFrame:
        """(token, stem) of the distinct tokens of all live postings."""
        manifest = self.manifest()
        known = self._dictionaries(manifest).select("token", "stem").distinct()
        if not manifest["tombstones"]:
            return known
        live = self._live(manifest, [(s, None) for s in manifest["segments"]]).select("token").distinct()
        return known.join(live, "token", "left_semi")

    def _dictionaries(self, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(*(f"{s['path']}/dictionary" for s in manifest["segments"]))

    def postings(self, stemmed: bool = True) -> DataFrame:
        """All live postings, by stem or by token."""
        manifest = self.manifest()
        found = self._live(manifest, [(s, None) for s in manifest["segments"]])
        return found.select("field", F.col("stem" if stemmed else "token").alias("token"), self.id, "pos")

    def frequencies(self) -> DataFrame:
        """(field, token, n, docs) of all live postings, by stem: how often it is there, and in how many records."""
        manifest = self.manifest()
        if manifest["tombstones"] or len(manifest["segments"]) > 1 or not all(s["apart"] for s in manifest["segments"]):
            return self.postings().groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(self.id).alias("docs"))
        found = self._blocks([(s, None) for s in manifest["segments"]]).select("field", F.col("stem").alias("token"), "n", "docs")
        return found.groupBy("field", "token").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "docs")))

    def tokens_of(self, terms: list[str], stemmed: bool = True) -> dict[str, str]:
        """The index's tokens that have the given stems (or are the given tokens), with the term of each."""
        manifest = self.manifest()
        if not manifest["segments"] or not terms:
            return {}
        by = "stem" if stemmed else "token"
        found = self._dictionaries(manifest).filter(F.col(by).isin(terms)).select("token", F.col(by).alias("term")).distinct()
        return {r["token"]: r["term"] for r in found.collect()}

    def files(self, tokens: list[str]) -> list[tuple[dict, list[str]]]:
        """The segments' files that have any of the tokens, by their fences."""
        out = []
        for s in self.manifest()["segments"]:
            meets = F.exists(F.array(*map(F.lit, tokens)), lambda t: t.between(F.col("first"), F.col("last"))) if tokens else F.lit(False)
            found = [r["file"] for r in self.spark.read.parquet(f"{s['path']}/fences").filter(meets).select("file").collect()]
            if found:
                out.append((s, found))
        return out

    def search(self, query: str, field: str | None = None, stemmed: bool = True) -> DataFrame:
        """(id, hits) of records that have every term of ``query``, in any field or in one."""
        terms = S.query_terms(self.spark, query, stemmed)
        tokens = self.tokens_of(terms, stemmed)
        files = self.files(sorted(tokens))
        if not files or set(tokens.values()) != set(terms):
            kind = self.manifest()["segments"] and self.spark.read.parquet(f"{self.manifest()['segments'][0]['path']}/postings").schema["ids"].dataType.elementType
            return self.spark.range(0).select(F.col("id").cast(kind or "bigint").alias(self.id), F.lit(0).cast("long").alias("hits"))
        found = self._blocks(files).filter(F.col("token").isin(sorted(tokens)))
        found = found.filter(F.col("field") == field) if field else found
        term = F.create_map(*(F.lit(x) for kv in sorted(tokens.items()) for x in kv))[F.col("token")]
        found = self._alive(self.manifest(), blocks.hits(found.withColumn("term", term), self.id, ["term", "_number"]))
        found = found.groupBy(self.id).agg(F.count_distinct("term").alias("_terms"), F.sum("n").alias("hits"))
        return found.filter(F.col("_terms") == len(terms)).select(self.id, "hits")


def signature(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of tables from another: their files with lengths and times, as a digest."""
    digest = hashlib.sha256()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        todo = [fs.getFileStatus(path)]
        for status in todo:
            if status.isDirectory():
                todo += sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().toString())
            else:
                digest.update(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()
