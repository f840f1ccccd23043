"""Interaction of filters: what each removes, alone and in any order, by products of integer matrices.

Each text has a mask of the filters that it fails. By part (source), rows with one mask are counted: all, good ones and
toxic ones; these histograms, stacked, are rows of a matrix. For each order of the filters and each step of it a column
says which masks are kept, removed, redundant or unique there; so the products of the histograms with four 0/1 matrices
(2 ** filters by orders * steps: 32 by 600 for five) are all the counts.

Only masks and digests of whole texts are kept of the documents, in one pass without a shuffle of texts. The first row of
each text is found by an aggregation over digests (SHA-256) that combines before the shuffle, and is met again by digest
and id together, so that a text with very many copies, or a part with very many rows, is no hot key. A part has at most
4 * 32 counts, whatever its rows.

Defined cases: a null text is empty (fails A; B not, as 0 < 0 is false); all empty texts are equal; a null source is the
empty string; a null id is smaller than none and has none smaller, so it never fails E; rows with the smallest id of a
text, repeated ones too, do not fail E; ids without labels are neither good nor toxic, those with several rows are if one
says so; an empty table gives no rows; only the named columns are read. A text with very many words is split in its own
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Scratch

#: Limits of the filters and the characters that D looks for.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 2, "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_mask(text: Column, words: Column) -> Column:
    """The filters that a text with these words fails by itself: bits 0 to 3 for A to D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * upper.cast("long") > UPPER_PERCENT * F.char_length(text), text.rlike(SIGNS)]
    mask = F.lit(0)
    for i, f in enumerate(fails):
        mask = mask + F.when(f, 1 << i).otherwise(0)
    return mask.cast("int")


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic, n): counts of the rows by what they fail and by their labels."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("doc_id", "part", own_mask(F.col("text"), F.col("words")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = scratch.keep(rows.groupBy("doc_id", "part", "own", "digest").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("doc_id IS NOT NULL")
    met = rows.join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    repeat = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("own") + F.when(repeat, 1 << FILTERS.index("E")).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return met.groupBy("part", mask.alias("mask"), flag("good").alias("good"), flag("toxic").alias("toxic")).agg(F.sum("n").alias("n"))


def incidence(filters: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of the filters, and the matrices of masks by (order, step): kept, removed, redundant, unique."""
    orders = list(permutations(range(filters)))
    own = 1 << np.array(orders)
    before = np.cumsum(own, axis=1) - own
    mask = np.arange(1 << filters)[:, None, None]
    fails, earlier = (mask & own) != 0, (mask & before) != 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique": fails & (mask == own)}
    return orders, {k: v.reshape(1 << filters, -1).astype(np.int64) for k, v in found.items()}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters and step: the counts of COUNTS, zeros too.

    shapley is what the step's filter removes, at whatever step, summed over all orders.
    """
    cells = masks(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"), Scratch(docs.sparkSession, "audit"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"), "n")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, m = incidence(len(FILTERS))
        letter = np.array(orders).ravel()
        of_letter = (letter[:, None] == np.arange(len(FILTERS))).astype(np.int64)
        names = pa.array(np.repeat(["".join(FILTERS[i] for i in o) for o in orders], len(FILTERS)))
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders)))
        for b in batches:
            for part, found in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                rows = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
                for c in found:
                    rows[:, c["mask"]] += np.array([1, c["good"], c["toxic"]]) * c["n"]
                removed = rows @ m["removed"]
                shapley = (removed[0] @ of_letter)[letter]
                values = [rows[0] @ m["kept"], removed[0], rows[0] @ m["redundant"], rows[0] @ m["unique"], removed[1], removed[2], shapley]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.string()), names, steps, *map(pa.array, values)], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
