"""Connected components by alternating large and small stars, on DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Scratch

ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: neighbours are linked to the least node instead."""
    if large:  # each node's larger neighbours go to its least neighbour
        sides = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        moved = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # each node and its smaller neighbours go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of ``links`` (a long, b long) with their component's least node: (node, component).

    Every round's edges are a table in the shared folder; the loop ends when a round changes nothing, which only
    counts and a checksum of the edges tell the driver.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    mark = _mark(edges)
    for _ in range(ROUNDS):
        after = scratch.keep(_star(_star(edges, True), False), "edges")
        now = _mark(after)
        scratch.drop(edges)
        edges = after
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    h = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first())
