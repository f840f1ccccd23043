"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... segments; each has its mean and its deviation (the norm of what remains without the
mean). With these, q.x = sum over segments of (length * mean_q * mean_x + residual_q . residual_x), and the last term
is at most deviation_q * deviation_x, which is the lower bound of the distance in terms of the product. Candidates are
bounded coarse to fine; only who can still reach a query's k-th best score goes on to the next level, and the survivors
get their exact integer product.

Vectors travel in blocks of bounded size. A block of queries meets the candidate blocks of a group one after the other;
its best k so far, with their scores as the bar for the next block, stay with it, and only the group's best k a query
leave the task. Query blocks form ranges: a task has one range and one group, so its work is bounded however large both
sides are. Of a row that repeats (id and vector), k copies are enough for any result, and no more are dealt to its block.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null
id; an empty table gives no rows; only vectors of one length are compared; the rows with a query's id are its own and no
candidates for it; other repeated rows each count; ties go to the smaller id; components of any size are exact integers,
and scores beyond 64 bits are held at its limits; vectors of any length are compared whole; extra columns, whatever
their names, do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import Scratch

CANDIDATES_A_BLOCK = 4096
QUERIES_A_BLOCK = 1024
#: Candidate blocks that a block of queries meets in one run.
BLOCKS_A_GROUP = 16
#: Query blocks that meet a group in one task: as many vectors as its candidates.
BLOCKS_A_RANGE = 64
#: Ids of repeated rows (some 16 bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
STRIP = 1024
#: Share of pairs of a strip from which on their products are made as one matrix.
DENSE = 0.05
BLOCK = "dim int, block long, ids binary, data binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), finite) & (F.size(vector) > 0), F.lit(False))


def levels(dim: int) -> list[int]:
    """Numbers of segments from coarse to fine, under the dimension."""
    out = [1]
    while out[-1] * 4 < dim:
        out.append(out[-1] * 4)
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means (times the root of the segment's length) and deviations of each row's segments, side by side."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    root = np.sqrt(np.diff(edges))
    mean = np.add.reduceat(x, edges[:-1], axis=1) / np.diff(edges)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    spread = np.sqrt(np.maximum(square - (mean * root) ** 2, 0.0))
    return np.hstack([mean * root, spread])


def _products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """a @ b.T where ``alive``, -inf elsewhere; only rows, columns or pairs that are alive are looked at."""
    out = np.full(alive.shape, -np.inf)
    rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    part = alive[np.ix_(rows, cols)]
    if part.mean() > DENSE:
        out[np.ix_(rows, cols)] = np.where(part, a[rows] @ b[cols].T, -np.inf)
    elif len(rows):
        i, j = np.nonzero(part)
        out[rows[i], cols[j]] = np.einsum("ij,ij->i", a[rows[i]], b[cols[j]])
    return out


class Best:
    """The best k of one block of queries among the candidates that it has met. Ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int) -> None:
        self.ids, self.raw, self.k, self.scale = ids, vectors, k, scale
        self.vectors, self.top = self._whole(vectors)
        with np.errstate(over="ignore", invalid="ignore"):
            self.stats = [(s, statistics(self.vectors, s)) for s in levels(vectors.shape[1])]
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), dtype=np.int64)

    def _whole(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """floor(scale * x), exact as long as it is under 2^53, and the largest of them."""
        with np.errstate(over="ignore"):
            y = np.floor(x * float(self.scale))
        return y, max(np.abs(y).max(initial=0), 1)

    def _integers(self, x: np.ndarray) -> list[list[int]]:
        whole = lambda v: math.floor(v * self.scale) if abs(v) < 2**40 else math.floor(Fraction(v) * self.scale)
        return [[whole(v) for v in row] for row in x.tolist()]

    def _merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes scores (rows by candidates) into the best; ids is one row of ids."""
        if self.score.dtype != score.dtype:
            score, self.score = score.astype(object), self.score.astype(object)
        both = np.hstack([self.score[rows], score])
        name = np.hstack([self.found[rows], np.broadcast_to(ids, score.shape)])
        order = np.argsort(name, axis=1, kind="stable")
        both, name = np.take_along_axis(both, order, axis=1), np.take_along_axis(name, order, axis=1)
        pick = np.argsort(-both, axis=1, kind="stable")[:, : self.k]
        self.score[rows], self.found[rows] = np.take_along_axis(both, pick, axis=1), np.take_along_axis(name, pick, axis=1)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """One block of candidates."""
        own, top = self._whole(vectors)
        top *= self.top * vectors.shape[1]
        if top < 2**53 and self.score.dtype != object:
            for lo in range(0, len(ids), STRIP):
                self._strip(ids[lo : lo + STRIP], own[lo : lo + STRIP], top)
            return
        limit, mine = 2**63 - 1, self._integers(self.raw)
        for i, x in zip(ids, self._integers(vectors), strict=True):
            rows = np.flatnonzero(self.ids != i)
            score = [max(-limit - 1, min(limit, sum(u * v for u, v in zip(mine[r], x, strict=True)))) for r in rows]
            self._merge(rows, np.array(score, dtype=object).reshape(-1, 1), np.array([i]))

    def _strip(self, ids: np.ndarray, part: np.ndarray, top: float) -> None:
        alive = self.ids[:, None] != ids[None, :]
        bar = self.score[:, -1:]
        for s, stats in self.stats if np.isfinite(bar).any() else ():
            alive &= _products(stats, statistics(part, s), alive) + (1e-9 * top + 1e-6) >= bar
            if not alive.any():
                return
        score = _products(self.vectors, part, alive)
        score[score < bar] = -np.inf
        rows = np.flatnonzero((score > -np.inf).any(axis=1))
        if not len(rows):
            return
        if len(ids) > 4 * self.k:  # only the k best of the strip, and what ties with the last of them
            least = -np.partition(-score[rows], self.k - 1, axis=1)[:, self.k - 1 : self.k]
            live = (score[rows] >= least) & (score[rows] > -np.inf)
            cols = np.flatnonzero(live.any(axis=0))
            self._merge(rows, np.where(live, score[rows], -np.inf)[:, cols], ids[cols])
        else:
            self._merge(rows, score[rows], ids)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores."""
        at, place = np.nonzero(self.score != -np.inf)
        return self.ids[at], self.found[at, place], np.array([int(v) for v in self.score[at, place]], dtype=np.int64)


def _at_most(vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``vectors`` (id, vector) with at most k of the rows that are the same.

    Rows of one id score alike with any query, so more than k of them cannot be among its best k, nor can more than k copies
    of a query's results. Only rows whose id repeats are counted.
    """
    several = scratch.keep(vectors.groupBy("id").count().filter("count > 1").select(F.col("id")), "several")
    n = several.count()
    if not n:
        return vectors
    several = F.broadcast(several) if n <= BROADCAST_IDS else several
    counted = vectors.join(several, "id", "left_semi").groupBy("id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_copies"))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("id", "vector")
    return vectors.join(several, "id", "left_anti").unionByName(copies)


def _blocks(vectors: DataFrame, size: int, count: int) -> DataFrame:
    """``count`` vectors (id long, vector array<double>) as rows of about ``size`` vectors of one length."""
    n = max(1, -(-count // size))
    dealt = vectors.withColumn("_dim", F.size("vector")).withColumn("_block", F.pmod(F.xxhash64("id", "vector"), F.lit(n)))

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dim, block = (k.as_py() for k in key)
        ids = rows.column("id").to_numpy().astype("<i8")
        data = rows.column("vector").combine_chunks().flatten().to_numpy().astype("<f8")
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "ids": [ids.tobytes()], "data": [data.tobytes()]})

    return dealt.groupBy("_dim", "_block").applyInArrow(pack, BLOCK)


def topk(candidates: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, id, score of each query's best k by the integer product of floor(scale * x)."""

    def ready(df: DataFrame) -> DataFrame:
        return df.filter(usable(F.col(vector)) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    scratch = Scratch(candidates.sparkSession, "topk")
    left, right = (_at_most(ready(df), k, scratch) for df in (queries, candidates))
    n_left, n_right = left.count(), right.count()
    blocks = max(1, -(-n_right // CANDIDATES_A_BLOCK))
    # Groups of a few blocks where the table is small, so that every core has one.
    groups = max(-(-blocks // BLOCKS_A_GROUP), min(blocks, candidates.sparkSession.sparkContext.defaultParallelism))
    ranges = max(1, -(-n_left // (QUERIES_A_BLOCK * BLOCKS_A_RANGE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    # A stated set of queries against all rows: a range of query blocks is sent to every group of candidate blocks.
    x = _blocks(right, CANDIDATES_A_BLOCK, n_right).withColumn("group", F.pmod("block", F.lit(groups))).withColumn("range", every(ranges))
    q = _blocks(left, QUERIES_A_BLOCK, n_left).withColumnsRenamed({"block": "q_block", "ids": "q_ids", "data": "q_data"})
    q = q.withColumn("range", F.pmod("q_block", F.lit(ranges))).withColumn("group", every(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda best: pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], ["query_id", id, "score"])
        now, best = None, None
        for b in batches:
            for r in range(b.num_rows):
                at = {c: b.column(c)[r].as_py() for c in b.schema.names if c != "q_data"}
                # Rows of a query block come one after the other; where they do not, it only sends on more.
                if (mark := (at["dim"], at["group"], at["q_block"])) != now:
                    if best:
                        yield as_batch(best)
                    q_ids = np.frombuffer(at["q_ids"], "<i8")
                    now, best = mark, Best(q_ids, np.frombuffer(b.column("q_data")[r].as_py(), "<f8").reshape(len(q_ids), -1), k, scale)
                ids = np.frombuffer(at["ids"], "<i8")
                best.meet(ids, np.frombuffer(at["data"], "<f8").reshape(len(ids), -1))
        if best:
            yield as_batch(best)

    met = q.join(x.hint("merge"), ["dim", "group", "range"])
    found = met.mapInArrow(run, f"query_id long, {id} long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), id, "score")
