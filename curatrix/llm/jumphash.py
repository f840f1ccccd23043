"""Sharding by jump consistent hashing.

``jump_hash(keys, n)`` maps 64-bit keys to 0..n-1 without a ring table; with one more shard only the necessary
fraction (1/(n+1)) of the keys moves, all of it into the new shard. ``assign_shards`` adds shard, slot (gapless from
0 in each shard) and, on request, the shard after growing.

Slots are numbered in slices of a shard, which other columns than the key can spread; rows that repeat are one row with a
count until they have their slots. So neither a key nor a row that is very common is sorted in one task.

Defined cases: a null key is the key 0; repeated rows and equal keys go to one shard and get slots of their own; an
empty table gives no rows; null, empty and very long texts only count with their bytes. Existing columns with the names
of the operator's outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curatrix.llm.common import Scratch

#: The generator of the published jump consistent hash.
MULTIPLIER = 2862933555777941757
#: Parts of a shard that are numbered apart from each other; a shard's slots are never sorted in one task.
SLICES = 1024
#: Slots of one repeated row that one step hands out.
REPEATS = 20_000


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards (int32) of unsigned 64-bit keys, all keys at once; at most n rounds, about ln(n) on average."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    out = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        out[live] = jump[live]
        k = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        key[live] = k
        step = ((out[live] + 1).astype(np.float64) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        jump[live] = step
        live = live[step < n]
    return out.astype(np.int32)


def jump_shards(key: Column, *counts: int) -> Column:
    """Shards of a long column for each number of shards, as the struct's fields s0, s1, ... (nulls count as key 0)."""
    kind = T.StructType([T.StructField(f"s{i}", T.IntegerType()) for i in range(len(counts))])

    @F.pandas_udf(kind)
    def shards(s: pd.Series) -> pd.DataFrame:
        keys = s.to_numpy(dtype=np.int64, na_value=0).view(np.uint64)
        return pd.DataFrame({f"s{i}": jump_hash(keys, n) for i, n in enumerate(counts)})

    return shards(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def slice_of(key: Column, spread: Column | None = None, slices: int = SLICES) -> Column:
    """Part of a shard in which a row is numbered; any arithmetic progression of keys spreads over the parts."""
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.pmod(F.pmod(k, F.lit(1_000_003)) * F.lit(7919) + (F.lit(0) if spread is None else spread), F.lit(slices)).cast("int")


def assign_shards(df: DataFrame, key: str, n: int, grown: int | None = None, order: list[str] | None = None, spread: str | None = None, slices: int = SLICES) -> DataFrame:
    """``df`` with shard, slot and grown_shard. Carry only small columns: rows are shuffled by all of them.

    Slots number a shard's rows by (slice, key, order). ``spread`` names a long column that deals rows of one key over
    the slices. Counts of the slices (n * slices rows at most, so the broadcast is bounded by the parameters) give each
    slice its first slot.
    """
    df = df.drop("shard", "slot", "grown_shard")
    scratch = Scratch(df.sparkSession, "jumphash")
    s = df.withColumn("_s", jump_shards(F.col(key), n, *([grown] if grown else [])))
    s = s.select(*df.columns, F.col("_s.s0").alias("shard"), (F.col("_s.s1") if grown else F.lit(None).cast("int")).alias("grown_shard"))
    s = s.withColumn("_slice", slice_of(F.col(key), F.col(spread) if spread else None, slices))
    rows = scratch.keep(s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("_n")), "rows")
    counts = rows.groupBy("shard", "_slice").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    first = [key, *(order or [])]
    local = Window.partitionBy("shard", "_slice").orderBy(*first, *(c for c in df.columns if c not in first)).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_at", F.coalesce(F.sum("_n").over(local), F.lit(0))).join(F.broadcast(starts), ["shard", "_slice"])
    numbered = numbered.withColumn("_slot", F.col("_start") + F.col("_at"))
    names = [*df.columns, "shard", F.col("grown_shard"), "slot"]
    each = lambda r, lo, hi: r.withColumn("slot", F.explode(F.sequence(lo, hi))).select(*names)
    end = F.col("_slot") + F.col("_n") - 1
    out = each(numbered.filter(F.col("_n") <= REPEATS), F.col("_slot"), end)
    if rows.filter(F.col("_n") > REPEATS).isEmpty():
        return out
    many = numbered.filter(F.col("_n") > REPEATS).withColumn("_end", end).withColumn("_lo", F.explode(F.sequence(F.col("_slot"), end, F.lit(REPEATS).cast("long"))))
    many = many.repartition(df.sparkSession.sparkContext.defaultParallelism, "_slot", "_lo")
    return out.unionByName(each(many, F.col("_lo"), F.least(F.col("_lo") + REPEATS - 1, F.col("_end"))))
