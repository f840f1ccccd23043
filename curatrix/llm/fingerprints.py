"""Canonical exact fingerprints of documents, in native expressions only.

A text is brought to Unicode normal form (NFKC), case is folded, white space is folded to single spaces. Two xxhash64
values of the canonical text, 128 bits, are the bucket. Inside equal buckets the canonical bytes are compared: a bucket
with more than one canonical text (a collision) tells them apart by a SHA-256 suffix. Equal canonical texts have equal
fingerprints, all others differ.

Defined cases: a null text is the empty text; repeated rows get equal fingerprints; an empty table gives no rows; very
long texts are taken whole; columns named like the outputs are replaced, other columns do not matter. In the order of
`with_next`, rows with a null key come first, and rows that share a key are ordered by a digest of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import Scratch

#: Buckets with more than one row whose numbers (16 bytes each) may be broadcast; more of them are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: Fixed value: Unicode white space, as a character class.
SPACE = r"[\u0009-\u000D\u001C- \u0085   -     　]+"
QUANTILES = 256
#: About how much larger rows are in a shuffle than in their compressed table.
GROWN = 2
#: Slices whose first rows (some 40 bytes each) may be broadcast; more of them are joined by a shuffle.
BROADCAST_SLICES = 200_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, white space folded and cut at both ends. Texts in ASCII need the JVM's own lower() only."""
    t = F.coalesce(text, F.lit(""))
    call = lambda cls, fn, x, arg: F.java_method(F.lit(cls), F.lit(fn), x, F.lit(arg))
    nfkc = lambda x: call("com.ibm.icu.text.Normalizer", "compose", x, True)
    folded = nfkc(call("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(t), True))
    ascii_only = F.octet_length(t) == F.char_length(t)
    cased = F.when(ascii_only, F.lower(t)).otherwise(folded)
    return F.trim(F.regexp_replace(cased, SPACE, " "))


def bucket(canon: Column) -> list[Column]:
    """The two halves of the 128-bit bucket."""
    return [F.xxhash64(canon).alias("_h1"), F.xxhash64(F.lit("wide"), F.octet_length(canon), F.reverse(canon)).alias("_h2")]


def collisions(rows: DataFrame) -> DataFrame:
    """Buckets (_h1, _h2) of ``rows`` (_h1, _h2, _canon) that hold more than one canonical text, compared byte by byte."""
    return rows.groupBy("_h1", "_h2").agg((F.min("_canon") != F.max("_canon")).alias("_differ")).filter("_differ").select("_h1", "_h2")


def name(h1: Column, h2: Column, canon_sha: Column, collided: Column) -> Column:
    base = F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))
    return F.when(collided, F.concat(base, F.lit("-"), canon_sha)).otherwise(base)


def fingerprint_columns(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` columns and a fingerprint of each text column: {text column: name of its fingerprint}.

    Hashes are written to a shared table first. Only rows in buckets with several rows carry their texts to the byte
    comparison.
    """
    scratch = Scratch(df.sparkSession, "fingerprints")
    texts = list(columns)
    numbers = range(len(texts))
    canon = df.select(*keep, *(canonical(F.col(c)).alias(f"_c{i}") for i, c in enumerate(texts)))
    hashes = [h.alias(f"{h_name}_{i}") for i in numbers for h, h_name in zip(bucket(F.col(f"_c{i}")), ("_h1", "_h2"), strict=True)]
    # Canonical texts are made once; later jobs read them, or the hashes alone.
    kept = scratch.keep(canon.select("*", *hashes), "canonical")
    long = lambda frame, extra=(): frame.select(
        F.inline(F.array(*(F.struct(F.col(f"_h1_{i}").alias("_h1"), F.col(f"_h2_{i}").alias("_h2"), *(e(i) for e in extra)) for i in numbers)))
    )
    several = long(kept).groupBy("_h1", "_h2").count().filter("count > 1").select("_h1", "_h2")
    several = scratch.keep(several, "several")
    n = several.count()
    rows = long(kept, (lambda i: F.col(f"_c{i}").alias("_canon"),))
    shared = rows.join(F.broadcast(several) if n <= BROADCAST_BUCKETS else several, ["_h1", "_h2"], "left_semi")
    bad = scratch.keep(collisions(shared), "collisions")
    if bad.isEmpty():
        none = F.lit(False)
        return kept.select(*keep, *(name(F.col(f"_h1_{i}"), F.col(f"_h2_{i}"), F.lit(""), none).alias(columns[c]) for i, c in enumerate(texts)))
    out = kept
    for i, c in enumerate(texts):
        marked = bad.select(F.col("_h1").alias(f"_h1_{i}"), F.col("_h2").alias(f"_h2_{i}"), F.lit(True).alias("_hit"))
        out = out.join(marked, [f"_h1_{i}", f"_h2_{i}"], "left")
        out = out.withColumn(columns[c], name(F.col(f"_h1_{i}"), F.col(f"_h2_{i}"), F.sha2(f"_c{i}", 256), F.coalesce("_hit", F.lit(False)))).drop("_hit")
    return out.select(*keep, *columns.values())


#: Slices whose order is found at once.
RING = 4096
#: Bytes that a task of `with_next` gets to sort, about.
TASK_BYTES = 8 << 20
MOST_TASKS = 100_000


def _before(firsts: DataFrame) -> DataFrame:
    """``firsts`` with the slice before each one (before the first: the last), in two steps, so that no task sees all."""
    firsts = firsts.withColumn("_ring", F.expr(f"_slice div {RING}"))
    inside = Window.partitionBy("_ring").orderBy("_slice")
    rings = firsts.groupBy("_ring").agg(F.max("_slice").alias("_last"))
    last = rings.agg(F.max("_last")).first()[0]
    rings = rings.select("_ring", F.coalesce(F.lag("_last").over(Window.orderBy("_ring")), F.lit(last)).alias("_until"))
    return firsts.withColumn("_lag", F.lag("_slice").over(inside)).join(rings, "_ring").withColumn("_before", F.coalesce("_lag", "_until")).drop("_lag", "_until", "_ring")


def with_next(df: DataFrame, key: str, value: str, out: str, rows_a_slice: int = 4096) -> DataFrame:
    """``df`` with the ``value`` of the next row in the order of ``key`` (after the last: of the first), as ``out``.

    Rows are dealt into slices of the key's range, from its quantiles; rows that share a key which fills a quantile by
    itself are dealt by their digest. Each slice also gets the first row of the next one. So every row is shuffled once,
    and no task sorts more than a few slices.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62)))
    base = df.withColumn("_k", k)
    stats = base.agg(F.percentile_approx("_k", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    if not stats["n"]:
        return base.drop("_k").withColumn(out, F.col(value))
    cuts = sorted(set(stats["q"]))
    # Slices of a quantile: first those of its least key, by digest, as many as quantiles have it; then of the others.
    parts = max(1, -(-stats["n"] // (rows_a_slice * QUANTILES)))
    least = [parts * (stats["q"].count(c) - 1) or 1 for c in cuts]
    base_of = [sum(least[:i]) + parts * i for i in range(len(cuts))]
    total = sum(least) + parts * len(cuts)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    lows = longs(cuts)
    at = F.greatest(F.size(F.filter(lows, lambda c: c <= F.col("_k"))), F.lit(1))
    low, high = F.element_at(lows, at), F.element_at(longs([*cuts[1:], cuts[-1] + 1]), at)
    share = (F.col("_k") - low).cast("double") / F.greatest((high - low).cast("double"), F.lit(1.0))
    inner = F.greatest(F.least(F.floor(share * parts), F.lit(parts - 1)), F.lit(0))
    wide = F.element_at(longs(least), at)
    by_tie = F.least(F.floor((F.col("_tie").cast("double") / float(1 << 64) + 0.5) * wide), wide - 1)
    base = base.withColumn("_tie", F.xxhash64(*[c for c in df.columns]))
    base = base.withColumn("_slice", (F.element_at(longs(base_of), at) + F.when(F.col("_k") <= low, by_tie).otherwise(wide + inner)).cast("long"))
    # The first row of each slice, by key and digest: one row per slice, so its size is the number of slices.
    firsts = _before(base.groupBy("_slice").agg(F.min(F.struct("_k", "_tie")).alias("_f")))
    firsts = firsts.select(F.col("_slice"), F.col("_f._k").alias("_k"), F.col("_f._tie").alias("_tie"), "_before")
    # A copy of each first row stands behind the slice before; of repeated rows that are first, a few copies do no harm.
    few = total <= BROADCAST_SLICES
    copies = base.join(F.broadcast(firsts) if few else firsts, ["_slice", "_k", "_tie"], "left")
    here = F.struct(F.col("_slice").alias("s"), F.lit(False).alias("copy"))
    there = F.struct(F.col("_before").alias("s"), F.lit(True).alias("copy"))
    both = copies.withColumn("_to", F.explode(F.when(F.col("_before").isNotNull(), F.array(here, there)).otherwise(F.array(here))))
    both = both.select(*df.columns, "_k", "_tie", F.col("_to.s").alias("_s"), F.col("_to.copy").alias("_copy"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size * GROWN // TASK_BYTES), total, MOST_TASKS))
    order = Window.partitionBy("_s").orderBy("_copy", "_k", "_tie")
    return both.repartition(tasks, "_s").withColumn(out, F.lead(value).over(order)).filter(~F.col("_copy")).select(*df.columns, out)
