"""Near-duplicate documents by HyperMinHash sketches.

A document's set holds its distinct shingles of ``width`` words. Its sketch has one register per bucket: the leading
zeros of the bucket's least hash and a few mantissa bits behind them. Empty buckets borrow another bucket's register,
chosen by a fixed probe order, so that small sets have whole sketches too. Bands of registers are the candidate keys.

Borrowed registers of small sets are not independent, so sets of fewer than SMALL shingles have exact candidates instead:
their rarest n - ceil(threshold * n) + 1 shingles are their keys. Two sets that reach the threshold share one of those,
whatever the order, as long as all sets use the same. Sets that are larger, but can reach the threshold with a small one,
have both kinds of keys.

Documents with one set are one class, found by a wide digest, and only classes are compared. In each band bucket the
class that meets most others is the pivot, and every member is compared with it; links found so far join components.
What a bucket then still holds outside its largest component is compared with the whole bucket, in blocks of bounded
size, which send on only links that join components. In a bucket of several blocks, sketches alone meet first, and only
texts that have a likely partner go on. Each comparison first corrects the share of equal registers for chance collisions and drops pairs
that are far below the threshold by many standard deviations; all others are confirmed on their full shingle sets. No
bucket is capped.

Defined cases: null texts and texts without words have empty sets and link with nothing; a document with fewer words
than ``width`` has its whole sequence as one shingle; rows with a null id get the component of an equal set where there
is one, and else none; rows that share an id are one document and linked; an empty table gives no rows; ties go to the
smaller id; texts of any length are hashed whole, one that is longer than a chunk by itself; extra columns, whatever
their names, do not matter. Shingles are compared by 64-bit hashes of every byte's value and place in its word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Scratch, bound_batches, release, row_chunks, trimmed
from curatrix.llm.components import components

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets of fewer shingles have exact candidates and no bands.
SMALL = 64
#: Standard deviations below the threshold at which a pair is dropped without a look at its sets.
SIGMAS = 6.0
#: Members of a band bucket that are compared with each other in one task.
BLOCK = 1024
#: And the shingles of as many members.
BLOCK_SHINGLES = 500_000
#: Comparisons with one pivot that are made in one task.
PIVOT_ROWS = 512
#: Ids (8 bytes each) that may be broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members of buckets (some 50 bytes each) that may be broadcast to the wide rows that they need.
BROADCAST_MEMBERS = 400_000

#: Bytes of text whose words are hashed at once.
CHUNK_BYTES = 500_000

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z in lower case, and where each text's words begin (one more than texts).

    A word's hash is the sum of its letters' hashes, each mixed with its place in the word.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.maximum.accumulate(np.where(before, place, 0))
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(mix((place.astype(U) << U(8)) + low + U(0x9E3779B97F4A7C15)), out=total[1:])
    h = mix(total[end] - total[start] + (end - start).astype(U))
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, edges)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, edges = word_hashes(texts)
    rolled = h.copy()
    for j in range(1, width):
        m = max(0, len(h) - j)
        rolled[:m] = mix(rolled[:m] * U(3)) + h[j : j + m]
    rolled = mix(rolled + U(width))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            x = np.array([b - a], dtype=U)
            for w in h[a:b]:
                x = mix(x * U(5)) + w
            out.append(mix(x ^ U(0xA5A5A5A5)))
        else:
            out.append(h[:0])
    return out


def _probes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, REGISTERS, (64, REGISTERS))


PROBES = _probes()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of non-empty sets: leading zeros above the mantissa's complement."""
    n = len(sets)
    h = np.concatenate(sets) if n else np.zeros(0, dtype=U)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    bucket = (mix(h ^ U(0x5BD1E995)) % U(REGISTERS)).astype(np.int64)
    value = mix(h + U(0x632BE59BD9B4E019)) >> U(11)
    least = np.full(n * REGISTERS, U(1) << U(53), dtype=U)
    np.minimum.at(least, row * REGISTERS + bucket, value)
    least = least.reshape(n, REGISTERS)
    part, exponent = np.frexp(least.astype(np.float64))
    fraction = np.floor((2 * part - 1) * (1 << MANTISSA)).astype(np.int64)
    fraction = np.where(least == 0, 0, fraction)
    reg = ((53 - np.maximum(exponent, 0)) << MANTISSA) + ((1 << MANTISSA) - 1 - fraction)
    empty = least == U(1) << U(53)
    out, open_ = reg.astype(np.uint16), empty.copy()
    for probe in PROBES:
        if not open_.any():
            break
        take = open_ & ~empty[:, probe]
        out = np.where(take, reg.astype(np.uint16)[:, probe], out)
        open_ &= ~take
    for i in np.flatnonzero(open_.any(axis=1)):  # a set of very few shingles: its first register stands in
        out[i, open_[i]] = reg[i, np.flatnonzero(~empty[i])[0]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    r = sketch.reshape(len(sketch), BANDS, ROWS).astype(U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), r.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + r[:, :, j])
    return key


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Probability that two unrelated registers of sets with these sizes are equal: same leading zeros, same mantissa."""
    edge = np.exp2(-np.arange(0, 40, dtype=np.float64))
    edge = np.append(edge, 0.0)
    # Of each leading-zero cell: the chance that a bucket's least value lies there.
    cell = lambda n: -np.diff(1 - np.exp(-np.multiply.outer(np.maximum(n / REGISTERS, 1.0), edge)), axis=-1)
    return (cell(na) * cell(nb)).sum(axis=-1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    c = chance(na, nb)
    return np.clip((equal - c) / (1 - c), 0.0, 1.0)


def least_estimate(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Estimates below this are far below the threshold; with a small set, no estimate is."""
    least = np.minimum(na, nb)
    free = np.minimum(least, REGISTERS) / 2
    return np.where(least < SMALL, 0.0, threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(free, 1)))


def may_link(na: np.ndarray, nb: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    p, q = threshold.numerator, threshold.denominator
    return q * np.minimum(na, nb) >= p * np.maximum(na, nb)


def most_exact(threshold: Fraction) -> int:
    """Shingles of the largest set that can reach the threshold with a small one."""
    return (SMALL - 1) * threshold.denominator // threshold.numerator


def similar(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Whether two full sets have that Jaccard similarity."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return threshold.denominator * both >= threshold.numerator * (len(a) + len(b) - both)


def _encoded(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(x.view(np.int64) for x in parts)])))


def sketch_documents(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text", threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(key, n_shingles, d1, d2, bands, shingles): set size, wide digest of the set, band keys (none for a set of fewer
    than SMALL), and all shingles of a set that can reach the threshold with such a one."""
    most, none = most_exact(threshold), np.zeros(0, dtype=U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in row_chunks(batches, text, CHUNK_BYTES):
            sets = shingle_sets(_encoded(b.column(text)), width)
            full = [s for s in sets if len(s) >= SMALL]
            keys = iter(band_keys(sketches(full)) if full else ())
            bands = [next(keys) if len(s) >= SMALL else none for s in sets]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            d1 = np.array([np.add.reduce(mix(s)) if len(s) else 0 for s in sets], dtype=U)
            d2 = np.array([np.bitwise_xor.reduce(mix(s + U(99))) if len(s) else 0 for s in sets], dtype=U)
            lists = [_lists(bands), _lists([s if len(s) <= most else none for s in sets])]
            cols = [b.column(key), pa.array(sizes), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays(cols, [key, "n_shingles", "d1", "d2", "bands", "shingles"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(trimmed(run), f"{key} long, n_shingles long, d1 long, d2 long, bands array<long>, shingles array<long>")


def exact_keys(rep: DataFrame, threshold: Fraction, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(id, key), and the tables that it reads: of each set that has its shingles with it, the rarest ones as candidate keys.

    ``rep`` has (id, n_shingles, d1, d2, shingles); rows that share an id can have several sets.
    """
    p, q = threshold.numerator, threshold.denominator
    each = scratch.keep(rep.select("id", "n_shingles", "d1", "d2", F.explode("shingles").alias("key")), "shingles")
    common = scratch.keep(each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "common")
    ranked = each.join(common, "key", "left").groupBy("id", "d1", "d2", "n_shingles")
    ranked = ranked.agg(F.array_sort(F.collect_set(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "key"))).alias("all"))
    first = F.expr(f"cast(n_shingles - (n_shingles * {p} + {q - 1}) div {q} + 1 as int)")
    # What only one set has meets no other.
    keys = ranked.select("id", F.explode(F.slice("all", F.lit(1), first)).alias("s")).filter("s.often > 1").select("id", F.col("s.key").alias("key"))
    return keys, [each, common]


def _with_sketch(texts: DataFrame, width: int) -> DataFrame:
    """(id, text) with n and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in row_chunks(batches, "text", CHUNK_BYTES):
            sets = shingle_sets(_encoded(b.column("text")), width)
            regs = sketches(sets)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), b.column("text")], ["id", "n", "sketch", "text"])

    return texts.mapInArrow(trimmed(run), "id long, n long, sketch binary, text string")


def estimate_pairs(pairs: DataFrame, known: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b) whose estimated similarity is not far below the threshold."""
    side = lambda x: known.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for big in batches:
            for lo in range(0, big.num_rows, 4096):
                b = big.slice(lo, 4096)
                na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
                sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                ok = may_link(na, nb, threshold)
                ok &= estimate((sa == sb).mean(axis=1), na, nb) >= least_estimate(na, nb, float(threshold))
                keep = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([b.column(c).take(keep) for c in "ab"], ["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(run), "a long, b long")


def confirm_pairs(pairs: DataFrame, texts: DataFrame, width: int, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold. Pairs of one ``a`` go to several tasks if many."""
    pairs = scratch.keep(pairs, "pairs")
    share = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).alias("_parts")), "shares")
    members = pairs.join(share, "a").withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_parts")))
    members = members.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "_part", "b", "text")
    pivots = share.join(texts.select(F.col("id").alias("a"), "text"), "a")
    pivots = pivots.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast("long").alias("b"), "text")
    rows = pivots.unionByName(members).repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, own = None, []
        for b in row_chunks(batches, "text", CHUNK_BYTES):
            sets = shingle_sets(_encoded(b.column("text")), width)
            found: tuple[list, list] = ([], [])
            for a, part, x, s in zip(b.column("a").to_pylist(), b.column("_part").to_pylist(), b.column("b").to_pylist(), sets, strict=True):
                if (a, part) != now:
                    now, own = (a, part), []
                if x is None:
                    own.append(s)  # more than one only where rows share an id
                elif any(similar(p, s, threshold) for p in own):
                    found[0].append(a)
                    found[1].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return rows.select("a", "_part", "b", "text").mapInArrow(trimmed(run), "a long, b long").distinct()


def group_links(ids: np.ndarray, comp: np.ndarray, own: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], threshold: Fraction) -> list[tuple[int, int]]:
    """Links that join the components of a group's members; every pair of different components is looked at.

    A link inside what is joined already says nothing new, so there are fewer links than members.
    """
    n = np.array([len(s) for s in sets])
    edges = np.cumsum([0, *n])
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    own_set = [place[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    root, split, out = comp.copy(), own.min() != own.max(), []
    held = np.zeros(len(names), dtype=bool)
    for i in range(len(ids)):
        j = np.arange(i + 1, len(ids))
        j = j[(root[j] != root[i]) & ((own[j] != own[i]) | (not split))]
        j = j[may_link(n[j], n[i], threshold)]
        if len(j):
            e = estimate((sketch[j] == sketch[i]).mean(axis=1), n[j], np.full(len(j), n[i]))
            j = j[e >= least_estimate(n[j], n[i], float(threshold))]
        if not len(j):
            continue
        held[own_set[i]] = True
        start = np.cumsum([0, *n[j[:-1]]])
        both = np.add.reduceat(held[np.concatenate([own_set[k] for k in j])].astype(np.int64), start)
        held[own_set[i]] = False
        for k in j[threshold.denominator * both >= threshold.numerator * (n[j] + n[i] - both)]:
            if root[k] != root[i]:
                out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                root[root == root[k]] = root[i]
    return out


def _dealt(rows: DataFrame, payload: str) -> DataFrame:
    """Members (key, id, component, payload, _main, _others, _mains) of buckets in pairs of blocks: (key, _i, _j, _own, id, component, payload).

    Blocks of the largest component come after the others and never meet each other.
    """
    main = F.col("component").eqNullSafe(F.col("_main"))
    own = F.when(main, F.col("_others") + F.pmod(F.xxhash64("id"), F.greatest("_mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("_others")))
    meets = F.when(main, F.col("_others")).otherwise(F.col("_others") + F.col("_mains"))
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)))
    dealt = dealt.select("key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "id", "component", payload)
    return dealt.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "_own", "id")


def _fetched(rows: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """``rows`` (id, ...) with columns of ``known`` (id, ...), whose rows are wide and stay where they are if ``rows`` are few."""
    few = rows.count() <= BROADCAST_MEMBERS
    return known.select("id", *columns).join(F.broadcast(rows) if few else rows, "id")


def _in_groups(batches: Iterator[pa.RecordBatch], payload: str, read: Callable, found: Callable) -> Iterator[pa.RecordBatch]:
    """``found`` of the members and the payloads (by ``read`` from a column) of each pair of blocks."""
    release()
    now, group, held = None, [], []
    for b in row_chunks(batches, payload, CHUNK_BYTES):
        places = zip(*(b.column(c).to_pylist() for c in ("key", "_i", "_j")), strict=True)
        members = zip(*(b.column(c).to_pylist() for c in ("id", "component", "_own")), strict=True)
        for p, g, s in zip(places, members, read(b.column(payload)), strict=True):
            if p != now:
                if len(group) > 1:
                    yield found(group, held)
                now, group, held = p, [], []
            group.append(g)
            held.append(s)
    if len(group) > 1:
        yield found(group, held)


def likely_members(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """Ids of members (as for `_dealt`, with n and sketch) whose sketch has a likely partner in another component."""
    known = rows.withColumn("known", F.concat(F.lpad(F.hex("n"), 16, "0").cast("binary"), F.col("sketch")))

    def found(group: list[tuple], held: list[bytes]) -> pa.RecordBatch:
        ids, comp, own = (np.array(x, dtype=np.int64) for x in zip(*group, strict=True))
        n = np.array([int(x[:16], 16) for x in held])
        sketch = np.frombuffer(b"".join(x[16:] for x in held), np.uint16).reshape(-1, REGISTERS)
        split, likely = own.min() != own.max(), np.zeros(len(ids), dtype=bool)
        for i in np.flatnonzero(own == own.min()):
            j = np.flatnonzero((comp != comp[i]) & ((own != own[i]) | (not split)) & may_link(n, n[i], threshold))
            if len(j):
                e = estimate((sketch[j] == sketch[i]).mean(axis=1), n[j], np.full(len(j), n[i]))
                j = j[e >= least_estimate(n[j], n[i], float(threshold))]
                likely[j] = True
                likely[i] |= len(j) > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[likely])], ["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_groups(batches, "known", lambda c: c.to_pylist(), found)

    return _dealt(known, "known").mapInArrow(trimmed(run), "id long").distinct()


def bucket_links(rows: DataFrame, known: DataFrame, width: int, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """Confirmed links (a, b) between different components inside buckets: rows (key, id, component), known (id, n, sketch, text).

    A bucket of more than one block's members is cut into blocks, and each pair of blocks that holds anything outside the
    bucket's largest component is compared in a place of its own. Sets are compared where they are; only the joining
    links leave a task.
    """
    size_of = known.groupBy("id").agg(F.max("n").alias("n"))  # rows that share an id have a set each
    rows = scratch.keep(rows.join(size_of, "id").select("key", "id", "component", "n"), "mixed-members")
    blocks = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / BLOCK_SHINGLES))
    each = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = each.groupBy("key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "component")).alias("m"))
    one = blocks(F.col("c"), F.col("s")) <= 1
    sizes = sizes.select(
        "key",
        F.when(~one, F.col("m.component")).alias("_main"),
        F.when(one, 1).otherwise(blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s"))).cast("long").alias("_others"),
        F.when(one, 0).otherwise(blocks(F.col("m.c"), F.col("m.s"))).cast("long").alias("_mains"),
    )
    sized = scratch.keep(rows.join(sizes, "key").drop("n"), "sized")
    scratch.drop(rows)
    large = sized.filter("_mains > 0")
    if not large.isEmpty():
        likely = scratch.keep(likely_members(_fetched(large, known, "n", "sketch"), threshold), "likely")
        sized = sized.filter("_mains = 0").unionByName(large.join(likely, "id", "left_semi").select(*sized.columns))
    dealt = _dealt(_fetched(sized, known, "text"), "text")

    def found(group: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        ids, comp, own = (np.array(x, dtype=np.int64) for x in zip(*group, strict=True))
        links = group_links(ids, comp, own, sketches(sets), sets, threshold)
        return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_groups(batches, "text", lambda c: shingle_sets(_encoded(c), width), found)

    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): one row per document; a component's id is its smallest key."""
    scratch = Scratch(docs.sparkSession, "hyperminhash")
    docs = bound_batches(docs.select(F.col(key).cast("long").alias(key), text))
    sk = scratch.keep(sketch_documents(docs, width, key, text, threshold), "sketches")
    classes = scratch.keep(sk.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min(key).alias("id")).filter("id is not null"), "classes")
    # Keys of one row of each class.
    rep = sk.filter("n_shingles > 0").join(classes.select("id").distinct(), F.col(key) == F.col("id"), "left_semi").withColumn("id", F.col(key))
    exact, read = exact_keys(rep, threshold, scratch)
    rows = scratch.keep(rep.select("id", F.explode("bands").alias("key")).unionByName(exact), "keys")
    scratch.drop(*read)
    # What is joined by key is kept as a table first: then the join is between two plain exchanges, whose hot
    # partitions Spark can split.
    count = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    members = scratch.keep(rows.join(count, "key"), "members")
    scratch.drop(rows)
    weight = members.groupBy("id").agg(F.sum("size").alias("w"))
    ranked = members.join(weight, "id").groupBy("key").agg((-F.max(F.struct("w", (-F.col("id")).alias("i")))["i"]).alias("a"))
    ranked = scratch.keep(ranked, "pivots")
    stars = members.join(ranked, "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    stars = scratch.keep(stars, "stars")
    involved = scratch.keep(members.select("id").distinct(), "involved")
    n = involved.count()
    if not n:
        return _result(sk, classes, None, key)
    reps = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    wanted = reps.join(F.broadcast(involved) if n <= BROADCAST_IDS else involved, "id", "left_semi")
    known = scratch.keep(_with_sketch(wanted, width).filter("n > 0"), "known")
    links = scratch.keep(confirm_pairs(estimate_pairs(stars, known, threshold), known, width, threshold, scratch), "links")
    parts = scratch.keep(components(links, scratch), "components")
    # What a bucket still holds in different components.
    placed = members.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("m")).filter("m").select("key")
    mixed = scratch.keep(mixed, "mixed")
    if not mixed.isEmpty():
        left = placed.join(mixed, "key", "left_semi").select("key", "id", "component")
        more = scratch.keep(bucket_links(left, known, width, threshold, scratch), "more")
        if not more.isEmpty():
            parts = scratch.keep(components(links.unionByName(more), scratch), "components")
    return _result(sk, classes, parts, key)


def _result(sk: DataFrame, classes: DataFrame, parts: DataFrame | None, key: str) -> DataFrame:
    if parts is not None:
        classes = classes.join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        classes = classes.select("d1", "d2", F.coalesce("component", "id").alias("_component"))
    else:
        classes = classes.select("d1", "d2", F.col("id").alias("_component"))
    out = sk.select(key, "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col(key))
    return out.select(key, "n_shingles", own.alias("component_id"))
