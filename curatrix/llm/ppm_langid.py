"""Language identification by prediction by partial matching.

For each language, frozen statistics of its own byte context tree of variable order (0 to 3, deeper contexts only where
the language's sample has them often) give every byte an exact code length: the deepest context in the tree codes the byte by
its frequency, every context that has not seen it pays its escape (method C, without exclusion). A text's language is
the one with the shortest code for the whole text.

Training reads a bounded sample: at most ``per_language`` different whole documents of each language, chosen by a hash.
Their contexts are counted in Spark; the driver gets the counts of the trees' contexts and no texts. A tree has the most
frequent contexts of its language, as many as ``contexts`` gives each of the languages (LEAST_SHARE at least), with all that
are as frequent as the last one. Every label is learned, however many there are: the costs of many languages are tables of
a few languages each, over the union of the trees (a context that a language's tree lacks costs it what its suffix does),
which are made in turn for each chunk of texts. Everything else runs over all rows and all bytes.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is everything when there is nothing
to learn from; rows with a null language are not learned from; repeated rows get equal results and are learned from
once; an empty table gives no rows; ties go to the first language in alphabetical order; very long texts are coded
whole; columns named like the outputs are replaced, other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curatrix.llm.common import Scratch, bound_batches, release, row_chunks, trimmed

#: Whole documents that are learned from, of each language.
PER_LANGUAGE = 250
#: Languages in one cost table, and its bytes; tables of up to KEPT_BYTES together stay in memory.
GROUP = 16
TABLE_BYTES = 32 << 20
KEPT_BYTES = 128 << 20
ORDER = 3
#: Times a context has to occur in a language's sample to stand in its tree; contexts of all trees, by which each has its
#: share, and the least share.
LEAST_COUNT = 48
MOST_CONTEXTS = 16_384
LEAST_SHARE = 256
#: Keys (8 bytes) of sampled rows that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Strings with their counts that a task holds before it sends them on.
HELD_GRAMS = 4_000_000
PAD = b"\n" * ORDER
_letters = re.compile(r"[^\W\d_]+").finditer


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def count_grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order k, the strings of a byte and the k before it, as numbers, and how often the texts have them."""
    data = fold(np.frombuffer(PAD + PAD.join(texts), dtype=np.uint8)).astype(np.int64)
    keep = np.ones(len(data), dtype=bool)
    at = 0
    for t in texts:
        keep[at : at + ORDER] = False
        at += ORDER + len(t)
    place, out = np.flatnonzero(keep), []
    for k in range(ORDER + 1):
        g = np.zeros(len(place), dtype=np.int64)
        for j in range(k, -1, -1):
            g = g << 8 | data[place - j]
        out.append(np.unique(g, return_counts=True))
    return out


def share(contexts: int, languages: int) -> int:
    """Contexts of one language's tree, besides those that are as frequent as the last one."""
    return max(LEAST_SHARE, contexts // max(1, languages))


def union(trees: Iterator[tuple[int, int]]) -> list[np.ndarray]:
    """The contexts of each order from 1 on that any tree has, of (order, context)."""
    found = set(trees)
    return [np.array(sorted(c for o, c in found if o == k), dtype=np.int64) for k in range(1, ORDER + 1)]


class PpmModel:
    """Code lengths in bits, cost[node * symbols + symbol, language], and the node of each context of three symbols.

    ``cost`` is there if one table holds all languages; ``table`` makes that of some.
    """

    def __init__(self, counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], contexts: list[np.ndarray]) -> None:
        """``counts`` of `count_grams` for each language; ``contexts``: those of each order from 1 on that the tree has."""
        self.languages = sorted(counts)
        seen = np.unique(np.concatenate([*(counts[name][0][0] for name in self.languages), [PAD[0]]]))
        self.symbols = a = len(seen) + 1  # 0: a byte that the sample does not have
        of = np.zeros(256, dtype=np.int32)
        of[seen] = np.arange(1, a)
        self.of = of[fold(np.arange(256, dtype=np.uint8))]

        def number(g: np.ndarray, k: int) -> np.ndarray:
            """Strings of k bytes as numbers in base a."""
            out = np.zeros(len(g), dtype=np.int64)
            for j in range(k - 1, -1, -1):
                out = out * a + of[g >> 8 * j & 255]
            return out

        # Nodes of each order: contexts as sorted numbers; order 0 has one. A context stays only if its suffix does.
        nodes = [np.zeros(1, dtype=np.int64)]
        self.parents = [np.zeros(1, dtype=np.int64)]
        for k in range(1, ORDER + 1):
            u = np.sort(number(contexts[k - 1], k))
            suffix = u % a ** (k - 1)
            u, suffix = (x[np.isin(suffix, nodes[k - 1])] for x in (u, suffix))
            nodes.append(u)
            self.parents.append(np.searchsorted(nodes[k - 1], suffix))
        self.counts = []  # for each order and language: node of the order, symbol, count
        for k, u in enumerate(nodes):
            kept = []
            for name in self.languages:
                g, n = counts[name][k]
                ctx, sym = number(g >> 8, k), of[g & 255]
                at = np.searchsorted(u, ctx)
                ok = (at < len(u)) & (u[np.minimum(at, len(u) - 1)] == ctx) if len(u) else np.zeros(len(g), dtype=bool)
                kept.append((at[ok].astype(np.int32), sym[ok].astype(np.int32), n[ok].astype(np.int32)))
            self.counts.append(kept)
        self.first = first = np.cumsum([0, *(len(n) for n in nodes)])
        kinds, one = len(self.languages), int(first[-1]) * a * 4
        size = max(1, min(GROUP, TABLE_BYTES // one))
        self.groups = [(lo, min(lo + size, kinds)) for lo in range(0, kinds, size)]
        self.keep = kinds * one <= KEPT_BYTES
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        self.cost = self.table(0, kinds) if len(self.groups) == 1 else None
        # The deepest node of each context of three symbols.
        deep = np.zeros(a**ORDER, dtype=np.int32)
        every = np.arange(a**ORDER)
        for k in range(1, ORDER + 1):
            if len(u := nodes[k]):
                key = every % a**k
                at = np.minimum(np.searchsorted(u, key), len(u) - 1)
                deep = np.where(u[at] == key, (first[k] + at).astype(np.int32), deep)
        self.node = deep * a

    @classmethod
    def of_texts(cls, samples: dict[str, list[bytes]]) -> PpmModel:
        """The model of texts at hand."""
        counts, trees = {name: count_grams(texts) for name, texts in samples.items()}, set()
        most = share(MOST_CONTEXTS, len(counts))
        for name, own in counts.items():
            rows = []
            for k in range(1, ORDER + 1):
                u, inv = np.unique(own[k][0] >> 8, return_inverse=True)
                total = np.bincount(inv, weights=own[k][1], minlength=len(u))
                rows += [(k, int(x), int(n)) for x, n in zip(u, total, strict=True) if n >= LEAST_COUNT]
            last = sorted((n for _, _, n in rows), reverse=True)[:most]
            tree = {(k, c) for k, c, n in rows if n >= last[-1]} if rows else set()
            trees |= tree
            held = [np.fromiter((c for o, c in tree if o == k), dtype=np.int64) for k in range(ORDER + 1)]
            counts[name] = [own[0], *((g[keep], n[keep]) for k in range(1, ORDER + 1) for g, n in [own[k]] for keep in [np.isin(g >> 8, held[k])])]
        return cls(counts, union(trees))

    def table(self, lo: int, hi: int) -> np.ndarray:
        """Costs of the languages from lo to hi."""
        if (lo, hi) in self.tables:
            return self.tables[lo, hi]
        first, a = self.first, self.symbols
        prob = np.zeros((first[-1], a, hi - lo))
        for k, parent in enumerate(self.parents):
            low = prob[first[k - 1] + parent] if k else np.full((1, a, hi - lo), 1.0 / 256)
            here = low.copy()
            for x, (at, sym, n) in enumerate(self.counts[k][lo:hi]):
                total = np.bincount(at, weights=n, minlength=len(parent))
                kindsof = np.bincount(at, minlength=len(parent))
                out = total + kindsof
                escape = np.where(total > 0, kindsof / np.maximum(out, 1), 1.0)
                here[:, :, x] = low[:, :, x] * escape[:, None]
                here[at, sym, x] = n / out[at]
            prob[first[k] : first[k + 1]] = here
        cost = (-np.log2(prob)).astype(np.float32).reshape(-1, hi - lo)
        if self.keep:
            self.tables[lo, hi] = cost
        return cost

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for lo, hi in self.groups if texts else ():
            out[:, lo:hi] = self._bits(texts, self.table(lo, hi) if self.cost is None else self.cost)
        return out

    def _bits(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        d = self.of[np.frombuffer(PAD + PAD.join(texts), dtype=np.uint8)]
        a = self.symbols
        ctx = (d[:-3] * a + d[1:-2]) * a + d[2:-1]
        # Sums over each text; what codes the padding between two texts is in the odd segments.
        sizes = np.array([len(t) for t in texts])
        start = np.cumsum([0, *(sizes[:-1] + ORDER)])
        out = np.zeros((len(texts), table.shape[1]))
        full = np.flatnonzero(sizes)
        if len(full):
            cost = table[self.node[ctx] + d[3:]]
            edges = np.stack([start[full], start[full] + sizes[full]], axis=1).ravel()
            edges = edges[:-1] if edges[-1] >= len(cost) else edges
            out[full] = np.add.reduceat(cost, edges, axis=0, dtype=np.float64)[::2]
        return out


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() or any(c.isalpha() for c in m.group()) for m in _letters(text))


def sample(rows: DataFrame, per_language: int, scratch: Scratch) -> DataFrame:
    """Of ``rows`` (_key, _lang, _text), at most ``per_language`` different ones of each language."""
    # About four times as many rows as are taken pass a hash threshold of their language, so that the ranking below sees
    # a bounded number of rows however large the table is.
    known = scratch.keep(rows.groupBy("_lang").agg(F.approx_count_distinct("_key").alias("_rows")), "labels")
    chosen = rows.select("_lang", "_key").join(known, "_lang").filter(F.pmod(F.xxhash64("_key", F.lit("sample")), F.greatest("_rows", F.lit(1))) < 4 * per_language)
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key")
    keys = chosen.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
    keys = scratch.keep(keys.select("_key").distinct(), "sample-keys")
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, "_key", "left_semi").dropDuplicates(["_key"])


def train(rows: DataFrame, text: str, lang: str, key: Column, per_language: int = PER_LANGUAGE, contexts: int | None = None, least: int | None = None) -> PpmModel | None:
    """The model of all the rows' languages, from a bounded sample of each; None if there is nothing to learn from.

    ``contexts`` (MOST_CONTEXTS) of all trees, ``least`` (LEAST_COUNT) occurrences of a context.
    """
    contexts, least = MOST_CONTEXTS if contexts is None else contexts, LEAST_COUNT if least is None else least
    scratch = Scratch(rows.sparkSession, "ppm")
    usable = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    usable = usable.select(F.xxhash64(key, lang, text).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[tuple[str, int], list] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (name, k), parts in held.items():
                g, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(np.full(len(g), k, dtype=np.int32)), pa.array(g), pa.array(n)], ["lang", "k", "gram", "n"])
            held.clear()

        for b in row_chunks(batches, "_text", 1_000_000):
            by: dict[str, list[bytes]] = {}
            for name, said in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                by.setdefault(name, []).append(said.encode("utf-8", "replace"))
            for name, texts in by.items():
                for k, (g, n) in enumerate(count_grams(texts)):
                    held.setdefault((name, k), []).append((g, n))
                    size += len(g)
            if size > HELD_GRAMS:
                yield from told()
                size = 0
        yield from told()

    # The sample is small, however many parts a shuffle has: a few tasks count it, and so send each string few times.
    texts = sample(usable, per_language, scratch).select("_lang", "_text").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    grams = texts.mapInArrow(trimmed(run), "lang string, k int, gram long, n long")
    grams = scratch.keep(grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).withColumn("ctx", F.expr("shiftright(gram, 8)")), "grams")
    often = grams.filter("k > 0").groupBy("lang", "k", "ctx").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    kinds = grams.agg(F.count_distinct("lang")).first()[0]
    ranked = often.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    trees = scratch.keep(ranked.filter(F.col("_r") <= share(contexts, kinds)).select("lang", "k", "ctx"), "trees")
    kept = union((r["k"], r["ctx"]) for r in trees.select("k", "ctx").distinct().collect())
    found = grams.filter("k = 0").select("lang", "k", "gram", "n").unionByName(grams.join(trees, ["lang", "k", "ctx"]).select("lang", "k", "gram", "n"))
    found = found.toArrow().combine_chunks()
    if not found.num_rows:
        return None
    names, order, gram, n = (found.column(c).to_numpy() for c in ("lang", "k", "gram", "n"))
    label, place = np.unique(names.astype(str), return_inverse=True)
    counts = {str(x): [(gram[(place == i) & (order == k)], n[(place == i) & (order == k)]) for k in range(ORDER + 1)] for i, x in enumerate(label)}
    return PpmModel(counts, kept)


def identify(docs: DataFrame, model: PpmModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred, score (share of the best language, 0 to 1) and bits_per_byte of the best."""
    outputs = ["lang_pred", "score", "bits_per_byte"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ppm = shared.value
        for b in row_chunks(batches, text, 1_000_000 if ppm is None or ppm.keep else 4_000_000):
            texts = b.column(text).to_pylist()
            pred, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if ppm else []
            if rows:
                data = [texts[i].encode("utf-8", "replace") for i in rows]
                bits = ppm.bits(data)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(rows)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                for i, k in zip(rows, best, strict=True):
                    pred[i] = ppm.languages[k]
                score[rows] = share
                rate[rows] = least / np.array([len(d) for d in data])
            cols = [pa.array(pred), pa.array(score), pa.array(rate, mask=np.isnan(rate))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *outputs])

    return bound_batches(docs.select(*dict.fromkeys([*keep, text]))).mapInArrow(trimmed(run), schema)
