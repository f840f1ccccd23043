"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel of two terms sums over all subsequences of three letters that both have; an occurrence that spans d characters
weighs decay ** d. So a term with characters put in between, or spaced out, is still near the term it comes from. Terms
are a sentence's words, and runs of single characters taken together. A sentence is as toxic as its worst term, a text as
its worst sentence.

Labels are those of whole texts. Which sentences of a toxic text are toxic is found first: strings of four letters that
toxic texts have and others have not are candidates. Taken are those with enough evidence from toxic texts that are no near
copies of each other (told by one minimum hash), and by a greedy cover those that account for toxic texts not yet accounted
for; sentences that hold one of them are toxic, those of clean texts are not, all others say nothing.
Terms that hold one of these strings, also with a character put in or signs between all, and those of clean sentences,
train a machine with squared hinge loss in the space
that the landmarks span; the clean terms that it finds worst are added, and it is trained again. As the kernel is an inner product of
weighted subsequences, landmarks and coefficients fold into one table of weights of three-letter subsequences: a term's
value is exact and takes one look-up per subsequence. A logistic curve fitted on the sample's texts gives the score.

Fitted on at most ``per_label`` different labelled texts of each kind (``most_clean`` clean ones); what comes to the driver is
bounded by that, by CANDIDATES, TERMS and LANDMARKS. Scoring reads every whole text.

Defined cases: null and empty texts score as texts without a term; without toxic or without clean labelled texts there is
no model and the score is 0; equal texts count once, toxic if one of them is labelled so; null labels say nothing; terms of
any length are scored in overlapping windows; repeated rows give repeated results; an empty table gives no rows; outputs
replace columns of their names, other columns pass through.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import Scratch, bound_batches, resident, row_chunks, trimmed

#: Different labelled texts that training takes at most, toxic and clean.
PER_LABEL, MOST_CLEAN = 2_000, 8_000
#: Strings that may account for toxic texts, terms of each kind for training, landmarks.
CANDIDATES, TERMS, LANDMARKS = 2_000, 4_096, 384
GRAM, DECAY, WINDOW, STRIDE = 4, 0.7, 24, 12
#: Least evidence (log likelihood ratio) that a string belongs to toxic texts; least toxic texts that a string of the cover accounts for.
EVIDENCE, NEW_TEXTS = 9.0, 3
#: Terms that are also trained with characters put in, and those characters.
VARIED, PUT_IN = 192, "-x"
COST, THRESHOLD = 10.0, 0.3
CACHE_TERMS = 400_000

_LETTERS = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    _base = unicodedata.normalize("NFKD", chr(_c).lower())[0]
    _LETTERS[_c] = ord(_base) - 96 if "a" <= _base <= "z" else 19 if _c == 0xDF else 27 if chr(_c).isalpha() else 0

_sentences = re.compile(r"[.!?]+\s+|\n+").split
_spaced = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_+=~`^@…«»“”‘’¡¿"


def terms_of(text: str) -> set[str]:
    """A text's different terms, in lower case, without signs at their ends."""
    text = text.lower()
    found = {w.strip(EDGES) for w in set(text.split())}
    for run in _spaced.findall(text):
        found.add(re.sub(r"[ \t]", "", run).strip(EDGES))
    found.discard("")
    return found


class Kernel:
    """Gap-weighted subsequences of three letters; signs and digits only take up room."""

    def __init__(self, decay: float = DECAY) -> None:
        self.decay, self.triples, self.steps = decay, {}, {}

    def windows(self, terms: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which term, codes) of all windows, those of one length together."""
        point = np.frombuffer("\n".join(terms).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        code = np.where(point < 0x250, _LETTERS[np.minimum(point, 0x24F)], 27 + point % 5)
        size = np.array([len(t) for t in terms])
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        own = np.flatnonzero((size >= 3) & (size <= WINDOW))
        begin, length = start[own], size[own]
        for i in np.flatnonzero(size > WINDOW):
            at = np.unique([*range(0, size[i] - WINDOW, STRIDE), size[i] - WINDOW])
            own, begin, length = np.append(own, np.full(len(at), i)), np.append(begin, start[i] + at), np.append(length, np.full(len(at), WINDOW))
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            for part in np.array_split(rows, -(-len(rows) * math.comb(int(n), 3) // 2_000_000)):
                yield own[part], code[begin[part][:, None] + np.arange(n)]

    def subsequences(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """For each three places: what each row has there, and the weight."""
        n = code.shape[1]
        if n not in self.triples:
            self.triples[n] = [(i, j, k, self.decay ** (k - i + 1)) for i, j, k in combinations(range(n), 3)]
        first, second = code << 10, code << 5
        for i, j, k, weight in self.triples[n]:
            yield first[:, i] | second[:, j] | code[:, k], weight

    def norms(self, code: np.ndarray) -> np.ndarray:
        """Roots of each row's kernel with itself."""
        n = code.shape[1]
        if n not in self.steps:
            gap = np.subtract.outer(np.arange(n), np.arange(n))
            self.steps[n] = np.where(gap > 0, self.decay ** np.maximum(gap - 1, 0), 0.0)
        step = self.steps[n]
        same = (code[:, :, None] == code[:, None, :]) & (code != 0)[:, :, None]
        same = self.decay**2 * same
        s = same * (step @ same @ step.T)
        return np.sqrt((same * (step @ s @ step.T)).sum(axis=(1, 2)))

    def table(self, landmarks: list[str]) -> np.ndarray:
        """Each landmark's normalised weights: a row per subsequence, a column per landmark; subsequences with a sign weigh 0."""
        out = np.zeros((1 << 15, len(landmarks)), dtype=np.float32)
        for own, code in self.windows([t[:WINDOW] for t in landmarks]):
            norm = np.maximum(self.norms(code), 1e-12)
            for found, weight in self.subsequences(code):
                out[found, own] += weight / norm
        every = np.arange(1 << 15)
        out[((every >> 10) == 0) | ((every >> 5 & 31) == 0) | ((every & 31) == 0)] = 0
        return out

    def against(self, terms: list[str], table: np.ndarray) -> np.ndarray:
        """Kernels of terms with a table's columns; of a term's windows the largest counts in each column."""
        out = np.full((len(terms), table.shape[1]), -np.inf)
        for own, code in self.windows(terms):
            value = np.zeros((len(code), table.shape[1]))
            for found, weight in self.subsequences(code):
                value += weight * table[found]
            np.maximum.at(out, own, value / np.maximum(self.norms(code), 1e-12)[:, None])
        return np.where(np.isinf(out), 0.0, out)


class Machine:
    """Folded weights of subsequences, a bias, and the curve from values to scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def values(self, terms: list[str], kernel: Kernel) -> np.ndarray:
        return kernel.against(terms, self.weights[:, None])[:, 0] + self.bias if terms else np.zeros(0)

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))


def fit(toxic: list[str], clean: list[str], hard: list[str] | None = None, most: int = LANDMARKS, cost: float = COST) -> Machine:
    """A machine from terms; ``hard`` ones are clean terms that also serve as landmarks."""
    hard = hard or []
    share = most // (3 if hard else 2)
    landmarks = list(dict.fromkeys([*toxic[: most - share * (1 + bool(hard))], *clean[:share], *hard[:share]]))
    kernel = Kernel()
    table = kernel.table(landmarks)
    positive = list(dict.fromkeys([*toxic, *varied(toxic[:VARIED])]))
    terms = list(dict.fromkeys([*positive, *clean, *hard]))
    y = np.where(np.arange(len(terms)) < len(positive), 1.0, -1.0)
    value, vector = np.linalg.eigh(kernel.against(landmarks, table))
    keep = value > 1e-6 * max(value.max(), 1e-12)
    whiten = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([kernel.against(terms, table) @ whiten, np.ones((len(terms), 1))])
    weight = np.zeros(z.shape[1])
    active = np.ones(len(terms), dtype=bool)
    for _ in range(30):  # Newton steps; each solves for the terms inside the margin
        za = z[active]
        weight = np.linalg.solve(np.eye(z.shape[1]) + 2 * cost * za.T @ za, 2 * cost * za.T @ y[active])
        inside = y * (z @ weight) < 1
        if (inside == active).all():
            break
        active = inside
    return Machine((table @ (whiten @ weight[:-1])).astype(np.float64), float(weight[-1]))


def calibrate(value: np.ndarray, toxic: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits best; targets are a little inside 0 and 1."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.array([1.0, 0.0])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + 1e-3 * w[0] ** 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9]), x.T @ (p - target) + np.array([2e-3 * w[0], 0]))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(max(w[0], 0.0)), float(w[1])


def varied(terms: list[str]) -> list[str]:
    """Terms with one character put in at each place, and with signs between all their characters."""
    return [t[:i] + x + t[i:] for t in terms for x in PUT_IN for i in range(1, len(t))] + [".".join(t) for t in terms]


def cover(texts: list[tuple[int, list[int]]], least: float, new_texts: int = NEW_TEXTS) -> list[int]:
    """Candidates of (minimum hash, candidates) of texts: those of at least ``least`` unlike texts, then those that
    account for at least ``new_texts`` more texts, most first."""
    unlike: dict[int, set[int]] = {}
    for key, t in texts:
        for c in t:
            unlike.setdefault(c, set()).add(key)
    chosen = sorted(c for c, keys in unlike.items() if len(keys) >= least)
    left = [t for t in (set(t) for _, t in texts) if t and t.isdisjoint(chosen)]
    while left:
        count: dict[int, int] = {}
        for t in left:
            for c in t:
                count[c] = count.get(c, 0) + 1
        best = min(count, key=lambda c: (-count[c], c))
        if count[best] < new_texts:
            break
        chosen.append(best)
        left = [t for t in left if best not in t]
    return chosen


def grams_of(terms: set[str]) -> set[str]:
    return {t[i : i + GRAM] for t in terms for i in range(max(1, len(t) - GRAM + 1)) if len(t) >= 3}


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, per_label: int, most_clean: int) -> DataFrame:
    """(toxic, text): different labelled texts, by their hashes the first ones of each kind."""
    said = labels.filter(F.col("toxic").isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(F.col("toxic") == 1).alias("toxic"))
    known = docs.filter(F.length(text) > 0).select(id, F.xxhash64(text).alias("key")).join(said, id)
    known = known.groupBy("key").agg(F.min(id).alias(id), F.max("toxic").alias("toxic"))
    order = [F.xxhash64("key", F.lit("toxicity")), F.col("key")]
    first = lambda kind, n: known.filter(F.col("toxic") == kind).orderBy(*order).limit(n)
    chosen = first(True, per_label).unionByName(first(False, most_clean))
    rows = docs.select(id, F.xxhash64(text).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), [id, "key"])
    return rows.dropDuplicates(["key"]).select("toxic", "text")


def _counts(texts: DataFrame) -> DataFrame:
    """(term, t, c): in how many toxic and clean texts of the sample each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_chunks(batches, "text", 4_000_000):
            count: dict[str, list[int]] = {}
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                for term in {x for s in _sentences(text) for x in terms_of(s)}:
                    count.setdefault(term, [0, 0])[not toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([n[i] for n in count.values()], pa.int64()) for i in (0, 1))], ["term", "t", "c"])

    return texts.mapInArrow(trimmed(run), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _candidates(terms: DataFrame, share: float) -> list[str]:
    """Strings that toxic texts have more often than their share of the sample explains, by evidence."""
    n = F.char_length("term")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1))), lambda i: F.substring(F.col("term"), i, F.lit(GRAM)))
    grams = terms.filter(n >= 3).select(F.explode(F.array_distinct(each)).alias("gram"), "t", "c").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    p = F.col("t") / (F.col("t") + F.col("c"))
    evidence = F.col("t") * F.log(p / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    good = grams.filter(F.col("t") > 0).filter(p > max(0.9, (1 + share) / 2)).withColumn("e", evidence).filter(F.col("e") >= EVIDENCE)
    return [r["gram"] for r in good.orderBy(F.desc("e"), "gram").limit(CANDIDATES).collect()]


def _value_column(rows: DataFrame, machine: Machine, text: str, whole: bool) -> DataFrame:
    """``rows`` with the value of each whole text, or of each term."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType([*(f for f in rows.schema if f.name != text or not whole), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(("toxicity", shared.value.bias, float(shared.value.weights.sum())), lambda: Scorer(shared.value))
        for b in row_chunks(batches, text, 4_000_000):
            texts = b.column(text).to_pylist()
            value = scorer.texts(texts) if whole else shared.value.values(texts, scorer.kernel)
            names = [c for c in b.schema.names if c != text or not whole]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(value, pa.float64())], schema=None, names=[*names, "value"])

    return rows.mapInArrow(trimmed(run), schema)


class Scorer:
    """Values of whole texts, each different term once while it is in the cache."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.kernel, self.cache = machine, Kernel(), {}

    def texts(self, texts: list[str | None]) -> np.ndarray:
        each = [terms_of(t) if t else set() for t in texts]
        new = set().union(*each).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_TERMS:
            self.cache.clear()
            new = set().union(*each)
        order = list(new)
        self.cache.update(zip(order, self.machine.values(order, self.kernel).tolist(), strict=True))
        look = self.cache.__getitem__
        return np.array([max(map(look, terms), default=self.machine.bias) for terms in each])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL, most_clean: int = MOST_CLEAN) -> Machine | None:
    """The machine from the labelled ones of ``docs`` (labels: ``id``, toxic); None without toxic or clean ones."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = bound_batches(scratch.keep(sample(docs, labels, id, text, per_label, most_clean), "sample"))
    kinds = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None
    terms = scratch.keep(_counts(texts), "terms")
    grams = _candidates(terms, kinds[True] / sum(kinds.values()))
    place = {g: i for i, g in enumerate(grams)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_chunks(batches, "text", 4_000_000):
            terms = [terms_of(t) for t in b.column("text").to_pylist()]
            found = [sorted(place[g] for g in grams_of(t) if g in place) for t in terms]
            least = [min((zlib.crc32(x.encode("utf-8", "replace")) for x in t), default=0) for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["least", "grams"])

    share = kinds[True] / sum(kinds.values())
    found = texts.filter("toxic").select("text").mapInArrow(held, "least long, grams array<int>").collect()
    chosen = cover([(r["least"], r["grams"]) for r in found], EVIDENCE / -math.log(share) + 1)
    if not chosen:
        return None
    marks = "|".join(f"\\Q{grams[i]}\\E" for i in chosen)
    marked, most = F.col("term").rlike(marks), lambda rows, by, n: [r["term"] for r in rows.orderBy(F.desc(by), "term").limit(n).collect()]
    toxic = most(terms.filter(marked & (F.col("t") > 9 * F.col("c"))), "t", TERMS)
    others = terms.filter(~marked & (F.col("c") > 0) & (F.char_length("term") >= 3))
    clean = most(others, "c", TERMS)
    if not toxic or not clean:
        return None
    machine = fit(toxic, clean)
    worst = most(_value_column(others.select("term"), machine, "term", whole=False), "value", TERMS)
    machine = fit(toxic, clean, worst)
    seen = _value_column(texts, machine, "text", whole=True).collect()
    machine.slope, machine.shift = calibrate(np.array([r["value"] for r in seen]), np.array([r["toxic"] for r in seen]))
    return machine


def toxicity(docs: DataFrame, machine: Machine | None, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted (1 from ``threshold``) of each whole text."""
    outputs = ["score", "predicted"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    # Columns go by position to the task, so no name of the input's clashes.
    given = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    if machine is None:
        value = F.lit(0.0)
        found = given
    else:
        found = _value_column(bound_batches(given), machine, "text", whole=True)
        value = 1 / (1 + F.exp(-(F.lit(machine.slope) * F.col("value") + F.lit(machine.shift))))
    out = found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
