"""Fill-in-middle, the filter audit and toxicity against plain Python."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import filter_audit, fim, toxicity

LONG = "".join(random.Random(3).choice(["word ", "é", "日本", "<P", "x1", "\n", "🤔 ", "<S", "Mm>"]) for _ in range(120_000))
TEXTS = [None, "", "a", "abc", "a b", "<P>", "x<M>y", "<<S>>", "<P<S<M", "é日🤔", "Ab9\u0000cd", " \t\r\n", LONG, LONG + "<S>", "word " * 40, "word " * 40, "<", "P>S>M>", "naïve café"]
MARKS = ("<P>", "<S>", "<M>")


def by_regex(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = [(None if i % 23 == 7 else i, TEXTS[i % len(TEXTS)], "x", "y", "z") for i in range(len(TEXTS) * 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, h0 string, k0 string").repartition(3)
    out = fim.transform(docs, fim.draws("1", F.col("doc_id")))
    assert out.columns == ["doc_id", "text", "h0", "k0", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_regex(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0), fim.draws("1", F.col("doc_id"))).count() == 0


@pytest.mark.parametrize("marks", [MARKS, ("<fim_prefix>", "<fim_suffix>", "<fim_middle>"), ("ab", "cd", "xy")])
def test_automaton_is_the_regex(marks):
    r = random.Random(11)
    make = lambda: "".join(r.choice([*marks, "a", "Z", "é", "🤔", "<", ">", " ", marks[0][:-1]]) for _ in range(r.randint(0, 400)))
    texts = [make() for _ in range(300)] + [make() * 300]
    scanned = fim.Scanned(fim.Automaton(marks), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert scanned.units[i] == len(units)
        assert bool(scanned.found[i]) == any(m in t for m in marks)
        k = r.randint(0, len(units))
        a, b = int(scanned.start[i]), scanned.cut(i, k)
        assert b - a == len("".join(units[:k]).encode()) and scanned.chars(a, b) == len("".join(units[:k]))


def test_overlapping_sentinels_are_refused():
    for marks in (("<P>", "<P>"), ("ab", "bc", "x"), ("", "a", "b"), ("abc", "b", "x>c", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.Automaton(marks)


def audit_by_loops(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    masks = []
    for doc_id, source, text in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, _, t in docs) else set()
        masks.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        removed_all = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [m for m in own if f in m[1] and not m[1] & before]
                removed_all[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not m[1] & (before | {f}) for m in own), len(gone), sum(f in m[1] and bool(m[1] & before) for m in own),
                    sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone), removed_all, f,
                ]
    return {k: (*v[:6], v[6][v[7]]) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#", "é", "1"]
    texts = [None, "", " ", "A", *(" ".join(r.choice(words) + str(r.randint(0, n)) for _ in range(n)) for n in (3, 150, 199, 200, 201, 400)), "w " * 300, "plain " * 5, LONG]
    docs = [(None if k % 11 == 3 else r.randint(0, 30), r.choice(["a", "b", "", None]), texts[k % len(texts)]) for k in range(70)]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 30, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (6, None, None)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id bigint, source string, text string, part string, mask string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(frame, marks).collect()
    assert len(got) == 3 * 600
    assert {(g["part"], g["filter_order"], g["step"]): tuple(g[c] for c in filter_audit.COUNTS) for g in got} == audit_by_loops(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


def plain_kernel(a, b, decay):
    """Sum over all pairs of places."""
    total = 0.0
    each = lambda t: [(t[i] + t[j] + t[k], k - i + 1) for i in range(len(t)) for j in range(i + 1, len(t)) for k in range(j + 1, len(t)) if (t[i] + t[j] + t[k]).isalpha()]
    for x, d in each(a):
        total += sum(decay ** (d + e) for y, e in each(b) if x == y)
    return total


def test_kernel_is_the_sum_over_subsequences():
    kernel = toxicity.Kernel()
    terms = ["idiot", "id.iot", "i-d-i-o-t", "stupidity", "aaa", "banana", "xyz", "ab", "a1b2c3"]
    got = kernel.against(terms, kernel.table(["idiot", "banana", "stupid"]))
    for i, t in enumerate(terms):
        for j, m in enumerate(["idiot", "banana", "stupid"]):
            own = plain_kernel(t, t, kernel.decay) ** 0.5 * plain_kernel(m, m, kernel.decay) ** 0.5
            assert got[i, j] == pytest.approx(plain_kernel(t, m, kernel.decay) / own if own else 0.0, abs=1e-5)


BAD = ["idiot", "moron", "stupid", "worthless"]


@pytest.fixture(scope="module")
def prose():
    r = random.Random(9)
    syllables = ["ka", "lo", "mi", "ren", "ta", "sto", "idi", "ost", "wor", "pim", "ing", "ed"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        said = [word() for _ in range(r.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            said.insert(r.randint(0, len(said)), r.choice(BAD).capitalize() + r.choice(["", ".", "!"]))
        rows.append((i, " ".join(said)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, prose):
    rows, labels = prose
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, score string, k0 string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int")
    machine = toxicity.train(docs.filter("doc_id % 4 <> 2"), marks)
    out = toxicity.toxicity(docs, machine, keep=["doc_id", "score", "k0"])
    assert out.columns == ["doc_id", "k0", "score", "predicted"]
    got = {r["doc_id"]: r for r in out.collect()}
    wrong = [i for i, t in labels if i % 4 == 2 and got[i]["predicted"] != t]
    assert len(got) == 600 and len(wrong) <= 2
    clean = " ".join(rows[1][1].split()[:30])
    odd = [(0, None, 0), (1, "", 0), (2, f"{clean} s-t-u-p-i-d", 1), (3, f"{clean} m o r o n {clean}", 1), (4, f"{clean} w.orth_less", 1), (5, clean, 0), (6, "12 34 !!", 0), (7, (clean + " ") * 3000 + "IDIOT", 1), (7, (clean + " ") * 3000 + "IDIOT", 1), (8, "ka" * 50_000, 0)]
    cases = toxicity.toxicity(spark.createDataFrame([(i, t) for i, t, _ in odd], "doc_id bigint, text string").repartition(2), machine)
    assert sorted((r["doc_id"], r["predicted"]) for r in cases.collect()) == sorted((i, p) for i, _, p in odd)
    assert all(0 <= r["score"] <= 1 for r in cases.collect())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text of words"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    machine = toxicity.train(docs, none)
    assert machine is None
    assert sorted((r["doc_id"], r["score"], r["predicted"]) for r in toxicity.toxicity(docs, machine, keep=["doc_id"]).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert toxicity.toxicity(docs.limit(0), machine).count() == 0


def test_cover_counts_unlike_texts():
    copies = [(1, [0, 5])] * 50
    others = [(k, [0]) for k in range(2, 12)]
    few = [(20 + k, [7]) for k in range(3)] + [(30, [8])]
    assert toxicity.cover([*copies, *others, *few], least=5) == [0, 7]


def test_calibration_is_monotone():
    value = np.array([-2.0, -1.5, -1, -0.5, 0.4, 1, 1.5, 2])
    slope, shift = toxicity.calibrate(value, value > 0)
    score = toxicity.Machine(np.zeros(1), 0.0, slope, shift).score(value)
    assert slope > 0 and (np.diff(score) > 0).all() and score[0] < 0.3 < score[-1]
