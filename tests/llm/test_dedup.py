"""Near duplicates, repeated passages, fingerprints and components against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from curatrix.llm import fingerprints, hyperminhash, rindex_dedup
from curatrix.llm.common import Scratch, drop_scratch
from curatrix.llm.components import components


def union(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width, threshold):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union(links, ids).items()}


def near_texts(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two three", "é É"]
    for n in (8, 30, 120, 600):
        for _ in range(6):
            base = [r.choice(words) for _ in range(n)]
            texts += [" ".join(base), " ".join(base).upper()]
            for _ in range(8):
                edit = list(base)
                for _ in range(r.choice([1, 2, n // 25 + 1, n // 12 + 1])):
                    edit[r.randrange(n)] = r.choice(words)
                texts.append("\n".join(edit))
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id bigint, text string, bands string, component_id int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.near_duplicates(df, width, Fraction(4, 5)).collect()}
    want = brute_components(rows, width, Fraction(4, 5))
    assert got == want and max(Counter(c for _, c in want.values()).values()) > 3


def test_large_group_in_small_blocks(spark, monkeypatch):
    """A group of near copies around one text, many of them beyond the threshold, with buckets cut into blocks."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 8)
    monkeypatch.setattr(hyperminhash, "PIVOT_ROWS", 16)
    r = random.Random(1)
    base = [f"w{r.randrange(900)}" for _ in range(140)]
    rows = []
    for i in range(150):
        edit = list(base)
        for _ in range(r.randint(0, 16)):
            edit[r.randrange(140)] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(edit)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in hyperminhash.near_duplicates(df, 2, Fraction(4, 5)).collect()}
    assert got == brute_components(rows, 2, Fraction(4, 5))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_short_texts(spark, width):
    """Pairs of small sets at exactly the threshold, or near it: each is found, whatever buckets their shingles have."""
    r = random.Random(width)
    rows = []
    for size in (5, 5, 5, 5, 5, 6, 10, 15, 30, 60):
        for _ in range(60):
            words = [f"v{r.randrange(10**9)}" for _ in range(size + width - 1)]
            less = size - -(-size * 4 // 5)
            rows += [" ".join(words), " ".join(words[less:]), " ".join(words[less + 1 :])]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in hyperminhash.near_duplicates(df, width, Fraction(4, 5)).collect()}
    sets = {i: shingles(t, width) for i, t in rows}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [(a, b) for i in range(0, len(rows), 3) for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)) if near(a, b)]
    assert got == {i: (len(sets[i]), c) for i, c in union(links, sets).items()} and len(links) >= 600


def test_words_are_told_apart(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2^64 are equal for every odd base; very long texts."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in signs) for flip in (0, 1))
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, " ".join([a] * 600)), (6, " ".join([a] * 700)), (7, "z" * 2_000_000), (8, "z" * 2_000_001)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in hyperminhash.near_duplicates(df, 2).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 8)} == brute_components(rows, 2, Fraction(4, 5))


def test_near_duplicate_edges(spark):
    schema = "doc_id bigint, text string"
    assert hyperminhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "a b c"), (None, "alone here"), (3, None)]
    got = sorted((tuple(r) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, schema), 2).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 1, None), (3, 0, 3)], key=str)


def test_estimate_is_corrected():
    r = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8):
        n = 4000
        common = r.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        own = [np.unique(np.concatenate([common, r.integers(0, 1 << 63, n - len(common), dtype=np.uint64)])) for _ in range(2)]
        true = len(np.intersect1d(*own)) / len(np.union1d(*own))
        s = hyperminhash.sketches(own)
        size = np.array([n])
        e = hyperminhash.estimate((s[:1] == s[1:]).mean(axis=1), size, size)[0]
        assert abs(e - true) < 0.12
    assert hyperminhash.chance(np.array([4000]), np.array([4000]))[0] < 0.01


def test_scratch(spark):
    s = Scratch(spark, "test")
    a, b = s.keep(spark.range(3)), s.keep(spark.range(4))
    s.drop(a)
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        a.count()
    assert drop_scratch(spark) >= 1 and drop_scratch(spark) == 0


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(5, 5)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {x["node"]: x["component"] for x in components(df, Scratch(spark, "test")).collect()}
    want = union(links, {x for p in links if p[0] != p[1] for x in p})
    assert got == want


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        flags = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        out.append((len(t), int(flags.sum()), runs, np.frombuffer(t, np.uint8)[~flags].tobytes()))
    return out


def repeated_texts(length, seed=8):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdefgh é日") for _ in range(n))
    passage, line = some(length + 40), some(length - 20)
    texts = [None, "", "short", "ab" * length, "x" * (3 * length), some(4 * length)]
    texts += [some(r.randint(1, length)) + passage + some(r.randint(1, length)) for _ in range(6)]
    texts += [some(30) + line + some(30) for _ in range(12)]
    texts += [some(50) + passage[:length] + some(20) + passage[20:] + some(9), texts[5], texts[5], passage]
    return texts


def removed(spark, texts, length, **how):
    """What repeated_spans makes of the texts, in the form of brute_repeats."""
    df = spark.createDataFrame([(i if i else None, t, i, "s") for i, t in enumerate(texts)], "doc_id int, text string, t1 int, spans string")
    spans = {}
    found = rindex_dedup.repeated_spans(df, length, **how)
    named = df.select("doc_id", "text").select("doc_id", *rindex_dedup.identity(df["text"]))
    for r in named.join(found, ["t1", "t2"]).collect():
        spans[r["doc_id"] or 0] = [s.asDict() for s in r["spans"]]
    out = []
    for i, t in enumerate((t or "").encode() for t in texts):
        ranges = rindex_dedup.byte_ranges(spans.get(i), length)
        left = b"".join(rindex_dedup.kept_parts(t, ranges))
        out.append((len(t), len(t) - len(left), len(ranges), left))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_nul_is_a_byte(spark, hot):
    """No 400-byte string repeats here, but one would if U+0000 ended a text; then strings that hold U+0000 and repeat."""
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    x, y, z = some(300), some(300), some(500)
    texts = [x + "\0" + y, *(some(200) + x for _ in range(8)), *(y + some(200) for _ in range(8))]
    want = brute_repeats([t.encode() for t in texts], 400)
    assert not any(w[1] for w in want) and removed(spark, texts, 400, hot=hot) == want
    texts += ["\0" * 900, some(9) + z[:250] + "\0" + z[250:] + "\0", "\0" + z[:250] + "\0" + z[250:], z, "\0" + x + "\0" + y]
    want = brute_repeats([t.encode() for t in texts], 400)
    assert removed(spark, texts, 400, hot=hot) == want and sum(w[1] > 0 for w in want) >= 4


def test_bytes_tell_equal_digests_apart(spark, monkeypatch):
    monkeypatch.setattr(rindex_dedup, "digest", lambda x: len(x).to_bytes(16, "little"))
    texts = repeated_texts(60)
    for hot in (4096, 1):
        assert removed(spark, texts, 60, anchor=20, hot=hot) == brute_repeats([(t or "").encode() for t in texts], 60)


def test_large_group_of_unlike_stretches(spark):
    """One string in 6000 texts, none of whose long windows repeats but those of a few pairs; rows stay few."""
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    line = some(150)
    texts = [some(r.randint(100, 250)) + line + some(r.randint(100, 250)) for _ in range(6000)]
    for i in range(0, 40, 2):  # 399 or 400 bytes in common
        a, b = some(125 + i % 4 // 2), some(124)
        texts += [some(90) + a + line + b + some(90) for _ in range(2)]
    want = brute_repeats([t.encode() for t in texts], 400)
    assert removed(spark, texts, 400) == want and sum(w[1] > 0 for w in want) == 20


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    r = random.Random(9)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (3000, 40, 0, 500, 130, 700)]
    whole = lambda out: {(t, s + i, k) for t, s, n, k in zip(*(x.tolist() for x in out), strict=True) for i in range(n)}
    want = whole(rindex_dedup.stretches(texts, 60, 20))
    monkeypatch.setattr(rindex_dedup, "PIECE_BYTES", 128)
    assert whole(rindex_dedup.stretches(texts, 60, 20)) == want and len(want) == sum(max(0, len(t) - 59) for t in texts)


@pytest.mark.parametrize(("length", "hot"), [(60, 4096), (60, 1), (60, 3), (400, 4096), (400, 2)])
def test_repeats(spark, length, hot):
    texts = repeated_texts(length)
    got = removed(spark, texts, length, anchor=length // 3, hot=hot)
    assert got == brute_repeats([(t or "").encode() for t in texts], length)


def test_remove_repeats(spark):
    texts = repeated_texts(90)
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id int, text string, t1 int, kept string")
    data = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in rindex_dedup.remove_repeats(df, 90, anchor=30).collect()}
    assert [bytes(got[i]["kept"]) for i in range(len(texts))] == [w[3] for w in brute_repeats(data, 90)] and got[3]["t1"] == 5
    assert all(got[i]["kept_text"] == bytes(got[i]["kept"]).decode() for i in range(len(texts)) if texts[i] is None or texts[i].isascii())
    whole = rindex_dedup.remove_repeats(df, 90, keep=["doc_id"], whole=True, anchor=30).collect()
    assert len([bytes(r["kept"]).decode() for r in whole]) == len(texts)
    assert rindex_dedup.remove_repeats(df.limit(0), 90).count() == 0


def test_run_index():
    r = random.Random(3)
    for _ in range(300):
        parts = [bytes(r.choice(b"\0a\xff") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))]
        length = r.randint(1, 6)
        parts = [p for p in parts if len(p) >= length] or [b"a" * length]
        count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, flags in zip(parts, rindex_dedup.repeated_windows(parts, length), strict=True):
            assert flags.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]
    assert [f.all() for f in rindex_dedup.repeated_windows([b"\0\0a", b"xyz"], 2, [2, 1])] == [True, False]
    index = rindex_dedup.RunIndex(rindex_dedup.letters([b"banana" * 50]))
    assert len(index.starts) < 20 and len(index.head_sample) == len(index.tail_sample) == len(index.starts)


def test_op10(spark, tmp_path):
    from curatrix.llm.queries import op10_rindex_dedup

    texts = repeated_texts(400)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_repeats([(t or "").encode() for t in texts], 400)
    for r in op10_rindex_dedup(spark, str(tmp_path)).collect():
        n, removed, runs, left = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, runs, hashlib.sha256(left).hexdigest())
        assert r["n_kept"] == len(left) and len(r["text"].encode()) <= len(left) < len(r["text"].encode()) + 6 * (runs + 1)


SAME = [("Straße  x", "STRASSE X "), ("ﬁ １２", "fi 12"), ("é", "é"), ("a b\n", "A B"), (None, " ")]
OTHER = [("a", "b"), ("ab", "a b"), ("é", "e")]


def test_fingerprints(spark):
    rows = [(i, *p, 1) for i, p in enumerate(SAME + OTHER)]
    df = spark.createDataFrame(rows, "doc_id int, a string, b string, fa int")
    got = {r["doc_id"]: (r["fa"], r["fb"]) for r in fingerprints.fingerprint_columns(df, {"a": "fa", "b": "fb"}, ["doc_id"]).collect()}
    assert all(got[i][0] == got[i][1] for i in range(len(SAME))) and all(got[i][0] != got[i][1] for i in range(len(SAME), len(rows)))
    assert fingerprints.fingerprint_columns(df.limit(0), {"a": "fa"}, ["doc_id"]).count() == 0


def test_colliding_buckets_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "bucket", lambda c: [F.octet_length(c).cast("long").alias("_h1"), F.lit(0).cast("long").alias("_h2")])
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "c")], "doc_id int, text string")
    got = {r["doc_id"]: r["f"] for r in fingerprints.fingerprint_columns(df, {"text": "f"}, ["doc_id"]).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3


def test_op2(spark, tmp_path):
    from curatrix.llm.queries import op2_canonical_fingerprint

    r = random.Random(6)
    texts = {i * 3: "".join(r.choice("abc é日😀") for _ in range(r.randint(0, 40))) for i in range(60)} | {500: None, 501: "same", 502: "SAME", 503: "x" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x["doc_id"]: x for x in op2_canonical_fingerprint(spark, str(tmp_path)).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(own) // 4
        edited = own[: len(own) - n] + after[:n]
        assert rows[i]["n_chars"] == len(own) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["near_next"] == float(rows[i]["fingerprint"] == rows[ids[(k + 1) % len(ids)]]["fingerprint"])
        if edited == own:
            assert rows[i]["near_edited"] == 1.0 and rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]
    assert rows[501]["near_next"] == 1.0 and rows[501]["near_edited"] == 1.0 or texts[502]


def test_next_row(spark):
    from pyspark.sql import functions as F

    for ids in ([5], [1, 2], list(range(0, 3000, 7)), [0, 1, 2, 10**15], []):
        df = spark.createDataFrame([(i, f"v{i}", 1) for i in ids], "k bigint, v string, _x int").repartition(4)
        got = {r["k"]: r["n"] for r in fingerprints.with_next(df, "k", "v", "n", 10).collect()}
        assert got == {i: f"v{ids[(p + 1) % len(ids)]}" for p, i in enumerate(ids)}
    # A key of half the rows, and null keys, are dealt by digest; each row still has the next one in that order.
    many = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"v{i}") for i in range(900)]
    df = spark.createDataFrame(many, "k bigint, v string").repartition(4)
    order = [r["v"] for r in df.orderBy(F.coalesce("k", F.lit(-(1 << 62))), F.xxhash64("k", "v")).collect()]
    got = {r["v"]: r["n"] for r in fingerprints.with_next(df, "k", "v", "n", 10).collect()}
    assert got == {v: order[(p + 1) % len(order)] for p, v in enumerate(order)}
    tied = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "z")], "k bigint, v string")
    out = fingerprints.with_next(tied, "k", "v", "n")
    assert out.count() == 5 and out.filter(F.col("n").isNull()).count() == 0
