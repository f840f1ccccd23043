"""Sharding, top-k search, chat formatting, language identification and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from curatrix.llm import chat, jumphash, ppm_langid, rindex_dedup, segment_topk

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def jump(key, n):
    """The published loop, one key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, 2, 10**18, 2**63, 2**64 - 1, *range(1000, 3000)], dtype=np.uint64)
    for n in (1, 2, 24, 25, 1000):
        got = jumphash.jump_hash(keys, n)
        assert got.tolist() == [jump(int(k), n) for k in keys]
    a, b = jumphash.jump_hash(keys, 24), jumphash.jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.02
    with pytest.raises(ValueError):
        jumphash.jump_hash(keys, 0)


@pytest.mark.parametrize("repeats", [20_000, 7])
def test_op8(spark, tmp_path, monkeypatch, repeats):
    from curatrix.llm.queries import op8_jump_sharding

    monkeypatch.setattr(jumphash, "REPEATS", repeats)
    texts = [None, "", "é", "same", "same", *(f"t{i}" for i in range(500)), *["again"] * 60, "x" * 300_000, *(f"u{i}" for i in range(40))]
    ids = [*range(505), *[None] * 60, 3, *[77] * 40]
    sf = write(spark, tmp_path, "documents", [(i, t, "s", 1) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, shard string, slot int")
    rows = op8_jump_sharding(spark, sf).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(i or 0, 24), jump(i or 0, 25)) for i, t in zip(ids, texts, strict=True))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    # Rows of one key are dealt over the slices of its shard.
    assert len({r["_slice"] for r in spark.createDataFrame([(77, c) for c in range(40)], "k bigint, c bigint").select(jumphash.slice_of(F.col("k"), F.col("c")).alias("_slice")).collect()}) == 40
    assert jumphash.assign_shards(spark.createDataFrame([], "doc_id bigint, shard string"), "doc_id", 4).count() == 0


def brute_topk(vectors, k, scale=64, every=20):
    ok = {i: [math.floor(scale * float(x)) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in [i for i in ok if i % every == 0]:
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def topk_rows(spark, vectors, k):
    clashing = "rank string, score string, query_id string, dim string, block string, ids string, data string, group string, vector string, id string"
    df = spark.createDataFrame([(i, v, *["x"] * 10) for i, v in vectors], f"vec_id bigint, embedding array<float>, {clashing}").repartition(4)
    got = {}
    for r in segment_topk.topk(df, df.filter("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_topk(spark, monkeypatch, dim):
    monkeypatch.setattr(segment_topk, "CANDIDATES_A_BLOCK", 100)
    monkeypatch.setattr(segment_topk, "QUERIES_A_BLOCK", 7)
    monkeypatch.setattr(segment_topk, "STRIP", 16)
    r = np.random.default_rng(dim)
    base = r.normal(size=(400, dim)).astype(np.float32)
    base[50:90] = base[0]  # ties
    base[90:140] = base[20] + np.float32(0.01)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    vectors += [(1000, None), (1020, []), (1040, [float("nan")] * dim), (1060, [float("inf")] * dim), (1080, [None] * dim), (None, [1.0] * dim), (1100, [0.0] * (dim + 1))]
    want = {q: v for q, v in brute_topk(vectors, 20).items() if v}
    assert topk_rows(spark, vectors, 20) == want


def test_topk_few_and_large(spark):
    vectors = [(i, [float(i), 2.0]) for i in range(5)]
    assert topk_rows(spark, vectors, 20) == brute_topk(vectors, 20)
    huge = [(i, [1e6 * (i + 1), -3e5, 0.5]) for i in range(45)]
    assert topk_rows(spark, huge, 3) == brute_topk(huge, 3)
    assert topk_rows(spark, [], 3) == {}
    # Components beyond 64 bits stay apart, and cancel out exactly.
    far = [(0, [1 / 64, -1 / 64]), *((i, [float(2**a), float(2**b + 2**c)]) for i, (a, b, c) in enumerate([(62, 62, 40), (64, 64, 42), (70, 70, 48), (70, 70, 50), (9, 5, 3)], 1))]
    assert topk_rows(spark, far, 20) == brute_topk(far, 20)


def test_topk_of_repeated_rows_and_long_vectors(spark):
    r = np.random.default_rng(4)
    long = [(i, [float(x) for x in r.normal(size=3000)]) for i in range(25)]
    assert topk_rows(spark, long, 5) == brute_topk(long, 5)
    twice = [(i % 30, [float(x) for x in (r.integers(-3, 3, 5) if i - 20 else np.ones(5))]) for i in range(30)] + [(7, [9.0] * 5), (7, [9.0] * 5)]
    got = topk_rows(spark, twice, 3)
    assert [x[1] for x in got[20]][:2] == [7, 7]  # each of the repeated rows counts


def test_topk_in_ranges_with_many_copies(spark, monkeypatch):
    """Several ranges and groups, a candidate and a query that repeat more often than k, ids that share no vector."""
    for name, n in {"CANDIDATES_A_BLOCK": 40, "QUERIES_A_BLOCK": 4, "BLOCKS_A_RANGE": 2, "BLOCKS_A_GROUP": 2}.items():
        monkeypatch.setattr(segment_topk, name, n)
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.integers(-9, 9, (600, 6)))]
    rows += [(7, [9.0] * 6)] * 300 + [(7, [-9.0] * 6)] * 2 + [(40, rows[40][1])] * 50
    for broadcast in (1_000_000, 0):
        monkeypatch.setattr(segment_topk, "BROADCAST_IDS", broadcast)
        got = topk_rows(spark, rows, 5)
        for q, v in rows[:600:20]:
            hits = sorted((-sum(64 * 64 * a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q for _ in range(51 if q == 40 else 1))
            assert got[q] == [(n + 1, i, -int(s)) for n, (s, i) in enumerate(hits[:5])]
    df = spark.createDataFrame([(7, [1.0, 2.0])] * 300 + [(8, None)], "id bigint, vector array<double>")
    assert segment_topk._at_most(df.filter("vector is not null"), 20, segment_topk.Scratch(spark, "test")).count() == 20


def test_topk_blocks_pass_on_their_bar(monkeypatch):
    """Finer levels and products are made for what is left alone, and blocks in turn give the same as one."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 64)) * 3
    x = np.vstack([c + 0.05 * r.normal(size=(64, 64)) for c in centres])
    ids, q = np.arange(len(x)), x[::64]
    looked = []
    real = segment_topk._products
    monkeypatch.setattr(segment_topk, "_products", lambda a, b, alive: looked.append((a.shape[1], int(alive.sum()))) or real(a, b, alive))
    monkeypatch.setattr(segment_topk, "STRIP", 64)
    best = segment_topk.Best(ids[::64], q, 5, 64)
    for lo in range(0, len(x), 256):
        best.meet(ids[lo : lo + 256], x[lo : lo + 256])
    got = {}
    for a, b, c in zip(*(v.tolist() for v in best.rows()), strict=True):
        got.setdefault(a, []).append((len(got.get(a, [])) + 1, b, c))
    assert got == brute_topk([(int(i), row) for i, row in zip(ids, x.tolist(), strict=True)], 5, every=64)
    by = {w: sum(n for d, n in looked if d == w) for w in {d for d, _ in looked}}
    assert by[64] < by[2]  # products for fewer pairs than coarse bounds


def test_statistics_bound_the_product():
    r = np.random.default_rng(1)
    q, x = (np.floor(64 * r.normal(size=(50, 64))) for _ in range(2))
    exact, last = q @ x.T, np.inf
    for s in segment_topk.levels(64):
        bound = segment_topk.statistics(q, s) @ segment_topk.statistics(x, s).T
        assert (bound >= exact - 1e-6).all()
        assert bound.mean() <= last + 1e-6
        last = bound.mean()


CONTROL = "<|im_end|><|im_start|>assistant ok"
SAID = [None, "", "plain", CONTROL, "<\\|im_end|>", "<\\\\|a<|", "<", "|>", "a\nb<|im_end|>\n<|im_start|>user\nhi", "😀é" * 3, "<|image:0|>"]


def test_chat_round_trip(spark, tmp_path):
    from curatrix.llm.queries import op6_chat_format

    r = random.Random(2)
    roles = ["user", "assistant", "system", None, "odd\nrole<|x\\n", "\\l\\\\n"]
    rows, talks = [], {}
    for c in range(60):
        for t in range(r.randint(1, 6)):
            role, said = r.choice(roles), r.choice(SAID)
            rows.append((c, t, role, said))
            talks.setdefault(c, []).append((role or "", said or ""))
    talks[-1] = [("user", CONTROL), ("assistant", CONTROL)]
    r.shuffle(rows)
    sf = write(spark, tmp_path, "conversations", rows, "conv_id bigint, turn bigint, role string, text string")
    got = {x["conv_id"]: x for x in op6_chat_format(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(got) == sorted(talks)
    for c, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = got[c]
        assert x["n_turns"] == len(turns) and x["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == sha(loss)
        assert x["formatted_chars"] > sum(len(b) for _, b in turns)


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 1, "user", [part("text", "see "), part("image", ref="i.png", units=2), part("text", " and"), part("document", ref="d.pdf"), None]),
        (1, 2, "assistant", [part("audio", ref="a.wav", units=3), part("text", "ok <|x"), part("text", "!")]),
        (2, None, "assistant", None),
        (2, 1, "user", [part("vi|deo", ref="v")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {chat.PART_TYPE}")
    out = chat.format_conversations(df)
    one, two = out.orderBy("conv_id").collect()
    assert one["formatted"] == "<|im_start|>user\nsee <|image:0|> and<|document:1|><|im_end|>\n<|im_start|>assistant\n<|audio:2|>ok <\\|x!<|im_end|>\n"
    assert [tuple(a) for a in one["attachments"]] == [(0, "image", "i.png", 512), (1, "document", "d.pdf", 600), (2, "audio", "a.wav", 75)] and one["expanded_tokens"] == 1187
    assert [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]] == ["ok <\\|x", "!"]
    assert two["formatted"] == "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n<|vi|deo:0|><|im_end|>\n" and two["expanded_tokens"] == 0
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).orderBy("conv_id").first()
    assert out.filter("conv_id = 2").select(chat.read_turns(F.col("formatted"))).first()[0][1]["text"] == ""
    assert [tuple(t) for t in read["t"]] == [("user", "see  and"), ("assistant", "ok <|x!")] and read["m"] == "ok <|x!"
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_ppm(samples, text, least):
    """Code lengths by dictionaries of contexts, a byte at a time, without anything of the model."""
    low = lambda t: b"\n\n\n" + bytes(c + 32 if 65 <= c <= 90 else c for c in t)
    seen = {}
    for name, texts in samples.items():
        own = seen[name] = {}
        for t in map(low, texts):
            for i in range(3, len(t)):
                for k in range(4):
                    own.setdefault(t[i - k : i], Counter())[t[i]] += 1

    def stands(own, c):
        return not c or c in own and sum(own[c].values()) >= least and stands(own, c[1:])

    def share(own, c, byte):
        if not stands(own, c):
            return share(own, c[1:], byte)
        here = own.get(c, Counter())
        n, kinds = sum(here.values()), len(here)
        if here[byte]:
            return here[byte] / (n + kinds)
        escape = kinds / (n + kinds) if n else 1
        return escape * (share(own, c[1:], byte) if c else 1 / 256)

    t = low(text)
    return [-sum(math.log2(share(seen[k], t[i - 3 : i], t[i])) for i in range(3, len(t))) for k in sorted(samples)]


def speak(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))


def test_ppm_against_plain_contexts(monkeypatch):
    r = random.Random(1)
    samples = {"x": [speak(r, "abcA", 40).encode() for _ in range(8)], "y": [speak(r, "bcdé", 300).encode(), b""], "z": [b"q"]}
    texts = [b"abc cab", b"", b"dcb bcd dcb", "é?\0".encode(), b"A", b"\nab\n\n\n\nq", *(speak(r, "abcdéxq \n", 30).encode() for _ in range(20))]
    for least in (48, 5, 1):
        monkeypatch.setattr(ppm_langid, "LEAST_COUNT", least)
        m = ppm_langid.PpmModel.of_texts(samples)
        assert np.allclose(m.bits(texts), [brute_ppm(samples, t, least) for t in texts], rtol=1e-5)
        # Over the symbols that the sample has, each node's code shares sum to at most 1.
        shares = np.exp2(-m.cost.astype(float)).reshape(-1, m.symbols, 3)[:, 1:, :].sum(axis=1)
        assert (shares <= 1 + 1e-5).all() and len(shares) > 10
    assert m.bits(texts)[0].argmin() == 0 and m.bits(texts)[2].argmin() == 1


def test_ppm_trained_in_spark(spark, monkeypatch):
    """Counts of a table's rows are those of its texts; repeated rows count once; the tree has a bounded size."""
    r = random.Random(7)
    samples = {k: [speak(r, v, r.randint(1, 60)) for _ in range(40)] for k, v in {"x": "abcB", "y": "bcdé", "z": "日本ab"}.items()}
    rows = [(i, t, k, "q") for i, (k, t) in enumerate((k, t) for k, ts in samples.items() for t in ts)]
    df = spark.createDataFrame([*rows, *rows[:30], (None, None, "x", "q"), (1, "", "x", "q"), (2, "abc", None, "q")], "doc_id bigint, text string, lang string, gram string").repartition(5)
    texts = [speak(r, "abcdé日", 20).encode() for _ in range(30)]
    want = ppm_langid.PpmModel.of_texts({k: [t.encode() for t in ts] for k, ts in samples.items()})
    got = ppm_langid.train(df, "text", "lang", F.col("doc_id"))
    assert got.languages == want.languages and np.allclose(got.bits(texts), want.bits(texts))
    assert np.allclose(got.bits(texts), [brute_ppm({k: [t.encode() for t in ts] for k, ts in samples.items()}, t, ppm_langid.LEAST_COUNT) for t in texts], rtol=1e-5)
    monkeypatch.setattr(ppm_langid, "HELD_GRAMS", 50)
    assert np.allclose(ppm_langid.train(df, "text", "lang", F.col("doc_id")).bits(texts), want.bits(texts))
    monkeypatch.setattr(ppm_langid, "MOST_CONTEXTS", 20)
    monkeypatch.setattr(ppm_langid, "LEAST_SHARE", 1)
    small = ppm_langid.train(df, "text", "lang", F.col("doc_id"))
    assert 5 < small.first[-1] < got.first[-1]  # six contexts a language, and those as frequent as the last
    assert np.allclose(small.bits(texts), ppm_langid.PpmModel.of_texts({k: [t.encode() for t in ts] for k, ts in samples.items()}).bits(texts))
    few = ppm_langid.train(df, "text", "lang", F.col("doc_id"), per_language=3)
    assert few.languages == want.languages
    told = ppm_langid.identify(df.withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1)), got).collect()
    assert len(told) == len(rows) + 33 and all(x["lang_pred"] == x["lang"] for x in told if x["text"] and len(x["text"]) > 40)


def test_ppm_learns_every_label(spark):
    """More labels than one cost table holds, some of them with few rows and one without ids."""
    r = random.Random(5)
    letters = {f"l{i:02}": "".join(chr(0x4E00 + 6 * i + j) for j in range(6)) for i in range(70)}
    rows = [(None if k == "l69" else 100 * i + j, speak(r, v, 40), k) for i, (k, v) in enumerate(letters.items()) for j in range(2 if i > 3 else 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = ppm_langid.train(df, "text", "lang", F.col("doc_id"))
    assert model.languages == sorted(letters) and len(model.groups) > 1
    asked = spark.createDataFrame([(k, speak(r, v, 30)) for k, v in letters.items()], "lang string, text string")
    assert all(x["lang_pred"] == x["lang"] for x in ppm_langid.identify(asked, model).collect())


def test_ppm_tables_agree(monkeypatch):
    r = random.Random(6)
    samples = {k: [speak(r, v, 400).encode()] for k, v in {"x": "abc", "y": "bcd", "z": "cdä"}.items()}
    texts = [b"abc cab", b"", b"dcb bcd dcb"]
    want = ppm_langid.PpmModel.of_texts(samples).bits(texts)
    monkeypatch.setattr(ppm_langid, "GROUP", 2)
    for kept in (ppm_langid.KEPT_BYTES, 0):
        monkeypatch.setattr(ppm_langid, "KEPT_BYTES", kept)
        m = ppm_langid.PpmModel.of_texts(samples)
        assert len(m.groups) == 2 and (m.bits(texts) == want).all() and len(m.tables) == (2 if kept else 0)


def language_rows(n=240):
    r = random.Random(3)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "äöüab"}
    rows = [(i, speak(r, letters[k := r.choice(list(letters))], r.randint(5, 60)), k, "s", 1) for i in range(n)]
    return rows, letters


def test_op7(spark, tmp_path):
    from curatrix.llm.queries import op7_ppm_language

    rows, _ = language_rows()
    odd = [(1000, None, "aa", "s", 0), (1001, "12 34 !", "aa", "s", 0), (1002, "", None, "s", 0), (1003, "abc " * 20_000, None, "s", 0), (None, "abcde abc", "aa", "s", 0)]
    got = {r["doc_id"]: r for r in op7_ppm_language(spark, write(spark, tmp_path, "documents", rows + odd, DOCUMENTS)).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {i for i, r in got.items() if i is not None and i < 1000 and r["held_out"]}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())


def test_op7_nothing_to_learn(spark, tmp_path):
    from curatrix.llm.queries import op7_ppm_language

    sf = write(spark, tmp_path, "documents", [(1, "text", None, "s", 4)], DOCUMENTS)
    assert [(r["lang_pred"], r["score"]) for r in op7_ppm_language(spark, sf).collect()] == [("und", 0.0)]
    sf = write(spark, tmp_path, "documents", [], DOCUMENTS)
    assert op7_ppm_language(spark, sf).count() == 0


def test_labels_do_not_reach_predictions(spark, tmp_path):
    """Held-out rows' labels change nothing."""
    from curatrix.llm.queries import op7_ppm_language

    rows, _ = language_rows()
    pick = lambda d: {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in d.collect()}
    a = pick(op7_ppm_language(spark, write(spark, tmp_path, "documents", rows, DOCUMENTS)))
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else k, s, n) for i, t, k, s, n in rows]
    assert a == pick(op7_ppm_language(spark, write(spark, tmp_path, "documents", changed, DOCUMENTS)))


def without_passages(texts):
    """The texts without the repeated runs of over 50 words, by counting windows."""
    import corpus_pipeline

    n = corpus_pipeline.PASSAGE_BYTES
    data = [t.encode() for t in texts]
    count = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    out = []
    for t in data:
        covered = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                covered[i : i + n] = b"\1" * n
        left, at = b"", 0
        for m in re.finditer(b"\1+", covered):
            if len(t[m.start() : m.end()].split()) > 50:
                left += t[at : m.start()]
                at = m.end()
        out.append((left + t[at:]).decode())
    return out


def test_words_of_scripts_without_spaces():
    count = rindex_dedup.count_words
    assert count("a bc\td  é~è\n".encode()) == 4 and count(b"") == 0 and count("«é» – «è»".encode()) == 3
    assert count("日本語のテキスト。".encode()) == 8 and count("日本 GPU 2、語".encode()) == 5
    assert count("กขค".encode()) == 1 and count("กิขีคืง".encode()) == 2 and count("한국어 말".encode()) == 2


def test_passages_of_scripts_without_spaces(spark):
    """51 ideographs or as many words of three Thai letters go, with and without punctuation; fewer stay."""
    import corpus_pipeline

    r = random.Random(9)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    thai = lambda n: "".join(chr(r.randrange(0x0E01, 0x0E2F)) for _ in range(n))
    for make, passage, gone in ((han, han(51), True), (han, f"{han(30)}。{han(30)}", True), (han, han(49), False), (thai, thai(153), True), (thai, thai(150), False), (han, thai(160), True)):
        sides = [(make(40), make(40)) for _ in range(3)]
        docs = spark.createDataFrame([(i, f"{a}\n{passage}\n{b}", "zz", "s", 0) for i, (a, b) in enumerate(sides)], DOCUMENTS)
        out = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
        assert {i: t.replace("\n", "") for i, t in out.items()} == {i: a + ("" if gone else passage) + b for i, (a, b) in enumerate(sides)}


def test_passages_are_told_by_words(spark):
    """51 short words go, 50 long ones stay, in any document; other columns keep their values."""
    import corpus_pipeline

    r = random.Random(4)
    word = lambda a, b: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(a, b)))
    say = lambda n, a=4, b=9: " ".join(word(a, b) for _ in range(n))
    short, long, most = say(51, 2, 3), say(50, 9, 12), say(51, 9, 12)
    texts = [f"{say(20)} ~{p}~ {say(20)}" for p in (short, long, most) for _ in range(3)] + [None, "", say(30), f"{most} {say(5)} {most}"]
    rows = [(i, t, "aa", "s", 0, b"k", f"r{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS + ", kept binary, removed string").repartition(3)
    out = corpus_pipeline.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns
    got = {x["doc_id"]: x for x in out.collect()}
    want = without_passages([t or "" for t in texts])
    assert {i: x["text"] for i, x in got.items()} == {i: t for i, t in enumerate(want) if t}
    assert not any(short in t or most in t for t in want) and sum(long in t for t in want) == 3
    assert all(x["removed"] == f"r{i}" and x["n_chars"] == len(x["text"]) for i, x in got.items())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_components

    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    clean = [say(r.randint(20, 80)) for _ in range(25)]
    passage = say(70)
    base = say(150)
    near = [base, base + " tail", base.upper()]
    holders = [say(30) + " " + passage + " " + say(30) for _ in range(3)]
    texts = [*clean, *near, *holders, None, "", "123 ??"]
    rows = [(i, t, "aa", "s", len(t or ""), i) for i, t in enumerate(texts)]
    sf = write(spark, tmp_path, "documents", rows, DOCUMENTS + ", extra int")
    docs = spark.read.parquet(sf + "/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, sf)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == list(range(len(texts) - 3))
    alone = stage["near_duplicates"](spark, kept, sf)
    want = {c for _, c in brute_components([(i, t) for i, t in enumerate(texts[:-3])], 5, 0.8).values()}
    assert alone.columns == docs.columns and {x["doc_id"] for x in alone.collect()} == want and len(want) == len(texts) - 5
    left = stage["repeated_passages"](spark, alone, sf)
    assert left.columns == docs.columns
    said = {x["doc_id"]: (x["text"], x["n_chars"], x["extra"]) for x in left.collect()}
    assert said == {i: (t, len(t), i) for i, t in zip(sorted(want), without_passages([texts[i] for i in sorted(want)]), strict=True) if t}
    assert all(said[i][0] == clean[i] for i in range(len(clean))) and not any(passage in t for t, _, _ in said.values())
    packed = corpus_pipeline.run(spark, sf).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t, _, _ in said.values())
    assert sum(x["length"] for x in packed) == total and {x["doc_id"] for x in packed} == set(said)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, write(spark, tmp_path, "documents", [], DOCUMENTS)).count() == 0


def test_pipeline_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    said = "one two three four five six"
    rows = [(1, said, "aa", "s", 1)] * 3 + [(None, "seven eight", "aa", "s", 1)] * 2
    rows += [(2, "other words under one id here", "aa", "s", 1), (2, "and yet another text of that id", "aa", "s", 1), (2, said.upper(), "aa", "s", 1)]
    rows += [(None, said, "aa", "s", 1), (None, "no id but a text", "aa", "s", 1), (3, None, "aa", "s", 1), (4, "", "aa", "s", 1), (9, "and yet another text of that id", "aa", "s", 1)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCUMENTS + ", component_id int")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    texts = [t for _, t in got if t]
    # One row of each text is left; one with an id of its own comes before others.
    assert sorted(t.lower() for t in texts) == sorted({said, "seven eight", "other words under one id here", "and yet another text of that id", "no id but a text"})
    assert (9, "and yet another text of that id") in got and {(3, None), (4, "")} < set(got) and len(got) == 7
