"""Trie BPE, packing and the longest-match automaton against the tokenizers library and plain loops."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from curatrix.llm import linmaxmatch, packing, trie_bpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
CONTENT = packing.vocabulary(WORD_BPE)
ODD = [
    None, "", " ", "<|endoftext|>Hello<|startoftext|> x", "ΑΣ ΣΑΣ İstanbul", "á é Å ﬁ １２ ½ ²", "\x1c\x1d x\x85y", "don't we'LL '' 's  ' s",
    "日本語テキスト🤔😀 a😀b", "<|ENDOFTEXT|>", "aaaaaaaaaaaa bbbbbbbb" * 50, "_a_b1_2", "x" * 3000, "The quick brown fox", "The quick brown fox", "՘ ₞",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_padding()
    t.no_truncation()
    return t


def random_texts(n, seed=5):
    r = random.Random(seed)
    words = [k.replace("</w>", "") for k in trie_bpe.load(CONTENT).vocab]
    make = lambda: "".join(r.choice([r.choice(words), r.choice("abcdefghij"), " ", chr(r.randint(32, 0x24F))]) for _ in range(r.randint(1, 14)))
    return [make() for _ in range(n)]


def test_encoder_equals_library(library):
    texts = ODD + random_texts(4000)
    got = [np.frombuffer(x, "<u4").tolist() for x in trie_bpe.load(CONTENT).encode_texts(texts)]
    assert got == [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_cache_generations(library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "CACHE_WORDS", 50)
    bpe = trie_bpe.WordBpe(CONTENT)
    for t in random_texts(100):
        assert np.frombuffer(bpe.encode_texts([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_encode_and_decode(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id int, text string, ids string")
    both = {r["doc_id"]: r for r in trie_bpe.bpe_encode(df, CONTENT, keep=["doc_id"], decoded="decoded").collect()}
    alone = {r["doc_id"]: r["decoded"] for r in trie_bpe.bpe_decode(trie_bpe.bpe_encode(df, CONTENT, keep=["doc_id"]), CONTENT).collect()}
    for i, t in enumerate(ODD):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert both[i]["ids"] == want
        assert both[i]["decoded"] == alone[i] == library.decode(want, skip_special_tokens=False)
    assert trie_bpe.bpe_encode(df.limit(0), CONTENT).count() == 0


def test_op9(spark, library, tmp_path):
    from curatrix.llm.queries import op9_trie_bpe

    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op9_trie_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("capacity", [1, 7, 16, 4096])
def test_bins_take_their_count(capacity):
    """Whole documents, as many as the class says, but for what fills the rest of a bin; nothing is padded or lost."""
    r = random.Random(capacity)
    docs = [(i, np.array([r.randrange(1000) for _ in range(r.choice([1, 2, 5, r.randint(1, 3 * capacity)]))], dtype="<u4").tobytes()) for i in range(800)]
    packer = packing.Packer(capacity, 100, waiting=5)
    out = []
    for key, ids in docs:
        packer.add(key, ids)
        out += packer.take()
    early, most = {s for _, s, _ in out}, len(packer.bins)
    packer.finish()
    out += packer.take()
    assert not packer.open and not packer.bins and most <= 5 and min(s for _, s, _ in out) == 100
    seqs, whole = {}, {}
    for p, s, at in sorted(out, key=lambda x: (x[1], x[2])):
        assert at == sum(q.length for q in seqs.setdefault(s, []))
        seqs[s].append(p)
        whole.setdefault(p.key, []).append(p)
    assert all(b"".join(p.ids for p in sorted(whole[k], key=lambda p: p.start)) == ids for k, ids in docs)
    for s, pieces in seqs.items():
        n = sum(p.length for p in pieces)
        assert n == capacity or s not in early and n & (n - 1) == 0
        first = capacity // pieces[0].length
        if s in early:  # the bin's count of one class, then what fills its rest
            assert len(pieces) >= first and all(capacity // p.length == first for p in pieces[:first])
    with pytest.raises(ValueError):
        packing.Packer(0)


def test_few_documents_are_cut():
    r = random.Random(3)
    sizes = [min(4000, max(1, int(r.lognormvariate(6, 0.8)))) for _ in range(20_000)]
    packer = packing.Packer(4096)
    for i, n in enumerate(sizes):
        packer.add(i, bytes(4 * n))
    packer.finish()
    out = packer.take()
    assert len(out) < 1.15 * len(sizes) and sum(p.length for p, _, _ in out) == sum(sizes)
    seqs = {s for _, s, _ in out}
    assert len(seqs) <= sum(sizes) // 4096 + 13


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, library, capacity):
    texts = ODD + random_texts(60) + ["one two three four five six seven"] * 30
    df = spark.createDataFrame([(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, start string, length int")
    rows = packing.harmonic_pack(df, CONTENT, 2, capacity, with_ids=True).collect()
    check_sequences(rows, capacity)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        got = sorted(by_doc[i if i != 4 else None], key=lambda r: r["start"])
        at = 0
        for r in got:
            part = want[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids"] == part
            assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    assert packing.harmonic_pack(df.limit(0), CONTENT, 2, capacity).count() == 0


def check_sequences(rows, capacity):
    """Pieces of a sequence fill it from 0 without gaps; a sequence is full or has a power of two's length."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_workers_pack_alone(spark, library):
    """Many parts, few rows in each; a clashing key, a very long text."""
    texts = [*ODD, *random_texts(60), "the quick brown fox " * 30_000]
    df = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "offset string, text string, sequence_id int").repartition(13)
    rows = packing.harmonic_pack(df.withColumnRenamed("offset", "id"), CONTENT, 2, 64, key="id").collect()
    check_sequences(rows, 64)
    total = sum(len(e.ids) + 1 for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False))
    assert sum(r["length"] for r in rows) == total and {r["id"] for r in rows} == {str(i) for i in range(len(texts))}


def test_op1(spark, library, tmp_path):
    from curatrix.llm.queries import op1_harmonic_packing

    texts = [*ODD, *random_texts(300), *(" ".join(random_texts(400, seed)) for seed in range(12))]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op1_harmonic_packing(spark, str(tmp_path)).collect()
    check_sequences(rows, 4096)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, t in enumerate(texts):
        want, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for start, length, crc, n in sorted(got.pop(i)):
            assert (start, n, crc) == (at, len(want), zlib.crc32(np.array(want[at : at + length], dtype="<u4").tobytes()))
            at += length
        assert at == len(want)
    assert not got


@pytest.mark.parametrize("longest", [100, None])
def test_token_counts(spark, longest):
    pieces = linmaxmatch.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    begin, inside = linmaxmatch.word_pieces(pieces)
    vocab = {p: i for i, p in enumerate(["[UNK]", *sorted(begin | {"##" + p for p in inside})])}
    library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=longest or 10**9))
    library.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    texts = [*ODD, *random_texts(1500), "y" * 101, "y" * 2500 + " y" * 3, "##", "a!b?c", "ab " * 40_000]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int, n_words string")
    got = {r["doc_id"]: r for r in linmaxmatch.count_tokens(df, pieces, longest=longest).collect()}
    for i, t in enumerate(texts):
        tokens = library.encode(t or "", add_special_tokens=False).tokens
        assert got[i]["n_tokens"] == len(tokens) and got[i]["n_unknown"] == tokens.count("[UNK]"), t
    assert linmaxmatch.count_tokens(df.limit(0), pieces).count() == 0


def test_op5(spark, tmp_path):
    """The query against greedy matching, word by word."""
    from curatrix.llm.queries import PIECES, op5_linmaxmatch

    texts = [*ODD, *random_texts(100), "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    begin, inside = linmaxmatch.word_pieces(linmaxmatch.read_pieces(PIECES))
    most = max(map(len, begin | inside))

    def greedy(w):
        at = n = 0
        while at < len(w):
            k = next((k for k in range(min(most, len(w) - at), 0, -1) if w[at : at + k] in (inside if at else begin)), 0)
            if not k:
                return 0
            at, n = at + k, n + 1
        return n

    for r in op5_linmaxmatch(spark, str(tmp_path)).collect():
        counts = [greedy(w) for w in linmaxmatch.split_words(texts[r["doc_id"]] or "")]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))


def test_automaton_against_greedy():
    r = random.Random(2)
    for _ in range(200):
        word = lambda n: "".join(r.choice("ab") for _ in range(n))
        begin, inside = {word(r.randint(1, 4)) for _ in range(5)}, {word(r.randint(1, 4)) for _ in range(5)}
        a = linmaxmatch.Automaton(begin, inside)
        for _ in range(20):
            w = word(r.randint(1, 12))
            at = n = 0
            while at < len(w):
                k = max((k for k in range(1, len(w) - at + 1) if w[at : at + k] in (inside if at else begin)), default=0)
                if not k:
                    n = 0
                    break
                at, n = at + k, n + 1
            assert a.count(w) == n
