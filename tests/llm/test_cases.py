"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curatrix.llm import chat, fingerprints, hyperminhash, packing, ppm_langid, rindex_dedup, trie_bpe
from tests.llm.test_tokens import CONTENT, WORD_BPE

LONG = " ".join(f"word{i % 977} é{i % 13}" for i in range(150_000))
ROWS = [(None, None), (None, None), (1, ""), (1, ""), (2, LONG), (2, LONG), (3, LONG + " tail"), (4, "few words here"), (None, "few words here"), (5, " \t\n")]
#: Names that operators use inside or for their outputs.
CLASHING = ["ids", "decoded", "start", "length", "key", "copies", "kept_text", "spans", "t1", "t2", "_k", "_slice", "n_shingles", "bands", "id", "size", "fingerprint", "formatted", "_tie", "a", "b", "w", "part", "score", "lang_pred", "gram", "n", "k"]


@pytest.fixture(scope="module")
def odd(spark):
    fields = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *[None if i is None else "x"] * len(CLASHING)) for i, t in ROWS], f"doc_id bigint, text string, {fields}").repartition(3)


def test_bpe(odd):
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    out = trie_bpe.bpe_encode(odd, CONTENT, decoded="decoded")
    assert out.columns == [c for c in odd.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    rows = out.collect()
    want = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS}
    assert len(rows) == len(ROWS) and all(r["ids"] == want[r["text"]] and r["decoded"] == library.decode(want[r["text"]], skip_special_tokens=False) for r in rows)
    none = trie_bpe.bpe_decode(out.select("doc_id", F.lit(None).cast("array<int>").alias("ids"), F.lit("x").alias("decoded")), CONTENT).collect()
    assert len(none) == len(ROWS) and {r["decoded"] for r in none} == {""}


def test_pieces(odd):
    rows = packing.harmonic_pack(odd, CONTENT, 2, 4096).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        want[i, n] += n
    assert got == want


def test_fingerprints(odd):
    rows = fingerprints.fingerprint_columns(odd, {"text": "fingerprint"}, ["doc_id", "size"]).collect()
    assert len(rows) == len(ROWS) and rows[0].__fields__ == ["doc_id", "size", "fingerprint"]
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert sorted(by.values(), key=str) == sorted([{None, 1, 5}, {2}, {3}, {4, None}], key=str)
    held = fingerprints.with_next(odd.select("doc_id", F.sha2("text", 256).alias("v"), "_k", "_tie"), "doc_id", "v", "next")
    assert held.count() == len(ROWS)


def test_near_duplicates(odd):
    rows = hyperminhash.near_duplicates(odd, 5, Fraction(4, 5)).collect()
    got = Counter((r["doc_id"], r["n_shingles"] > 1, r["component_id"]) for r in rows)
    assert got == Counter([(None, False, None), (None, False, None), (1, False, 1), (1, False, 1), (2, True, 2), (2, True, 2), (3, True, 2), (4, False, 4), (None, False, 4), (5, False, 5)])


def test_repeats(odd):
    out = rindex_dedup.remove_repeats(odd, 400)
    assert out.columns == [c for c in odd.columns if c != "kept_text"] + ["kept", "kept_text", "removed"]
    left = Counter((r["doc_id"], bytes(r["kept"]), r["t1"], r["kept_text"]) for r in out.collect())
    say = lambda i, t, kept: (i, kept.encode(), None if i is None else "x", kept)
    want = Counter(say(i, t, "" if t and len(t) > 400 else t or "") for i, t in ROWS)
    # The tail's word alone is new; the long text repeats itself, with a space behind it.
    want[say(3, LONG, "")] -= 1
    want[say(3, LONG, "tail")] += 1
    assert left == +want


def test_languages(odd, spark):
    df = odd.withColumn("lang", F.when(F.col("doc_id") == 4, "aa").when(F.col("doc_id") == 2, "bb"))
    told = ppm_langid.identify(df, ppm_langid.train(df, "text", "lang", F.col("doc_id"))).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in told) == Counter([(None, "und"), (None, "und"), (1, "und"), (1, "und"), (2, "bb"), (2, "bb"), (3, "bb"), (4, "aa"), (None, "aa"), (5, "und")])
    assert all(0 <= r["score"] <= 1 for r in told)


def test_chat(odd):
    turns = odd.select("*", F.lit(7).alias("conv_id"), F.lit("assistant").alias("role"), F.lit(None).cast("int").alias("turn"), chat.text_parts(F.col("text")).alias("parts"), F.lit(1).alias("_said"), F.lit(2).alias("_n"))
    out = chat.format_conversations(turns)
    row = out.select("formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.sha2(chat.masked_text(F.col("formatted"), F.col("loss_spans")), 256).alias("m")).first()
    said = sorted(t or "" for _, t in ROWS)
    assert out.count() == 1 and [t["text"] for t in row["turns"]] == said and {t["role"] for t in row["turns"]} == {"assistant"}
    assert row["m"] == hashlib.sha256("".join(said).encode()).hexdigest()
