"""The corpus pipeline: language, near duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) on the whole output of the stage before. All but the last return the
columns of ``documents`` (and any extra ones, whatever their names); the last returns the packed pieces. SQL cannot express
the first stage, so ORACLE_SQL is None; the tests hold the stages against brute-force versions. Texts of any length are
worked on whole, and an empty table stays empty in every stage.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import hyperminhash, packing, ppm_langid, rindex_dedup
from curatrix.llm.common import Scratch, drop_scratch, scratch_mark, table

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
#: A repeated passage has at least so many words, and bytes: those of as many words of two letters.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 3 * PASSAGE_WORDS - 1
PASSAGE_ANCHOR = 48
#: Where the numbers begin that stand for rows without a key of their own; there are so many.
OWN_KEYS, OWN_KEY_COUNT = 1 << 62, 1 << 61
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
CAPACITY = 4096
#: Words in a generation of a packing worker's cache; the stages before leave it less memory than it has alone.
CACHE_WORDS = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it as lang.

    Rejected: null texts and texts without any letter. A tie goes to the first language in alphabetical order; rows that
    repeat, share an id or have none are told each on its own; where no row has a language, nothing is rejected.
    """
    model = ppm_langid.train(docs, "text", "lang", F.col("doc_id"))
    told = ppm_langid.identify(docs, model, keep=[c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")])
    kept = told.filter("lang_pred <> 'und'") if model else told
    return kept.select(*(F.col("lang_pred").alias("lang") if c == "lang" and model else F.col(c) for c in docs.columns if c in told.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that share an id, or have none, are documents of their own, as their texts are; of a group, such a row stays only
    if no row with an id of its own is in it, and then the one with the least digest. Of rows that repeat id and text, one
    stays. Null texts and texts without words are near nothing.
    """
    scratch = Scratch(spark, "pipeline")
    several = scratch.keep(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")), "several")
    n = several.count()
    marked = docs.withColumn("_several", F.lit(False))
    if n:
        several = several.withColumn("_hit", F.lit(True))
        marked = docs.join(F.broadcast(several) if n <= hyperminhash.BROADCAST_IDS else several, docs["doc_id"] == several["_id"], "left")
        marked = marked.withColumn("_several", F.col("_hit").isNotNull()).drop("_id", "_hit")
    own = F.lit(OWN_KEYS) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(OWN_KEY_COUNT))
    shared = F.col("doc_id").isNull() | F.col("_several")
    rows = marked.withColumn("_several", shared).withColumn("_row", F.when(shared, own).otherwise(F.col("doc_id")).cast("long"))
    found = hyperminhash.near_duplicates(rows.select("_row", "text"), SHINGLE_WORDS, SIMILARITY, key="_row")
    dropped = scratch.keep(found.filter("component_id <> _row").select("_row").distinct(), "dropped")
    few = dropped.count() <= hyperminhash.BROADCAST_IDS
    kept = rows.join(F.broadcast(dropped) if few else dropped, "_row", "left_anti")
    single, repeated = kept.filter("not _several"), kept.filter("_several").dropDuplicates(["_row"])
    return single.unionByName(repeated).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur again, in another document or the same one.

    All copies go, the first one too, and a document of which nothing is left goes. Words are what white space separates;
    in scripts without spaces, each ideograph or kana is one, and so are three Thai, Lao, Khmer, Myanmar or Tibetan letters
    (`rindex_dedup.count_words`). A passage of shorter words than two letters on average, under PASSAGE_BYTES, is not
    found. Rows that repeat, share an id or have none are documents each; a null text has no passages and goes.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars", "kept", "kept_text", "removed")]
    clashing = {c: f"_own_{c}" for c in ("kept", "kept_text", "removed") if c in docs.columns}
    named = docs.withColumnsRenamed(clashing)
    out = rindex_dedup.remove_repeats(named, PASSAGE_BYTES, keep=[*rest, *clashing.values()], whole=True, anchor=PASSAGE_ANCHOR, words=PASSAGE_WORDS)
    text = F.col("kept").cast("string")
    out = out.filter(F.octet_length("kept") > 0).withColumn("text", text).withColumn("n_chars", F.char_length(text).cast("long"))
    return out.select(*(F.col(clashing.get(c, c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most CAPACITY.

    A null or empty text is its end token alone; rows that repeat, share an id or have none are packed each on its own, in
    the order in which they are read.
    """
    out = packing.harmonic_pack(docs.select("doc_id", "text"), packing.vocabulary(TOKENIZER), END_ID, CAPACITY, cache_words=CACHE_WORDS)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's output is written and read again as the next one's input."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    before, mark = None, scratch_mark()
    for name, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir), name)
        # What the stage wrote on its way, and its input, are not read again.
        drop_scratch(spark, mark)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
