"""Full-text search over postings (field, token, id, pos), stemmed unless told otherwise.

Tokens are lower-case runs of letters and digits without the marks of Latin letters. A stored index (`search_index`) is
what searches read; here are its parts, and a search of records that have no index. Stems are made once for each distinct
token: distinct tokens are checkpointed with their stems, so that no plan above them makes the stems again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.stem import porter_stem
from curatrix.functions.text import spaced_tokens, tokens
from curatrix.lineage import cut

#: The searched columns of a record.
FIELDS = ["name", "summary", "description", "tags"]
PAGE_SIZE = 24
#: Distinct tokens with their stems that may be broadcast; more are joined by a shuffle.
BROADCAST_TOKENS = 1_000_000


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """Porter stems of tokens."""
    return words.map(lambda w: porter_stem(w) if w is not None else None)


def stems(words: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct tokens with their stems, dealt over all cores: they are few bytes, and adaptive execution would take one task."""
    return words.repartition(parts or words.sparkSession.sparkContext.defaultParallelism).withColumn("stem", stem("token"))


def _words(field: Column, kind: T.DataType) -> Column:
    return tokens(F.concat_ws(" ", field) if isinstance(kind, T.ArrayType) else field)


def _lists(rows: DataFrame, fields: list[str], id: str) -> DataFrame:
    """(id, field, words): each field's tokens in order."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), _words(F.col(f), rows.schema[f].dataType).alias("words")) for f in fields)))
    return rows.select(id, each.alias("f")).select(id, "f.field", "f.words")


def words(rows: DataFrame, fields: list[str] | None = None, id: str = "id") -> DataFrame:
    """The id, and under each field's name its tokens in order as a text, single spaces between them."""
    text = lambda f: F.concat_ws(" ", f) if isinstance(rows.schema[f].dataType, T.ArrayType) else F.col(f)
    return rows.select(id, *(spaced_tokens(text(f)).alias(f) for f in fields or FIELDS))


def occurrences(rows: DataFrame, fields: list[str] | None = None, id: str = "id") -> DataFrame:
    """(token, field, id, pos): one row per token occurrence, positions from 0 in each field; no stems, no shuffle."""
    return _lists(rows, fields or FIELDS, id).select("field", id, F.posexplode("words").alias("pos", "token")).select("token", "field", id, "pos")


def vocabulary(rows: DataFrame, fields: list[str] | None = None, id: str = "id") -> DataFrame:
    """(token, stem) of every distinct token; within a record each comes once before the shuffle."""
    own = _lists(rows, fields or FIELDS, id).select(F.explode(F.array_distinct("words")).alias("token")).distinct()
    return stems(own)


def _known(found: DataFrame) -> DataFrame:
    """Distinct tokens with stems, made once; broadcast if their number allows."""
    known = cut(found)
    return F.broadcast(known) if known.count() <= BROADCAST_TOKENS else known


def postings(rows: DataFrame, fields: list[str] | None = None, id: str = "id", stemmed: bool = True) -> DataFrame:
    """One row per token occurrence of records without an index, positions from 0 in each field."""
    found = occurrences(rows, fields, id)
    if stemmed:
        found = found.join(_known(vocabulary(rows, fields, id)), "token").withColumn("token", F.col("stem"))
    return found.select("field", "token", id, "pos")


def query_terms(spark: SparkSession, query: str, stemmed: bool = True) -> list[str]:
    """Distinct terms of a query, tokenised like the text; quotes and stars are no operators."""
    row = spark.range(1).select(tokens(F.lit(query)).alias("w")).first()
    return sorted({porter_stem(w) if stemmed else w for w in row["w"]})


def _all_terms(hits: DataFrame, terms: list[str], id: str) -> DataFrame:
    return hits.groupBy(id).agg(F.count_distinct("token").alias("n"), F.count(F.lit(1)).alias("hits")).filter(F.col("n") == len(terms)).select(id, "hits")


def prefix(stemmed: str) -> str:
    """What every word with this stem begins with: the rules rewrite no more than a stem's last letter."""
    return stemmed[: max(1, min(3, len(stemmed) - 1))]


def match(found: DataFrame, terms: list[str], field: str | None = None, id: str = "id") -> DataFrame:
    """Ids of postings that have every term, in any field or in one."""
    hit = found.filter(F.col("token").isin(terms))
    return _all_terms(hit.filter(F.col("field") == field) if field else hit, terms, id)


def search(rows: DataFrame, query: str, fields: list[str] | None = None, field: str | None = None, id: str = "id", stemmed: bool = True) -> DataFrame:
    """(id, hits) of records that have every term of ``query``, without postings of anything else."""
    terms = query_terms(rows.sparkSession, query, stemmed)
    fields = [field] if field else fields or FIELDS
    if not terms:
        return rows.select(id, F.lit(0).cast("long").alias("hits")).limit(0)
    lists = _lists(rows, fields, id)
    if not stemmed:
        wanted = F.filter("words", lambda w: w.isin(terms))
        return _all_terms(lists.select(id, F.explode(wanted).alias("token")), terms, id)
    begins = sorted({prefix(t) for t in terms})
    like = lists.select(id, F.explode(F.filter("words", lambda w: reduce(or_, (w.startswith(p) for p in begins)))).alias("word"))
    # One tokenising pass: what is left of it, a row per record and word, is small and kept.
    like = cut(like.groupBy(id, "word").agg(F.count(F.lit(1)).alias("n")))
    known = _known(stems(like.select(F.col("word").alias("token")).distinct()).select(F.col("token").alias("word"), F.col("stem").alias("token")))
    found = like.join(known.filter(F.col("token").isin(terms)), "word")
    return found.groupBy(id).agg(F.count_distinct("token").alias("_terms"), F.sum("n").alias("hits")).filter(F.col("_terms") == len(terms)).select(id, "hits")


def search_page(rows: DataFrame, query: str, page: int = 1, size: int = PAGE_SIZE, id: str = "id", score: str = "quality_score", index=None, **how) -> DataFrame:
    """A page of active records that match, most hits first, then by score and id; hits beside the records' columns.

    ``index``: a `SearchIndex` of the records, without which they are read for the search.
    """
    live = rows.filter("is_active")
    found = index.search(query, **how) if index else search(live, query, id=id, **how)
    order, last = [F.desc("hits"), F.desc(score), F.col(id)], max(page, 1) * size
    # First which ids come up to the page's end, without the other columns; then only their records.
    first = live.select(id, score).join(found, id).orderBy(*order).limit(last).select(id, "hits").distinct()
    found = live.join(F.broadcast(first) if last <= BROADCAST_TOKENS else first, id)
    return found.orderBy(*order).offset(last - size).limit(size)


def refresh(old: DataFrame, changed: DataFrame, fields: list[str] | None = None, id: str = "id", stemmed: bool = True) -> DataFrame:
    """Postings after records changed: theirs are replaced, all others stay."""
    return old.join(changed.select(id), id, "left_anti").select(*old.columns).unionByName(postings(changed, fields, id, stemmed))
