"""Keyed merge of a batch into the catalog with inserted, unchanged, updated and rejected outcomes.

One shuffle on the key does both the sequential state inside the batch (a repeat is compared with what the record before
it left) and the comparison with the stored version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.functions.text import slugify
from curatrix.lineage import cut

#: Rows of one chunk of a batch, and what a run may fail of.
MAX_VARIABLES, COLUMNS, MAX_ERRORS = 900, 27, 20
#: A round that leaves more than this share of the records undecided is followed by one that also walks chains.
SLOW = 0.5


def insertions(edges: DataFrame, key: str) -> DataFrame:
    """(key, _at): the record with which each new key is inserted, by the order of positions.

    ``edges`` (key, slug, pos) has the first record of each new key for each slug. A record is inserted if its key was
    not yet and no earlier record of another key took its slug; so a key that was rejected may come in under a later
    name. That is the greedy matching of keys and slugs by position, found in rounds: a record that is the earliest left
    both for its key and for its slug comes in, whatever happens to others, and what shares its key or slug goes. Where
    records wait for each other in a chain, each for the one before it, a round settles the whole chain: a record with one
    earlier rival comes in if that one does not, so it follows the parity of its distance from the chain's first record,
    which is found by doubling, in as many steps as the logarithm of the chain. Rounds are left for records with two
    undecided earlier rivals; of random conflicts each round leaves a small share.

    One slug may have most of the records: aggregations combine before the shuffle and ranks are cut to two rows there.
    """
    first = lambda rows, by, other: rows.groupBy(by).agg(F.min(F.struct("pos", other)).alias("_m")).select(by, "_m.*")
    rest, came = cut(edges.select(key, "slug", "pos")), None
    left = rest.count()
    slow = False
    while left or came is None:
        taken = first(rest, key, "slug").join(first(rest, "slug", key), [key, "slug", "pos"])
        if slow:
            taken = taken.unionByName(_chains(rest, cut(taken), key))
        taken = cut(taken)
        came = taken if came is None else came.unionByName(taken)
        rest = cut(rest.join(taken.select(key), key, "left_anti").join(taken.select("slug"), "slug", "left_anti"))
        before, left = left, rest.count()
        slow = left > SLOW * before
    return came.select(key, F.col("pos").alias("_at"))


def _chains(rest: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """Records that come in because they are an even number of steps from a head, each step's record having one earlier rival."""
    me = F.struct("pos", key, "slug")
    ranked = lambda by: rest.select(by, me.alias("_e"), F.row_number().over(Window.partitionBy(by).orderBy(me)).alias("_n")).filter("_n <= 2")

    def earlier(by: str) -> DataFrame:
        """(_e, parent): the records that are first (no parent) or second for their ``by``."""
        each = ranked(by)
        head = each.filter("_n = 1").select(by, F.col("_e").alias("_p"))
        return each.join(head, by).select("_e", F.when(F.col("_n") == 2, F.col("_p")).alias("_p"))

    both = earlier(key).withColumnRenamed("_p", "_pk").join(earlier("slug").withColumnRenamed("_p", "_ps"), "_e")
    # One earlier rival in all; the other side has the record as its first.
    links = both.filter(F.col("_pk").isNull() != F.col("_ps").isNull()).select("_e", F.coalesce("_pk", "_ps").alias("_to"), F.lit(1).alias("_steps"))
    links = cut(links)
    while True:
        jumps = links.select(F.col("_e").alias("_to"), F.col("_to").alias("_next"), F.col("_steps").alias("_more"))
        if links.join(jumps, "_to", "left_semi").isEmpty():
            break
        links = links.join(jumps, "_to", "left").select("_e", F.coalesce("_next", "_to").alias("_to"), ((F.col("_steps") + F.coalesce("_more", F.lit(0))) % 2).alias("_steps"))
        links = cut(links)
    settled = links.join(heads.select(me.alias("_to")), "_to", "left_semi").filter("_steps = 0")
    return settled.select(f"_e.{key}", "_e.slug", "_e.pos")


def outcomes(batch: DataFrame, stored: DataFrame, key: str = "source_url", pos: str = "pos", slugs: DataFrame | None = None) -> DataFrame:
    """``batch`` (key, pos, name, content_hash, ...) with its outcome, by the batch's order.

    ``stored`` has at least the stored records of the batch's keys; ``slugs`` are those of all records, if it has not all.

    A record of a new key is rejected when its slug belongs to another key: a stored one, or one that came earlier in the
    batch. The key's next record tries again, with its own name.
    """
    held = stored.select(F.col(key), F.col("content_hash").alias("_stored"), F.col("slug").alias("_slug"))
    rows = batch.withColumn("_own_slug", slugify(F.col("name"))).join(held, key, "left")
    order = Window.partitionBy(key).orderBy(pos)
    rows = rows.withColumn("_before", F.coalesce(F.lag("content_hash").over(order), F.col("_stored")))
    fresh = F.col("_stored").isNull()
    edges = rows.filter(fresh).groupBy(key, F.col("_own_slug").alias("slug")).agg(F.min(pos).alias("pos"))
    edges = edges.join((stored if slugs is None else slugs).select("slug"), "slug", "left_anti")
    rows = rows.join(insertions(edges, key), key, "left")
    rejected = fresh & F.coalesce(F.col(pos) < F.col("_at"), F.lit(True))
    inserted = fresh & (F.col(pos) == F.col("_at"))
    outcome = F.when(rejected, "rejected").when(inserted, "inserted").when(F.col("_before") == F.col("content_hash"), "unchanged").otherwise("updated")
    # A record has the slug that it was refused, or that its key was inserted with.
    own = F.max(F.when(inserted, F.col("_own_slug"))).over(Window.partitionBy(key))
    slug = F.coalesce("_slug", F.when(rejected, F.col("_own_slug")).otherwise(own))
    return rows.withColumn("outcome", outcome).withColumn("slug", slug).drop("_own_slug", "_stored", "_slug", "_before", "_at")


def snapshot(batch: DataFrame, stored: DataFrame, now: str, content: list[str], key: str = "source_url", pos: str = "pos") -> DataFrame:
    """The next version of the catalog: the columns of ``stored``.

    Seen records are active again. Only changed ones take the batch's content columns and go back to the queue for
    enrichment; slug and first_seen_at never change.
    """
    return applied(outcomes(batch, stored, key, pos), stored, now, content, key, pos)


def applied(done: DataFrame, stored: DataFrame, now: str, content: list[str], key: str = "source_url", pos: str = "pos") -> DataFrame:
    """The next version from a batch with its outcomes."""
    done = done.filter("outcome <> 'rejected'")
    changed = F.col("outcome") != "unchanged"
    take = F.struct(*content, "slug")
    last = done.groupBy(key).agg(F.max_by(F.when(changed, take), F.when(changed, F.col(pos))).alias("_new"), F.max(changed).alias("_changed"))
    joined = stored.withColumn("_held", F.lit(True)).join(last, key, "full_outer")
    seen, fresh = F.col("_changed").isNotNull(), F.col("_held").isNull()
    new = F.coalesce(F.col("_changed"), F.lit(False))
    ts = F.lit(now).cast("timestamp")
    values = {c: F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in content}
    values |= {
        "slug": F.when(fresh, F.col("_new.slug")).otherwise(F.col("slug")),
        "first_seen_at": F.when(fresh, ts).otherwise(F.col("first_seen_at")),
        "last_seen_at": F.when(seen, ts).otherwise(F.col("last_seen_at")),
        "enriched_at": F.when(~new, F.col("enriched_at")),
        "quality_score": F.when(new, F.lit(0)).otherwise(F.col("quality_score")),
        "categories": F.when(new, F.array().cast("array<string>")).otherwise(F.col("categories")),
        "is_active": F.when(seen, True).otherwise(F.col("is_active")),
        "inactive_reason": F.when(~seen, F.col("inactive_reason")),
    }
    return joined.select(*(values.get(c, F.col(c)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns))


def chunk_ids(rows: DataFrame, index: str, columns: int = COLUMNS, budget: int = MAX_VARIABLES) -> DataFrame:
    """``rows`` with the chunk that each belongs to under a budget of bound variables."""
    if columns <= 0 or columns > budget:
        raise ValueError(f"{columns} columns do not fit a budget of {budget}")
    return rows.withColumn("chunk", F.floor(F.col(index) / (budget // columns)).cast("long"))


def report(done: DataFrame, *by: str) -> DataFrame:
    """Counts of each outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return done.groupBy(*by).agg(F.count(F.lit(1)).alias("discovered"), *(count(o) for o in ("inserted", "updated", "unchanged", "rejected")))


def run_status(attempted, accepted, failed_chunks, threshold: int = 0):
    """ok, partial or failed: nothing attempted is no failure, nothing accepted is one."""
    failed = F.when(attempted == 0, False).when(accepted == 0, True).otherwise(failed_chunks > threshold)
    return F.when(failed, "failed").when(accepted < attempted, "partial").otherwise("ok")


def merge_outcomes(chunks: DataFrame, *by: str, order: str = "chunk") -> DataFrame:
    """Sums of chunk outcomes, and the first errors of all chunks in their order."""
    errors = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "errors"))), lambda x: x["errors"]))
    return chunks.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("attempted", "accepted", "rejected", "failed_chunks")), F.slice(errors, 1, MAX_ERRORS).alias("errors"))


def exclude(batch: DataFrame, removed: DataFrame, key: str = "source_url") -> DataFrame:
    """Records that are not on the removal list."""
    return batch.join(removed.select(key), key, "left_anti")


def fork_dedup(rows: DataFrame, hash: str, *order) -> DataFrame:
    """The first record of each content in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(hash).orderBy(*order))).filter("_n = 1").drop("_n")


def retired(rows: DataFrame, removed: DataFrame, hash: str, *order, key: str = "source_url") -> DataFrame:
    """(key, reason): records on the removal list, and all but the preferred one of each content."""
    gone = rows.join(removed.select(key), key, "left_semi").select(key, F.lit("removal_requested").alias("reason"))
    left = exclude(rows, removed, key)
    lost = left.join(fork_dedup(left, hash, *order).select(key), key, "left_anti").select(key, F.lit("superseded").alias("reason"))
    return gone.unionByName(lost)
