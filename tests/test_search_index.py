"""The stored inverted index against searches that read the records."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import search
from curatrix.operators.search_index import SearchIndex
from curatrix.store import Store

WORDS = ["running", "runs", "ran", "skill", "skills", "table", "tables", "Café", "cafe", "naïve", "été", "数据", "x1", "the", "the", "the", "relational", "ponies"]
RECORD = "id bigint, name string, summary string, description string, tags array<string>"


def records(spark, ids, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    return spark.createDataFrame([(i, text(3), text(6), text(40) if i % 7 else None, [text(1), text(2)]) for i in ids], RECORD)


def answers(found):
    return sorted(map(tuple, found.collect()))


QUERIES = [('run "CAFE"*', {}), ("数据", {}), ("the", {"field": "name"}), ("cafe", {"stemmed": False}), ("run nothing", {}), ("", {})]


def same(index, rows, whole=False):
    for query, how in QUERIES if whole else QUERIES[:1]:
        assert answers(index.search(query, **how)) == answers(search.search(rows, query, **how)), (query, how)
    assert answers(index.postings(stemmed=False)) == answers(search.postings(rows, stemmed=False))
    if whole:
        assert answers(index.postings()) == answers(search.postings(rows))
        assert answers(index.dictionary()) == answers(search.vocabulary(rows))


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex(Store(spark, str(tmp_path / "store")), "fts", file_postings=150)


def test_build_insert_update_delete(spark, index):
    first = records(spark, range(60), 1)
    index.build(first)
    same(index, first, whole=True)
    changed, fresh = records(spark, range(10, 20), 2), records(spark, range(100, 110), 3)
    index.change(changed.unionByName(fresh))
    now = first.filter("id < 10 OR id >= 20").unionByName(changed).unionByName(fresh)
    same(index, now)
    index.change(deleted=now.filter("id % 3 = 0").select("id"))
    now = now.filter("id % 3 <> 0")
    same(index, now)
    back = records(spark, [12, 15], 4)
    index.change(back, deleted=now.filter("id = 13").select("id"))
    now = now.filter("id NOT IN (12, 13, 15)").unionByName(back)
    same(index, now, whole=True)
    before = index.manifest()
    index.compact()
    assert len(index.manifest()["segments"]) == 1 and not index.manifest()["tombstones"] and len(before["segments"]) == 3
    same(index, now)


def test_reads_only_the_files_of_its_tokens(spark, index):
    rows = records(spark, range(200), 5)
    index.build(rows)
    (segment,) = index.manifest()["segments"]
    every = {r["file"] for r in spark.read.parquet(f"{segment['path']}/fences").collect()}
    ((_, read),) = index.files(sorted(index.tokens_of(["poni"])))
    assert len(every) >= 8 and len(read) <= 3
    name = lambda f: f.rsplit("/", 1)[1]
    assert set(map(name, index.search("ponies").inputFiles())) == set(map(name, read))
    # A token with very many postings fills several files, split by id.
    ((_, hot),) = index.files(["the"])
    assert len(hot) >= 2
    assert answers(index.search("the")) == answers(search.search(rows, "the"))


def test_no_python_above_an_explode(spark, index):
    """A search's plan tokenises nothing and stems nothing; that of an index makes stems for distinct tokens only."""
    index.build(records(spark, range(50), 6))
    plan = index.search("the skill")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ArrowEvalPython" not in plan
    scan = search.search(records(spark, range(50), 6), "the skill")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in scan and "Generate" not in scan


def test_empty_index_and_second_writer(spark, index):
    none = records(spark, [], 1)
    index.build(none)
    assert index.search("the").count() == 0 and index.dictionary().count() == 0
    index.change(records(spark, range(5), 1))
    same(index, records(spark, range(5), 1))
    number, manifest = index.store.state("fts")
    with pytest.raises(RuntimeError, match="another writer"):
        index.store.commit("fts", number, manifest)


def test_changes_compact_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("curatrix.operators.search_index.MOST_SEGMENTS", 2)
    index = SearchIndex(Store(spark, str(tmp_path / "s")), "fts")
    index.build(records(spark, range(3), 0))
    for i in range(2):
        index.change(records(spark, [i, i + 1], i))
    assert len(index.manifest()["segments"]) == 1
    now = records(spark, range(3), 0)
    for i in range(2):
        now = now.filter(~F.col("id").isin(i, i + 1)).unionByName(records(spark, [i, i + 1], i))
    assert answers(index.search("the")) == answers(search.search(now, "the"))


def test_postings_are_stored_in_blocks(spark, index):
    """what is shuffled and sorted is a row for many occurrences, none of them long."""
    from curatrix.operators import blocks

    rows = records(spark, range(200), 7)
    rows = rows.withColumn("description", F.when(F.col("id") == 3, F.repeat(F.lit("the Café "), 500)).otherwise(F.col("description"))).coalesce(1)
    index.build(rows)
    (segment,) = index.manifest()["segments"]
    stored = spark.read.parquet(f"{segment['path']}/postings")
    assert stored.agg(F.sum("n")).first()[0] == search.postings(rows, stemmed=False).count() > 3 * stored.count()
    assert stored.agg(F.max(F.size("pos"))).first()[0] == blocks.BLOCK
    assert answers(index.postings()) == answers(search.postings(rows)) and answers(index.search("cafe")) == answers(search.search(rows, "cafe"))


def test_chunks_hold_every_row(monkeypatch):
    import pyarrow as pa

    from curatrix.operators import blocks

    b = pa.RecordBatch.from_pydict({"id": list(range(9)), "t": ["a", "bb" * 40, None, "", "c", "d d", "e", "f" * 200, "g"]})
    for size in (1, 5, 50, 10**6):
        got = list(blocks._chunks(iter([b, b.slice(0, 0), b]), ["t"], size))
        assert [x for t in got for x in t["id"].to_pylist()] == [*range(9)] * 2 and (size < 10**6 or len(got) == 1)


def test_frequencies(spark, index):
    """sums over blocks, if each id has one row; counted by ids if not, or after changes."""
    rows = records(spark, range(40), 8)
    of = lambda r: search.postings(r).groupBy("field", "token").agg(F.count(F.lit(1)), F.count_distinct("id"))
    index.build(rows)
    assert answers(index.frequencies()) == answers(of(rows))
    plan = index.frequencies()._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "Join" not in plan and "Generate" not in plan
    index.change(records(spark, range(5, 9), 9))
    assert answers(index.frequencies()) == answers(of(rows.filter("id NOT BETWEEN 5 AND 8").unionByName(records(spark, range(5, 9), 9))))
    again = rows.unionByName(records(spark, [1, 2], 10)).unionByName(rows.limit(2).withColumn("id", F.lit(None).cast("bigint")))
    index.build(again)
    assert answers(index.frequencies()) == answers(of(again))


def test_page_moves_only_its_records(spark, index):
    """the records' texts are in no shuffle; the page is that of the whole join, with ids of several rows, too."""
    rows = records(spark, range(80), 11).unionByName(records(spark, range(5), 12)).withColumns({"is_active": F.col("id") % 7 != 0, "quality_score": F.col("id") % 3})
    index.build(rows)
    whole = rows.filter("is_active").join(search.search(rows, "the"), "id").orderBy(F.desc("hits"), F.desc("quality_score"), "id").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for page in (1, 2, 3, 9):
            got = search.search_page(rows, "the", page=page, size=10, index=index)
            key = lambda r: (r["hits"], r["quality_score"], r["id"])
            assert [key(r) for r in got.collect()] == [key(r) for r in whole[(page - 1) * 10 : page * 10]]
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
