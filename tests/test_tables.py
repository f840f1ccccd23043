"""Bucketed merges, day logs and their commits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curatrix.buckets import BucketedTable
from curatrix.daylog import DayLog
from curatrix.operators import upsert
from curatrix.store import Store
from curatrix.streaming import pulse
from tests.test_operators import CONTENT, NOW, STORED, batch, made

KEYS = ["source_url", "content_hash", "slug", "is_active"]


def plain(df):
    return sorted(map(tuple, df.select(*KEYS).collect()))


def files(table):
    return {b: tuple(p) for b, p in table.manifest()["folders"].items()}


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(Store(spark, str(tmp_path / "store")), "artifacts", buckets=16)
    t.create(upsert.snapshot(batch(spark, made(40)), spark.createDataFrame([], STORED), NOW, CONTENT))
    return t


def test_merge_rewrites_only_touched_buckets(spark, table):
    stored, before = spark.createDataFrame(table.read().collect(), STORED), files(table)
    old = table.manifest()
    change = batch(spark, made(3, "x"))
    touched = table.merge(change, NOW, CONTENT)
    after = files(table)
    assert 1 <= len(touched) <= 3 and {int(b) for b in after if after[b] != before[b]} == set(touched)
    assert plain(table.read()) == plain(upsert.snapshot(change, stored, NOW, CONTENT))
    assert plain(table.read(manifest=old)) == plain(stored)  # a reader that began before
    assert table.vacuum() >= len(touched)
    assert plain(table.read()) == plain(upsert.snapshot(change, stored, NOW, CONTENT))


def test_slugs_of_untouched_buckets_count(spark, table):
    taken = table.read().select("slug", "name").first()
    table.merge(batch(spark, [("elsewhere", taken["name"], "h")]), NOW, CONTENT)
    assert table.read().filter("source_url = 'elsewhere'").count() == 0


def evidence(done):
    return upsert.report(done)


@pytest.mark.parametrize("step", ["data", "evidence", "commit"])
def test_a_failed_batch_is_committed_once(spark, tmp_path, table, step):
    batch(spark, made(5, "x")).coalesce(1).write.json(str(tmp_path / "in" / "b0"))
    fails = [step]

    def between(at):
        if fails and at == fails[0]:
            fails.pop()
            raise OSError(f"lost after {at}")

    run = lambda: pulse.ingest_stream(pulse.read_batches(spark, str(tmp_path / "in" / "*"), batch(spark, made(1)).schema), table, lambda n: NOW, CONTENT, evidence, str(tmp_path / "cp"), between=between)
    version = table.store.version("artifacts")
    with pytest.raises(Exception, match="lost after"):
        run().awaitTermination()
    run().awaitTermination()
    assert table.store.version("artifacts") == version + 1
    assert [(r["discovered"], r["updated"]) for r in table.runs().collect()] == [(5, 2)]
    run().awaitTermination()
    assert table.store.version("artifacts") == version + 1 and table.runs().count() == 1


CHECKS = "id bigint, artifact_id bigint, checked_at timestamp, http_status int"


def test_old_days_go(spark, tmp_path):
    log = DayLog(Store(spark, str(tmp_path / "store")), "checks")
    now = dt.datetime(2026, 8, 15, 12)
    edge = now - dt.timedelta(days=90)
    times = [edge - dt.timedelta(days=40), edge - dt.timedelta(days=1), edge - dt.timedelta(microseconds=1), edge, edge + dt.timedelta(hours=1), now, None]
    log.append(spark.createDataFrame([(i, 1, t, 200) for i, t in enumerate(times)], CHECKS))
    log.append(spark.createDataFrame([(10, 1, now, 404)], CHECKS))
    ids = lambda rows: sorted(r["id"] for r in rows.collect())
    before, reader = log.manifest(), log.read()
    done = log.trim(now.isoformat(sep=" "), clock=1000.0)
    assert (done["deleted"], len(done["dropped"]), done["rewritten"]) == (3, 2, edge.date().isoformat())
    assert ids(log.read()) == [3, 4, 5, 6, 10]
    assert log.vacuum(clock=1500.0, grace=3600) == 0 and ids(reader) == [0, 1, 2, 3, 4, 5, 6, 10]
    assert log.vacuum(clock=5000.0, grace=3600) == 3
    gone = [f for d in done["dropped"] for f in before["days"][d]]
    assert all(not log.store.names(f) for f in gone) and ids(log.read()) == [3, 4, 5, 6, 10]
    assert log.trim(now.isoformat(sep=" ")) == {"dropped": [], "rewritten": None, "deleted": 0}
    assert ids(log.read(since=now.date().isoformat())) == [5, 6, 10]


def test_rollup_is_the_same_whenever_it_runs(spark, tmp_path):
    rows = [(i, i % 3, dt.datetime(2026, 1 + i % 5, 1 + i % 28), 200 if i % 4 else 404) for i in range(200)]
    frame = lambda part: spark.createDataFrame(part, CHECKS).withColumn("failed", (F.col("http_status") != 200).cast("long"))
    want = {}
    for _, a, t, code in rows:
        if t.month <= 3:
            n, f = want.get((f"2026-{t.month:02d}", a), (0, 0))
            want[f"2026-{t.month:02d}", a] = (n + 1, f + (code != 200))
    for parts, runs in (([rows], [1]), ([rows[:120], rows[120:]], [2, 1])):
        log = DayLog(Store(spark, str(tmp_path / f"s{len(parts)}")), "runs")
        for part, k in zip(parts, runs, strict=True):  # the second part is late: its months were rolled up before
            log.append(frame(part))
            for _ in range(k):
                log.rollup("2026-06-15 00:00:00", 60, ["artifact_id"], ["failed"])
        got = {(r["month"], r["artifact_id"]): (r["n"], r["failed"]) for r in log.months().collect()}
        assert got == want
        assert log.read().agg(F.min(F.month("checked_at"))).first()[0] == 4
        assert log.read().count() + sum(n for n, _ in got.values()) == 200
