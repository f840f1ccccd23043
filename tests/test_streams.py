"""The cursor source and the reason machine over streams."""

import datetime as dt
import json
import random

import pytest

from curatrix.operators import checks
from curatrix.sources import cursor_stream
from curatrix.streaming import pulse


def recorded(folder, pages):
    """Answers by cursor: (cursor, items, next cursor)."""
    folder.mkdir(exist_ok=True)
    for cursor, items, following in pages:
        answer = {"servers": [{"name": n} for n in items]} | ({"nextCursor": following} if following else {})
        name = cursor.replace("/", "%2F") if cursor else "page-1"
        (folder / f"{name}.json").write_text(json.dumps(answer))


PAGES = [("", ["a", "b"], "c/1"), ("c/1", ["c"], "c2"), ("c2", ["d", "e", "f"], "c3"), ("c3", ["g"], None)]


def run(spark, folder, out, checkpoint, **options):
    cursor_stream.register(spark)
    stream = spark.readStream.format("recorded_cursors").options(path=str(folder), **options).load()
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.schema(cursor_stream.SCHEMA).parquet(str(out)).collect()
    return sorted(json.loads(r["item"])["name"] for r in rows if r["item"]), [r["warning"] for r in rows if r["warning"]]


def test_each_item_once_over_restarts(spark, tmp_path):
    places = (tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    recorded(places[0], PAGES[:3])
    got, warnings = run(spark, *places, pages=1)
    assert got == ["a", "b", "c", "d", "e", "f"] and warnings == ["FileNotFoundError: c3.json"]
    recorded(places[0], PAGES[3:])
    got, warnings = run(spark, *places, pages=1)
    assert got == ["a", "b", "c", "d", "e", "f", "g"] and len(warnings) == 1
    got, _ = run(spark, *places, pages=2)
    assert got == ["a", "b", "c", "d", "e", "f", "g"]


def test_limit_is_a_runs_ceiling(spark, tmp_path):
    places = (tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    recorded(places[0], PAGES)
    seen = [run(spark, *places, limit=2, pages=3)[0] for _ in range(4)]
    assert seen == [list("ab"), list("abcd"), list("abcdef"), list("abcdefg")]


def test_a_bad_answer_is_asked_for_again(spark, tmp_path):
    places = (tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    recorded(places[0], PAGES[:2])
    (places[0] / "c2.json").write_text("{ no json")
    got, warnings = run(spark, *places)
    assert got == ["a", "b", "c"] and warnings == ["JSONDecodeError: c2.json"]
    recorded(places[0], PAGES[2:])
    got, warnings = run(spark, *places)
    assert got == list("abcdefg") and len(warnings) == 1


def test_pages_by_number_end(tmp_path):
    for i in range(1, 15):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"items": [i]}))
    reader = cursor_stream.CursorReader({"path": str(tmp_path), "pages": 100})
    end = reader.latestOffset()
    assert end["end"] and [p.page for p in reader.partitions(reader.initialOffset(), end)] == list(range(1, 11))
    assert [x[3] for p in reader.partitions(reader.initialOffset(), end) for x in reader.read(p)] == [str(i) for i in range(1, 11)]
    assert reader.latestOffset() == end


@pytest.mark.parametrize("room", [1, 2, 3, 4, 7])
def test_offsets_are_replayed_exactly(tmp_path, room):
    recorded(tmp_path / "in", PAGES)
    options = {"path": str(tmp_path / "in"), "limit": room, "pages": 2}
    at, got = None, []
    for _ in range(30):
        reader = cursor_stream.CursorReader(options)
        start = at or reader.initialOffset()
        reader.here = start
        end = reader.latestOffset()
        replay = cursor_stream.CursorReader(options).partitions(start, end)
        got += [json.loads(x[3])["name"] for p in replay for x in reader.read(p) if x[3]]
        at = end
    assert got == list("abcdefg")


CHECKS = "id bigint, artifact_id bigint, checked_at timestamp, http_status int"


@pytest.mark.parametrize("order", ["in order", "reordered"])
def test_reason_machine_equals_batch(spark, tmp_path, order):
    """Four micro-batches, with repeats; in one case late ones first."""
    r = random.Random(4)
    start = dt.datetime(2026, 1, 1)
    rows = [(i, r.randint(1, 12), start + dt.timedelta(hours=r.randint(0, 24 * 40)), r.choice([200, 200, 500, 503, None, 500, 404 if i % 9 == 0 else 429])) for i in range(300)]
    rows = sorted(rows, key=lambda x: x[2], reverse=order == "reordered")
    parts = [rows[:90] + rows[5:15], rows[90:180] + rows[80:100], rows[180:], rows[10:60]]
    found = {}
    stream = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    keep = lambda batch, n: found.update({x["artifact_id"]: x for x in batch.collect()})
    for i, part in enumerate(parts):
        spark.createDataFrame(part, CHECKS).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
        q = pulse.reason_states(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    every = spark.createDataFrame(rows, CHECKS)
    now = "2026-02-20 00:00:00"
    seen = spark.createDataFrame([(i, start - dt.timedelta(days=200 * (i % 3 == 0))) for i in range(1, 15)], "artifact_id bigint, last_seen_at timestamp")
    got = pulse.reasons_of(spark.createDataFrame(list(found.values()), pulse.MACHINE), seen, now)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, checks.inactive_reasons(every, seen, now).collect()))
    assert {r["reason"] for r in got.collect()} >= {"gone", "unreachable"}


def test_a_late_batch_does_not_end_a_state_earlier(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    day = lambda n: t + dt.timedelta(days=n)
    batches = [[(1, 1, day(50), 500)], [(2, 1, day(1), 500), (3, 2, day(50), 500)], [(4, 2, day(100), 500)], [(5, 1, day(101), 500)]]
    stream = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHECKS).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
        q = pulse.failure_counters(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    got = {(r["artifact_id"], r["checked_at"]): r["run"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, day(101)] == 3
