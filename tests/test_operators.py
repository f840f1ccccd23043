"""Operators: merge, schedule, decay, search, store, streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import browse, checks, search, upsert
from curatrix.schemas import violations
from curatrix.sources import adapter, feeds, harvest
from curatrix.store import Store, holder_id
from curatrix.streaming import pulse

NOW = "2026-08-15 00:00:00"
STORED = "source_url string, slug string, name string, content_hash string, first_seen_at timestamp, last_seen_at timestamp, enriched_at timestamp, quality_score int, categories array<string>, is_active boolean, inactive_reason string"
BATCH = "pos int, source_url string, name string, content_hash string"
CONTENT = ["name", "content_hash"]


def batch(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], BATCH)


def made(n, change=""):
    return [(f"u{i}", f"test-skill-{i}", f"h{i}{change if i < n // 2 else ''}") for i in range(n)]


def test_post_repost_change(spark):
    state = spark.createDataFrame([], STORED)
    tally = lambda b: {r["outcome"]: r["n"] for r in upsert.outcomes(b, state).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    first = batch(spark, made(20))
    assert tally(first) == {"inserted": 20}
    state = spark.createDataFrame(upsert.snapshot(first, state, NOW, CONTENT).collect(), STORED)
    assert tally(first) == {"unchanged": 20}
    again = upsert.snapshot(first, state, NOW, CONTENT)
    assert sorted(again.collect()) == sorted(state.collect())
    changed = batch(spark, made(20, "x"))
    assert tally(changed) == {"updated": 10, "unchanged": 10}
    after = {r["source_url"]: r for r in upsert.snapshot(changed, state.withColumn("enriched_at", F.lit(NOW).cast("timestamp")), "2026-08-16 00:00:00", CONTENT).collect()}
    assert after["u0"]["enriched_at"] is None and after["u19"]["enriched_at"] is not None
    assert after["u0"]["first_seen_at"] == dt.datetime(2026, 8, 15) and after["u19"]["last_seen_at"] == dt.datetime(2026, 8, 16)


def test_repeats_and_collisions_in_a_batch(spark):
    b = batch(spark, [("a", "One", "1"), ("a", "One", "1"), ("a", "One", "2"), ("b", "one!", "3"), ("b", "one!", "4"), ("c", "Two", "5")])
    got = [r["outcome"] for r in upsert.outcomes(b, spark.createDataFrame([], STORED)).orderBy("pos").collect()]
    assert got == ["inserted", "unchanged", "updated", "rejected", "rejected", "inserted"]


def test_reactivation_keeps_slug(spark):
    old = spark.createDataFrame([("a", "kept", "x", "1", None, None, None, 7, ["skill"], False, "gone"), ("z", "zz", "z", "9", None, None, None, 1, [], False, "gone")], STORED)
    rows = {r["source_url"]: r for r in upsert.snapshot(batch(spark, [("a", "renamed", "1")]), old, NOW, CONTENT).collect()}
    assert rows["a"]["is_active"] and rows["a"]["inactive_reason"] is None and rows["a"]["slug"] == "kept" and rows["a"]["name"] == "x"
    assert not rows["z"]["is_active"] and rows["z"]["inactive_reason"] == "gone"


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (33, 1), (34, 2), (100, 4), (500, 16), (1000, 31)])
def test_chunks(spark, n, chunks):
    assert upsert.chunk_ids(spark.range(n), "id").select("chunk").distinct().count() == chunks


def test_chunk_budget(spark):
    for columns in (0, 1000):
        with pytest.raises(ValueError):
            upsert.chunk_ids(spark.range(1), "id", columns)


def test_merge_and_status(spark):
    rows = [(1, 2, 0, 2, 1, [f"e{i}" for i in range(15)]), (0, 3, 3, 0, 0, [f"d{i}" for i in range(15)])]
    c = spark.createDataFrame(rows, "chunk int, attempted int, accepted int, rejected int, failed_chunks int, errors array<string>")
    m = upsert.merge_outcomes(c).first()
    assert (m["attempted"], m["accepted"], m["rejected"], m["failed_chunks"], len(m["errors"]), m["errors"][0]) == (5, 3, 2, 1, 20, "d0")
    s = spark.createDataFrame([(0, 0, 0), (5, 0, 0), (5, 5, 1), (5, 4, 0), (5, 5, 0)], "a int, b int, c int")
    assert [r[0] for r in s.select(upsert.run_status(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["ok", "failed", "failed", "partial", "ok"]


def test_due_sources(spark):
    t = lambda h: dt.datetime(2026, 8, 15) - dt.timedelta(hours=h)
    rows = [(1, True, 6, None), (2, True, 6, t(5)), (3, True, 6, t(6)), (4, False, 6, None), (5, True, 24, t(30))]
    s = spark.createDataFrame(rows, "id bigint, enabled boolean, cadence_hours int, last_run_at timestamp")
    assert [r["id"] for r in browse.due_sources(s, NOW).collect()] == [1, 5, 3]
    assert [r["id"] for r in browse.due_sources(s, NOW, 1).collect()] == [1]
    stamped = browse.stamp(s, browse.due_sources(s, NOW), NOW)
    assert browse.due_sources(stamped, NOW).count() == 0


def test_pages(spark):
    rows = spark.range(60).select("id", F.lit("skill").alias("kind"), (F.col("id") % 3).alias("quality_score"), F.lit(True).alias("is_active"))
    pages = [[r["id"] for r in browse.page(rows, "skill", p).collect()] for p in (0, 1, 2, 3, 4)]
    assert pages[0] == pages[1] and [len(p) for p in pages[1:]] == [24, 24, 12, 0] and len({i for p in pages[1:] for i in p}) == 60
    m = browse.page_meta(rows, 3).first()
    assert (m["total"], m["pages"], m["has_next"], m["has_prev"]) == (60, 3, False, True)


CHECKS = "id bigint, artifact_id bigint, checked_at timestamp, http_status int"


def observed(spark, histories):
    rows, n = [], 0
    for a, codes in histories.items():
        for day, c in enumerate(codes):
            n += 1
            rows.append((n, a, dt.datetime(2026, 8, 1) + dt.timedelta(days=day), c))
    return spark.createDataFrame(rows, CHECKS)


def test_inactive_reasons(spark):
    c = observed(spark, {1: [404, 200], 2: [200, 500, 500, 500], 3: [500, 500, 200, 500], 4: [200]})
    seen = spark.createDataFrame([(i, dt.datetime(2026, 8, 10)) for i in (1, 2, 3)] + [(4, dt.datetime(2025, 1, 1)), (5, None)], "artifact_id bigint, last_seen_at timestamp")
    got = {r["artifact_id"]: r["reason"] for r in checks.inactive_reasons(c, seen, NOW).collect()}
    assert got == {1: "gone", 2: "unreachable", 3: None, 4: "stale", 5: None}
    histogram = {r["reason"]: r["n"] for r in checks.by_reason(checks.inactive_reasons(c, seen, NOW)).collect()}
    assert histogram == {"gone": 1, "unreachable": 1, "stale": 1}


def test_same_day_failures_count_once(spark):
    t = dt.datetime(2026, 8, 1)
    c = spark.createDataFrame([(i, 1, t + dt.timedelta(hours=i), 500) for i in range(5)], CHECKS)
    assert checks.trailing_runs(c).first()["run"] == 1


@pytest.mark.parametrize(("found", "live", "blocked"), [(10, 100, False), (11, 100, True), (104, 1000, True), (0, 0, False), (1, 0, False)])
def test_safety_ratio(spark, found, live, blocked):
    assert checks.safety_ratio(spark.range(found), spark.range(live)).first()["blocked"] is blocked


def test_rounded_ratio_and_dry_run(spark):
    assert checks.safety_ratio(spark.range(104), spark.range(1000), rounded=True).first()["blocked"] is False
    r = spark.createDataFrame([(1, "gone"), (2, None)], "artifact_id int, reason string")
    assert [x["deactivate"] for x in checks.decisions(r, spark.range(100), dry_run=False).collect()] == [True]
    assert [x["deactivate"] for x in checks.decisions(r, spark.range(9), dry_run=False).collect()] == [False]
    assert [x["deactivate"] for x in checks.decisions(r, spark.range(100)).collect()] == [False]


def test_trim(spark):
    t = dt.datetime(2026, 8, 15) - dt.timedelta(days=90)
    c = spark.createDataFrame([(1, 1, t, 200), (2, 1, t - dt.timedelta(microseconds=1), 200), (3, 1, None, 200)], CHECKS)
    kept, gone = checks.trim(c, NOW)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3] and [r["id"] for r in gone.collect()] == [2]


def test_recount_fixes_corruption(spark):
    rows = spark.createDataFrame([(["a", "a"], True), (["a", "b"], True), (["b"], False)], "categories array<string>, is_active boolean")
    cats = spark.createDataFrame([("a", 9), ("b", 1), ("c", 0)], "slug string, artifact_count int")
    out = browse.recount(cats, rows)
    assert {r["slug"]: r["recount"] for r in out.collect()} == {"a": 2, "b": 1, "c": 0}
    assert browse.drift(out).first()[0] == 1


def test_search(spark):
    rows = spark.createDataFrame([(1, "Skill réunion", "running tests", None, ["Ő"], True, 1), (2, "other", "another skill runs", "Āā šş", [], True, 2), (3, "skill", "x", "", None, False, 3)],
        "id bigint, name string, summary string, description string, tags array<string>, is_active boolean, quality_score int")
    found = search.postings(rows, stemmed=False)
    ids = lambda q, **k: sorted(r["id"] for r in search.match(found, search.query_terms(spark, q, stemmed=False), **k).collect())
    for plain in (False, True):
        got = lambda q, **k: sorted(r["id"] for r in search.search(rows, q, stemmed=not plain, **k).collect())
        assert got("skill") == [1, 2, 3] and got("skill", field="name") == [1, 3] and got('"another"* skill') == [2] and got("REUNION") == [1]
        assert got("aa") == [2] and got("ss") == [2] and got("o") == [1] and got("nowhere") == got(" ,") == []
    assert ids("skill") == [1, 2, 3] and ids("skill", field="name") == [1, 3]
    stems = lambda q: sorted(r["id"] for r in search.search(rows, q).collect())
    assert stems("run") == stems("running") == [1, 2] and stems("test") == [1] and stems("running skills") == [1, 2]
    stemmed = search.postings(rows)
    assert sorted(r["id"] for r in search.match(stemmed, search.query_terms(spark, "run")).collect()) == [1, 2]
    page = search.search_page(rows, "skills").collect()
    assert [(r["id"], r["hits"]) for r in page] == [(2, 1), (1, 1)] and search.search_page(rows, "skill", page=2).count() == 0
    changed = spark.createDataFrame([(2, "fresh", "text", None, [], True, 1)], rows.schema)
    found = search.refresh(found, changed, stemmed=False)
    assert ids("skill") == [1, 3] and ids("fresh") == [2]
    gone = rows.filter("id <> 2")  # a deleted record is not found
    assert search.search(gone, "another").count() == 0


def test_words_begin_like_their_stems():
    import random

    from curatrix.functions.stem import STEP2, STEP3, STEP4, porter_stem

    r = random.Random(1)
    ends = [*(e for e, _ in STEP2 + STEP3), *STEP4, "s", "ed", "ing", "eed", "ies", "sses", "y", "e", "ll", ""]
    for _ in range(30_000):
        w = "".join(r.choice("abeiouylstz") for _ in range(r.randint(1, 4))) + r.choice(ends) + r.choice(ends)
        assert w.startswith(search.prefix(porter_stem(w))), w


def test_store_and_lock(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.version("t") == 0
    assert s.write("t", spark.range(3)) == 1
    assert s.write("t", s.read("t").filter("id > 0")) == 2
    assert s.read("t").count() == 2 and s.read("t", 1).count() == 3
    assert s.acquire("l", holder_id("a"), 100.0, 10) and not s.acquire("l", "b@1", 109.0, 10) and s.acquire("l", "b@1", 110.0, 10)
    assert not s.release("l", holder_id("a")) and s.release("l", "b@1") and s.acquire("l", "c@1", 111.0)
    assert not s.release("l", "b@1") and not s.release("none", "b@1")
    s.append("log", spark.range(2))
    s.append("log", spark.range(2))
    assert s.log("log").count() == 4


def test_one_of_many_takes_over(spark, tmp_path):
    """Writers that all see an expired lock, or the same last version: one of them wins."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    s = Store(spark, str(tmp_path / "store"))
    for turn in range(5):
        assert s.acquire("l", "old", 100.0 * turn, 10)
        start = Barrier(6)

        def take(i, turn=turn, start=start):
            start.wait()
            return s.acquire("l", f"w{i}", 100.0 * turn + 10, 10)

        with ThreadPoolExecutor(6) as pool:
            assert sum(pool.map(take, range(6))) == 1
    # Two that have read the same state: the second's file is there already.
    number, _ = s._lock("l")
    assert s._next_lock("l", number, "a", 1e9) and not s._next_lock("l", number, "b", 1e9) and s._lock("l")[1]["holder"] == "a"


def test_lock_requests(spark):
    asked = spark.createDataFrame([("free", "a", 2), ("free", "b", 1), ("held", "a", 1), ("ended", "a", 1), ("ended", "c", 3)], "name string, holder string, pos int")
    locks = spark.createDataFrame([("held", "x", "2026-08-15 00:00:01"), ("ended", "x", NOW)], "name string, holder string, expires_at string")
    got = {(r["name"], r["holder"]): (r["acquired"], r["blocked_by"]) for r in browse.lock_decisions(asked, locks, NOW).collect()}
    assert got == {("free", "a"): (False, "b"), ("free", "b"): (True, None), ("held", "a"): (False, "x"), ("ended", "a"): (True, None), ("ended", "c"): (False, "a")}


def test_stale_queue(spark):
    rows = spark.createDataFrame([(1, None, 5, True), (2, 4, 5, True), (3, 5, 5, True), (4, 1, 5, False), (5, 3, None, True)], "id int, enriched_at int, last_seen_at int, is_active boolean")
    assert [r["id"] for r in browse.stale_queue(rows).collect()] == [1, 2]
    assert [r["id"] for r in browse.stale_queue(rows, force=True).collect()] == [1, 5, 2, 3]


def test_sentinel(spark):
    due = spark.createDataFrame([(1, 200), (2, 404), (3, 503), (3, None)], "artifact_id int, http_status int")
    appended, report = checks.sentinel(due, spark.range(20), NOW)
    assert sorted((r["artifact_id"], r["http_status"] or 0) for r in appended.collect()) == [(2, 404), (3, 0), (3, 503)]
    assert tuple(report.first()) == (4, 1, 3, False) and checks.sentinel(due, spark.range(9), NOW)[1].first()["blocked"] and not checks.sentinel(due, spark.range(0), NOW)[1].first()["blocked"]


def greedy(records, stored):
    """Outcomes one record at a time, as a loop over the batch has them."""
    hashes, slugs, out = dict.fromkeys(()), {s for s, _ in stored.values()}, []
    hashes.update({k: h for k, (_, h) in stored.items()})
    for key, name, h in records:
        if key not in hashes:
            if name in slugs:
                out.append("rejected")
                continue
            slugs.add(name)
            out.append("inserted")
        else:
            out.append("unchanged" if hashes[key] == h else "updated")
        hashes[key] = h
    return out


def one_by_one(edges):
    taken, done = set(), {}
    for key, slug, pos in sorted(edges, key=lambda e: e[2]):
        if key not in done and slug not in taken:
            taken.add(slug)
            done[key] = pos
    return done


def chain(n):
    """Each record shares its key with the one before it or its slug, in turn."""
    return [(f"k{(i + 1) // 2}", f"s{i // 2}", i) for i in range(n)]


def tangle(n, seed):
    r = random.Random(seed)
    pairs = {(f"k{r.randint(0, n // 3)}", f"s{int(r.random() ** 3 * n / 4)}") for _ in range(n)}
    return [(k, s, i) for i, (k, s) in enumerate(sorted(pairs, key=lambda _: r.random()))]


@pytest.mark.parametrize(("edges", "most"), [(chain(10_000), 4), (tangle(3000, 1), 8), (tangle(300, 2), 8), ([(f"k{i}", "artifact", i) for i in range(5000)], 2), (chain(31)[::-1], 4), ([], 1)])
def test_insertions_equal_one_by_one(spark, monkeypatch, edges, most):
    rounds = []
    real = upsert.cut
    monkeypatch.setattr(upsert, "cut", lambda df: rounds.append("_at" if df.columns == ["source_url", "slug", "pos"] else "") or real(df))
    rows = spark.createDataFrame(edges, "source_url string, slug string, pos bigint").repartition(4)
    got = {r["source_url"]: r["_at"] for r in upsert.insertions(rows, "source_url").collect()}
    assert got == one_by_one(edges)
    # Two tables a round (who came in, who is left), one before, and one more where chains are walked.
    assert rounds.count("_at") <= 1 + 3 * most


def test_rejected_keys_try_again(spark, tmp_path):
    import random

    r = random.Random(7)
    records = [("a", "x", "1"), ("b", "x", "2"), ("b", "y", "3"), ("c", "y", "4"), ("c", "x", "4"), ("c", "z", "5"), ("c", "x", "6"), ("d", "kept", "7"), ("d", "w", "8"), ("s", "other", "9")]
    records += [(f"k{r.randrange(40)}", f"n{r.randrange(25)}", str(r.randrange(3))) for _ in range(200)]
    stored = {"s": ("kept", "9")}
    held = spark.createDataFrame([(k, s, s, h, None, None, None, 1, [], True, None) for k, (s, h) in stored.items()], STORED)
    done = upsert.outcomes(batch(spark, records), held).orderBy("pos").collect()
    assert [x["outcome"] for x in done] == greedy(records, stored)
    kept = {}
    for x in done:
        if x["outcome"] == "rejected":
            assert x["slug"] == x["name"]
        else:
            assert kept.setdefault(x["source_url"], x["slug"]) == x["slug"]
    assert len(set(kept.values())) == len(kept) and upsert.outcomes(batch(spark, []), held).count() == 0


def test_overlay_only_adds(spark):
    from curatrix.operators.overlay import overlay

    rows = spark.createDataFrame([(1, "s", ["a"], 5), (2, None, None, 6), (3, "t", ["b"], 7)], "id int, summary string, tags array<string>, quality_score int")
    told = spark.createDataFrame([(1, "better", ["a", "c"], 99), (2, " ", ["d"], 99), (9, "x", [], 1)], "id int, summary string, tags array<string>, quality_score int")
    assert sorted(tuple(r) for r in overlay(rows, told).collect()) == [(1, "better", ["a", "c"], 5), (2, None, ["d"], 6), (3, "t", ["b"], 7)]
    assert overlay(rows, None) is rows


def test_retired(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "2", 3), ("d", "2", 4)], "source_url string, h string, n int")
    gone = spark.createDataFrame([("c",)], "source_url string")
    assert {(r[0], r[1]) for r in upsert.retired(rows, gone, "h", "n").collect()} == {("c", "removal_requested"), ("b", "superseded")}


def test_expectations(spark):
    rows = spark.createDataFrame([("skill", True, None), ("plugin", False, None)], "kind string, is_active boolean, inactive_reason string")
    assert {r["constraint"]: r["rows"] for r in violations(rows, "artifacts").collect()} == {"kind": 1, "inactive needs a reason": 1}


def test_feeds(spark, tmp_path):
    (tmp_path / "search.json").write_text(json.dumps({"total_count": 2, "items": [
        {"path": "SKILL.md", "html_url": "https://github.com/o/r/blob/SKILL.md", "repository": {"full_name": "o/r", "html_url": "https://github.com/o/r"}, "score": 1.0},
        {"path": "docs/SKILL.md", "html_url": "x", "repository": {"full_name": "o/q", "html_url": "y"}, "score": 1.0}]}))
    contents = spark.createDataFrame([("o/r", "---\nname: nice\ndescription: d\n---\n")], "repo_full_name string, content string")
    plain = feeds.code_search(spark, str(tmp_path / "search.json")).collect()
    named = feeds.code_search(spark, str(tmp_path / "search.json"), contents).collect()
    assert [r["name"] for r in plain] == ["r"] and [(r["name"], r["summary"]) for r in named] == [("nice", "d")]
    (tmp_path / "reg.json").write_text(json.dumps({"servers": [{"name": "", "title": "T", "url": "https://s.org/x", "stars": 42, "tags": "a, ,b"}], "nextCursor": "n2"}))
    r = feeds.registry(spark, str(tmp_path / "reg.json")).first()
    assert (r["kind"], r["name"], r["stars"], r["tags"], r["install_target"]) == ("mcp", "T", 42.0, ["a", "b"], ["generic"])
    assert feeds.registry_cursor(spark, str(tmp_path / "reg.json")).first()[0] == "n2"
    (tmp_path / "list.md").write_text("# L\n- [a](https://x.org/a)\n- [b](https://x.org/b)\n- [i](https://img.shields.io/badge/i)\n")
    assert feeds.markdown_list(spark, str(tmp_path / "list.md")).count() == 2 and feeds.markdown_list(spark, str(tmp_path / "list.md"), 1).count() == 1
    robots = spark.createDataFrame([("x.org", "User-agent: *\nDisallow: /a")], "host string, content string")
    assert [r["name"] for r in feeds.allowed(feeds.markdown_list(spark, str(tmp_path / "list.md")), robots).collect()] == ["b"]
    (tmp_path / "body.json").write_text(json.dumps({"agent": "crawler", "source_id": 1, "artifacts": [{"kind": "skill", "name": "n", "source_url": "https://x.org"}]}))
    assert feeds.ingest_bodies(spark, str(tmp_path / "body.json")).select("agent", "index", "name").collect() == [("crawler", 0, "n")]
    q = spark.createDataFrame([("o/r",), ("path:skills a/b",), ("free text",)], "l string")
    assert [r[0] for r in q.select(feeds.search_query(F.col("l"))).collect()] == ["repo:o/r filename:SKILL.md", "path:skills a/b", "free text"]
    lists = spark.createDataFrame([(["a", 'b"c'], ), ([],), (None,)], "tags array<string>")
    stored = feeds.encoded(lists, "tags")
    assert [r[0] for r in stored.collect()] == ['["a","b\\"c"]', "[]", "[]"]
    assert [r[0] for r in feeds.decoded(stored, "tags").collect()] == [["a", 'b"c'], [], []]
    assert feeds.decoded(spark.createDataFrame([("no json",), (None,)], "tags string"), "tags").collect() == [([],), ([],)]
    entries = spark.createDataFrame([("a", "ok", 3, 2, 1), ("b", "failed", 0, 0, 0)], "source string, status string, discovered int, accepted int, rejected int")
    assert tuple(feeds.harvest_report(entries).first()) == (2, 1, 3, 2, 1)


def test_harvest_isolates_sources(spark, tmp_path):
    (tmp_path / "list.md").write_text("- [a](https://x.org/a)\n- [r](/rel/r)\n")
    (tmp_path / "reg.json").write_text(json.dumps({"items": [{"title": "T", "href": "https://s.org/x"}], "next_page_cursor": "p2"}))
    sources = [("l", "markdown_list", str(tmp_path / "list.md")), ("bad", "no_such", "x"), ("gone", "registry", str(tmp_path / "none.json")), ("r", "registry", str(tmp_path / "reg.json"))]
    report = harvest.run(sources, str(tmp_path / "out"), harvest.Context(spark)).collect()
    assert [(r["source"], r["status"], r["accepted"], r["rejected"], r["next_cursor"]) for r in report] == [
        ("l", "partial", 1, 1, None), ("bad", "failed", 0, 0, None), ("gone", "failed", 0, 0, None), ("r", "ok", 1, 0, "p2")]
    assert "no_such" in report[1]["error"]
    got = harvest.harvested(spark, str(tmp_path / "out"), feeds.markdown_list(spark, str(tmp_path / "list.md")).schema.add("safe", "boolean").add("source", "string"))
    assert sorted((r["source"], r["source_url"]) for r in got.collect()) == [("l", "https://x.org/a"), ("r", "https://s.org/x")]
    totals = feeds.harvest_report(spark.createDataFrame(report)).first()
    assert (totals["sources"], totals["failed"], totals["accepted"]) == (4, 2, 2)


def test_recorded_pages(spark, tmp_path):
    adapter.register(spark)
    for i in range(4):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"page": i}))
    read = lambda **o: sorted(r["cursor"] for r in spark.read.format("recorded_pages").options(path=str(tmp_path), **o).load().collect())
    assert read() == ["p0.json", "p1.json", "p2.json", "p3.json"]
    assert read(cursor="p1.json", limit=1) == ["p2.json"]


def test_stream_equals_batch(spark, tmp_path):
    parts = [batch(spark, made(10)), batch(spark, made(10)), batch(spark, made(10, "x"))]
    for i, p in enumerate(parts):
        p.coalesce(1).write.json(str(tmp_path / "in" / f"b{i}"))
    s = Store(spark, str(tmp_path / "store"))
    s.write("artifacts", spark.createDataFrame([], STORED))
    want = spark.createDataFrame([], STORED)
    for i, p in enumerate(parts):
        want = spark.createDataFrame(upsert.snapshot(p, want, NOW, CONTENT).collect(), STORED)
        stream = pulse.read_batches(spark, str(tmp_path / "in" / f"b{i}"), p.schema)
        pulse.merge_stream(stream, s, "artifacts", lambda n: NOW, CONTENT, str(tmp_path / f"cp{i}")).awaitTermination()
    assert sorted(s.read("artifacts").select(*want.columns).collect()) == sorted(want.collect())


def test_registered_gates_have_their_default_limits(spark):
    from curatrix.plans import checks as plans

    sf = "/root/testdata/sf0.001"
    live, runs = plans._seen(spark, sf).count(), {}
    for r in plans.QUERIES["prune_decisions"](spark, sf).collect():
        runs.setdefault(r["run"], []).append(r["deactivate"])
    assert set(runs["all"]) == {100 * len(runs["all"]) <= 10 * live} == {False} and set(runs["few"]) == {True} and set(runs["dry"]) == {False}
    days = plans.QUERIES["circuit_breaker"](spark, sf).collect()
    assert days and all(r["tripped"] == (100 * r["failed"] > 40 * r["checked"]) for r in days)


def test_failure_counters_equal_batch(spark, tmp_path):
    c = observed(spark, {1: [500, 500, 200, 500], 2: [404, 500, 500]})
    c.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
    q = pulse.failure_counters(stream).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    last = {r["artifact_id"]: r["run"] for r in spark.sql("select artifact_id, max_by(run, checked_at) as run from counted group by 1").collect()}
    want = {r["artifact_id"]: r["run"] for r in checks.trailing_runs(c).collect()}
    assert last == want == {1: 1, 2: 2}


def test_failure_counters_forget(spark, tmp_path):
    """A record that was not seen for the watermark's time starts anew."""
    t = dt.datetime(2026, 1, 1)
    first = [(1, 1, t, 500), (2, 2, t, 500)]
    later = [(3, 2, t + dt.timedelta(days=200), 500)]
    last = [(4, 1, t + dt.timedelta(days=201), 500), (5, 2, t + dt.timedelta(days=201), 500)]
    out = str(tmp_path / "in")
    stream = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(out + "/*")
    for i, rows in enumerate((first, later, last)):
        spark.createDataFrame(rows, CHECKS).coalesce(1).write.parquet(f"{out}/b{i}")
        q = pulse.failure_counters(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    got = {(r["artifact_id"], r["checked_at"].day): r["run"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 1] == 1 and got[1, 21] == 1 and got[2, 21] == got[2, 20] + 1


def test_windowed_tally_and_replays(spark, tmp_path):
    c = observed(spark, {1: [200, 500], 2: [200]})
    c.unionByName(c).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
    q = pulse.without_replays(stream).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    q = pulse.windowed_tally(stream).writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from tally").first()[0] == 6
