"""Scalar functions against the documented examples."""

import pytest
from pyspark.sql import functions as F

from curatrix.functions import dates, documents, hashing, score, status, stem, taxonomy, text, url, validate

NOW = "2026-08-15 00:00:00"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize_text(spark):
    rows = [("  a   b \n c  ",), (" x﻿ y　",), (None,)]
    assert values(spark, rows, "t string", text.normalize_text(F.col("t"))) == [("a b c",), ("x y",), ("",)]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("HTTPS://GitHub.com/A/b", "https://github.com/A/b"),
        ("https://x.org/a?utm_source=q&b=1#frag", "https://x.org/a?b=1"),
        ("https://x.org/a?b=2&a=1&b=1", "https://x.org/a?a=1&b=2&b=1"),
        ("https://x.org/a/", "https://x.org/a"),
        ("https://x.org", "https://x.org/"),
        ("https://x.org:443/a", "https://x.org/a"),
        ("http://x.org:443/a", "http://x.org:443/a"),
        ("  not a url ", "not a url"),
        ("https://x.org/?ref=1&REFERRER=2&gclid=3&reference=4", "https://x.org/?reference=4"),
        ("https://x.org/a/?b=1", "https://x.org/a/?b=1"),
        ("https://x.org/a/?ref=1", "https://x.org/a"),
        ("https://x.org/a/./b/../c/..", "https://x.org/a"),
        ("https://x.org/../../a/%2e%2E/.%2e/b/.", "https://x.org/b"),
        ("https://x.org/a/.hidden/...", "https://x.org/a/.hidden/..."),
        ("https://x.org\\\\a\\b".replace("\\\\", "\\"), "https://x.org/a/b"),
        ("https://x.org/a b/é/😀/%c3%A9\"", "https://x.org/a%20b/%C3%A9/%F0%9F%98%80/%c3%A9%22"),
        ("https://x.org/a?z&b=x%20y&B=~&a=%zz&=v&&q=a=b", "https://x.org/a?=v&a=%25zz&b=x+y&B=%7E&q=a%3Db&z="),
        ("https://x.org/a?%75tm_x=1", "https://x.org/a"),
        ("https://BÜCHER.example/a", "https://xn--bcher-kva.example/a"),
        ("http://x.org:080/a", "http://x.org/a"),
        ("http://x.org:/a", "http://x.org/a"),
        ("http://x.org:0/a", "http://x.org:0/a"),
        ("http://x.org:70000/a", "http://x.org:70000/a"),
        ("http://x.org:9999999999999/A/..", "http://x.org:9999999999999/A/.."),
        ("http://x.org:ab/A/..", "http://x.org:ab/A/.."),
        ("http://[::1]:80/a", "http://[::1]/a"),
        ("https://x.o\nrg/\ta", "https://x.org/a"),
        (None, ""),
    ],
)
def test_normalize_url(spark, given, want):
    assert values(spark, [(given,)], "u string", url.normalize_url(F.col("u"))) == [(want,)]


def test_safe_url(spark):
    good, bad = ["http://a.b", "https://a.b/c"], ["javascript:alert(1)", "data:x", "//a.b", "/a", "file:///etc", None]
    got = values(spark, [(u,) for u in good + bad], "u string", url.is_safe_url(F.col("u")))
    assert [g[0] for g in got] == [True] * len(good) + [False] * len(bad)


def hashed(spark, **change):
    base = {"kind": "skill", "name": "n", "summary": "s", "url": "https://x.org/a", "license": "MIT", "tags": ["b", "a"]} | change
    schema = "kind string, name string, summary string, url string, license string, tags array<string>"
    return values(spark, [tuple(base.values())], schema, hashing.content_hash(*(F.col(c) for c in base)))[0][0]


def test_content_hash(spark):
    h = hashed(spark)
    assert len(h) == 64
    assert h == hashed(spark, tags=["a", "b"]) == hashed(spark, name=" n ") == hashed(spark, url="https://X.org/a/?utm_x=1") == hashed(spark, tags=["a", "  ", "b", ""])
    assert h != hashed(spark, summary="t") and h != hashed(spark, tags=["a"])


def test_slugify(spark):
    rows = [("Hello, World!",), ("---",), (None,), ("é",), ("a" * 119 + " b",)]
    assert [r[0] for r in values(spark, rows, "n string", text.slugify(F.col("n")))] == ["hello-world", "artifact", "artifact", "artifact", "a" * 119 + "-"]


def test_dates(spark):
    rows = [(None,), ("2026-08-15 00:00:00",), ("2026-08-05 00:00:00",), ("2026-09-01 00:00:00",)]
    d = F.col("t").cast("timestamp")
    got = values(spark, rows, "t string", dates.days_since(d, NOW), dates.is_stale(d, 10, NOW))
    assert got == [(None, True), (0, False), (10, False), (0, False)]
    rows = [("2026-08-15 00:00:00",), ("2026-08-15 00:00:01",), ("bad",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", dates.is_expired(F.col("t"), NOW))] == [True, False, True, True]


SCORE = "frontmatter boolean, summary string, tags array<string>, targets array<string>, readme boolean, examples boolean, description string, days int, license string, stars bigint"


def scored(spark, **change):
    base = dict.fromkeys(["frontmatter", "summary", "tags", "targets", "readme", "examples", "description", "days", "license", "stars"])
    base |= {"frontmatter": False, "tags": [], "targets": [], "readme": False, "examples": False, "stars": 0} | change
    cols = [F.col(c) for c in base]
    notes = score.notes(*(F.col(c) for c in ("frontmatter", "summary", "readme", "examples", "days", "license")))
    row = spark.createDataFrame([tuple(base.values())], SCORE).select(score.breakdown(*cols).alias("s"), notes.alias("notes")).first()
    assert row["s"]["score"] == sum(row["s"][k] for k in ("metadata", "documentation", "freshness", "licensing", "popularity", "discoverability"))
    return row["s"], row["notes"]


def test_score(spark):
    bare, notes = scored(spark)
    assert bare["score"] == 4 == bare["freshness"]
    assert notes[0] == "No valid frontmatter detected." and notes[-1].startswith("No license declared")
    full, none = scored(spark, frontmatter=True, summary="s" * 50, tags=["a", "b", "c"], targets=["x"], readme=True, examples=True, description="d" * 900, days=3, license="MIT", stars=1_000_000)
    assert full["score"] == 100 and none == []
    new, _ = scored(spark, frontmatter=True, summary="s" * 50, tags=["a", "b", "c"], readme=True, examples=True, description="d" * 900, days=5, license="MIT", stars=2)
    famous, said = scored(spark, days=1000, license="GPL-3.0", stars=100_000)
    assert new["score"] > famous["score"] and 'License "GPL-3.0" may restrict reuse.' in said


def test_score_parts(spark):
    assert [scored(spark, days=d)[0]["freshness"] for d in (14, 730, 960)] == [20, 3, 0]
    fading = [scored(spark, days=d)[0]["freshness"] for d in (45, 195, 348)]
    assert fading == sorted(fading, reverse=True) and len(set(fading)) == 3
    assert [scored(spark, stars=s)[0]["popularity"] for s in (0, 10, 100, 1000, 100_000)] == [0, 5, 10, 15, 20]
    assert [scored(spark, license=x)[0]["licensing"] for x in ("MIT", "GPL-3.0", None, "NOASSERTION")] == [10, 6, 0, 0]
    rows = [(80,), (79,), (40,), (20,), (0,)]
    assert [r[0] for r in values(spark, rows, "s int", score.band(F.col("s")))] == ["well maintained", "solid", "usable", "gaps", "barely described"]


def test_status(spark):
    rows = [(200,), (301,), (404,), (410,), (429,), (500,), (403,), (None,)]
    assert [r[0] for r in values(spark, rows, "s int", status.verdict(F.col("s")))] == ["ok", "ok", "terminal", "terminal", *["transient"] * 4]
    rows = [(True, 5, 500), (False, 3, 500), (False, 2, 181), (False, 2, 180)]
    got = values(spark, rows, "t boolean, r int, d int", status.inactive_reason(F.col("t"), F.col("r"), F.col("d")))
    assert [g[0] for g in got] == ["gone", "unreachable", "stale", None]


def test_taxonomy(spark):
    rows = [("skill", ["MCP", "ci"], ["zed"]), (None, [], []), ("other", ["constructor"], ["claude-desktop"]), (None, None, None)]
    schema = "k string, t array<string>, g array<string>"
    got = values(spark, rows, schema, taxonomy.map_categories(F.col("k"), F.col("t"), F.col("g")))
    assert [g[0] for g in got] == [["skill", "mcp"], ["uncategorized"], ["uncategorized"], ["uncategorized"]]
    got = values(spark, [("", ["CLI", "x", "cli"], ["zed", "cursor"])], schema, taxonomy.example_signals(F.col("t"), F.col("g")))
    assert got[0][0] == ["cli", "cursor"]


def test_frontmatter(spark):
    rows = [("---\nname: a\ndescription: 'b: c'\nname: z\n---\nbody\nname: no",), ("plain",), (None,), ("---\nname:\n---\n",)]
    m = documents.frontmatter(F.col("c"))
    got = values(spark, rows, "c string", m, documents.frontmatter_valid(m))
    assert got[0] == ({"name": "z", "description": "b: c"}, True)
    assert [g[1] for g in got[1:]] == [False, False, False]


def test_list_and_robots(spark):
    md = "# T\n- [a](https://x.org/a)\n- [b](https://img.shields.io/badge/b)\n- [c](anchor)\n* [d](https://x.org/d)\n- [e](/rel/e)\n"
    got = values(spark, [(md,)], "c string", documents.list_links(F.col("c")))[0][0]
    assert [(r["line"], r["name"], r["url"]) for r in got] == [(1, "a", "https://x.org/a"), (5, "e", "/rel/e")]
    txt = "Allow: /p\nCrawl-delay: 3\nUser-agent: a\nDisallow: /\nCrawl-delay: 4\n \nUser-agent: *\r\n# Allow: /p\nDisallow:  /p \nAllow: /q\ncrawl-delay: x\n"
    rules = documents.robots_rules(F.col("c"))
    got = values(spark, [(txt, "/p"), (txt, "/q"), (txt, "/z"), (None, "/p")], "c string, p string", documents.robots_allowed(rules, F.col("p")))
    assert [g[0] for g in got] == [False, True, True, True]
    early = [("Disallow: /\n",), ("User-agent:\nDisallow: /\n",), ("User-agent: *\nDisallow: /\n",)]
    assert [g[0] for g in values(spark, early, "c string", documents.robots_allowed(rules, F.lit("/p")))] == [True, True, False]
    assert [g[0]["crawl_delay"] for g in values(spark, [(txt,), ("User-agent: *\nCrawl-delay: 2.5",), ("Crawl-delay: 1",)], "c string", rules)] == [4.0, 2.5, None]


def test_fold_accents(spark):
    got = values(spark, [("Āā Őő šŞ é e\u0301 ñ",), ("plain",), (None,), ("й ά だ",)], "t string", text.fold_accents(F.col("t")))
    assert [g[0] for g in got] == ["Aa Oo sS e e n", "plain", None, "й ά だ"]


def test_validation(spark):
    schema = "index int, kind string, name string, source_url string, summary string, description string, tags array<string>, install_target array<string>, stars double, forks double"
    good = (0, "skill", "n", "https://x.org", None, None, [], ["zed"], 1.5, None)
    bad = (1, "plugin", "  ", "javascript:x", "s" * 301, "d" * 4001, ["t"] * 26, ["emacs", "zed", "vi"], -5.0, float("nan"))
    df = spark.createDataFrame([good, bad], schema)
    got = [tuple(r) for r in validate.issue_table(df, "index", "crawler").collect()]
    assert {g[0] for g in got} == {1}
    assert [g[1] for g in got] == ["kind", "name", "source_url", "summary", "description", "tags", "install_target", "install_target", "stars", "forks"]
    assert validate.issue_table(df.limit(0), "index", " ").count() == 2
    big = spark.range(501).select(F.col("id").alias("index"), *(F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in schema.split(", ")[1:])))
    assert validate.issue_table(big, "index", "a").filter("index = -1").first()["message"] == "batch of 501 exceeds max 500; chunk upstream"


def test_utf16(spark):
    assert values(spark, [("a😀",)], "t string", text.utf16_length(F.col("t"))) == [(3,)]


def test_stem():
    pairs = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "sky": "sky", "happy": "happi", "controll": "control", "adjustable": "adjust", "ab": "ab", "don't": "don't"}
    assert {w: stem.porter_stem(w) for w in pairs} == pairs


def test_user_info_keeps_its_case(spark):
    from curatrix.functions.url import normalize_url

    rows = spark.createDataFrame([("HTTPS://User:PassWord@Example.ORG:443/a/",), ("http://EXAMPLE.org:80",)], "u string")
    assert [r[0] for r in rows.select(normalize_url(F.col("u"))).collect()] == ["https://User:PassWord@example.org/a", "http://example.org/"]
