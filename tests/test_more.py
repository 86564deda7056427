"""Operators whose results SQL twins don't show: sinks, requests, long chains, registration."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagelode.operators import crawl, fixes, graph, impact, recommendations, scoring
from pagelode.plans import catalog
from pagelode.sources import payloads, readers


def test_long_chains_are_followed_to_their_end(spark):
    nodes = spark.range(90).select(F.col("id").alias("node"))
    edges = spark.range(89).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("pos"))
    assert {r.node: r.depth for r in graph.depths(nodes, edges, 0).collect()} == {i: i for i in range(90)}
    name = lambda c: F.concat(F.lit("https://a/"), F.col(c).cast("string"))
    out = crawl.crawl(nodes.select(name("node").alias("url"), F.lit(200).alias("status")), edges.select(name("src").alias("src"), "pos", name("dst").alias("dst")), "https://a/0", None)
    assert out.count() == 90


def test_requests_of_all_commands():
    given = {"keyword": "k", "keywords": "a, b ,", "target": "x,y", "target1": "p", "target2": "q", "url": "u", "location": " UK", "language": "English", "limit": 5, "device": "mobile", "mode": "gap"}
    made = {c: payloads.request(c, **given)[0] for c in payloads.REQUESTS}
    assert len(made) == 27
    assert made["serp"] == {"keyword": "k", "location_name": "United Kingdom", "language_name": "English", "device": "mobile", "os": "android", "depth": 5, "calculate_rectangles": False}
    assert made["volume"]["keywords"] == ["a", "b"] and made["bulk-ranks"] == {"targets": ["x", "y"]} and made["ideas"]["keywords"] == ["k"]
    assert made["intersection"]["intersections"] is False and made["lighthouse"]["for_mobile"] is True and made["backlinks"]["internal_list_limit"] == 10
    assert "date_from" not in made["trends"] and payloads.request("trends", keywords="a", date_from="2026-01-01")[0]["date_from"] == "2026-01-01"
    with pytest.raises(ValueError):
        payloads.request("nothing")


def test_location_names(spark):
    names = {"U.S.": "United States", " uae ": "United Arab Emirates", "Great Britain": "United Kingdom", "de": "de", " Berlin": " Berlin"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", payloads.location(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in got} == names


def test_properties_read_like_values():
    assert fixes.coerced("http://a,http://b") == ["http://a", "http://b"] and fixes.coerced("1e3") == 1000.0 and fixes.coerced("TRUE") is True
    text, missing = fixes.json_ld("video", {"name": "v"})
    assert json.loads(text)["@type"] == "VideoObject" and "uploadDate" in missing
    with pytest.raises(ValueError):
        fixes.json_ld("person", {"name": "a", "name.first": "b"})


def test_a_shell_that_never_closes_says_nothing(spark):
    html = [("open", '<body><div id="root"><p>few words'), ("closed", '<body><div id="root"></div> more text')]
    got = scoring.spa_verdict(spark.createDataFrame(html, "name string, html string"), ["name"]).collect()
    assert {r.name: r.spa_score for r in got} == {"open": 0, "closed": 3}


def test_snapshots_of_one_second_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    assert [readers.write_snapshot(rows, str(tmp_path / "s"), 100) for _ in range(3)] == [100, 101, 102]
    assert sorted(r._saved_at for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [100, 101, 102]
    readers.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"k": "a", "v": 1}
    assert all("--profile" in line for line in readers.schedule_lines("run"))
    crawled = tmp_path / "crawl.json"
    crawled.write_bytes(json.dumps({"pages": [{"url": "a", "status": 200}]}).encode("utf-16"))
    assert [r.url for r in readers.crawl_file(spark, str(crawled)).collect()] == ["a"]


def test_impact_needs_both_snapshots_and_keeps_the_window(spark):
    recs = spark.createDataFrame(
        [("d", 1, "", "done", 500_000, "kw", 12, None), ("d", 2, "u", "resolved", 500_000, None, None, None), ("d", 3, "u", "open", 500_000, None, None, None), ("d", 4, "", "done", 500_000, None, None, None), ("d", 5, "u", "done", 5, None, None, None), ("e", 6, "u", "done", 500_000, None, None, None)],
        "domain string, id int, url string, status string, updated long, keyword string, was int, now int",
    )
    ranks = spark.createDataFrame([("d", 400_000, "kw", "u", 9, 0), ("d", 600_000, "kw", "u", 14, 0), ("d", 600_000, "kw", "u", 8, 1)], "domain string, ts long, keyword string, url string, position int, seq int")
    got = impact.ordered(impact.report(recs, ranks, 510_000, days=1)).collect()
    assert [(r.id, r.verdict) for r in got] == [(1, "improved"), (2, "worse"), (4, "insufficient_data"), (6, "insufficient_data")]


def test_saving_a_run_twice_changes_nothing_more(spark):
    state = spark.createDataFrame([("u", "a", "done"), ("u", "b", "open"), ("u", "c", "ignored"), ("w", "b", "open")], "url string, rule_id string, status string")
    found = spark.createDataFrame([("u", "a"), ("u", "c"), ("u", "d")], "url string, rule_id string")
    linted, ran = spark.createDataFrame([("u",)], "url string"), spark.createDataFrame([(x,) for x in "abcd"], "rule_id string")
    events = recommendations.save_lint(state, found, linted, ran)
    assert {(r.rule_id, r.kind, r.status) for r in events.collect()} == {("a", "rec_reopened", "open"), ("b", "rec_status", "resolved"), ("c", "raised_again", "ignored"), ("d", "rec_raised", "open")}
    assert recommendations.saved(state, events).first().asDict() == {"raised": 3, "reopened": 1, "resolved": 1, "open_total": 3}


def test_entry_point_lists_optional_queries():
    assert len(__spark_entry__.queries()) > 100


def test_patch_effect_sends_no_pages_through_the_driver(spark):
    found = catalog.queries()["patch_effect"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1  # the templates of patches
    assert plan.count("SortMergeJoin") == 3
