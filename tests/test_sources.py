"""Saved fetches, versions of files, the response cache and the watch job."""

import os

import pytest
from pyspark.sql import functions as F

from pagelode.operators import versions
from pagelode.operators.responses import RESPONSES, ResponseCache
from pagelode.sources.fetched import fetched, save_fetches, saves
from pagelode.streaming import watch

FETCH = "url string, status int, body string, headers map<string,string>, final_url string"


def test_saved_fetches_as_table_and_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/fetches"
    rows = [(f"https://a/{i}", 200 if i else 404, f"line one\nline two {i}", {"CONTENT-type": "text/html", "x": "y"}, None if i % 2 else "https://a/end") for i in range(6)]
    assert fetched(spark, folder).count() == 0
    save_fetches(spark.createDataFrame(rows, FETCH).repartition(3), folder, 7)
    got = {r.url: r for r in fetched(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows} and len(saves(folder)) == fetched(spark, folder).rdd.getNumPartitions()
    assert got["https://a/0"][:4] == (7, "https://a/0", 404, "text/html") and got["https://a/3"].body == "line one\nline two 3"
    assert got["https://a/2"].final_url == "https://a/end" and got["https://a/3"].final_url == "https://a/3" and got["https://a/1"].headers["x"] == "y"

    out = str(tmp_path / "out")

    def drain():
        q = fetched(spark, folder, stream=True).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
        q.awaitTermination()
        return sorted(((r.save, r.url) for r in spark.read.parquet(f"{out}/rows").collect()), key=str)

    first = drain()
    assert first == sorted(((7, r[0]) for r in rows), key=str) and drain() == first  # nothing new: nothing read again
    os.makedirs(tmp_path / "fetches" / "000000000009")
    with open(tmp_path / "fetches" / "000000000009" / "part-0", "w") as f:
        f.write('{"url": "https://a/half"}\n')
    assert drain() == first  # a save without its mark isn't whole
    with open(tmp_path / "fetches" / "000000000009" / "_SUCCESS", "w") as f:
        f.write("")
    with open(tmp_path / "fetches" / "000000000009" / "part-1", "w") as f:
        f.write('no json\n[1]\n{"url": 5, "status": "x", "headers": {"a": 1}}')
    assert drain() == sorted([*first, (9, "https://a/half"), *[(9, None)] * 3], key=str)


PAGE = "<html lang=en><head><title>{0}</title></head><body><h1>{0}</h1></body></html>"


def test_only_changed_files_are_linted(spark, tmp_path, monkeypatch):
    def site(name, files):
        for path, text in files.items():
            os.makedirs(os.path.dirname(tmp_path / name / path), exist_ok=True)
            with open(tmp_path / name / path, "wb") as f:
                f.write(text if isinstance(text, bytes) else text.encode())
        return versions.folder_files(spark, str(tmp_path / name))

    old = {"a.html": PAGE.format("A page"), "b/b.html": PAGE.format("B"), "gone.html": PAGE.format("G"), "same/é.html": b"\xff\xfe broken \x00"}
    new = {**old, "b/b.html": PAGE.format("B").replace("<h1>B</h1>", "<h2>B</h2>"), "new.html": "<h1>N</h1>", "note.txt": "x"}
    del new["gone.html"]
    before, after = site("old", old), site("new", new)
    assert {r.path: r.change for r in versions.changes(before, after).collect()} == {"a.html": "same", "b/b.html": "changed", "gone.html": "removed", "same/é.html": "same", "new.html": "added"}
    known = spark.createDataFrame(versions.lint_files(before).collect())
    linted = []
    plain = versions.lint_files
    monkeypatch.setattr(versions, "lint_files", lambda files: linted.extend(r.path for r in files.select("path").collect()) or plain(files))
    states, results = versions.lint_changes(before, after, known)
    got = {(r.path, r.rule_id): r.state for r in states.collect()}
    assert sorted(linted) == ["b/b.html", "new.html"]
    assert got[("b/b.html", "missing-h1")] == "new" and got[("b/b.html", "missing-h2")] == "fixed" and got[("b/b.html", "no-cta")] == "carried"
    assert {s for (p, _), s in got.items() if p == "a.html"} == {"carried"} and {s for (p, _), s in got.items() if p == "gone.html"} == {"fixed"}
    assert {s for (p, _), s in got.items() if p == "new.html"} == {"new"}
    whole = {r.path: (r.score, sorted(r.rules)) for r in plain(after).collect()}
    assert {r.path: (r.score, sorted(r.rules)) for r in results.collect()} == whole


def test_cache_takes_a_batch_once(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame([(*r,) for r in rows], RESPONSES)
    cache = ResponseCache(spark, f"file://{tmp_path}/cache")
    assert cache.responses().count() == 0 and cache.ledger().count() == 0
    one = batch(("k", "serp", "old", 0.5, "x" * 300, 100), ("k", "serp", "late", 0.25, None, 200), ("l", "serp", "l", None, "d", 100), (None, "serp", "lost", 1.0, "d", 100))
    assert cache.apply(1, one) and not cache.apply(1, one)
    assert {(r.key, r.body) for r in cache.responses().collect()} == {("k", "late"), ("l", "l")}
    assert sorted((r.batch, r.cost, len(r.detail)) for r in cache.ledger().collect()) == [(1, 0.0, 1), (1, 0.25, 0), (1, 0.5, 120), (1, 1.0, 1)]
    assert cache.apply(2, batch(("k", "serp", "older", 9.0, "d", 150), ("l", "serp", "same second", 0.0, "d", 100)))
    assert {(r.key, r.body) for r in cache.responses().collect()} == {("k", "late"), ("l", "same second")}

    class Broken(ResponseCache):
        def _publish(self, state):
            raise OSError("lost before the manifest")

    with pytest.raises(OSError):
        Broken(spark, cache.folder).apply(3, batch(("k", "serp", "never", 7.0, "d", 900)))
    again = ResponseCache(spark, cache.folder)  # what a lost batch left isn't seen, and the batch can come again
    assert {r.body for r in again.responses().collect()} == {"late", "same second"} and again.ledger().where("cost = 7").count() == 0
    assert again.apply(3, batch(("k", "serp", "now", 7.0, "d", 900))) and again.ledger().where("cost = 7").count() == 1
    assert {(r.key) for r in again.fresh(900 + 21_600).collect()} == {"k"}


def test_watch_goes_on_after_failures_and_restarts(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "watch")
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").coalesce(1).write.parquet(source)

    def broken(rows):
        return rows.select(F.raise_error(F.lit("a check's own fault")).cast("string").alias("x"))

    checks = {"first": broken, "count": lambda rows: rows.agg(F.count("*").alias("n")), "none": lambda rows: None}
    stream = lambda: spark.readStream.schema("n int, s string").parquet(source)
    watch.watch(stream(), checks, folder)
    told = {(r.batch, r.check_name): (r.state, r.error) for r in watch.runs(spark, folder).collect()}
    assert {k: v[0] for k, v in told.items()} == {(0, "first"): "failed", (0, "count"): "done", (0, "none"): "skipped"}
    assert "fault" in told[(0, "first")][1] and len(told[(0, "first")][1]) <= 200
    watch.watch(stream(), checks, folder)  # nothing new arrived
    assert watch.runs(spark, folder).count() == 3
    spark.createDataFrame([(3, "c")], "n int, s string").coalesce(1).write.mode("append").parquet(source)
    watch.watch(stream(), {**checks, "first": lambda rows: rows.select("n")}, folder)
    assert {(r.batch, r.n) for r in watch.results(spark, folder, "count").collect()} == {(0, 2), (1, 1)}
    # a batch that comes again replaces what it wrote
    watch.run_checks(spark.createDataFrame([(3, "c")], "n int, s string"), 1, checks, folder)
    assert {(r.batch, r.n) for r in watch.results(spark, folder, "count").collect()} == {(0, 2), (1, 1)}
    assert watch.runs(spark, folder).where("batch = 1").count() == 3
    assert {(r.check_name, r.state) for r in watch.runs(spark, folder).where("batch = 1").collect()} == {("first", "failed"), ("count", "done"), ("none", "skipped")}
