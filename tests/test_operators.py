import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagelode.functions import text as X
from pagelode.operators import fixes, graph, history, logs, pages, recommendations, scoring, visibility
from pagelode.plans import catalog, inputs
from pagelode.sources import payloads, readers


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_link_graph_of_five_pages(spark):
    nodes = spark.createDataFrame([(x,) for x in ("home", "a", "b", "c", "orphan")], "node string")
    edges = spark.createDataFrame([("home", "a", "A"), ("home", "b", "click here"), ("a", "home", "Home"), ("a", "c", "C"), ("b", "home", "Home")], "src string, dst string, anchor string")
    assert [r.node for r in graph.orphans(nodes, edges, "home").collect()] == ["orphan"]
    reach = graph.depths(nodes, edges, "home")
    assert {r.node: r.depth for r in reach.collect()} == {"home": 0, "a": 1, "b": 1, "c": 2}
    assert [r.node for r in graph.unreachable(nodes, reach).collect()] == ["orphan"]
    scored = graph.degrees(nodes, edges)
    assert {r.node: (r.inlinks, r.outlinks) for r in scored.collect()}["home"] == (2, 2)
    assert graph.anchor_quality(edges).first()[:2] == (5, 1)
    assert {r.node: r.role for r in graph.roles(scored, reach, "home").collect()} == {"home": "home", "a": "page", "b": "page", "c": "page", "orphan": "unreachable"}
    assert {r.node: r.parent for r in graph.parents(reach, edges).collect()} == {"home": None, "a": "home", "b": "home", "c": "a"}


def test_redirects(spark):
    hops = spark.createDataFrame([("a", 301, "b"), ("b", 200, ""), ("c", 301, "a"), ("d", 302, ""), ("e", 301, "f"), ("f", 301, "e"), ("g", 404, ""), ("h", 301, "gone")], "url string, status int, location string")
    got = {r.start: (r.verdict, r.redirect_count, r.final_url) for r in graph.trace_redirects(hops.select(F.col("url").alias("start")), hops).collect()}
    assert got["a"] == ("ok", 1, "b") and got["b"] == ("ok", 0, "b") and got["c"] == ("redirect_chain", 2, "b")
    assert got["d"][0] == "broken_location" and got["e"][0] == got["f"][0] == "loop_or_limit" and got["g"][0] == "non_200_final" and got["h"][0] == "request_failed"
    long = spark.createDataFrame([(f"n{i}", 301, f"n{i + 1}") for i in range(30)], "url string, status int, location string")
    assert graph.trace_redirects(long.where("url = 'n0'").select(F.col("url").alias("start")), long, max_hops=5).first().verdict == "loop_or_limit"
    sites = spark.createDataFrame([(1, "b", "a"), (1, "b", "b"), (2, "b", "c"), (3, "b", "g")], "site int, canonical string, start string")
    traces = graph.trace_redirects(hops.select(F.col("url").alias("start")), hops)
    assert {r.site: r.overall for r in graph.canonical_audit(traces, sites).collect()} == {1: "healthy", 2: "needs_chain_cleanup", 3: "failure"}


LOG = [
    '1.2.3.4 - - [01/Jan/2024:10:00:00 +0000] "GET /a?x=1 HTTP/1.1" 200 5 "-" "Mozilla Googlebot/2.1"',
    '1.2.3.4 - - [02/Jan/2024:10:00:00 +0000] "GET /b HTTP/1.1" 404 5 "-" "Googlebot-Mobile"',
    '1.2.3.4 - - [02/Jan/2024:10:00:00 +0000] "GET /b HTTP/1.1" 200 5 "-" "GPTBot"',
    '1.2.3.4 - - [02/Jan/2024:10:00:00 +0000] "GET /b HTTP/1.1" 200 5',
    "  ",
]


def test_access_log(spark):
    parsed = logs.parse(spark.createDataFrame([(x,) for x in LOG], "value string"))
    bots = {r.bot: r for r in logs.by_bot(parsed).collect()}
    assert (bots["Googlebot"].hits, bots["Googlebot"].param_pct, bots["Googlebot"].share_pct, bots["GPTBot"].hits) == (2, 50.0, 66.7, 1)
    assert tuple(logs.totals(parsed).first()) == (4, 1, 3)
    assert {r.day: r.hits for r in logs.daily(parsed).collect()} == {"01/Jan/2024": 1, "02/Jan/2024": 2}
    assert [(r.path, r["rank"]) for r in logs.top_paths(parsed, 1).where("bot = 'Googlebot'").collect()] == [("/a?x=1", 1)]


def test_ctr_and_estimate(spark):
    df = spark.createDataFrame([(float(p),) for p in (1, 10, 15, 25, 0)], "p double")
    assert [r.c for r in df.select(history.ctr(F.col("p")).alias("c")).collect()] == [0.25, 0.01, 0.004, 0.001, 0.25]
    assert tuple(one(spark, history.estimate(F.col("v"), F.lit(3)), v=1000)) == (48, 80, 112)


def test_forecast_totals(spark):
    volumes = spark.createDataFrame([("a", 1000), ("b", 500)], "keyword string, volume long")
    ranks = spark.createDataFrame([("a", 8), ("b", 15)], "keyword string, position int")
    t = history.forecast_totals(history.forecast(volumes, ranks)).first()
    assert (t.now_clicks, t.expected, t.uplift) == (20, 120, 100)


def test_priority(spark):
    rows = [("critical", "high", 0.0, False, 1, 5.0), ("critical", "high", 0.0, True, 1, 6.25), ("critical", "high", 0.0, False, 3, 6.0), ("critical", "high", 0.0, False, 99, 7.5), ("medium", "high", 1000.0, False, 1, 4.0)]
    df = spark.createDataFrame(rows, "s string, c string, e double, a boolean, n int, x double")
    assert all(r.p == r.x for r in df.select("x", recommendations.priority(*map(F.col, "scean")).alias("p")).collect())


def test_replay(spark):
    rows = [(1, 1, 10, "raise", "", "high"), (1, 2, 11, "status", "done", ""), (1, 3, 12, "raise", "", ""), (2, 4, 13, "status", "done", ""), (3, 5, 14, "raise", "", "low"), (3, 6, 15, "status", "ignored", ""), (3, 7, 16, "raise", "", "medium"), (3, 8, 17, "status", "bogus", "")]
    state = {r.id: tuple(r)[1:] for r in recommendations.replay(spark.createDataFrame(rows, "id int, seq int, ts long, event string, status string, severity string"), ["id"]).collect()}
    assert state == {1: ("open", 2, 10, 12, "high"), 3: ("ignored", 2, 14, 16, "medium")}


def test_health_and_trend(spark):
    rows = [("d", 1, p, 80.0) for p in ("technical", "content", "authority", "cwv", "ai_search")] + [("d", 2, "technical", 80.0), ("d", 2, "content", 70.0)]
    h = history.health(spark.createDataFrame(rows, "domain string, ts int, pillar string, value double"), ["domain", "ts"])
    assert {r.ts: r.health for r in h.collect()} == {1: 80.0, 2: 75.0}
    more = spark.createDataFrame([("d", i, float(i)) for i in range(20)] + [("e", 1, 1.0)], "domain string, ts int, health double")
    t = history.trend(more, "domain", "ts").collect()
    assert len(t) == 12 and {r.domain for r in t} == {"d"} and min(r.ts for r in t) == 8


def test_asof(spark):
    left = spark.createDataFrame([("u", 5), ("u", 10), ("v", 1)], "k string, t int")
    right = spark.createDataFrame([("u", 5, 1.0), ("u", 7, 2.0), ("u", 12, 3.0)], "k string, t int, x double")
    assert {(r.k, r.t): (r.before, r.after) for r in history.asof(left, right, ["k"], "t", "x").collect()} == {("u", 5): (1.0, 2.0), ("u", 10): (2.0, 3.0), ("v", 1): (None, None)}
    assert [one(spark, history.impact(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((5, 3), (3, 5), (3, 3))] == ["improved", "worse", "no_change"]


def test_drift_is_antisymmetric(spark):
    a = spark.createDataFrame([("x", 1), ("y", 5), ("z", 9)], "keyword string, position int")
    b = spark.createDataFrame([("y", 2), ("z", 9), ("w", 4)], "keyword string, position int")
    there, back = ({r.keyword: r.change for r in history.drift_rankings(p, q, ["keyword"]).collect()} for p, q in ((a, b), (b, a)))
    assert there == {"x": "lost", "y": "up", "z": "same", "w": "gained"}
    assert back == {"x": "gained", "y": "down", "z": "same", "w": "lost"}


def test_rank_loss(spark):
    old = spark.createDataFrame([("s", "a", 12, 50000), ("s", "b", 3, 0), ("s", "c", 30, 9), ("s", "d", 4, 10)], "site string, keyword string, position int, volume long")
    new = spark.createDataFrame([("s", "b", 14), ("s", "d", 5)], "site string, keyword string, position int")
    got = {r.keyword: (r.severity, r.clicks_at_risk, r["rank"]) for r in history.rank_losses(old, new, "site").collect()}
    assert got == {"a": ("medium", 200, 2), "b": ("high", 0, 1)}


GOOD = {
    "status": 200, "noindex": False, "first_h2_para_words": 60, "h2": ["How does it work?", "What", "Why"], "h2_count": 3, "meta_author": "A", "has_rel_author": False,
    "schema_types": ["Article"], "jsonld_has_dates": True, "time_elements": 0, "external_link_count": 3, "list_count": 2, "word_count": 1800, "number_density": 12.0,
    "images_total": 2, "images_missing_alt": 0, "canonical": "https://a",
}


@pytest.mark.parametrize("change,score", [({}, 105), ({"noindex": True}, 0), ({"status": 404}, 0), ({"external_link_count": 1}, 101), ({"first_h2_para_words": 20}, 93), ({"first_h2_para_words": 250}, 97)])
def test_citation(spark, change, score):
    schema = "status int, noindex boolean, first_h2_para_words int, h2 array<string>, h2_count int, meta_author string, has_rel_author boolean, schema_types array<string>, jsonld_has_dates boolean, time_elements int, external_link_count int, list_count int, word_count int, number_density double, images_total int, images_missing_alt int, canonical string"
    df = spark.createDataFrame([tuple((GOOD | change).values())], schema).withColumn("k", F.lit(1))
    assert scoring.citation_scores(df, ["k"]).first().score == score


def test_page_types_and_consensus(spark):
    schema = "url string, title string, h1 array<string>, h2 array<string>, schema_types array<string>, tables_total int, tel_links int, form_count int, time_elements int, meta_author string, cta_count int, word_count int"
    rows = [("https://a/shop/x", "Buy x", [], [], ["Product"], 0, 0, 0, 0, "", 0, 0), ("https://a/blog/y", "y", [], [], ["Article"], 0, 0, 0, 1, "", 0, 2000), ("https://a/", "x vs y", [], [], [], 1, 0, 0, 0, "", 0, 0), ("https://a/z", "plain", [], [], [], 0, 0, 0, 0, "", 0, 0)]
    got = {r.url: (r.page_type, r.confidence) for r in scoring.page_type(spark.createDataFrame(rows, schema), ["url"]).collect()}
    assert got == {"https://a/shop/x": ("product", "high"), "https://a/blog/y": ("article", "high"), "https://a/": ("comparison", "high"), "https://a/z": ("unknown", "low")}
    results = spark.createDataFrame([("q", i, "product" if i < 6 else "article") for i in range(8)], "q string, position int, page_type string")
    c = scoring.consensus(results, "q").first()
    assert (c.dominant, c.share, c.verdict, c.confidence) == ("product", 0.75, "strong_consensus", "high")
    assert one(spark, scoring.alignment(F.col("t"), F.col("d"), F.lit("strong_consensus")), t="article", d="product") == 35
    assert one(spark, scoring.keyword_candidate(F.array(F.col("t")), F.lit("")), t="Coffee Grinder Guide") == "coffee grinder"


def test_saved_counts_events_of_pages_that_share_an_address_once(spark):
    state = spark.createDataFrame([("u", "a", "done"), ("u", "a", "ignored"), ("u", "b", "open"), ("v", "c", "accepted")], "url string, rule_id string, status string")
    found = spark.createDataFrame([("u", "a"), ("w", "d")], "url string, rule_id string")
    ran = spark.createDataFrame([("a",), ("b",), ("d",)], "rule_id string")
    events = recommendations.save_lint(state, found, spark.createDataFrame([("u",), ("w",)], "url string"), ran)
    # a is raised beside both its states: reopened and ignored; with two states each, the reopened one is open twice
    assert tuple(recommendations.saved(state, events).first()) == (3, 1, 1, 4)


def test_a_word_of_a_page_type_begins_behind_any_letter_but_ascii(spark):
    """As in the twins, whose word boundary knows ASCII letters only."""
    schema = "url string, title string, h1 array<string>, h2 array<string>, schema_types array<string>, tables_total int, tel_links int, form_count int, time_elements int, meta_author string, cta_count int, word_count int"
    rows = [(f"https://a/{n}", t, [], [], [], 0, 0, 0, 0, "", 0, 0) for n, t in enumerate(("Ver übest mit", "Ver einbest mit", "shopé", "shopx", "toolß"))]
    got = {r.url[-1]: r.page_type for r in scoring.page_type(spark.createDataFrame(rows, schema), ["url"]).collect()}
    assert got == {"0": "comparison", "1": "unknown", "2": "product", "3": "unknown", "4": "tool"}


def test_spa_and_render(spark):
    shell = '<div id="root"></div><script src="/_next/x.js"></script>' + "<!--" + "x" * 11_000 + "-->"
    static = "<p>" + "word " * 300 + "</p>"
    got = {r.k: (r.verdict, r.should_render) for r in scoring.spa_verdict(spark.createDataFrame([(1, shell), (2, static)], "k int, html string"), ["k"]).collect()}
    assert got == {1: ("spa", True), 2: ("static", False)}
    side = lambda n, t: spark.createDataFrame([("u", n, t)], "url string, word_count int, schema_types array<string>")
    r = pages.render_diff(side(50, []), side(200, ["Article"]), "url").first()
    assert (r.ratio, r.verdict, r.only_rendered) == (4.0, "significant", ["Article"])


def test_urls(spark):
    base = "https://A.example/x/y.html?q#f"
    cases = {"/r": "https://A.example/r", "r#g": "https://A.example/x/r", "//b/z": "https://b/z", "mailto:x": "mailto:x", "?k": "https://A.example/x/y.html?k", "#t": "https://A.example/x/y.html?q"}
    for href, expected in cases.items():
        assert one(spark, X.joined_url(F.col("b"), F.col("h")), b=base, h=href) == expected
    assert one(spark, X.normal_url(F.col("u")), u="HTTP://Ex.COM:80?a=1#x") == "http://ex.com:80/?a=1"
    assert one(spark, X.slug(F.col("u")), u="--Hello, World! ") == "hello-world"


def test_gate(spark):
    side = lambda s, r: spark.createDataFrame([("p", s, r)], "path string, score int, rules array<string>")
    got = recommendations.gate(side(90, ["a"]), side(50, ["a", "b"])).first()
    assert got.reasons == ["below_min", "dropped", "new_findings"] and got.new_rules == ["b"]
    assert recommendations.gate(side(46, ["a"]), side(100, [])).count() == 0


def test_visibility(spark):
    m = one(spark, visibility.mention(F.col("t"), F.lit("Acme"), F.lit("acme.org")), t="x" * 200 + " I like ACME a lot")
    assert m.mentioned and m.excerpt.endswith("ACME a lot") and len(m.excerpt) <= 164
    df = spark.createDataFrame([("p", True), ("p", False), ("p", True), ("p", True), ("p", None)], "k string, mentioned boolean")
    assert tuple(visibility.rate(df, "k").first()) == ("p", 4, 3, 75.0)
    s = visibility.sources(spark.createDataFrame([(1, "see https://a.b/c and https://d.e, https://a.b/c")], "k int, text string"), "k")
    assert sorted(r.url for r in s.collect()) == ["https://a.b/c", "https://d.e,"]
    j = visibility.json_strings(spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "n": 1}'), (2, "broken"), (3, None)], "k int, body string"), "k", "body")
    assert [(r.k, r.pos, r.value) for r in j.orderBy("k", "pos").collect()] == [(1, 0, "x"), (1, 1, "y")]


def test_fixes(spark):
    assert one(spark, fixes.meta_draft(F.col("t")), t="word " * 40).endswith("word") and one(spark, fixes.meta_draft(F.col("t")), t="short. ") == "short"
    crumbs = one(spark, fixes.breadcrumb(F.col("u")), u="https://a.b/one-two/three.html")
    assert (crumbs["@context"], crumbs["@type"]) == ("https://schema.org", "BreadcrumbList")
    assert [(c.name, c.position, c.item) for c in crumbs.itemListElement] == [("Home", 1, "https://a.b"), ("One Two", 2, "https://a.b/one-two"), ("Three.Html", 3, "https://a.b/one-two/three.html")]
    assert [c.name for c in one(spark, fixes.breadcrumb(F.col("u")), u="https://a.b/-/it's_2nd/").itemListElement] == ["Home", "Page", "It'S 2Nd"]
    html = "<html><head><title>old</title></head></html>"
    patched = lambda r, p: one(spark, fixes.apply_patch(F.col("h"), F.lit(r), F.lit(p)), h=html)
    assert patched("missing-title", "<title>$1 new</title>") == "<html><head><title>$1 new</title></head></html>"
    assert patched("missing-html-lang", 'lang="en"') == '<html lang="en"><head><title>old</title></head></html>'
    assert "width=device-width" in patched("missing-viewport", fixes.TEMPLATES["missing-viewport"]) and patched("unknown", "x") == html
    text, missing = fixes.json_ld("Article", {"headline": "H", "author.name": "A", "tags": "a, b", "n": "3", "ok": "true"})
    assert '"author": {"name": "A"}' in text and '"tags": ["a", "b"]' in text and missing == ["datePublished", "image"]


def test_ledgers(spark):
    l = spark.createDataFrame([(0, "serp", 100), (86400 * 6, "serp", 10), (86400 * 7, "kd", 1)], "ts long, command string, cost long")  # noqa: E741
    r = history.cost_periods(l, 86400 * 7).first()
    assert (r.today, r.week, r.month, r.all_time) == (11.0, 111.0, 111.0, 111)
    cache = spark.createDataFrame([("a", "serp", 0, 5), ("a", "serp", 900, 6), ("b", "whois", 0, 7), ("c", "odd", 0, 1)], "key string, command string, created long, size long")
    assert {r.key: r.fresh for r in history.fresh(cache, 86401).collect()} == {"a": False, "b": True, "c": False}


def test_set_diff_and_sitemaps(spark):
    xml = spark.createDataFrame([("s", "<urlset><url><loc> https://a/x?p=1&amp;q=2 </loc></url><url><loc>https://a/y</loc></url></urlset>")], "source string, xml string")
    assert [r.loc for r in pages.sitemap_locations(xml).collect()] == ["https://a/x?p=1&q=2", "https://a/y"]
    assert pages.soft404(spark.createDataFrame([("a", 200, "text/HTML"), ("a", 404, "text/html")], "site string, status int, content_type string")).first().hits == 1


def test_sources(spark, tmp_path):
    (tmp_path / "site" / "deep").mkdir(parents=True)
    (tmp_path / "site" / "deep" / "a.html").write_text("<title>x</title>")
    assert readers.html_files(spark, str(tmp_path / "site")).first().html == "<title>x</title>"
    (tmp_path / "log.json").write_text('{"ts": 1, "command": "serp", "cost": 0.5}\nbroken\n{"ts": 2, "command": "kd", "cost": 1}\n')
    assert readers.json_lines(spark, str(tmp_path / "log.json"), readers.COSTS).count() == 2
    (tmp_path / "snaps").mkdir()
    (tmp_path / "snaps" / "170.json").write_text('{"scores": {"technical": 5.0}}')
    (tmp_path / "snaps" / "note.json").write_text('{"scores": {"technical": 9.0}}')
    assert [r.ts for r in readers.snapshots(spark, str(tmp_path / "snaps"), "scores map<string,double>").collect()] == [170]
    flat = '{"result": [{"items": [{"keyword": "k", "rank_group": 0, "rank_absolute": 4, "url": "u"}]}]}'
    deep = '{"result": [[{"items": [{"keyword": "k", "rank_group": 3, "url": "u"}]}]]}'
    got = readers.ranking_items(spark.createDataFrame([(flat,), (deep,)], "payload string")).collect()
    assert sorted(r.position for r in got) == [3, 4]
    errors = readers.task_errors(spark.createDataFrame([('{"tasks": [{"status_code": 20000}, {"status_code": 40501, "status_message": "bad"}]}',)], "payload string"))
    assert [tuple(r) for r in errors.collect()] == [(40501, "bad")]
    bodies = readers.indexnow_payload(spark.createDataFrame([(f"u{i}",) for i in range(50)], "url string"), "h", "k", limit=10).collect()
    assert sum(r.n for r in bodies) == 50 and max(r.n for r in bodies) <= 10
    e = readers.project_entities(spark, {"entities": [{"name": "A", "type": "Person"}, {"name": ""}]})
    assert [r.known for r in e.collect()] == [True, False]
    assert one(spark, readers.normalise_location(F.col("l")), l=" UK ") == "United Kingdom"
    crawl = tmp_path / "crawl.json"
    crawl.write_text('{"summary": {}, "pages": [{"url": "a", "status": 200, "internal_outlinks": [{"url": "b", "anchor": "B"}]}]}')
    assert [tuple(r) for r in readers.edges_of(readers.crawl_file(spark, str(crawl))).collect()] == [("a", 0, "b", "B")]
    readers.write_log(spark.createDataFrame([("d", 1)], "domain string, ts long"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_crawl_waves_budget_and_robots(spark):
    from pagelode.operators import crawl, reports

    u = lambda x: f"https://a/{x}"
    table = spark.createDataFrame([(u(x), 404 if x == "dead" else 200) for x in ("", "x", "y", "z", "dead", "admin/q", "far")], "url string, status int")
    links = spark.createDataFrame([(u(a), i, u(b)) for i, (a, b) in enumerate([("", "y"), ("", "x"), ("", "admin/q"), ("x", "z"), ("y", "dead"), ("dead", "far"), ("admin/q", "far"), ("z", "")])], "src string, pos int, dst string")
    rules = [(r.prefix, r.allow) for r in crawl.robots_rules(spark, "User-agent: *\nDisallow: /admin # closed\nAllow: /admin/open\n\nUser-agent: other\nDisallow: /").collect()]
    assert rules == [("/admin", False), ("/admin/open", True)]
    got = crawl.crawl(table, links, u(""), robots=rules).orderBy("depth", "place").collect()
    assert [(r.url.rpartition("a/")[2] if "admin" not in r.url else "admin", r.depth, r.status) for r in got] == [("", 0, 200), ("y", 1, 200), ("x", 1, 200), ("admin", 1, None), ("dead", 2, 404), ("z", 2, 200)]
    few = crawl.crawl(table, links, u(""), max_pages=3)
    assert few.count() == 3 and crawl.truncated(few, links)
    f = spark.createDataFrame([("a:b,c", "r", "cat", "medium")], "url string, rule_id string, category string, severity string")
    assert reports.annotation(f).first().line == "::warning file=a%3Ab%2Cc,title=r::cat r"
    assert reports.text_line(f).first().line == "[MEDIUM] r (cat)"


def test_near_duplicates_compare_whole_texts(spark, tmp_path):
    body = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))
    long = body("same", 900)  # beyond 5,000 characters
    rows = [(1, f"{long} {body('a', 900)}"), (2, f"{long} {body('b', 900)}"), (3, f"{body('x', 100)} {body('rest', 3000)}"), (4, f"{body('y', 100)} {body('rest', 3000)}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.a, r.b) for r in catalog.near_dup_pairs(spark, str(tmp_path)).collect()] == [(3, 4)]
    assert catalog.near_dup_classes(spark, str(tmp_path)).count() == 0


def test_every_supplier_is_ranked(spark):
    at = "/root/testdata/sf0.01"
    sold = spark.read.parquet(f"{at}/lineitem.parquet").where(F.year("l_shipdate") == 1998)
    assert inputs.supplier_rankings(spark, at, 1998).select("supplier").distinct().count() == sold.select("l_suppkey").distinct().count() == 100


def test_every_part_is_ranked(spark):
    at = "/root/testdata/sf0.01"
    sold = spark.read.parquet(f"{at}/lineitem.parquet").where(F.year("l_shipdate") == 1998).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).collect()
    expected = [f"part {r.l_partkey}" for r in sorted(sold, key=lambda r: (-r.q, r.l_partkey))]
    got = inputs.rankings(spark, at, 1998).orderBy("position").collect()
    assert [r.keyword for r in got] == expected and [r.position for r in got] == list(range(1, len(expected) + 1))


def test_depth_beyond_fifty_links(spark):
    n = 53
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.depths(nodes, edges, 0).agg(F.max("depth")).first()[0] == n - 1


def test_response_items_at_any_depth(spark):
    import json

    node = {"items": [{"url": "last"}, 3, None]}
    for level in range(12):
        node = {"items": [{"url": f"own {level}"}], "results": [[node], "text"], "tasks": {"items": [{"url": f"task {level}"}]}}
    rows = [(1, json.dumps(node)), (2, "no json"), (3, None), (4, json.dumps([node["tasks"], [[node["tasks"]]]])), (5, json.dumps({"items": {"url": "no list"}}))]
    found = payloads.serp_items(payloads.opened(spark.createDataFrame(rows, "grp int, payload string")), ["grp"])
    got = {}
    for r in found.orderBy("grp", "place").select("grp", F.to_json("item").alias("i")).collect():
        got.setdefault(r.grp, []).append(json.loads(r.i)["url"])
    assert got == {1: [*(f"own {n}" for n in range(11, -1, -1)), "last", *(f"task {n}" for n in range(12))], 4: ["task 11"] * 2}


def classes_by_hand(rows, least=0.9, words=5):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)))
    label = {i: i for i in sets}
    heads = {}
    for i in sorted(sets):
        heads.setdefault(sets[i], i)
        for j in sorted(sets):
            if j < i and label[i] != label[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return {(i, heads[sets[i]], label[i]) for i in sets}


def test_near_duplicate_classes(spark, monkeypatch):
    """Chains of near copies, exact copies, cut and empty texts, and lists that need several rounds."""
    import random

    from pagelode.operators import similar

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    bases = [[rnd.choice(words) for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(160):
        t = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 1, 2, 3])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        t = t[: rnd.randrange(1, 120)] if rnd.random() < 0.1 else t
        rows.append((i, None if i % 37 == 0 else "" if i % 41 == 0 else " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_hand(rows)
    assert {tuple(r) for r in similar.near_duplicate_classes(docs).collect()} == want
    assert len({c for *_, c in want}) > 10 and any(h != c for _, h, c in want)
    monkeypatch.setattr(similar, "HEAVY", 4)
    assert {tuple(r) for r in similar.near_duplicate_classes(docs.limit(90), pivots=1).collect()} == classes_by_hand(rows[:90])


def test_connected_labels(spark):
    from pagelode.operators import similar

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (130, 129), (200, 201)]
    got = {r.node: r.label for r in similar.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{k: 100 for k in range(101, 131)}, 201: 200}
    assert similar.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_layout_of_a_hub_and_its_children(spark):
    import math

    from pagelode.operators import layout

    tree = [("home", 0, None), *((f"k{n:03}", 1, "home") for n in range(200)), ("deep a", 2, "k007"), ("deep b", 2, "k007"), ("deeper", 3, "deep b")]
    links = spark.createDataFrame([("k007", 9), ("k100", 5), ("deep b", 3), ("deep a", 1)], "node string, inlinks long")
    lost = spark.createDataFrame([("z",), ("y",)], "node string")
    got = {r.node: (r.depth, r.x, r.y) for r in layout.layout(spark.createDataFrame(tree, "node string, depth int, parent string"), lost, links).collect()}
    order = ["k007", "k100", *(f"k{n:03}" for n in range(200) if n not in (7, 100))]
    step = 2 * math.pi / 200
    angles = {n: (1, step * i) for i, n in enumerate(order)}
    angles |= {"deep b": (2, -step * 0.9 / 4), "deep a": (2, step * 0.9 / 4), "deeper": (3, -step * 0.9 / 4)}
    want = {n: (d, 550 + (150 + 130 * d) * math.cos(a), 550 + (150 + 130 * d) * math.sin(a)) for n, (d, a) in angles.items()}
    want |= {"home": (0, 550, 550), "y": (-1, 550 + 670, 550), "z": (-1, 550 - 670, 550)}
    assert set(got) == set(want)
    assert all(got[n][0] == want[n][0] and got[n][1:] == pytest.approx(want[n][1:]) for n in want)


def test_pairs_move_prefixes_and_not_whole_sets(spark):
    """Texts that nothing is like cost a few index entries, and all pairs are still found."""
    from pagelode.operators import similar

    rows = [(n, " ".join(f"w{n}x{k}" for k in range(200))) for n in range(40)] + [(40, "w0x0 other " + " ".join(f"w0x{k}" for k in range(2, 200))), (41, None), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, heads = similar.near_duplicate_pairs(docs, sample=None)
    assert [(r.a, r.b, round(r.similarity, 4)) for r in pairs.collect()] == [(0, 40, round(194 / 198, 4))]
    assert {(r.doc_id, r.head) for r in heads.collect()} == {(n, n) for n in range(42)} | {(42, 41)}
    sets = similar.shingle_sets(docs)
    assert similar.prefix_index(sets, docs.select("doc_id"), 0.9).count() == 41 * 20 + 2


def test_near_duplicate_sets_are_worked_out_once(spark, monkeypatch):
    """Rounds and passes of the classes read stored sets, and lists hold shared shingles only."""
    from pagelode.operators import similar

    made, shingle_sets = [], similar.shingle_sets
    monkeypatch.setattr(similar, "shingle_sets", lambda *a, **k: made.append(1) or shingle_sets(*a, **k))
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "end"])), (2, " ".join(words)), (3, " ".join(f"v{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in similar.near_duplicate_classes(docs).collect()} == classes_by_hand(rows)
    assert len(made) == 1
    sets = shingle_sets(docs)
    held = similar.lists(sets, docs.select("doc_id"), 0.9).groupBy("g").agg(F.countDistinct("doc_id").alias("n"))
    assert held.where("n < 2").isEmpty() and not held.isEmpty()
