"""Further named queries: completed recommendations, saved lint runs, API responses, visibility, reports and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelode.functions import words as W
from pagelode.operators import fixes, graph, history, impact, pages, recommendations, reports, scoring, visibility
from pagelode.plans import catalog, inputs
from pagelode.plans.catalog import picked
from pagelode.plans.inputs import read
from pagelode.sources import payloads, readers

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- impact of completed recommendations


def impact_rows(spark, sf_dir):
    return impact.report(inputs.completed_recs(spark, sf_dir), inputs.ranking_snapshots(spark, sf_dir), inputs.epoch("1999-06-01"), days=1000)


@query
def impact_report(spark, sf_dir):
    return impact_rows(spark, sf_dir)


@query
def impact_counts(spark, sf_dir):
    return impact.counts(impact_rows(spark, sf_dir))


# -- recommendations


def lint_state(spark, sf_dir):
    """Rule findings raised earlier: two of three pairs of page and rule, in all statuses."""
    i = F.col("page_id") + F.col("n")
    pairs = read(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.array(*[F.lit(r.id) for r in catalog.rules.load_rules()])).alias("n", "rule_id"))
    return pairs.where(i % 3 != 0).select("url", "rule_id", picked(W.STATUSES, i).alias("status"))


def saved_run(spark, sf_dir):
    """State before, and the events of saving a run of all rules over all pages."""
    ran = spark.createDataFrame([(r.id,) for r in catalog.rules.load_rules()], "rule_id string")
    state = lint_state(spark, sf_dir)
    return state, recommendations.save_lint(state, catalog.found(spark, sf_dir), read(spark, sf_dir, "pages"), ran)


@query
def lint_save(spark, sf_dir):
    return recommendations.saved(*saved_run(spark, sf_dir))


@query
def lint_save_events(spark, sf_dir):
    return saved_run(spark, sf_dir)[1]


def detailed_events(spark, sf_dir):
    """The recommendation log with details that are empty now and then, and notes."""
    i = F.col("seq")
    e = inputs.recommendation_events(spark, sf_dir)
    return e.withColumns({"why": F.when(i % 3 == 0, F.concat(F.lit("why "), (i % 7).cast("string"))).otherwise(""), "auto_fixable": i % 5 == 0, "note": F.when(i % 4 == 1, F.concat(F.lit("note "), (i % 9).cast("string"))).otherwise("")})


@query
def rec_details(spark, sf_dir):
    return recommendations.replay(detailed_events(spark, sf_dir), ["id"]).select("id", "status", "why", "auto_fixable", "last_note")


@query
def rec_fixable(spark, sf_dir):
    return recommendations.summary(recommendations.replay(detailed_events(spark, sf_dir), ["id"])).select("total", "actionable", "auto_fixable_open")


@query
def rec_list(spark, sf_dir):
    """Recommendations that aren't closed, those that are done, and all high ones, as lists."""
    s = catalog.rec_state(spark, sf_dir)
    lists = {"open": recommendations.listed(s), "done": recommendations.listed(s, status="done"), "high": recommendations.listed(s, severity="high", include_closed=True)}
    out = None
    for name, rows in lists.items():
        part = rows.select(F.lit(name).alias("list"), "id", "status", "severity")
        out = part if out is None else out.unionByName(part)
    return out


@query
def rec_history(spark, sf_dir):
    """The log of one recommendation."""
    return recommendations.history(inputs.recommendation_events(spark, sf_dir), 7).select("id", "seq", "event", "status")


@query
def rec_wins(spark, sf_dir):
    """The latest finished recommendations of each severity."""
    return recommendations.wins(catalog.rec_state(spark, sf_dir), "severity").select("severity", "rank", "id", "status")


# -- rankings


def repeated_rankings(spark, sf_dir, year):
    """Rankings in which each keyword of a third comes twice, the later one five places down."""
    r = inputs.rankings(spark, sf_dir, year).withColumn("seq", F.lit(0))
    return r.unionByName(r.where("position % 3 = 0").select("keyword", (F.col("position") + 5).alias("position"), "volume", F.lit(1).alias("seq")))


@query
def drift_repeats(spark, sf_dir):
    return history.drift_rankings(repeated_rankings(spark, sf_dir, 1998), repeated_rankings(spark, sf_dir, 1999), ["keyword"])


@query
def drift_moves(spark, sf_dir):
    """The report's first twenty keywords that rose, by how far."""
    return history.drift_moves(catalog.QUERIES["drift_rankings"](spark, sf_dir), "up", ["keyword"]).limit(20)


@query
def watch_health(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("site"), F.unix_timestamp(F.date_trunc("day", "ts")).alias("ts")).agg(F.round(F.avg(F.col("user_id")), 1).alias("health"))
    return reports.health_delta(e, "site")


@query
def cache_expired(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir).withColumnRenamed("ts", "created")  # noqa: E741
    return history.expired(l, catalog.latest(l, "created"), 7).groupBy("command").agg(F.count("*").alias("n"))


@query
def drift_sections(spark, sf_dir):
    """Metrics of three sections, of which both versions have a value and the values differ."""
    line = read(spark, sf_dir, "lineitem")

    def side(year):
        parts = {"scores": (read(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority"), "backlinks": (line, "l_shipdate", "l_linestatus"), "mentions": (line, "l_shipdate", "l_returnflag")}
        out = None
        for section, (rows, day, key) in parts.items():
            part = rows.where(F.year(day) == year).groupBy(F.lit(section).alias("section"), F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value"))
            out = part if out is None else out.unionByName(part)
        return out

    return history.drift_values(side(1997), side(1998), ["section", "key"])


@query
def cost_running(spark, sf_dir):
    return history.running_cost(inputs.ledger(spark, sf_dir))


# -- API responses


@query
def payload_rankings(spark, sf_dir):
    return payloads.rank_items(payloads.opened(inputs.ranking_payloads(spark, sf_dir)))


@query
def payload_backlinks(spark, sf_dir):
    return payloads.backlink_summary(payloads.opened(inputs.backlink_payloads(spark, sf_dir)), ["k"])


@query
def payload_volumes(spark, sf_dir):
    """Volumes of all names: a snapshot's for every third, else the fetched one."""
    names = read(spark, sf_dir, "supplier").select(F.regexp_replace("s_name", "#", " ").alias("keyword"), F.col("s_suppkey").alias("k"))
    snapshot = names.where("k % 3 = 0").select("keyword", F.lit(5.0).alias("volume"))
    return payloads.merged_volumes(names, snapshot, payloads.volume_items(payloads.opened(inputs.volume_payloads(spark, sf_dir))))


@query
def payload_errors(spark, sf_dir):
    return payloads.task_errors(payloads.opened(inputs.search_payloads(spark, sf_dir)), ["grp"])


@query
def ai_overviews(spark, sf_dir):
    p = payloads.opened(inputs.search_payloads(spark, sf_dir))
    return visibility.overview(p, ["grp"], "Supplier 000000027", "d3.example").withColumn("cited_domains", F.array_join("cited_domains", "|"))


def search_items(spark, sf_dir):
    return payloads.serp_items(payloads.opened(inputs.search_payloads(spark, sf_dir)), ["grp"])


@query
def serp_nested(spark, sf_dir):
    """Addresses of the items of deep responses, numbered in the order in which a response reads."""
    found = payloads.serp_items(payloads.opened(inputs.nested_payloads(spark, sf_dir)), ["grp"])
    at = F.row_number().over(Window.partitionBy("grp").orderBy("place"))
    return found.select("grp", at.cast("int").alias("nr"), F.try_variant_get("item", "$.url", "string").alias("url"))


@query
def serp_features(spark, sf_dir):
    return scoring.features(search_items(spark, sf_dir), ["grp"])


@query
def serp_organic(spark, sf_dir):
    return scoring.organic(search_items(spark, sf_dir), ["grp"]).select("grp", "url", "title")


def search_consensus(spark, sf_dir):
    o = scoring.organic(search_items(spark, sf_dir), ["grp"])
    none = F.array().cast("array<string>")
    blank = {"h1": none, "h2": none, "schema_types": none, "meta_author": F.lit(""), **{c: F.lit(0) for c in ("tables_total", "cta_count", "form_count", "word_count", "tel_links", "time_elements")}}
    typed = scoring.page_type(o.withColumns(blank), ["grp", "place"])
    return scoring.consensus(typed.withColumnRenamed("place", "position"), "grp")


@query
def serp_types(spark, sf_dir):
    return search_consensus(spark, sf_dir)


@query
def sxo_mismatch(spark, sf_dir):
    """A page of a type by its group's number beside each group's results."""
    c = search_consensus(spark, sf_dir)
    status = scoring.fit(picked(("article", "tool", "landing"), F.col("grp")), F.col("dominant"), F.col("verdict"))
    rows = c.select("grp", F.when(F.col("grp") % 2 == 0, F.concat(F.lit("Best Word "), F.col("grp").cast("string"), F.lit("!"))).alias("keyword"), picked(("article", "tool", "landing"), F.col("grp")).alias("page_type"), status.alias("status"), "dominant", "confidence")
    return scoring.mismatch(rows, ["grp"])


@query
def locations(spark, sf_dir):
    names = [*payloads.LOCATIONS, " U.K. ", "USA", "France", " paris", ""]
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("k"), payloads.location(picked(names, k)).alias("location"))


# -- visibility


@query
def prompt_visible(spark, sf_dir):
    """Saved prompts of the newer and the older shape."""
    i = F.col("conv_id")
    true = lambda c: F.when(c, "true").otherwise("false")
    new = F.concat(F.lit('{"llm": [{"mentioned": '), true(i % 3 == 0), F.lit('}, {"mentioned": '), true(i % 5 == 0), F.lit('}], "ai_overview": '), F.when(i % 2 == 0, F.concat(F.lit('{"mentioned": '), true(i % 7 == 0), F.lit("}"))).otherwise("null"), F.lit("}"))
    old = F.concat(F.lit('{"mentioned": '), true(i % 4 == 0), F.lit("}"))
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select("conv_id", visibility.prompt_mentioned(F.parse_json(F.when(i % 6 == 5, old).otherwise(new))).alias("mentioned"))


@query
def annotated_sources(spark, sf_dir):
    i = F.col("conv_id")
    name = lambda m: F.concat(F.lit('{"url": "https://s'), (i % m).cast("string"), F.lit('.example", "title": "T'), (i % m).cast("string"), F.lit('"}'))
    text = F.when(i % 11 == 0, "broken {").otherwise(F.concat(F.lit('{"a": [{"annotations": ['), name(3), F.lit(", null, "), name(4), F.lit(']}], "b": {"c": {"annotations": ['), name(3), F.lit(", "), name(5), F.lit("]}}}")))
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return visibility.annotated_sources(c.withColumn("payload", text), "conv_id")


# -- pages and reports


@query
def security_fields(spark, sf_dir):
    i = F.col("page_id")
    none = F.lit(None).cast("string")
    names = F.array(F.when(i % 2 == 0, "Strict-Transport-Security").otherwise(none), F.when(i % 3 == 0, "content-security-policy").otherwise(none), F.when(i % 5 == 0, "X-Frame-Options").otherwise(none), F.when(i % 7 == 0, "x-content-type-options").otherwise(none))
    headers = F.when(i % 13 != 0, F.map_from_entries(F.transform(F.array_compact(names), lambda n: F.struct(n, F.lit("on")))))
    return pages.with_security(read(spark, sf_dir, "pages").select("page_id", headers.alias("headers"))).drop("headers")


@query
def sitemap_report(spark, sf_dir):
    """Report over pages of which some aren't fetched, some fail and some aren't listed."""
    p = read(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 9 == 4, F.lit(None).cast("int")).when(F.col("page_id") % 5 == 1, 500).otherwise(200)
    name = F.concat(F.lit("https://site.example/"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    crawled = p.where("page_id % 2 = 0").select(F.concat(name, F.when(F.col("page_id") % 4 == 0, "/").otherwise("")).alias("url"), status.alias("status"))
    return pages.sitemap_report(crawled, p.where("page_id % 3 <> 2").select(name.alias("url")))


@query
def sitemap_urls(spark, sf_dir):
    """Addresses below sitemaps, of which some are indexes."""
    i = F.col("page_id")
    n = i.cast("string")
    loc = lambda *parts: F.concat(F.lit("<url><loc> "), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit(" </loc></url>"))
    p = read(spark, sf_dir, "pages")
    index = F.concat(loc("https://a/Sitemap-", n, ".xml"), loc("https://a/page-", n), *[loc(f"https://a/sitemap-none{k}.xml") for k in range(10)], loc("https://a/sitemap-late-", n, ".xml"))
    roots = p.select(n.alias("source"), F.when(i % 3 == 0, index).otherwise(F.concat(loc("https://b/", n), loc("https://b/x"))).alias("xml"))
    children = p.select(F.concat(F.lit("https://a/Sitemap-"), n, F.lit(".xml")).alias("source"), loc("https://c/", n).alias("xml"))
    late = p.select(F.concat(F.lit("https://a/sitemap-late-"), n, F.lit(".xml")).alias("source"), loc("https://late/", n).alias("xml"))
    return pages.sitemap_urls(roots, children.unionByName(late))


@query
def mixed_depths(spark, sf_dir):
    """Labels of a graph's picture: the sixteen pages with most inlinks, and their size."""
    top = graph.top(catalog.QUERIES["link_degree"](spark, sf_dir), "inlinks", 16)
    return top.select("node", "inlinks", (5 + F.least(F.lit(14.0), F.sqrt("inlinks") * 2.2)).alias("size"))


@query
def report_figures(spark, sf_dir):
    """Severities and scores found in reports, made from suppliers."""
    k = F.col("s_suppkey")
    n = (k % 130).cast("string")
    rows = F.concat(*[F.repeat(F.lit(f"| {s} | x |\n"), (k % m).cast("int")) for s, m in (("Critical", 3), ("HIGH", 4), ("medium", 2))])
    head = F.when(k % 4 == 0, F.concat(F.lit("Overall: "), n, F.lit("/100"))).when(k % 4 == 1, F.concat(F.lit("we gave "), n, F.lit(" / 100"))).when(k % 4 == 2, F.concat(n, F.lit(".5 out of 100"))).otherwise("none given")
    text = F.concat(F.lit("# Audit\n"), head, F.lit("\n"), rows, F.lit('<span class="a badge b">low</span>'))
    s = reports.severity_counts(text)
    return read(spark, sf_dir, "supplier").select(k.alias("k"), reports.report_score(text).alias("score"), *[s[c].alias(c) for c in ("critical", "high", "medium", "low")])


@query
def report_cells(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit("  a | b\n\n c  "), F.repeat(F.lit("xy "), (k % 60).cast("int")))
    return read(spark, sf_dir, "customer").select(k.alias("k"), reports.cell(text, 90).alias("cell"), reports.cell(F.when(k % 3 == 0, " ")).alias("nothing"), reports.shown_date((k - 1) * 86400).alias("day"), reports.score_colour(k % 101).alias("colour"))


@query
def profile_problems(spark, sf_dir):
    """Profiles made from suppliers, with a missing address, no competitors or half-named entities."""
    k = F.col("s_suppkey")
    entities = F.array(F.struct(F.when(k % 3 != 0, "Name").alias("name"), F.when(k % 5 == 0, " ").otherwise("Person").alias("type")))
    competitors = F.when(k % 4 != 0, F.array(F.lit("rival.example"))).otherwise(F.array(F.lit("")))
    rows = read(spark, sf_dir, "supplier").select(k.alias("client"), F.when(k % 2 == 0, "https://a").alias("url"), competitors.alias("competitors"), entities.alias("entities"))
    return readers.project_problems(rows).withColumn("problems", F.array_join("problems", "|"))


@query
def submission_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    part = lambda m: p.where(F.col("page_id") % m == 0).select(F.concat(F.lit(" "), "url"))
    return readers.submission_urls(part(2), part(3), part(5))


@query
def entity_fields(spark, sf_dir):
    """Properties of the first organisation among entities made from suppliers."""
    k = F.col("s_suppkey")
    e = read(spark, sf_dir, "supplier").select(k.alias("pos"), F.when(k % 3 == 2, "Organization").otherwise("Person").alias("type"), F.regexp_replace("s_name", "#", " ").alias("name"), F.lit("").alias("description"), F.array(F.lit("https://a"), F.lit("https://b")).alias("sameAs"), F.lit("chief").alias("role"))
    return fixes.entity_properties(e, "organization", "https://site.example/")


@query
def labels(spark, sf_dir):
    i = F.col("page_id")
    url = F.concat(picked(("https://", "http://", ""), i), F.lit("site.example"), F.repeat(F.lit("/part"), (i % 13).cast("int")), F.lit("?q=1"))
    return read(spark, sf_dir, "pages").select("page_id", reports.short_url(url).alias("short"), reports.path_label(url).alias("path"), reports.humanised(F.concat(F.lit("missing-H1_of-"), i.cast("string"))).alias("name"))


@query
def crawl_links(spark, sf_dir):
    """Links of made pages as a crawl sees them."""
    from pagelode.functions import html

    r = pages.crawl_links(html.extract_pages(inputs.made_pages(spark, sf_dir)).select("k", "url", "links"))
    return r.select("k", "internal_link_count", "external_link_count", F.array_join(F.transform("internal_outlinks", lambda x: F.concat(x["url"], F.lit(">"), x["anchor"])), "|").alias("internal"))


@query
def loss_recs(spark, sf_dir):
    return history.loss_recommendations(catalog.QUERIES["rank_loss"](spark, sf_dir), "supplier")


@query
def recovered_recs(spark, sf_dir):
    """Rank losses among recommendations of all sources and statuses, resolved by the next year's rankings."""
    old, new = catalog.suppliers(spark, sf_dir)
    part = F.regexp_extract("keyword", "([0-9]+)", 1).cast("long")
    recs = old.select("supplier", part.alias("id"), picked(("skill:watch", "rule:x"), part).alias("source"), F.concat(picked(("rank-loss-", "rank-loss-", "other-"), part), F.col("keyword")).alias("key"), picked(W.STATUSES, part).alias("status"), "keyword", F.when(part % 7 != 0, F.col("position")).alias("was"))
    return history.recovered(history.open_losses(recs, "supplier"), new, "supplier")


@query
def search_console(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit('{"rows": [{"keys": ["q'), k.cast("string"), F.lit('", "/p"], "clicks": '), (k % 9).cast("string"), F.lit(', "impressions": 10, "ctr": 0.5, "position": 1.5}, {"keys": ["r"]}]}'))
    rows = read(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 5 == 0, F.lit('{"rows": null}')).otherwise(text).alias("payload"))
    return payloads.search_rows(payloads.opened(rows))


HREFS = ("../a", "./b?x=1", "../../../c", "d/./e/../f", "?y=2", "#z", "/g/../h/", "//o.example/i", "mailto:m", "j/..", ".")


@query
def joined_links(spark, sf_dir):
    from pagelode.functions import text as X

    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("k"), X.joined_url(F.concat(F.lit("https://s.example/p/q/r"), k.cast("string"), F.lit("?o=1#f")), picked(HREFS, k)).alias("target"))


@query
def name_keys(spark, sf_dir):
    from pagelode.functions import text as X

    name = F.concat(F.lit(" --"), F.upper("p_name"), F.lit("!? "), F.col("p_partkey").cast("string"), F.lit(" and a rather long tail of words that is cut --"))
    domain = F.concat(F.lit(" Shop"), F.col("p_partkey").cast("string"), F.lit(".Example/x y "))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.slug(name).alias("slug"), X.domain_key(domain).alias("domain"), history.cache_key(F.lit("serp"), F.col("p_name")).alias("key"))


@query
def rec_normalised(spark, sf_dir):
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        k.alias("k"), F.lit(" Site.Example ").alias("domain"), F.when(k % 3 != 0, F.concat(F.lit(" u"), (k % 9).cast("string"))).alias("url"), F.when(k % 4 == 0, "Rule:x").when(k % 4 == 1, " ").alias("source"),
        picked(("HIGH", "urgent", "low", None), k).alias("severity"), picked(("sure", "Low", None), k).alias("confidence"), F.concat(F.lit(" Finding "), (k % 5).cast("string"), F.lit(" ")).alias("finding"), F.when(k % 2 == 0, " Key ").alias("key"),
    )
    return recommendations.normalise(rows).select("k", "id", "domain", "url", "source", "severity", "confidence", "finding", "category", "auto_fixable", "status")


@query
def render_changes(spark, sf_dir):
    """Pages before and after scripts ran: more words and schema types for some."""
    k = F.col("p_partkey")
    words = (k % 90 + 10).cast("int")
    p = read(spark, sf_dir, "part")
    raw = p.select("p_partkey", words.alias("word_count"), F.array(F.lit("WebPage")).alias("schema_types"))
    shown = p.select("p_partkey", (words + k % 60).cast("int").alias("word_count"), F.when(k % 3 == 0, F.array(F.lit("WebPage"), F.lit("Product"))).otherwise(F.array(F.lit("WebPage"))).alias("schema_types"))
    return pages.render_diff(raw, shown, "p_partkey").withColumn("only_rendered", F.array_join("only_rendered", "|"))


@query
def json_texts(spark, sf_dir):
    i = F.col("conv_id").cast("string")
    text = F.when(F.col("conv_id") % 9 == 0, "no json").otherwise(F.concat(F.lit('{"a": "x'), i, F.lit('", "b": [1, "y'), i, F.lit('", {"c": ["z", null]}], "d": {"e": "w"}}')))
    return visibility.json_strings(read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("body", text), "conv_id", "body")


@query
def json_log(spark, sf_dir):
    """An append-only cost log with broken lines, written and read again."""
    from pagelode.operators.store import fresh_path

    to = fresh_path(spark, "log")
    i = F.col("event_id")
    good = F.to_json(F.struct(F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("command"), (i % 100 / 4).alias("cost"), F.lit("d").alias("detail")))
    read(spark, sf_dir, "events").select(F.when(i % 7 == 0, "{broken").otherwise(good).alias("value")).write.text(to)
    return readers.json_lines(spark, to, readers.COSTS).groupBy("command").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


@query
def site_files(spark, sf_dir):
    """Pages as files of a folder, written and read again; other files there are left alone."""
    from pagelode.operators.store import fresh_path

    to = fresh_path(spark, "site")
    p = read(spark, sf_dir, "pages").select(F.regexp_replace("html", "[\\r\\n]+", " ").alias("value"), (F.col("page_id") % 50).alias("part"))
    p.repartition("part").write.partitionBy("part").text(to)
    return readers.html_files(spark, to, "*.txt").select(F.regexp_extract("url", "part=([0-9]+)", 1).cast("int").alias("part"), F.regexp_count("html", F.lit("(?i)<title")).cast("long").alias("titles")).groupBy("part").agg(F.sum("titles").alias("titles"))


@query
def submission_bodies(spark, sf_dir):
    """How many addresses the submission bodies of at most a hundred hold."""
    p = read(spark, sf_dir, "pages").select("url")
    return readers.indexnow_payload(p, "site.example", "key", 100).agg(F.sum("n").alias("urls"), (F.max("n") <= 100).alias("within"), F.count_if(~F.contains("body", F.lit('"host":"site.example"'))).alias("wrong"))


@query
def cost_windows(spark, sf_dir):
    """Sliding weekly costs of a stream whose watermark has passed."""
    from pagelode.streaming import streams

    return streamed(spark, sf_dir, "costs", lambda s: streams.trailing_cost(as_log(s))).select(F.date_format("until", "yyyy-MM-dd").alias("until"), "cost", "calls")


# -- all rules and the citation ladder over made records


def made_records(spark, sf_dir):
    """Parts as page records in which every field of the rules takes several values, nulls included."""
    k = F.col("p_partkey")
    less = lambda m, c: F.when(k % m != 0, c)
    text = lambda m, n: less(m, F.repeat(F.lit("x"), (k % n).cast("int")))
    ints = {
        "duplicate_ids": 3, "empty_buttons": 4, "empty_links": 5, "form_inputs_unlabelled": 2, "generic_link_texts": 6, "heading_skips": 7, "iframes_missing_title": 3, "positive_tabindex": 5,
        "tables_without_th": 8, "word_count": 1700, "cta_count": 11, "form_fields_max": 9, "tel_links": 3, "trust_signal_count": 4, "cta_above_fold": 5, "urgency_signal_count": 2, "h1_count": 4,
        "h2_count": 5, "images_missing_alt": 4, "internal_link_count": 7, "external_link_count": 4, "meta_description_length": 230, "title_length": 90, "schema_blocks": 3, "mixed_content_count": 2,
        "first_h2_para_words": 220, "list_count": 3, "images_total": 6, "time_elements": 2,
    }
    bools = {"has_main": 2, "has_nav": 3, "has_skip_link": 5, "form_has_captcha": 4, "primary_cta_generic": 3, "faq_present": 2, "noindex": 19, "has_viewport": 7, "security_csp": 2, "security_hsts": 3, "has_rel_author": 6, "jsonld_has_dates": 5}
    types = F.array(*[picked(names, k) for names in (("Article", "WebPage", "article"), ("Organization", "Offer"), ("BreadcrumbList", "Product", "Person", "FAQPage", "WebSite"))])
    columns = {name: less(17 + n, (k * (n + 3) % m).cast("int")) for n, (name, m) in enumerate(ints.items())}
    columns |= {name: less(23 + n, k % m == 0) for n, (name, m) in enumerate(bools.items())}
    columns |= {
        "canonical": F.when(k % 3 == 0, "/p").when(k % 3 == 1, "https://a/p").otherwise(""), "status": F.when(k % 41 == 0, 404).otherwise(200), "js_content_ratio": less(9, (k % 30) / 10.0),
        "url": F.when(k % 2 == 0, "HTTPS://a/p").otherwise("http://a/p"), "html_lang": text(4, 3), "meta_description": text(5, 2), "title": text(6, 3), "og_title": text(3, 2), "twitter_card": text(7, 2),
        "schema_types": F.when(k % 6 != 0, F.slice(types, 1, (k % 4).cast("int"))), "h2": F.when(k % 5 == 0, F.array(F.lit("How it works"))).when(k % 5 == 1, F.array(F.lit("Plans"), F.lit("Ready?"))).otherwise(F.array(F.lit("Whatever"))),
        "meta_author": F.when(k % 8 == 0, "Ann").otherwise(""), "number_density": (k % 23) / 2.0,
    }
    return read(spark, sf_dir, "part").select(k.alias("k"), *[c.alias(n) for n, c in columns.items()])


@query
def lint_all_rules(spark, sf_dir):
    from pagelode.plans import rules

    return rules.lint(made_records(spark, sf_dir), rules.load_rules(), ["k"]).select("k", "score", "rules_run", "passed", "failed", F.array_join(F.col("findings.rule_id"), ",").alias("fired"))


@query
def page_features(spark, sf_dir):
    """What the HTML visitor finds in made pages."""
    from pagelode.functions import html

    r = html.extract_pages(inputs.made_pages(spark, sf_dir))
    lists = {c: F.array_join(c, "|") for c in ("h1", "h2", "schema_types", "cta_texts")}
    links = F.array_join(F.transform("links", lambda x: F.concat(x["href"], F.lit(">"), x["anchor"])), "|")
    return r.withColumns({**lists, "links": links}).drop("url", "title_length", "og_image", "number_density", "word_count", "scripts_total", "cta_above_fold")


@query
def page_meta(spark, sf_dir):
    """Meta elements and mixed content of made pages in native columns."""
    from pagelode.functions import text as X

    h = F.col("html")
    names = {"meta_description": "description", "og_title": "og:title", "twitter_card": "twitter:card", "meta_author": "author"}
    return inputs.made_pages(spark, sf_dir).select("k", *[X.meta_content(h, n).alias(c) for c, n in names.items()], F.contains(F.lower(X.meta_content(h, "robots")), F.lit("noindex")).alias("noindex"), X.mixed_content(h).alias("mixed_content_count"))


@query
def patch_effect(spark, sf_dir):
    """Findings that the machine patch of a missing viewport or language solves in made pages, and whether the score is no worse."""
    from pagelode.functions import html
    from pagelode.operators.store import never_broadcast

    p = inputs.made_pages(spark, sf_dir).select(F.col("k").alias("page_id"), "url", "html")
    before = catalog.cut(catalog.rules.lint(html.extract_pages(p), catalog.rules.load_rules(local=True), ["page_id"]))
    found = before.select("page_id", F.explode("findings").alias("f")).select("page_id", F.col("f.rule_id").alias("rule_id")).where(F.col("rule_id").isin("missing-viewport", "missing-html-lang"))
    plan = fixes.patch_plan(found, p.select("page_id", F.lit("en").alias("lang")), "page_id")
    patched = never_broadcast(p).join(plan, "page_id").select(F.struct("page_id", "rule_id").alias("page_id"), "url", fixes.apply_patch(F.col("html"), F.col("rule_id"), F.col("patch")).alias("html"))
    after = catalog.rules.lint(html.extract_pages(patched), catalog.rules.load_rules(local=True), ["page_id"]).select("page_id.*", F.col("score").alias("after"), F.col("failed").alias("left"))
    return after.join(never_broadcast(before.select("page_id", F.col("score").alias("before"), "failed")), "page_id").select(F.col("page_id").alias("k"), "rule_id", (F.col("failed") - F.col("left")).cast("int").alias("solved"), (F.col("after") >= F.col("before")).alias("no_worse"))


@query
def json_walk(spark, sf_dir):
    """All values of JSON documents, through SQL."""
    from pagelode.functions import walker

    walker.register(spark)
    i = F.col("conv_id").cast("string")
    text = F.when(F.col("conv_id") % 9 == 0, "no json").otherwise(F.concat(F.lit('{"a": "x'), i, F.lit('", "b": [1, true, {"c": null}]}')))
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("body", text)
    return spark.sql("SELECT conv_id, w.path, w.kind, w.value FROM {rows}, LATERAL walk_json(body) w", rows=rows)


@query
def near_dup_report(spark, sf_dir):
    return graph.near_duplicate_report(catalog.QUERIES["near_dup_pairs"](spark, sf_dir))


@query
def fold_position(spark, sf_dir):
    """Actions in the first two fifths of a made page's elements."""
    from pagelode.functions import html

    k = F.col("p_partkey")
    body = F.concat(F.lit("<html><head></head><body>"), F.repeat(F.lit("<i></i>"), (k % 7).cast("int")), F.lit("<a href='/'>Buy</a>"), F.repeat(F.lit("<i></i>"), (k % 5).cast("int")), F.lit("<button>Go on</button><button>Try it</button>"), F.repeat(F.lit("<i></i>"), (k % 11).cast("int")))
    r = html.extract_pages(inputs.spread_parts(spark, sf_dir).select(k.alias("k"), F.lit("").alias("url"), body.alias("html")))
    return r.select("k", "cta_count", "cta_above_fold")


@query
def lint_categories(spark, sf_dir):
    """Conversion and accessibility baselines: score and findings of the category's rules alone, zero findings included."""
    from pagelode.plans import rules

    out = None
    for category in ("cro", "accessibility"):
        part = rules.lint(made_records(spark, sf_dir), rules.load_rules(category), ["k"]).select("k", F.lit(category).alias("category"), "score", F.col("failed").alias("findings"), F.col("rules_run").alias("rules"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def lint_conditions(spark, sf_dir):
    """Every condition of the rule algebra over fields that are there, null and unknown."""
    from pagelode.plans.rules import Rule, predicate

    tests = (
        ("title", "empty", None), ("word_count", "empty", None), ("title_length", "empty", None), ("schema_types", "not_empty", None), ("status", "equals", 200), ("status", "not_equals", 200), ("has_main", "is_true", None),
        ("has_main", "is_false", None), ("no_such_field", "missing", None), ("title", "missing", None), ("html_lang", "min_length", 2), ("html_lang", "max_length", 1), ("word_count", "min", 500), ("word_count", "max", 500),
        ("word_count", "gte", 500), ("word_count", "lte", 500), ("canonical", "contains", "HTTPS"), ("canonical", "not_contains", "https"), ("schema_types", "list_contains", "Article"), ("schema_types", "list_not_contains", "ORGANIZATION"),
        ("url", "matches", "^https"), ("schema_types", "min_length", 2), ("no_such_field", "gte", 1), ("no_such_field", "is_false", None),
    )
    r = made_records(spark, sf_dir)
    hits = [predicate(Rule(f"t{n}", "t", "low", "high", field, c, v), r.schema) for n, (field, c, v) in enumerate(tests)]
    return r.select("k", F.array_join(F.array(*[F.when(h, "1").otherwise("0") for h in hits]), "").alias("fired"))


@query
def citation_ladder(spark, sf_dir):
    r = made_records(spark, sf_dir)
    filled = r.fillna(0).fillna("").fillna(False).withColumn("schema_types", F.coalesce("schema_types", F.array().cast("array<string>")))
    out = scoring.citation_scores(filled, ["k"])
    return out.select("k", "gate", "score", "grade", F.array_join(F.transform("criteria", lambda c: F.concat(c["name"], F.lit(":"), c["points"].cast("string"), F.lit(":"), c["status"])), "|").alias("criteria"))


# -- streams


def streamed(spark, sf_dir, name, build, key=None):
    """What a streaming query writes once all of the events table has passed, as a table in the shared folder.

    An update-mode stream is written batch by batch; of a key the last row counts.
    """
    from pagelode.operators.store import fresh_path

    to = fresh_path(spark, name)
    schema = read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    out = build(source)
    if key is None:
        writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{to}/rows")
    else:
        writer = out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{to}/rows"))
    writer.option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{to}/rows")
    if key is None:
        return rows
    kept = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("s")).select(key, "s.*")


def as_log(source):
    return source.select("ts", F.col("event_type").alias("type"), F.round(F.col("value") * 100).cast("long").alias("value"), "user_id")


@query
def stream_daily(spark, sf_dir):
    """Daily counts of the closed days: those the watermark has passed."""
    from pagelode.streaming import streams

    return streamed(spark, sf_dir, "daily", lambda s: streams.daily_counts(as_log(s))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", "n", "value")


@query
def stream_sessions(spark, sf_dir):
    from pagelode.streaming import streams

    return streamed(spark, sf_dir, "sessions", lambda s: streams.sessions(as_log(s))).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def as_recommendations(source):
    raised = F.col("event_type").isin("error", "view", "signup")
    status = F.when(raised, F.lit("")).otherwise(picked((*W.STATUSES, "bogus"), F.col("event_id")))
    severity = F.when(raised, picked(W.SEVERITIES, F.col("event_id"))).otherwise("")
    return source.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("ts"), F.when(raised, "raise").otherwise("status").alias("event"), status.alias("status"), severity.alias("severity"))


@query
def stream_replay(spark, sf_dir):
    from pagelode.streaming import streams

    return streamed(spark, sf_dir, "replay", lambda s: streams.replay_stream(as_recommendations(s)), "id").withColumn("id", F.col("id").cast("long"))


@query
def stream_timeline(spark, sf_dir):
    """What each event does to its recommendation, as a stream with a state for each key tells it."""
    from pagelode.streaming import streams

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return streamed(spark, sf_dir, "timeline", lambda s: streams.timeline_stream(as_recommendations(s))).withColumn("id", F.col("id").cast("long"))
    finally:
        spark.conf.set(provider, before)


# -- saved fetches, versions, caches and the watch job


def saved_fetches(spark, sf_dir):
    """Folder with two saves of fetched pages."""
    from pagelode.operators.store import fresh_path
    from pagelode.sources.fetched import save_fetches

    to, rows = fresh_path(spark, "fetches"), inputs.fetches(spark, sf_dir)
    for save in (1, 2):
        save_fetches(rows.where(F.col("save") == save), to, save)
    return to


@query
def fetched_pages(spark, sf_dir):
    """Pages as a crawl saved them, with their security fields."""
    from pagelode.sources.fetched import fetched

    rows = pages.with_security(fetched(spark, saved_fetches(spark, sf_dir)))
    return rows.select("save", "url", "status", "content_type", "final_url", F.length("body").alias("chars"), F.size("headers").alias("n_headers"), "security_hsts", "security_csp")


@query
def fetched_stream(spark, sf_dir):
    """Saves read as a stream that stops after the first one and goes on with the second."""
    from pagelode.operators.store import fresh_path
    from pagelode.sources.fetched import fetched, save_fetches

    folder, out, rows = fresh_path(spark, "fetches"), fresh_path(spark, "fetched"), inputs.fetches(spark, sf_dir)
    for save in (1, 2):
        save_fetches(rows.where(F.col("save") == save), folder, save)
        stream = fetched(spark, folder, stream=True).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
        stream.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("save", "status", "content_type").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


@query
def lint_changed(spark, sf_dir):
    """New, fixed and carried findings between two versions of the pages' files."""
    from pagelode.operators import versions

    before, after = inputs.site_versions(spark, sf_dir)
    return versions.lint_changes(before, after, catalog.cut(versions.lint_files(before)))[0]


def filled_cache(spark, sf_dir):
    """A cache that took three batches, one of them twice."""
    from pagelode.operators.responses import ResponseCache
    from pagelode.operators.store import fresh_path

    cache, rows = ResponseCache(spark, fresh_path(spark, "responses")), inputs.response_batches(spark, sf_dir)
    for batch in (0, 1, 2, 1):
        cache.apply(batch, rows.where(F.col("batch") == batch))
    return cache


@query
def cache_latest(spark, sf_dir):
    return filled_cache(spark, sf_dir).responses().select("key", "command", "body", "cost", "ts")


@query
def cache_ledger(spark, sf_dir):
    return filled_cache(spark, sf_dir).ledger().groupBy("batch", "command").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum(F.length("detail")).alias("detail_chars"))


def watched(spark, sf_dir):
    """Folder of a watch job over the events, one of whose checks fails and one has nothing to do."""
    from pagelode.operators.store import fresh_path
    from pagelode.streaming import watch

    folder = fresh_path(spark, "watch")

    def unknown_shape(rows):
        raise ValueError("shape not recognised")

    checks = {
        "backlinks": unknown_shape,
        "competitors": lambda rows: None,
        "counts": lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") * 100).cast("long")).alias("cents")),
        "users": lambda rows: rows.select("user_id").distinct().agg(F.count("*").alias("users")),
    }
    schema = read(spark, sf_dir, "events").schema
    watch.watch(spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*"), checks, folder)
    return folder


@query
def watch_runs(spark, sf_dir):
    """What became of each check of the watch job."""
    from pagelode.streaming import watch

    return watch.runs(spark, watched(spark, sf_dir))


@query
def watch_counts(spark, sf_dir):
    """The result of a check that ran beside a failed one."""
    from pagelode.streaming import watch

    return watch.results(spark, watched(spark, sf_dir), "counts").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@query
def page_layout(spark, sf_dir):
    """Where the pages of the link graph stand in its drawing."""
    from pagelode.operators import layout

    return layout.layout(catalog.QUERIES["bfs_parents"](spark, sf_dir), catalog.QUERIES["unreachable"](spark, sf_dir), catalog.QUERIES["link_degree"](spark, sf_dir).select("node", "inlinks"))
