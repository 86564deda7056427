"""Catalogue of named queries over the test tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelode.functions import html as H
from pagelode.functions import tags as T
from pagelode.functions import text as X
from pagelode.functions import words as W
from pagelode.operators import crawl, fixes, graph, history, impact, logs, pages, recommendations, reports, scoring, similar, visibility
from pagelode.plans import inputs, oracle, rules
from pagelode.operators.store import cut
from pagelode.plans.inputs import read

def records(spark, sf_dir):
    return pages.native_record(read(spark, sf_dir, "pages"))


def visited(spark, sf_dir):
    return H.extract_pages(read(spark, sf_dir, "pages"))


def linted(spark, sf_dir):
    """All pages under all rules; saved pages have no response headers, so their security fields count as missing."""
    return rules.lint(T.page_records(read(spark, sf_dir, "pages")).withColumn("status", F.lit(200)), rules.load_rules(), ["page_id", "url"])


def found(spark, sf_dir):
    return linted(spark, sf_dir).select("page_id", "url", F.explode("findings").alias("f")).select("page_id", "url", "f.rule_id", "f.category", "f.severity", "f.weight")


def crawled(spark, sf_dir):
    return records(spark, sf_dir).withColumn("status", F.when(F.col("page_id") % 17 == 3, 404).otherwise(200))


def picked(values, index):
    """Element of a list of literals by index modulo its length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- pages


@query
def page_extract(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("page_id", "url", "title", "title_length", "html_lang", F.array_join("h1", "|").alias("h1_text"), "h1_count", "word_count", "internal_link_count", "external_link_count", "list_count", "images_total", "has_viewport", "has_nav")


@query
def page_extract_full(spark, sf_dir):
    """All record fields from the HTML visitor."""
    return visited(spark, sf_dir).drop("links")


@query
def page_links(spark, sf_dir):
    return pages.links(read(spark, sf_dir, "pages"))


@query
def url_normalise(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.normal_url(F.col("url")).alias("normal_url"), X.netloc(F.col("url")).alias("host"))


# -- rules


@query
def lint_findings(spark, sf_dir):
    return found(spark, sf_dir).select("page_id", "rule_id", "category", "severity", "weight")


@query
def lint_scores(spark, sf_dir):
    return linted(spark, sf_dir).select("page_id", "url", "score", "failed")


@query
def lint_full(spark, sf_dir):
    """Scores under all rules of the catalogue that need no fetch, over visitor records."""
    return rules.lint(visited(spark, sf_dir).withColumn("status", F.lit(200)), rules.load_rules(local=True), ["page_id"]).select("page_id", "score", "rules_run", "passed", "failed", F.array_join(F.col("findings.rule_id"), ",").alias("fired"))


@query
def lint_gate(spark, sf_dir):
    return linted(spark, sf_dir).where("score < 30").select("page_id", "score")


@query
def lint_rollup(spark, sf_dir):
    f = found(spark, sf_dir).rollup("category", "severity").agg(F.count("*").alias("n"), F.sum("weight").alias("lost"))
    return f.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("severity", F.lit("all")).alias("severity"), "n", "lost")


@query
def lint_annotations(spark, sf_dir):
    return reports.annotation(found(spark, sf_dir))


# -- crawl


@query
def crawl_summary(spark, sf_dir):
    return pages.crawl_summary(crawled(spark, sf_dir))


@query
def duplicate_titles(spark, sf_dir):
    return records(spark, sf_dir).where("title <> ''").groupBy("title").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query
def status_distribution(spark, sf_dir):
    status = F.when(F.col("page_id") % 17 == 3, 404).when(F.col("page_id") % 23 == 1, F.lit(None)).otherwise(200)
    return read(spark, sf_dir, "pages").groupBy(F.coalesce(status.cast("string"), F.lit("None")).alias("status")).agg(F.count("*").alias("n"))


@query
def sitemap_diff(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("url", F.rtrim(F.col("url"), F.lit("/")))
    return pages.set_diff(p.where("page_id % 3 <> 0"), p.where("page_id % 4 <> 0"), "url")


@query
def near_dup_pairs(spark, sf_dir):
    return similar.near_duplicate_pairs(read(spark, sf_dir, "documents"), sample=None)[0]


@query
def near_dup_classes(spark, sf_dir):
    heads = similar.near_duplicate_pairs(read(spark, sf_dir, "documents"), sample=None)[1]
    return heads.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")


@query
def near_dup_groups(spark, sf_dir):
    """Every document with the least one of the same shingles and of its class of similar ones."""
    return similar.near_duplicate_classes(read(spark, sf_dir, "documents"))


@query
def crawl_order(spark, sf_dir):
    """Crawl of the derived link graph, without a budget; addresses that begin with 7 are closed to robots."""
    name = lambda c: F.concat(F.lit("https://site.example/"), F.col(c).cast("string"))
    table = inputs.nodes(spark, sf_dir).select(name("node").alias("url"), F.when(F.col("node") % 13 == 5, 404).otherwise(200).alias("status"))
    links = inputs.edges(spark, sf_dir).select(name("src").alias("src"), "pos", name("dst").alias("dst"))
    out = crawl.crawl(table, links, "https://site.example/0", None, [("/7", False)])
    return out.select("url", "depth", "status", "blocked_by_robots")


# -- link graph


def reached(spark, sf_dir):
    return graph.depths(inputs.nodes(spark, sf_dir), inputs.edges(spark, sf_dir), 0)


@query
def link_degree(spark, sf_dir):
    return graph.degrees(inputs.nodes(spark, sf_dir), inputs.edges(spark, sf_dir))


@query
def orphans(spark, sf_dir):
    return graph.orphans(inputs.nodes(spark, sf_dir), inputs.edges(spark, sf_dir), 0)


@query
def hubs_topk(spark, sf_dir):
    return graph.top(link_degree(spark, sf_dir), "inlinks")


@query
def bfs_depth(spark, sf_dir):
    return reached(spark, sf_dir)


@query
def depth_distribution(spark, sf_dir):
    return reached(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


@query
def bfs_parents(spark, sf_dir):
    known = inputs.edges(spark, sf_dir).join(inputs.nodes(spark, sf_dir).withColumnRenamed("node", "dst"), "dst", "left_semi")
    return graph.parents(reached(spark, sf_dir), known)


@query
def unreachable(spark, sf_dir):
    return graph.unreachable(inputs.nodes(spark, sf_dir), reached(spark, sf_dir))


@query
def link_roles(spark, sf_dir):
    return graph.roles(link_degree(spark, sf_dir), reached(spark, sf_dir), 0, hub=3)


@query
def anchor_quality(spark, sf_dir):
    return graph.anchor_quality(inputs.edges(spark, sf_dir))


@query
def top_anchors(spark, sf_dir):
    return graph.top_anchors(inputs.edges(spark, sf_dir))


def traced(spark, sf_dir):
    hops = inputs.hops(spark, sf_dir)
    return graph.trace_redirects(hops.select(F.col("url").alias("start")), hops)


@query
def redirect_trace(spark, sf_dir):
    return traced(spark, sf_dir)


@query
def canonical_audit(spark, sf_dir):
    site = F.floor(F.col("page_id") / 3)
    name = lambda i: F.concat(F.lit("u"), i.cast("string"))
    sites = read(spark, sf_dir, "pages").select(site.alias("site"), name(site * 3 + 2).alias("canonical"), name(F.col("page_id")).alias("start"))
    return graph.canonical_audit(traced(spark, sf_dir), sites)


# -- logs


def parsed(spark, sf_dir):
    return logs.parse(inputs.log_lines(spark, sf_dir))


@query
def log_bots(spark, sf_dir):
    return logs.by_bot(parsed(spark, sf_dir))


@query
def log_status(spark, sf_dir):
    return logs.by_status(parsed(spark, sf_dir))


@query
def log_daily(spark, sf_dir):
    return logs.daily(parsed(spark, sf_dir))


@query
def log_top_paths(spark, sf_dir):
    return logs.top_paths(parsed(spark, sf_dir))


@query
def log_totals(spark, sf_dir):
    return logs.totals(parsed(spark, sf_dir))


# -- scorers


@query
def citation_score(spark, sf_dir):
    return scoring.citation_scores(visited(spark, sf_dir), ["page_id"]).select("page_id", "gate", "score", "grade", F.to_json("criteria").alias("criteria"))


@query
def page_type(spark, sf_dir):
    return scoring.page_type(visited(spark, sf_dir), ["page_id"]).select("page_id", "page_type", "second_type", "confidence", "top_score")


def typed_results(spark, sf_dir):
    """Pages as search results of the query that their host stands for."""
    r = visited(spark, sf_dir)
    t = scoring.page_type(r, ["page_id", "url"])
    return t.select(X.netloc(F.col("url")).alias("host"), F.col("page_id").alias("position"), "page_type", "second_type")


@query
def serp_consensus(spark, sf_dir):
    return scoring.consensus(typed_results(spark, sf_dir), "host")


@query
def serp_alignment(spark, sf_dir):
    t = typed_results(spark, sf_dir)
    c = scoring.consensus(t, "host").select("host", "dominant", "verdict")
    types = [F.col(x) for x in ("page_type", "dominant", "verdict", "second_type")]
    return t.join(c, "host", "left").select(F.col("position").alias("page_id"), "page_type", "dominant", scoring.fit(*types).alias("status"), scoring.alignment(*types).alias("alignment"))


@query
def spa_verdict(spark, sf_dir):
    return scoring.spa_verdict(read(spark, sf_dir, "pages"), ["page_id"])


@query
def keyword_candidates(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", scoring.keyword_candidate(F.col("h1"), F.col("title")).alias("keyword"))


# -- drift, forecast, impact, watch


def versions(spark, sf_dir):
    return inputs.rankings(spark, sf_dir, 1998), inputs.rankings(spark, sf_dir, 1999)


@query
def drift_rankings(spark, sf_dir):
    return history.drift_rankings(*versions(spark, sf_dir), ["keyword"])


@query
def drift_stats(spark, sf_dir):
    return history.drift_stats(drift_rankings(spark, sf_dir))


@query
def drift_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    side = lambda y: o.where(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("pillar")).agg(F.count("*").cast("double").alias("value"))
    return history.drift_values(side(1997), side(1998), ["pillar"])


@query
def health_trend(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    pillar = picked(list(W.PILLARS), F.col("user_id"))
    s = e.groupBy(F.weekofyear("ts").alias("snap"), pillar.alias("pillar")).agg(F.count("*").cast("double").alias("value"))
    return history.trend(history.health(s, ["snap"]).withColumn("domain", F.lit("site")), "domain", "snap")


@query
def drift_chart(spark, sf_dir):
    return reports.chart_rows(history.drift_stats(history.drift_rankings(*versions(spark, sf_dir), ["keyword"])))


def forecast_rows(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return history.forecast(old.select("keyword", "volume"), new)


@query
def forecast(spark, sf_dir):
    return history.by_volume(forecast_rows(spark, sf_dir))


@query
def forecast_totals(spark, sf_dir):
    return history.forecast_totals(forecast_rows(spark, sf_dir))


def suppliers(spark, sf_dir):
    return inputs.supplier_rankings(spark, sf_dir, 1998), inputs.supplier_rankings(spark, sf_dir, 1999)


@query
def rank_loss(spark, sf_dir):
    return history.rank_losses(*suppliers(spark, sf_dir), "supplier")


@query
def rank_recovery(spark, sf_dir):
    old, new = suppliers(spark, sf_dir)
    return history.recovered(old.select("supplier", "keyword", F.col("position").alias("was")), new, "supplier")


@query
def competitor_gain(spark, sf_dir):
    old, new = (x.withColumnRenamed("supplier", "competitor") for x in suppliers(spark, sf_dir))
    return history.competitor_gains(old, new).select("competitor", "gained", F.array_join("examples", "|").alias("examples"))


@query
def impact_asof(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", "ts", "value")
    out = history.asof(done, seen, ["user_id"], "ts", "value")
    verdict = F.when(F.col("before").isNull() | F.col("after").isNull(), "insufficient_data").otherwise(impact.by_page(F.col("before"), F.col("after")))
    return out.select("event_id", "user_id", "before", "after", verdict.alias("verdict"))


# -- recommendations


@query
def rec_ids(spark, sf_dir):
    anchor = F.concat(F.lit("Rule-"), (F.col("page_id") % 7).cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", recommendations.make_id(F.lit("Example.com"), F.col("url"), F.lit("lint"), anchor).alias("rec_id"))


@query
def rec_priority(spark, sf_dir):
    i = F.col("page_id")
    p = recommendations.priority(picked(W.SEVERITIES, i), picked(("high", "medium", "low"), i), (i * 37 % 2000).cast("double"), i % 2 == 0, i % 9)
    return read(spark, sf_dir, "pages").select("page_id", p.alias("priority"))


def rec_state(spark, sf_dir):
    return recommendations.replay(inputs.recommendation_events(spark, sf_dir), ["id"])


@query
def rec_replay(spark, sf_dir):
    return rec_state(spark, sf_dir)


@query
def rec_summary(spark, sf_dir):
    return recommendations.summary(rec_state(spark, sf_dir))


@query
def rec_autoresolve(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("url")
    ran = spark.createDataFrame([(x,) for x in ("thin-content", "missing-h1", "title-too-long")], "rule_id string")
    open_recs = p.withColumn("rule_id", F.explode(F.array(*[F.lit(x) for x in ("thin-content", "missing-h1", "title-too-long", "not-run")])))
    return recommendations.auto_resolved(open_recs, p, ran, found(spark, sf_dir)).select("url", "rule_id")


def file_versions(spark, sf_dir):
    """Lint outcomes of all pages, as files before and after a change; pages are linted once."""
    after = cut(linted(spark, sf_dir).select(F.col("page_id").alias("path"), "score", F.col("findings.rule_id").alias("rules")))
    return after.withColumn("path", F.col("path") - 1), after


@query
def pr_compare(spark, sf_dir):
    out = recommendations.compare(*file_versions(spark, sf_dir))
    return out.withColumns({"new_rules": F.array_join("new_rules", "|"), "fixed_rules": F.array_join("fixed_rules", "|")})


@query
def pr_gate(spark, sf_dir):
    out = recommendations.gate(*file_versions(spark, sf_dir), min_score=30)
    return out.select("path", "before_score", "after_score", F.array_join("reasons", "|").alias("reasons"), F.array_join("new_rules", "|").alias("new_rules"))


@query
def pr_summary(spark, sf_dir):
    return reports.change_table(recommendations.gate(*file_versions(spark, sf_dir), min_score=30))


# -- ledgers


def latest(frame, column="ts"):
    return frame.agg(F.max(column)).first()[0] or 0


@query
def cost_periods(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir)  # noqa: E741
    return history.cost_periods(l, latest(l))


@query
def cost_by_command(spark, sf_dir):
    return history.cost_by_command(inputs.ledger(spark, sf_dir))


@query
def cache_fresh(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir)  # noqa: E741
    i = F.col("event_id")
    rows = l.select(F.concat(F.lit("k"), (i % 50).cast("string")).alias("key"), picked(("serp", "volume", "whois", "ranked"), i).alias("command"), F.col("ts").alias("created"), F.lit(1).alias("size"))
    return history.cache_stats(history.fresh(rows, latest(l))).drop("bytes")


@query
def event_tail(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_id").alias("seq"))
    return history.tail(e, "user_id", 5).select("user_id", "event_id", "back")


# -- visibility


@query
def brand_mentions(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    m = visibility.mention(F.col("text"), F.lit("The"), F.lit("no-such-domain.example"))
    return c.select("conv_id", "turn", m["mentioned"].alias("mentioned"), m["excerpt"].alias("excerpt"))


@query
def visibility_rate(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    m = F.when(F.col("conv_id") % 7 != 0, F.instr(F.lower("text"), "the") > 0)
    return visibility.rate(c.select((F.col("conv_id") % 4).alias("platform"), m.alias("mentioned")), "platform")


@query
def visibility_diff(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    side = lambda cond, word: c.where(cond).groupBy("conv_id").agg(F.bool_or(F.instr(F.lower("text"), word) > 0).alias("mentioned"))
    return visibility.compare(side("turn < 2", "the"), side("turn >= 1", "and"), "conv_id")


# -- fixes


@query
def meta_draft(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", fixes.meta_draft(F.col("text")).alias("draft"))


@query
def breadcrumb_json(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.to_json(fixes.breadcrumb(F.col("url"))).alias("breadcrumb"))


@query
def patch_plan(spark, sf_dir):
    r = records(spark, sf_dir)
    values = r.select("page_id", "url", F.get("h1", F.lit(0)).alias("h1_first"), F.nullif(fixes.meta_draft(F.array_join("h1", " ")), F.lit("")).alias("meta_draft"), F.col("html_lang").alias("lang"), F.to_json(fixes.breadcrumb(F.col("url"))).alias("breadcrumb"))
    return fixes.patch_plan(found(spark, sf_dir), values, "page_id")


def queries():
    from pagelode.plans import more

    return {**QUERIES, **more.QUERIES}


def oracle_sql():
    from pagelode.plans import more, oracle_more

    known = {**QUERIES, **more.QUERIES}
    return {name: sql for name, sql in {**oracle.SQL, **oracle_more.SQL}.items() if name in known}
