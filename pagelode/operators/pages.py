"""Page records in native columns, crawl summaries, sitemap and version differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as X


def native_record(pages: DataFrame) -> DataFrame:
    """The record fields that columns can express, from (page_id, url, html)."""
    pages = X.once(pages, ["page_id", "url", "html"], {"clean": X.without_blocks(F.col("html"))})
    pages = X.once(pages, ["page_id", "url", "html", "clean"], {"found": X.links(F.col("clean")), "visible": X.visible_text(F.col("clean")), "host": X.netloc(F.col("url"))})
    html, clean, visible, host, found = map(F.col, ("html", "clean", "visible", "host", "found"))
    internal = F.size(F.filter(found, lambda x: X.internal_in_lint(host, x["href"])))
    title = X.title(html)
    return pages.select(
        "page_id",
        "url",
        title.alias("title"),
        F.length(title).alias("title_length"),
        F.trim(F.regexp_extract(html, r'(?is)<html\b[^>]*\slang="([^"]*)"', 1)).alias("html_lang"),
        X.tag_texts(clean, "h1").alias("h1"),
        X.tag_texts(clean, "h2").alias("h2"),
        X.word_count(visible).alias("word_count"),
        internal.alias("internal_link_count"),
        (F.size(found) - internal).alias("external_link_count"),
        (X.tag_count(clean, "ul") + X.tag_count(clean, "ol")).alias("list_count"),
        X.tag_count(clean, "img").alias("images_total"),
        F.regexp_count(clean, F.lit(r'(?i)<meta\s[^>]*name="viewport"')).cast("boolean").alias("has_viewport"),
        F.regexp_extract(clean, r'(?is)<link\b[^>]*rel="canonical"[^>]*href="([^"]*)"', 1).alias("canonical"),
        F.regexp_extract(clean, r'(?is)<meta\b[^>]*name="description"[^>]*content="([^"]*)"', 1).alias("meta_description"),
        F.regexp_count(html, F.lit(r"(?i)application/ld\+json")).cast("int").alias("schema_blocks"),
        (X.tag_count(clean, "nav") > 0).alias("has_nav"),
        (X.tag_count(clean, "main") > 0).alias("has_main"),
        X.total_occurrences(F.lower(visible), ("guarantee", "verified", "rated", "award")).alias("trust_terms"),
    ).withColumns({"h1_count": F.size("h1"), "h2_count": F.size("h2"), "meta_description_length": F.length("meta_description")})


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, anchor, target, internal) edges; target is resolved against the page."""
    host = X.netloc(F.col("url"))
    out = pages.select("page_id", "url", F.posexplode(X.links(X.without_blocks(F.col("html")))).alias("pos", "x"))
    target = X.joined_url(F.col("url"), F.col("x.href"))
    return out.select("page_id", "pos", F.col("x.href").alias("href"), F.substring("x.anchor", 1, 120).alias("anchor"), target.alias("target"), (X.netloc(target) == host).alias("internal"))


def crawl_summary(records: DataFrame) -> DataFrame:
    """One row of counts over page records with a status."""
    ok = F.col("status") == 200
    return records.agg(
        F.count("*").alias("pages"),
        F.count_if(ok).alias("ok_pages"),
        F.count_if(~ok).alias("failed_pages"),
        F.count_if(ok & (F.col("title") == "")).alias("missing_titles"),
        F.count_if(ok & (F.col("h1_count") == 0)).alias("missing_h1"),
        F.count_if(ok & (F.col("h1_count") > 1)).alias("multiple_h1"),
        F.count_if(ok & (F.col("meta_description") == "")).alias("missing_descriptions"),
        F.count_if(ok & (F.col("word_count") < 300)).alias("thin_pages"),
        F.sum(F.when(ok, F.col("word_count")).otherwise(0)).alias("words"),
        F.sum(F.when(ok, F.col("internal_link_count")).otherwise(0)).alias("internal_links"),
    )


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


#: A crawl's fetched pages, as a table made beforehand.
FETCHED = "url string, status int, content_type string, body string, headers map<string,string>, final_url string"
#: Response headers behind the security fields of a record.
SECURITY = {"security_hsts": "strict-transport-security", "security_csp": "content-security-policy", "security_xfo": "x-frame-options", "security_xcto": "x-content-type-options"}


def crawl_links(records: DataFrame) -> DataFrame:
    """``records`` (url, links) with internal_outlinks array<struct(url, anchor)> and link counts as a crawl sees them.

    Links resolve against the page; those on its host are internal, those on
    another external, those without a host (mail, telephone) neither.
    """
    base = F.col("url")
    absolute = F.transform("links", lambda x: F.struct(X.joined_url(base, x["href"]).alias("url"), F.substring(x["anchor"], 1, 120).alias("anchor")))
    found = X.once(records, records.columns, {"_all": absolute})
    host = X.netloc(base)
    inside = F.filter("_all", lambda x: X.netloc(x["url"]) == host)
    outside = F.filter("_all", lambda x: (X.netloc(x["url"]) != host) & (X.netloc(x["url"]) != ""))
    return found.withColumns({"internal_outlinks": inside, "internal_link_count": F.size(inside), "external_link_count": F.size(outside)}).drop("_all")


def with_security(records: DataFrame, headers: str = "headers") -> DataFrame:
    """``records`` with a field for each security header that the response had, whatever the case of its name."""
    names = F.transform(F.coalesce(F.map_keys(headers), F.array().cast("array<string>")), F.lower)
    return records.withColumns({field: F.array_contains(names, name) for field, name in SECURITY.items()})


def sitemap_locations(xml: DataFrame, column: str = "xml", limit: int | None = None) -> DataFrame:
    """(source, loc) of the <loc> values of each sitemap, the first ``limit`` of it if given."""
    found = F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    if limit is not None:
        found = F.slice(found, 1, limit)
    return xml.select("source", F.explode(found).alias("loc")).withColumn("loc", X.unescaped(F.trim("loc")))


def sitemap_urls(roots: DataFrame, fetched: DataFrame, max_sitemaps: int = 10) -> DataFrame:
    """(source, url) of the addresses below sitemaps; an index that names child sitemaps yields only their addresses.

    roots, fetched: source, xml. Of an index, the first ``max_sitemaps``
    children count (what a crawl fetches).
    """
    listed = roots.select("source", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("pos", "loc"))
    child = F.contains(F.lower("loc"), F.lit("sitemap")) & F.endswith("loc", F.lit(".xml"))
    index = listed.where(child)
    plain = listed.join(index.select("source").distinct(), "source", "left_anti").select("source", F.trim("loc").alias("url"))
    first = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    taken = index.withColumn("n", first).where(F.col("n") <= max_sitemaps).select(F.col("source").alias("root"), F.col("loc").alias("source"))
    below = taken.join(fetched, "source").select(F.col("root").alias("source"), F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("url"))
    return plain.unionByName(below.withColumn("url", F.trim("url"))).distinct()


#: Addresses that a sitemap report names of each kind.
REPORTED = 50


def sitemap_report(crawled: DataFrame, sitemap: DataFrame, limit: int = REPORTED) -> DataFrame:
    """(kind, url) rows of a sitemap report, each kind sorted and cut to the report's ``limit``.

    crawled: url, status (null: not fetched). Kinds: crawled_not_in_sitemap,
    sitemap_not_crawled, and non_200_in_sitemap with the address as crawled.
    """
    bare = F.rtrim(F.col("url"), F.lit("/"))
    seen = crawled.where(F.coalesce("status", F.lit(0)) != 0)
    a, b = seen.select(bare.alias("url")).distinct(), sitemap.select(bare.alias("url")).distinct()
    failed = seen.where("status <> 200").withColumn("bare", bare).join(b.withColumnRenamed("url", "bare"), "bare", "left_semi")
    parts = {"crawled_not_in_sitemap": a.join(b, "url", "left_anti"), "sitemap_not_crawled": b.join(a, "url", "left_anti"), "non_200_in_sitemap": failed.select("url")}
    out = None
    for kind, rows in parts.items():
        part = rows.select("url").orderBy("url").limit(limit).select(F.lit(kind).alias("kind"), "url")
        out = part if out is None else out.unionByName(part)
    return out


def soft404(probes: DataFrame) -> DataFrame:
    """Per site: answers 200 with HTML to addresses that can't exist."""
    hit = (F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("html"))
    return probes.groupBy("site").agg(F.count_if(hit).alias("hits"), (F.count_if(hit) > 0).alias("trap_detected"))


def render_diff(raw: DataFrame, rendered: DataFrame, key: str) -> DataFrame:
    """Word counts and schema types of raw against rendered records; a ratio of 1.5 or more is significant."""
    a = raw.select(key, F.col("word_count").alias("raw_words"), F.col("schema_types").alias("raw_types"))
    b = rendered.select(key, F.col("word_count").alias("rendered_words"), F.col("schema_types").alias("types"))
    ratio = F.floor(F.col("rendered_words") / F.greatest(F.lit(1), "raw_words") * 100 + 0.5) / 100
    return a.join(b, key).select(key, "raw_words", "rendered_words", ratio.alias("ratio"), F.array_except("types", "raw_types").alias("only_rendered"), F.when(ratio >= 1.5, "significant").otherwise("minor").alias("verdict"))
