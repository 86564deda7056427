"""Drafts, machine patches and JSON-LD from page records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.operators.store import never_broadcast


def meta_draft(text: Column, limit: int = 155) -> Column:
    """A description of at most ``limit`` characters, cut at a word, without a trailing mark."""
    short = F.length(text) <= limit
    cut = F.regexp_replace(F.substring(text, 1, limit), r"\s\S*\z", "")
    return F.regexp_replace(F.when(short, text).otherwise(cut), r"[ .,;:]+\z", "")


def titled(text: Column) -> Column:
    """Every run of letters with a capital first letter, the rest small."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), "")


def breadcrumb(url: Column) -> Column:
    """BreadcrumbList of a URL: the site as Home, then its path segments."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")

    def item(position, name, address):
        return F.struct(F.lit("ListItem").alias("@type"), position.alias("position"), name.alias("name"), address.alias("item"))

    def step(p: Column, i: Column) -> Column:
        name = F.trim(F.translate(p, "-_", "  "))
        return item(i + 2, F.when(name == "", "Page").otherwise(titled(name)), F.concat(root, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))

    items = F.concat(F.array(item(F.lit(1), F.lit("Home"), root)), F.transform(parts, step))
    return F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Templates of machine patches; {{name}} stands for a derived value.
TEMPLATES = {
    "missing-canonical": '<link rel="canonical" href="{{url}}">',
    "missing-meta-description": '<meta name="description" content="{{meta_draft}}">',
    "missing-title": "<title>{{h1_first}}</title>",
    "missing-viewport": '<meta name="viewport" content="width=device-width, initial-scale=1">',
    "missing-html-lang": 'lang="{{lang}}"',
    "missing-breadcrumb-schema": '<script type="application/ld+json">{{breadcrumb}}</script>',
}


def patch_plan(found: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, patch, skipped): resolved patches of fired rules that have one; a missing value skips the patch."""
    table = found.sparkSession.createDataFrame(sorted(TEMPLATES.items()), "rule_id string, template string")
    names = [c for c in values.columns if c != key]
    j = found.select(key, "rule_id").join(F.broadcast(table), "rule_id").join(never_broadcast(values), key)
    patch = F.col("template")
    for n in names:
        mark, v = F.lit("{{" + n + "}}"), F.nullif(F.col(n), F.lit(""))
        patch = F.replace(patch, mark, F.coalesce(v if n == "breadcrumb" else escaped(v), mark))
    skipped = F.contains(patch, F.lit("{{"))
    return j.select(key, "rule_id", F.when(~skipped, patch).alias("patch"), skipped.alias("skipped"))


def apply_patch(html: Column, rule_id: Column, patch: Column) -> Column:
    """HTML with one patch put into its first fitting place; unknown rules and null patches leave it alone."""
    quoted = F.regexp_replace(patch, r"([\\$])", r"\\$1")
    in_head = F.regexp_replace(html, r"(?is)^(.*?)</head>", F.concat(F.lit("$1"), quoted, F.lit("</head>")))
    in_title = F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.regexp_replace(html, r"(?is)^(.*?)<title[^>]*>.*?</title>", F.concat(F.lit("$1"), quoted))).otherwise(in_head)
    in_html = F.regexp_replace(html, r"(?is)^(.*?)<html\b", F.concat(F.lit("$1<html "), quoted))
    return F.when(patch.isNull(), html).when(rule_id == "missing-html-lang", in_html).when(rule_id == "missing-title", in_title).when(rule_id.isin(*TEMPLATES), in_head).otherwise(html)


#: Properties a type is expected to have.
RECOMMENDED = {
    "Organization": ["name", "url", "logo"],
    "WebSite": ["name", "url"],
    "WebPage": ["name", "url"],
    "Article": ["headline", "author", "datePublished", "image"],
    "BlogPosting": ["headline", "author", "datePublished", "image"],
    "NewsArticle": ["headline", "author", "datePublished", "image"],
    "Product": ["name", "image", "description", "offers"],
    "Offer": ["price", "priceCurrency", "availability"],
    "Review": ["reviewRating", "author", "itemReviewed"],
    "AggregateRating": ["ratingValue", "reviewCount"],
    "BreadcrumbList": ["itemListElement"],
    "LocalBusiness": ["name", "address", "telephone", "openingHours"],
    "Person": ["name"],
    "Event": ["name", "startDate", "location"],
    "JobPosting": ["title", "description", "hiringOrganization", "jobLocation"],
    "Course": ["name", "description", "provider"],
    "FAQPage": ["mainEntity"],
    "VideoObject": ["name", "description", "thumbnailUrl", "uploadDate"],
}


#: Types by the names they are asked for.
TYPE_NAMES = {name.lower(): name for name in RECOMMENDED} | {"video": "VideoObject"}


def coerced(value: str):
    """A property's text as list, bool, number or text: commas part a list, and what reads as a number is one."""
    if "," in value:
        return [coerced(x.strip()) for x in value.split(",")]
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def json_ld(kind: str, properties: dict[str, str]) -> tuple[str, list[str]]:
    """JSON-LD of a type from dotted properties, and the expected properties that are missing."""
    name = TYPE_NAMES.get(kind.lower(), kind)
    out: dict = {"@context": "https://schema.org", "@type": name}
    for path, value in properties.items():
        node, rest = out, path.strip().split(".")
        for part in rest[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"{part} of {path} already holds a plain value")
        node[rest[-1]] = coerced(value.strip())
    return json.dumps(out, ensure_ascii=False), [p for p in RECOMMENDED.get(name, []) if p not in out]


#: Types whose properties an entity of the same type can fill.
ENTITY_TYPES = ("Organization", "Person", "Product")


def entity_properties(entities: DataFrame, kind: str, site_url: str = "") -> DataFrame:
    """Properties (name, description, sameAs, url, jobTitle) of the first entity, by pos, of a type; none for types without entities."""
    name = TYPE_NAMES.get(kind.lower(), kind)
    first = entities.where((F.col("type") == name) & F.lit(name in ENTITY_TYPES)).orderBy("pos").limit(1)
    site = F.nullif(F.rtrim(F.lit(site_url), F.lit("/")), F.lit(""))
    return first.select("name", F.nullif("description", F.lit("")).alias("description"), F.when(F.size("sameAs") > 0, F.array_join("sameAs", ",")).alias("sameAs"), F.when(F.lit(name == "Organization"), site).alias("url"), F.when(F.lit(name == "Person"), F.nullif("role", F.lit(""))).alias("jobTitle"))
