"""Saved API responses as rows, and the requests that fetch them.

Responses come as JSON text, one a row. Items lie below result, results, tasks
and items; a VARIANT keeps the parts whose shape differs from command to command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.walker import ResponseItems

OK = 20000


def opened(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with the text replaced by a VARIANT, null where it isn't JSON."""
    return payloads.withColumn(column, F.try_parse_json(column))


def _list(node: Column, path: str) -> Column:
    """Elements of a list below a VARIANT; none if it isn't there or is no list."""
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>"))


def text(node: Column, *paths: str) -> Column:
    """First text below a VARIANT that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(node, p, "string"), F.lit("")) for p in paths])


def number(node: Column, *paths: str) -> Column:
    """First number below a VARIANT that isn't zero, else zero if one is; text doesn't count as a number."""
    found = [F.when(F.schema_of_variant(F.coalesce(F.try_variant_get(node, p, "variant"), F.parse_json(F.lit("null")))).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(node, p, "double")) for p in paths]
    return F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in found], *found)


def results(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per element of the response's result list: (..., at, result)."""
    kept = [c for c in payloads.columns if c != column]
    return payloads.select(*kept, F.posexplode(_list(F.col(column), "$.result")).alias("at", "result"))


def items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per item of every result, in order: (..., at, pos, item)."""
    r = results(payloads, column)
    kept = [c for c in r.columns if c != "result"]
    return r.select(*kept, F.posexplode(_list(F.col("result"), "$.items")).alias("pos", "item"))


def rank_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(..., keyword, position, url, search_volume) of ranking responses, in either of their shapes; items without a keyword or a position are left out."""
    r = items(payloads, column)
    kept = [c for c in r.columns if c not in ("at", "pos", "item")]
    i = F.col("item")
    position = number(i, "$.position", "$.rank_group", "$.ranked_serp_element.serp_item.rank_group")
    volume = number(i, "$.search_volume", "$.keyword_data.keyword_info.search_volume")
    return r.select(
        *kept,
        text(i, "$.keyword", "$.keyword_data.keyword").alias("keyword"),
        position.cast("int").alias("position"),
        F.coalesce(text(i, "$.url", "$.ranked_serp_element.serp_item.url", "$.ranked_serp_element.check_url"), F.lit("")).alias("url"),
        volume.cast("long").alias("search_volume"),
    ).where("keyword is not null and position is not null")


def backlink_summary(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """(key, referring_domains, backlinks): the first candidate with a number, each result before its own items."""
    r = results(payloads, column)
    found = r.select(*key, "at", F.posexplode(F.concat(F.array("result"), _list(F.col("result"), "$.items"))).alias("pos", "c"))
    c = F.col("c")
    found = found.select(*key, "at", "pos", number(c, "$.referring_domains", "$.refdomains").cast("long").alias("referring_domains"), number(c, "$.backlinks", "$.backlinks_count", "$.total_count").cast("long").alias("backlinks"))
    first = found.where("referring_domains is not null or backlinks is not null").groupBy(*key).agg(F.min_by(F.struct("referring_domains", "backlinks"), F.struct("at", "pos")).alias("b"))
    return first.select(*key, "b.*")


def volume_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(keyword, volume) of volume responses; of equal keywords the last counts."""
    r = items(payloads, column)
    found = r.select("at", "pos", text(F.col("item"), "$.keyword").alias("keyword"), number(F.col("item"), "$.search_volume", "$.keyword_info.search_volume").alias("volume"))
    return found.where("keyword is not null and volume is not null").groupBy("keyword").agg(F.max_by("volume", F.struct("at", "pos")).alias("volume"))


def merged_volumes(wanted: DataFrame, snapshot: DataFrame, fetched: DataFrame) -> DataFrame:
    """(keyword, volume) of the wanted keywords: the snapshot's volume over a fetched one; null where neither has it."""
    have = snapshot.select("keyword", F.col("volume").alias("had"))
    return wanted.select("keyword").distinct().join(have, "keyword", "left").join(fetched.select("keyword", F.col("volume").alias("got")), "keyword", "left").select("keyword", F.coalesce("had", "got").alias("volume"))


def serp_items(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """(key, place, item): members of every items list below result, results and tasks, however deep.

    place is the path of steps, so rows sort in document order.
    """
    found = payloads.select(*key, F.to_json(column).alias("_document")).lateralJoin(ResponseItems(F.col("_document").outer()))
    return found.select(*key, "place", F.try_parse_json("item").alias("item"))


def task_errors(payloads: DataFrame, key: list[str], column: str = "payload") -> DataFrame:
    """(key, status_code, message) of failed responses: the response's own code first, then the first task's, where it isn't OK."""
    p = F.col(column)
    own, task = F.try_variant_get(p, "$.status_code", "int"), F.try_variant_get(p, "$.tasks[0].status_code", "int")
    code = F.when(own != OK, own).when(task != OK, task)
    message = F.when(own != OK, F.try_variant_get(p, "$.status_message", "string")).otherwise(F.try_variant_get(p, "$.tasks[0].status_message", "string"))
    return payloads.select(*key, code.alias("status_code"), message.alias("message")).where("status_code is not null")


#: Short and spoken names of places and the names that requests need.
LOCATIONS = {
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "gb": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "usa": "United States",
    "u.s.a.": "United States",
    "us": "United States",
    "u.s.": "United States",
    "america": "United States",
    "united states of america": "United States",
    "uae": "United Arab Emirates",
}


def location(name: Column) -> Column:
    """The place's full name for an alias, whatever its case or the blanks around it; any other name stays as it is."""
    pairs = [v for k, x in LOCATIONS.items() for v in (F.lit(k), F.lit(x))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(name))), name)


#: What a command's request asks for; a name alone stands for the field of that name, ``list`` splits at commas.
_PLACE = {"location_name": "location", "language_name": "language"}
_SERP = {"keyword": "keyword", **_PLACE, "device": "device", "os": "os", "depth": "limit"}
_WORD = {"keyword": "keyword", **_PLACE}
_LIST = {"keywords": "list", **_PLACE}
_SPAN = {"date_from": "date_from", "date_to": "date_to"}
REQUESTS = {
    "serp": {**_SERP, "calculate_rectangles": False},
    "serp-maps": _SERP,
    "serp-news": _SERP,
    "serp-bing": _SERP,
    "serp-youtube": _SERP,
    "volume": _LIST,
    "kd": _LIST,
    "trends": {**_LIST, "type": ("web",), **_SPAN},
    "ideas": {"keywords": "one", **_PLACE, "limit": "limit"},
    "related": {**_WORD, "limit": "limit"},
    "autocomplete": _WORD,
    "business": _WORD,
    "amazon": {**_WORD, "depth": "limit"},
    "ranked": {"target": "target", **_PLACE, "limit": "limit", "order_by": (["keyword_data.keyword_info.search_volume,desc"],)},
    "competitors": {"target": "target", **_PLACE, "limit": "limit"},
    "intersection": {"target1": "target1", "target2": "target2", **_PLACE, "limit": "limit", "intersections": "intersect"},
    "backlinks": {"target": "target", "internal_list_limit": 10, "backlinks_status_type": ("live",)},
    "refdomains": {"target": "target", "limit": "limit", "order_by": (["rank,desc"],)},
    "anchors": {"target": "target", "limit": "limit", "order_by": (["backlinks,desc"],)},
    "whois": {"target": "target", "limit": "limit"},
    "backlinks-history": {"target": "target", **_SPAN},
    "bulk-ranks": {"targets": "targets"},
    "technologies": {"target": "target"},
    "mentions": {"target": "keyword", "limit": "limit"},
    "content": {"keyword": "keyword", "search_mode": ("as_is",), "limit": "limit"},
    "onpage": {"url": "url", "enable_javascript": True, "load_resources": True},
    "lighthouse": {"url": "url", "for_mobile": "mobile", **_PLACE},
}


def request(command: str, **given) -> list[dict]:
    """The task list of a command's request; dates that aren't given are left out."""
    if command not in REQUESTS:
        raise ValueError(f"unknown command {command!r}")
    listed = lambda name: [x.strip() for x in (given.get(name) or "").split(",") if x.strip()]
    place = given.get("location") or ""
    device = given.get("device", "desktop")
    made = {
        "location": LOCATIONS.get(place.strip().lower(), place),
        "list": listed("keywords"),
        "targets": listed("target"),
        "one": [given.get("keyword")],
        "os": "windows" if device == "desktop" else "android",
        "device": device,
        "mobile": device != "desktop",
        "intersect": given.get("mode", "intersect") == "intersect",
    }
    task = {}
    for field, source in REQUESTS[command].items():
        if isinstance(source, tuple):
            task[field] = source[0]
        elif isinstance(source, str):
            value = made[source] if source in made else given.get(source)
            if value or field not in _SPAN:
                task[field] = value
        else:
            task[field] = source
    return [task]


def analytics_request(command: str, **given) -> dict:
    """Body of a request to the search console, field data or analytics services."""
    if command == "pagespeed":
        return {"url": given["url"], "strategy": given.get("strategy", "mobile")}
    if command in ("crux", "crux-history"):
        return {"formFactor": given.get("form_factor", "PHONE"), "origin" if given.get("origin") else "url": given["target"]}
    if command == "gsc-queries":
        return {"startDate": given["start"], "endDate": given["end"], "dimensions": ["query", "page"], "rowLimit": given.get("limit", 100)}
    if command == "gsc-inspect":
        return {"inspectionUrl": given["url"], "siteUrl": given["site"]}
    if command == "gsc-sitemaps":
        return {}
    if command == "ga4-organic":
        channel = {"filter": {"fieldName": "sessionDefaultChannelGroup", "stringFilter": {"value": "Organic Search"}}}
        metrics = [{"name": n} for n in ("sessions", "engagedSessions", "conversions")]
        return {"dateRanges": [{"startDate": given["start"], "endDate": given["end"]}], "dimensions": [{"name": "landingPagePlusQueryString"}], "metrics": metrics, "dimensionFilter": channel, "limit": given.get("limit", 100)}
    raise ValueError(f"unknown command {command!r}")


def search_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(..., query, page, clicks, impressions, ctr, position) of saved search console responses."""
    kept = [c for c in payloads.columns if c != column]
    rows = payloads.select(*kept, F.explode(_list(F.col(column), "$.rows")).alias("r"))
    value = lambda name: F.try_variant_get("r", f"$.{name}", "double").alias(name)
    return rows.select(*kept, F.try_variant_get("r", "$.keys[0]", "string").alias("query"), F.try_variant_get("r", "$.keys[1]", "string").alias("page"), *[value(n) for n in ("clicks", "impressions", "ctr", "position")])
