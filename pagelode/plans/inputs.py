"""Derived inputs of the catalogue queries: the test tables seen as edges, logs, rankings and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions import words as W
from pagelode.operators.store import cut

ANCHORS = ("click here", "Read more", "Guide", "Pricing", "here")
AGENTS = (
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0)",
    "Mozilla/5.0 GPTBot/1.0",
    "ClaudeBot/1.0",
    "Mozilla/5.0 (X11; Linux) Firefox/120.0",
)
DAY = 86400


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nodes(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("node"))


def edges(spark, sf_dir):
    """Three links from every page but each fifth, by arithmetic on its id; every target is a known page or a gap, and no link leads to each eleventh page."""
    p = read(spark, sf_dir, "pages").where("page_id % 5 <> 4").select(F.col("page_id").alias("src"))
    n = p.agg(F.max("src") + 2).first()[0]
    e = p.select("src", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    anchor = F.element_at(F.array(*[F.lit(a) for a in ANCHORS]), ((F.col("src") + F.col("k")) % len(ANCHORS) + 1).cast("int"))
    to = (F.col("src") * 7 + F.col("k") * F.col("k") * 3) % F.lit(n)
    return e.select("src", F.when(to % 11 == 3, to - 1).otherwise(to).alias("dst"), anchor.alias("anchor"), F.col("k").alias("pos"))


def log_lines(spark, sf_dir):
    """Events as combined-format lines; errors come out in another format, which stays unparsed."""
    e = read(spark, sf_dir, "events")
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.col("user_id") % len(AGENTS) + 1).cast("int"))
    path = F.concat(F.lit("/"), "event_type", F.lit("/"), (F.col("event_id") % 13).cast("string"), F.when(F.col("event_id") % 3 == 0, "?ref=x").otherwise(""))
    status = F.when(F.col("event_id") % 10 == 0, "404").otherwise("200")
    line = F.concat(F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), path, F.lit(' HTTP/1.1" '), status, F.lit(' 512 "-" "'), agent, F.lit('"'))
    return e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(line).alias("value"))


def rankings(spark, sf_dir, year: int):
    """(keyword, position, volume): all parts by the quantity ordered in a year; ranges are numbered apart, so no task ranks all."""
    from pyspark.sql import Window

    sold = read(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    ranged = cut(sold.repartitionByRange(F.desc("q"), F.asc("l_partkey")).withColumn("part", F.spark_partition_id()))
    sizes = dict(ranged.groupBy("part").count().collect())  # a row for each range
    before = [F.struct(F.lit(p).alias("part"), F.lit(sum(n for k, n in sizes.items() if k < p)).cast("long").alias("before")) for p in sorted(sizes)]
    offset = F.element_at(F.map_from_entries(F.array(*before)), F.col("part")) if before else F.lit(0)
    position = (F.row_number().over(Window.partitionBy("part").orderBy(F.desc("q"), "l_partkey")) + offset).cast("int")
    return ranged.select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("keyword"), position.alias("position"), F.col("q").cast("long").alias("volume"))


def supplier_rankings(spark, sf_dir, year: int):
    """(supplier, keyword, position, volume): parts of each supplier by quantity in a year."""
    from pyspark.sql import Window

    sold = read(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year).groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    position = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey"))
    return sold.select(F.col("l_suppkey").alias("supplier"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("keyword"), position.alias("position"), F.col("q").cast("long").alias("volume"))


def ledger(spark, sf_dir):
    """(ts seconds, command, cost): events as paid calls, cost in whole hundredths to keep sums exact."""
    return read(spark, sf_dir, "events").select(F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("command"), F.round(F.col("value") * 100).cast("long").alias("cost"), "event_id")


def recommendation_events(spark, sf_dir):
    """(id, seq, ts, event, status, severity): events as a recommendation log keyed by user."""
    kind = F.col("event_type")
    raised = kind.isin("error", "view", "signup")
    status = F.when(raised, F.lit("")).otherwise(F.element_at(F.array(*[F.lit(s) for s in (*W.STATUSES, "bogus")]), (F.col("event_id") % 6 + 1).cast("int")))
    severity = F.when(raised, F.element_at(F.array(*[F.lit(s) for s in W.SEVERITIES]), (F.col("event_id") % 4 + 1).cast("int"))).otherwise("")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("ts"), F.when(raised, "raise").otherwise("status").alias("event"), status.alias("status"), severity.alias("severity"))


def hops(spark, sf_dir):
    """A redirect table over page ids: chains, loops, broken locations and final answers."""
    i = F.col("page_id")
    n = i.cast("string")
    status = F.when(i % 6 == 0, 301).when(i % 6 == 1, 302).when(i % 11 == 5, 404).otherwise(200)
    location = F.when(i % 12 == 6, "").when(i % 6 == 0, F.concat(F.lit("u"), (i + 1).cast("string"))).when(i % 30 == 1, F.concat(F.lit("u"), (i - 1).cast("string"))).when(i % 6 == 1, F.concat(F.lit("u"), (i + 1).cast("string")))
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("u"), n).alias("url"), status.alias("status"), F.coalesce(location, F.lit("")).alias("location"))


def epoch(day: str) -> int:
    """Seconds of a day's start."""
    from datetime import datetime, timezone

    return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp())


#: Years whose rankings are snapshots, taken on their last day.
SNAPSHOT_YEARS = (1994, 1996, 1998)


def ranking_snapshots(spark, sf_dir):
    """(domain, ts, keyword, url, position, seq): parts of each supplier in three years; each thirteenth supplier has only the last."""
    out = None
    for year in SNAPSHOT_YEARS:
        r = supplier_rankings(spark, sf_dir, year)
        if year != SNAPSHOT_YEARS[-1]:
            r = r.where("supplier % 13 <> 0")
        part = F.regexp_extract("keyword", "([0-9]+)", 1).cast("long")
        r = r.select(F.col("supplier").alias("domain"), F.lit(epoch(f"{year}-12-31")).alias("ts"), "keyword", F.concat(F.lit("u"), (part % 50).cast("string")).alias("url"), "position", part.alias("seq"))
        out = r if out is None else out.unionByName(r)
    return out


def completed_recs(spark, sf_dir):
    """(domain, id, url, status, updated, keyword, was, now): parts ranked in 1996 as recommendations, some for a keyword, some for a page, some for neither."""
    r = supplier_rankings(spark, sf_dir, 1996).withColumn("part", F.regexp_extract("keyword", "([0-9]+)", 1).cast("long"))
    p = F.col("part")
    status = F.element_at(F.array(*[F.lit(s) for s in W.STATUSES]), (p % 5 + 1).cast("int"))
    return r.select(
        F.col("supplier").alias("domain"), p.alias("id"), F.when(p % 7 == 1, "").otherwise(F.concat(F.lit("u"), (p % 50).cast("string"))).alias("url"), status.alias("status"),
        (F.lit(epoch("1996-07-01")) + (p * 37 % 1000) * DAY).alias("updated"), F.when(p % 3 != 0, F.col("keyword")).alias("keyword"),
        F.col("position").alias("was"), F.when(p % 4 != 0, F.col("position") + (p % 11).cast("int")).alias("now"),
    )


def _cells(spark, sf_dir):
    """Suppliers in groups of twenty, in order."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.floor(s / 20).cast("long").alias("grp"), s.alias("k"), F.regexp_replace("s_name", "#", " ").alias("name"))


def search_payloads(spark, sf_dir):
    """(grp, payload): search responses of twenty items each, in two shapes; the items repeat some pages and hold overviews and other kinds."""
    k = F.col("k")
    kind = F.when(k % 20 == 7, "ai_overview").when(k % 5 == 4, "people_also_ask").when(k % 9 == 0, F.lit(None).cast("string")).otherwise("organic")
    path = F.element_at(F.array(*[F.lit(x) for x in ("/blog/", "/shop/", "/contact/", "/x/", "/tool/")]), (F.col("grp") % 5 + 1).cast("int"))
    url = F.when(k % 20 == 13, "").otherwise(F.concat(F.lit("https://s.example"), path, (k - k % 2).cast("string")))
    references = F.when(k % 20 == 7, F.array(*[F.struct(F.concat(F.lit("d"), (k % m).cast("string"), F.lit(".example")).alias("domain")) for m in (3, 5, 4)]))
    item = F.struct(kind.alias("type"), url.alias("url"), F.concat(F.lit("Item "), (k - k % 4).cast("string")).alias("title"), F.concat(F.lit("as "), F.col("name"), F.lit(" says")).alias("text"), references.alias("references"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"])  # twenty a group
    g = _cells(spark, sf_dir).groupBy("grp").agg(items.alias("items"))
    flat = F.to_json(F.struct(F.array(F.struct(F.lit(20000).alias("status_code"), F.array(F.struct("items")).alias("result"))).alias("tasks")))
    failed = F.to_json(F.struct(F.array(F.struct(F.lit(40501).alias("status_code"), F.lit("bad field").alias("status_message"), F.array(F.struct("items")).alias("result"))).alias("tasks")))
    return g.select("grp", F.when(F.col("grp") % 4 == 3, failed).otherwise(flat).alias("payload"))


def nested_payloads(spark, sf_dir):
    """(grp, payload): the groups' search responses below up to thirteen further results, each with an item of its own."""
    def wrap(inner, level):
        own = F.concat(F.lit('{"items": [{"url": "/'), F.col("grp").cast("string"), F.lit("/"), level.cast("string"), F.lit('"}, 7], "'))
        return F.concat(own, F.when(level % 2 == 0, 'result": [').otherwise('tasks": [null, ['), inner, F.when(level % 2 == 0, "]}").otherwise("]]}"))

    levels = F.when(F.col("grp") % 14 > 0, F.sequence(F.lit(1), (F.col("grp") % 14).cast("int"))).otherwise(F.array().cast("array<int>"))
    return search_payloads(spark, sf_dir).select("grp", F.aggregate(levels, F.col("payload"), wrap).alias("payload"))


def ranking_payloads(spark, sf_dir):
    """(grp, payload): ranking responses in two item shapes, with zero positions and items without a keyword."""
    k = F.col("k")
    flat = F.struct(F.when(k % 6 != 0, F.col("name")).alias("keyword"), (k % 3).cast("int").alias("position"), (k % 9).cast("int").alias("rank_group"), F.concat(F.lit("f"), k.cast("string")).alias("url"), F.when(k % 4 != 0, k * 10).alias("search_volume"))
    deep = F.struct(
        F.struct(F.col("name").alias("keyword"), F.struct((k * 7).alias("search_volume")).alias("keyword_info")).alias("keyword_data"),
        F.struct(F.struct((k % 50).cast("int").alias("rank_group"), F.when(k % 5 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("url")).alias("serp_item"), F.concat(F.lit("c"), k.cast("string")).alias("check_url")).alias("ranked_serp_element"),
    )
    text = F.when(F.col("grp") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(deep))
    items = F.transform(F.sort_array(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"])
    g = _cells(spark, sf_dir).groupBy("grp").agg(F.array_join(items, ",").alias("items"))
    return g.select("grp", F.concat(F.lit('{"result": [null, {"items": ['), "items", F.lit("]}]}")).alias("payload"))


def backlink_payloads(spark, sf_dir):
    """(k, payload): backlink responses whose numbers sit in the result, in an item, under other names, or nowhere."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('{"result": [{"referring_domains": '), n, F.lit(', "backlinks": '), (k * 3).cast("string"), F.lit("}]}")))
        .when(k % 5 == 1, F.concat(F.lit('{"result": [{"items": [{"x": 1}, {"refdomains": '), n, F.lit("}]}]}")))
        .when(k % 5 == 2, F.concat(F.lit('{"result": ["none", {"backlinks": "many", "items": [{"total_count": '), n, F.lit('}, {"backlinks": 1}]}]}')))
        .when(k % 5 == 3, F.concat(F.lit('{"result": [{"referring_domains": 0, "refdomains": '), n, F.lit(', "backlinks_count": 2.0}]}')))
        .otherwise("{broken")
    )
    return read(spark, sf_dir, "supplier").select(k.alias("k"), text.alias("payload"))


def volume_payloads(spark, sf_dir):
    """(grp, payload): volumes of the names in groups of twenty, half of them nested, some missing."""
    k = F.col("k")
    flat, deep = F.to_json(F.struct(F.col("name").alias("keyword"), (k * 10).alias("search_volume"))), F.to_json(F.struct(F.col("name").alias("keyword"), F.struct((k * 9).alias("search_volume")).alias("keyword_info")))
    text = F.when(k % 7 == 0, F.lit('{"keyword": "no volume"}')).when(k % 2 == 0, flat).otherwise(deep)
    g = _cells(spark, sf_dir).groupBy("grp").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("items"))
    return g.select("grp", F.concat(F.lit('{"result": [{"items": ['), "items", F.lit("]}]}")).alias("payload"))


def spread_parts(spark, sf_dir):
    """(p_partkey) of all parts, dealt over all tasks: a part makes a page a hundred times its size, and few files hold the parts."""
    return read(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def made_pages(spark, sf_dir):
    """(k, url, html): parts as pages whose elements come and go with the part's number."""
    k = F.col("p_partkey")
    n = k.cast("string")

    def when(m: int, r: int, text: str):
        return F.when(k % m == r, text).otherwise("")

    def times(m: int, text: str):
        return F.repeat(F.lit(text), (k % m).cast("int"))

    parts = [
        F.when(k % 3 != 0, '<html lang=" en ">').otherwise("<html>"), F.lit("<head><title>Page "), n, F.lit("</title>"),
        when(2, 0, '<meta name="viewport" content="w">'), when(3, 1, '<meta name="description" content=" About things ">'), when(4, 1, '<meta property="og:title" content="O">'),
        when(5, 1, '<meta name="twitter:card" content="summary">'), when(6, 1, '<meta name="robots" content="index, NOINDEX">'), when(7, 1, '<meta name="author" content="Ann">'),
        when(8, 1, '<link rel="canonical" href="/p">'), when(9, 1, '<link rel="stylesheet author" href="http://cdn/x.css">'), when(17, 1, '<meta name="dc.date" content="x">'),
        when(10, 1, '<script type="application/ld+json">{"author": {"@type": "Person"}, "@type": ["Article", "FAQPage"], "datePublished": "x"}</script>'),
        when(10, 2, '<script type="application/ld+json">{"@type": broken</script>'), when(13, 1, '<script src="https://x/hcaptcha.js">var guarantee = 1;</script>'),
        F.lit("</head><body>"), when(4, 2, '<a href="#main">Skip to content</a>'), F.when(k % 3 != 2, "<nav></nav>").otherwise(""), F.when(k % 5 != 2, '<div role="main"></div>').otherwise(""),
        times(3, "<h1>Alpha  <b>beta</b></h1>"), when(2, 1, "<h2>How it works</h2><p>one two <i>three</i></p><p>four</p>"), when(4, 3, "<h4>deep</h4>"), times(3, "<ul><li>x</li></ul>"),
        times(4, '<img src="a" alt="ok">'), times(3, '<img src="http://b" alt=" ">'), times(3, '<a href="https://other.example/">Other</a>'), times(4, '<a href="/in">Here</a>'), times(2, '<a href="/e"> </a>'),
        times(2, "<a>no target</a>"), times(3, '<a href="/e"><img src="c" alt="named"></a>'), when(6, 3, '<a href="TEL:123">Call us</a>'), times(3, "<button> </button>"), times(2, '<button aria-label="x"></button>'), times(3, "<button>Buy now</button>"),
        times(3, "<table><tr><td>1</td></tr></table>"), times(2, "<table><tr><th>h</th></tr></table>"), times(2, '<iframe src="x"></iframe>'), times(3, '<iframe title="t"></iframe>'),
        when(3, 0, '<form><input><input type="hidden"><label for=" e ">E</label><input id="e"><label>L <select></select></label><input type="submit"><textarea title="t"></textarea></form>'),
        times(2, '<span tabindex="3"></span><span tabindex="-1"></span>'), times(4, '<i id="d"></i>'), times(2, "<time>t</time>"), times(3, "guarantee; "), times(2, "<p>last chance</p>"), when(11, 1, '<div class="x-intercom"></div>'),
    ]
    return spread_parts(spark, sf_dir).select(k.alias("k"), F.lit("https://site.example/a").alias("url"), F.concat(*parts).alias("html"))


def fetches(spark, sf_dir):
    """(save, url, status, body, headers, final_url): pages as two saves of a crawl fetched them."""
    i = F.col("page_id")
    kind = F.when(i % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    headers = F.when(i % 2 == 0, F.create_map(F.lit("Content-Type"), kind, F.lit("STRICT-Transport-Security"), F.lit("max-age=1"))).otherwise(F.create_map(F.lit("content-type"), kind))
    final = F.when(i % 4 == 0, F.concat("url", F.lit("#end")))
    return read(spark, sf_dir, "pages").select((1 + i % 2).alias("save"), "url", F.when(i % 17 == 3, 404).otherwise(200).alias("status"), F.col("html").alias("body"), headers.alias("headers"), final.alias("final_url"))


def site_versions(spark, sf_dir):
    """Two versions of a site's files (path, digest, content): some files get the next page's text, some go, some are new."""
    i = F.col("page_id")
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    old = p.select(F.concat(F.lit("p/"), i.cast("string")).alias("path"), F.col("html").alias("content"))
    following = p.select((i - 1).alias("page_id"), F.col("html").alias("later"))
    kept = p.where(i % 11 != 5).join(following, "page_id", "left").select(F.concat(F.lit("p/"), i.cast("string")).alias("path"), F.when(i % 3 == 0, F.coalesce("later", "html")).otherwise(F.col("html")).alias("content"))
    new = p.where(i % 13 == 1).select(F.concat(F.lit("new/"), i.cast("string")).alias("path"), F.col("html").alias("content"))
    return tuple(v.select("path", F.sha2("content", 256).alias("digest"), F.col("content").cast("binary").alias("content")) for v in (old, kept.unionByName(new)))


def response_batches(spark, sf_dir):
    """(batch, key, command, body, cost, detail, ts): events as paid responses in three batches."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        (i % 3).alias("batch"), F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("key"), F.col("event_type").alias("command"), F.concat(F.lit("body "), i.cast("string")).alias("body"),
        (i % 100 / 4).alias("cost"), F.repeat(F.lit("d"), (i % 150).cast("int")).alias("detail"), F.unix_timestamp("ts").alias("ts"),
    )
