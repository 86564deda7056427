"""Crawl over pages fetched beforehand: robots rules, frontier waves, budget."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text as X
from pagelode.operators.store import cut


def robots_rules(spark: SparkSession, robots: str, agent: str = "*") -> DataFrame:
    """(prefix, allow) of the groups of a robots.txt that name the agent, else of the ``*`` groups."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    named: list[str] = []
    fresh = True
    for raw in robots.splitlines():
        key, _, value = (x.strip() for x in raw.partition("#")[0].partition(":"))
        key = key.lower()
        if key == "user-agent":
            named = [value.lower()] if fresh is False else [*named, value.lower()]
            fresh = True
            for n in named:
                groups.setdefault(n, [])
        elif key in ("allow", "disallow"):
            fresh = False
            for n in named:
                if value:
                    groups[n].append((value, key == "allow"))
    rules = groups.get(agent.lower(), groups.get("*", []))
    return spark.createDataFrame(rules, "prefix string, allow boolean")


def allowed(rules: list[tuple[str, bool]]) -> Column:
    """True where the longest matching prefix of the column ``path`` allows it; ties allow, no match allows."""
    out = F.lit(True)
    for prefix, allow in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        out = F.when(F.startswith("path", F.lit(prefix)), F.lit(allow)).otherwise(out)
    return out


def crawl(pages: DataFrame, links: DataFrame, start: str, max_pages: int | None = 200, robots: list[tuple[str, bool]] = (), max_depth: int | None = None) -> DataFrame:
    """(url, depth, place, status, blocked_by_robots), at most ``max_pages`` (the crawl's budget; None: all).

    pages: (url, status), links: (src, pos, dst). Waves follow depth. place is
    the least chain of link positions that leads to a page, so depth and place
    together give the crawl order without numbering a wave in one task.
    """
    path = X.normal_url(F.col("url"))
    table = pages.select("url", "status").dropDuplicates(["url"]).withColumn("path", F.regexp_replace(path, r"^[a-z][a-z0-9+.-]*://[^/]*", ""))
    table = cut(table.withColumn("blocked", ~allowed(list(robots))))
    wave = cut(table.where(F.col("url") == start).select("url", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place")))
    seen, taken = wave, wave.count()
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if max_pages is not None and taken >= max_pages:
            break
        live = wave.join(table.where("not blocked and status = 200"), "url", "left_semi")
        chain = F.concat("place", F.array(F.col("pos").cast("int")))
        found = live.join(links, F.col("url") == F.col("src")).groupBy("dst").agg(F.min(chain).alias("place"))
        fresh = found.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), "place").join(seen, "url", "left_anti").join(table.select("url"), "url", "left_semi")
        if max_pages is not None:
            fresh = fresh.orderBy("place", "url").limit(max_pages - taken)
        wave = cut(fresh)
        n = wave.count()
        if not n:
            break
        taken += n
        seen = seen.unionByName(wave)
        if depth % 8 == 0:
            seen = cut(seen)
    out = seen.join(table, "url")
    return out.select("url", "depth", "place", F.when(~F.col("blocked"), F.col("status")).alias("status"), F.col("blocked").alias("blocked_by_robots"))


def truncated(crawled: DataFrame, links: DataFrame) -> bool:
    """Whether known links lead outside what was crawled."""
    return not links.join(crawled.select(F.col("url").alias("src")), "src", "left_semi").join(crawled.select(F.col("url").alias("dst")), "dst", "left_anti").isEmpty()
