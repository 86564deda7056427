"""Link graph: degrees, depth by frontier expansion, orphans, anchors, redirects."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import words as W
from pagelode.operators.store import cut


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, inlinks, outlinks): links count with multiplicity; targets outside nodes don't count."""
    known = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    inn = known.groupBy("dst").count().toDF("node", "inlinks")
    out = edges.groupBy("src").count().toDF("node", "outlinks")
    return nodes.select("node").join(inn, "node", "left").join(out, "node", "left").na.fill(0, ["inlinks", "outlinks"])


def orphans(nodes: DataFrame, edges: DataFrame, start) -> DataFrame:
    return nodes.where(F.col("node") != start).join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node")


def depths(nodes: DataFrame, edges: DataFrame, start, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of what links reach from start, within ``max_depth`` levels if given; each level joins only its frontier and drops what was seen."""
    # links lie by their source once and for all, so each level moves only its frontier
    known = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    steps = cut(known.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").distinct())
    seen = cut(nodes.where(F.col("node") == start).select("node", F.lit(0).alias("depth")))
    frontier = seen
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        frontier = cut(frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % 8 == 0:
            seen = cut(seen)
    return seen


def parents(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth, parent): the least linking node of the level above."""
    above = reached.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    candidates = edges.select("src", F.col("dst").alias("node")).join(above, "src").groupBy("node", "depth").agg(F.min("src").alias("parent"))
    return reached.join(candidates, ["node", "depth"], "left")


def unreachable(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.select("node").join(reached, "node", "left_anti")


def top(scored: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The n greatest by column, ties by greater node; zeros are left out."""
    return scored.where(F.col(column) > 0).orderBy(F.desc(column), F.desc("node")).limit(n).select("node", column)


def roles(scored: DataFrame, reached: DataFrame, start, hub: int = 25) -> DataFrame:
    """(node, role, size) for drawing: home, hub, unreachable or page."""
    joined = scored.join(reached, "node", "left")
    role = F.when(F.col("node") == start, "home").when(F.col("depth").isNull(), "unreachable").when(F.col("outlinks") >= hub, "hub").otherwise("page")
    return joined.select("node", role.alias("role"), (5 + F.least(F.lit(14.0), F.sqrt("inlinks") * 2.2)).alias("size"))


def anchor_quality(edges: DataFrame) -> DataFrame:
    """One row: anchors in all, generic ones and their share in percent, one decimal."""
    low = F.lower(F.trim("anchor"))
    generic = F.count_if(low.isin(*W.GENERIC_ANCHORS))
    return edges.where(low != "").agg(F.count("*").alias("anchors"), generic.alias("generic"), (F.floor(generic * 1000.0 / F.greatest(F.count("*"), F.lit(1)) + 0.5) / 10).alias("generic_pct"))


def top_anchors(edges: DataFrame, n: int = 15) -> DataFrame:
    return edges.where("anchor <> ''").groupBy("anchor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anchor").limit(n)


def trace_redirects(starts: DataFrame, hops: DataFrame, max_hops: int = 10) -> DataFrame:
    """(start, final_url, final_status, redirect_count, verdict) of every start.

    hops: (url, status, location), one row an address. All starts advance one
    hop at a time; an address without a row answers with status 0.
    """
    redirect = F.col("status").isin(*W.REDIRECTS)
    table = hops.select("url", "status", "location")
    live = starts.select("start", F.col("start").alias("url"), F.array("start").alias("path"), F.lit(0).alias("redirects"))
    done = []
    for _ in range(max_hops + 1):
        seen = cut(live.join(table, "url", "left").withColumn("status", F.coalesce("status", F.lit(0))))
        goes = redirect & (F.coalesce("location", F.lit("")) != "")
        loops = goes & F.array_contains("path", F.col("location"))
        count = F.col("redirects") + redirect.cast("int")
        ended = seen.where(~goes | loops)
        state = F.when(redirect & ~goes, "broken_location").when(loops, "loop_or_limit").when(F.col("status") == 0, "request_failed").when(F.col("status") != 200, "non_200_final").when(count > 1, "redirect_chain").otherwise("ok")
        done.append(ended.select("start", F.col("url").alias("final_url"), F.col("status").alias("final_status"), count.alias("redirect_count"), state.alias("verdict")))
        live = seen.where(goes & ~loops).select("start", F.col("location").alias("url"), F.concat("path", F.array("location")).alias("path"), count.alias("redirects"))
        if live.isEmpty():
            break
    else:
        done.append(live.select("start", F.col("url").alias("final_url"), F.lit(0).alias("final_status"), F.col("redirects").alias("redirect_count"), F.lit("loop_or_limit").alias("verdict")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def canonical_audit(traces: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site the verdict over its variants. sites: (site, canonical, start)."""
    j = sites.join(traces, "start")
    is_canonical = F.col("start") == F.col("canonical")
    verdict = (
        F.when(F.col("verdict").isin("loop_or_limit", "broken_location"), F.col("verdict"))
        .when(F.col("final_status") != 200, "non_200_final")
        .when(~is_canonical & (F.col("redirect_count") == 0), "variant_direct_200")
        .when(F.col("final_url") != F.col("canonical"), "wrong_final_url")
        .when(is_canonical & (F.col("redirect_count") == 0), "canonical_200")
        .when(F.col("redirect_count") > 1, "redirect_chain")
        .otherwise("redirect_ok")
    )
    good = F.col("v").isin("canonical_200", "redirect_chain", "redirect_ok")
    overall = F.when(F.bool_or(~good), "failure").when(F.bool_or(F.col("v") == "redirect_chain"), "needs_chain_cleanup").otherwise("healthy")
    return j.withColumn("v", verdict).groupBy("site").agg(overall.alias("overall"), F.count_if(~good).alias("failures"), F.count_if(F.col("v") == "redirect_chain").alias("chains"))


def near_duplicate_report(pairs: DataFrame) -> DataFrame:
    """Pairs with similarity to two decimals, the most similar first."""
    return pairs.withColumn("similarity", F.bround("similarity", 2)).orderBy(F.desc("similarity"), "a", "b")
