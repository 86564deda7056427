"""What happened to rankings after a recommendation was completed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("improved", "worse", "no_change", "insufficient_data")
DAY = 86400
#: Position that counts for a keyword or page that isn't ranked.
UNRANKED = 999


def completed(recs: DataFrame, now: int, days: int = 90) -> DataFrame:
    """Done and resolved recommendations whose last change lies within ``days`` before ``now`` (seconds)."""
    return recs.where(F.col("status").isin("done", "resolved") & (F.col("updated") >= now - days * DAY))


def around(recs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``recs`` with before_ts, the latest snapshot of its domain up to ``updated``, and after_ts, the earliest later one.

    A domain's snapshot times travel as one sorted list beside its rows, so no pair of rows forms.
    """
    times = snapshots.select("domain", "ts").distinct().groupBy("domain").agg(F.collect_list("ts").alias("times"))
    at = F.col("updated")
    out = recs.join(times, "domain", "left")
    before, after = F.array_max(F.filter("times", lambda t: t <= at)), F.array_min(F.filter("times", lambda t: t > at))
    return out.withColumns({"before_ts": before, "after_ts": after}).drop("times")


def by_keyword(was: Column, now: Column, position: Column) -> Column:
    """Verdict from a keyword's evidence (its position before it was raised, and when raised: null if it was gone) and its position after."""
    reference = F.coalesce(F.nullif(now, F.lit(0)), F.nullif(was, F.lit(0)), F.lit(UNRANKED))
    absent = F.when(now.isNull(), "no_change").otherwise("worse")
    return F.when(position.isNull(), absent).when(position < reference, "improved").when(position > reference, "worse").otherwise("no_change")


def by_page(before: Column, after: Column) -> Column:
    """Verdict from a page's average positions; a change counts from 1 on, once rounded to one decimal (0.95 itself rounds down)."""
    delta = F.coalesce(before, F.lit(float(UNRANKED))) - F.coalesce(after, F.lit(float(UNRANKED)))
    verdict = F.when(delta > 0.95, "improved").when(delta < -0.95, "worse").otherwise("no_change")
    return F.when(before.isNull() & after.isNull(), "insufficient_data").otherwise(verdict)


def report(recs: DataFrame, rankings: DataFrame, now: int, days: int = 90) -> DataFrame:
    """(domain, id, completed, verdict, rank) of completed recommendations.

    recs: domain, id, url, status, updated, keyword, was, now. rankings: domain,
    ts, keyword, url, position, seq; of equal keywords in a snapshot the last by
    seq counts. A snapshot on either side is needed; then the keyword decides
    where there is one, else the page. rank orders a report: by verdict, then
    the latest first.
    """
    placed = around(completed(recs, now, days), rankings)
    words = rankings.groupBy("domain", F.col("ts").alias("after_ts"), "keyword").agg(F.max_by("position", "seq").alias("position"))
    pages = rankings.groupBy("domain", "ts", "url").agg(F.avg("position").alias("mean"))
    out = placed.join(words, ["domain", "after_ts", "keyword"], "left")
    for side in ("before", "after"):
        out = out.join(pages.select("domain", F.col("ts").alias(f"{side}_ts"), "url", F.col("mean").alias(side)), ["domain", f"{side}_ts", "url"], "left")
    keyed, paged = F.coalesce("keyword", F.lit("")) != "", F.coalesce("url", F.lit("")) != ""
    verdict = (
        F.when(F.col("before_ts").isNull() | F.col("after_ts").isNull(), "insufficient_data")
        .when(keyed, by_keyword(F.col("was"), F.col("now"), F.col("position")))
        .when(paged, by_page(F.col("before"), F.col("after")))
        .otherwise("insufficient_data")
    )
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict")).cast("int")
    return out.select("domain", "id", F.col("updated").alias("completed"), verdict.alias("verdict")).withColumn("rank", rank)


def ordered(found: DataFrame) -> DataFrame:
    """A report's order."""
    return found.orderBy("rank", F.desc("completed"), "id")


def counts(found: DataFrame, group: str = "domain") -> DataFrame:
    """Verdicts of each group, zero where there is none."""
    return found.groupBy(group).agg(F.count("*").alias("evaluated"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
