"""Snapshots, drift, forecast, impact, watch thresholds and the ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as X
from pagelode.functions import words as W
from pagelode.operators.impact import by_page as impact  # noqa: F401 - the verdict of values around a change


def drift_rankings(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, was, now, change (gained, lost, up, down, same), delta; of equal keywords the last by seq counts, where rows have one."""
    if "seq" in old.columns:
        old, new = (x.groupBy(*keys).agg(F.max_by("position", "seq").alias("position")) for x in (old, new))
    a = old.select(*keys, F.col("position").alias("was"))
    b = new.select(*keys, F.col("position").alias("now"))
    j = a.join(b, keys, "full_outer")
    delta = F.col("was") - F.col("now")
    change = F.when(F.col("was").isNull(), "gained").when(F.col("now").isNull(), "lost").when(delta > 0, "up").when(delta < 0, "down").otherwise("same")
    return j.select(*keys, "was", "now", change.alias("change"), delta.alias("delta"))


def drift_stats(drift: DataFrame) -> DataFrame:
    return drift.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("gained", "lost", "up", "down", "same")])


def drift_moves(drift: DataFrame, change: str, keys: list[str]) -> DataFrame:
    """Keywords that moved up or down, the furthest first; equal moves by name."""
    return drift.where(F.col("change") == change).orderBy(F.desc(F.abs("delta")), *keys)


def drift_values(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics that both versions have with different values."""
    a, b = old.select(*keys, F.col("value").alias("was")), new.select(*keys, F.col("value").alias("now"))
    return a.join(b, keys, "full_outer").where("was is not null and now is not null and was <> now").withColumn("delta", F.col("now") - F.col("was"))


def health(scores: DataFrame, group: list[str]) -> DataFrame:
    """Weighted pillars if all five are there, else their mean; one decimal, half to even."""
    weight = F.lit(None).cast("int")
    for name, w in W.PILLARS.items():
        weight = F.when(F.col("pillar") == name, round(w * 100)).otherwise(weight)  # whole percents keep the sum exact
    g = scores.groupBy(*group).agg(F.count_distinct(F.when(weight.isNotNull(), F.col("pillar"))).alias("named"), F.sum(F.col("value") * weight).alias("weighted"), F.avg("value").alias("mean"))
    raw = F.when(F.col("named") == len(W.PILLARS), F.col("weighted") / 100).otherwise(F.col("mean"))
    return g.select(*group, F.bround(raw, 1).alias("health"))


def trend(values: DataFrame, group: str, order: str, last: int = 12, least: int = 3) -> DataFrame:
    """The last snapshots of a group with at least three, with the step from the one before."""
    newest = Window.partitionBy(group).orderBy(F.desc(order))
    n = F.count("*").over(Window.partitionBy(group))
    kept = values.withColumn("back", F.row_number().over(newest)).withColumn("n", n).where((F.col("back") <= last) & (F.col("n") >= least))
    return kept.withColumn("step", F.col("health") - F.lag("health").over(Window.partitionBy(group).orderBy(order))).drop("n")


def ctr(position: Column) -> Column:
    """Click share of a position: a fixed curve, then the second page, then beyond."""
    p = F.bround(F.greatest(position, F.lit(1)).cast("double")).cast("int")
    curve = F.array(*[F.lit(x) for x in W.CTR])
    return F.when(position <= 10, F.get(curve, p - 1)).when(position <= 20, W.CTR_SECOND_PAGE).otherwise(W.CTR_BEYOND)


def estimate(volume: Column, position: Column) -> Column:
    """struct(low, expected, high) clicks."""
    x = volume * ctr(position)
    return F.struct(F.bround(x * W.BAND[0]).cast("long").alias("low"), F.bround(x).cast("long").alias("expected"), F.bround(x * W.BAND[1]).cast("long").alias("high"))


def forecast(volumes: DataFrame, rankings: DataFrame, target: int = 3) -> DataFrame:
    """keyword, volume, position, now_clicks, low, expected, high, uplift at the target position."""
    j = volumes.join(rankings.select("keyword", "position"), "keyword", "left")
    e = estimate(F.col("volume"), F.lit(target))
    now = F.when(F.col("position").isNull(), F.lit(0).cast("long")).otherwise(F.bround(F.col("volume") * ctr(F.col("position"))).cast("long"))
    return j.select("keyword", "volume", "position", now.alias("now_clicks"), e["low"].alias("low"), e["expected"].alias("expected"), e["high"].alias("high")).withColumn("uplift", F.greatest(F.lit(0), F.col("expected") - F.col("now_clicks")))


def by_volume(rows: DataFrame) -> DataFrame:
    """Forecast rows, the most searched first; equal volumes by keyword."""
    return rows.orderBy(F.desc("volume"), "keyword")


def forecast_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("keywords"), *[F.sum(c).alias(c) for c in ("now_clicks", "low", "expected", "high", "uplift")])


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """left with before (latest value at or before ``on``) and after (earliest value strictly later).

    Both sides are stacked and carried along one window a group, so no pair of
    rows is ever formed; ties of the right side resolve to the last at a time.
    """
    l = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(dict(right.dtypes)[value])})
    others = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (*by, on)]
    r = right.groupBy(*by, on).agg(F.max(value).alias("_value")).select(*by, on, *others, F.lit(0).alias("_side"), "_value")
    both = l.unionByName(r)
    back = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc(on), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("before", F.last("_value", True).over(back)).withColumn("after", F.last("_value", True).over(ahead))
    return out.where("_side = 1").drop("_side", "_value")


def rank_losses(previous: DataFrame, current: DataFrame, group: str, cap: int = 10) -> DataFrame:
    """Keywords that were in the top 20 and are gone or fell by 5 or more; the worst ``cap`` of a group (the report's size)."""
    j = previous.select(group, "keyword", F.col("position").alias("was"), "volume").join(current.select(group, "keyword", F.col("position").alias("now")), [group, "keyword"], "left")
    gone, fall = F.col("now").isNull(), F.col("now") - F.col("was")
    severity = F.when(gone, F.when(F.col("was") <= 10, "high").otherwise("medium")).otherwise(F.when(fall >= 10, "high").otherwise("medium"))
    lost = j.where((F.col("was") <= 20) & (gone | (fall >= 5))).withColumn("severity", severity)
    clicks = F.when(F.col("volume") > 0, F.bround(F.col("volume") * ctr(F.col("was"))).cast("long")).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy(group).orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "was", "keyword")
    return lost.withColumn("clicks_at_risk", clicks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def recovered(open_losses: DataFrame, current: DataFrame, group: str) -> DataFrame:
    """Open losses whose keyword ranks again at or above where it was."""
    return open_losses.select(group, "keyword", "was").join(current.select(group, "keyword", F.col("position").alias("now")), [group, "keyword"]).where("now <= was")


#: Competitors of a profile that a watch run looks at.
WATCHED = 3


def watched(competitors: Column) -> Column:
    """The competitors of a profile that are watched, in its order."""
    return F.slice(competitors, 1, WATCHED)


def open_losses(recs: DataFrame, group: str) -> DataFrame:
    """(group, id, keyword, was) of rank losses that a watch run raised and that aren't closed.

    recs: group, id, source, key, status, keyword, was.
    """
    raised = (F.col("source") == "skill:watch") & F.startswith("key", F.lit("rank-loss-"))
    return recs.where(raised & ~F.col("status").isin(*W.CLOSED) & F.col("keyword").isNotNull() & F.col("was").isNotNull()).select(group, "id", "keyword", "was")


def loss_recommendations(losses: DataFrame, group: str) -> DataFrame:
    """Rank losses as recommendations: (group, key, severity, finding)."""
    slug = F.concat(F.lit("rank-loss-"), X.slug(F.col("keyword")))
    quoted = F.concat(F.lit("'"), F.col("keyword"), F.lit("'"))
    was, now = F.col("was").cast("string"), F.col("now").cast("string")
    finding = F.when(F.col("now").isNull(), F.concat(F.lit("Ranking lost: "), quoted, F.lit(" (was "), was, F.lit(")"))).otherwise(F.concat(F.lit("Ranking dropped: "), quoted, F.lit(" "), was, F.lit(" → "), now))
    return losses.select(group, slug.alias("key"), "severity", finding.alias("finding"))


def competitor_gains(previous: DataFrame, current: DataFrame, least: int = 3, examples: int = 10) -> DataFrame:
    """Competitors seen before with ``least`` or more new keywords, and the first examples by name."""
    known = previous.select("competitor").distinct()
    new = current.select("competitor", "keyword").join(previous.select("competitor", "keyword"), ["competitor", "keyword"], "left_anti").join(known, "competitor", "left_semi")
    r = F.row_number().over(Window.partitionBy("competitor").orderBy("keyword"))
    return new.withColumn("r", r).groupBy("competitor").agg(F.count("*").alias("gained"), F.sort_array(F.collect_list(F.when(F.col("r") <= examples, F.col("keyword")))).alias("examples")).where(F.col("gained") >= least)


def cost_periods(ledger: DataFrame, now: int) -> DataFrame:
    """Cost of the last day, 7 days, 30 days and in all, at the given second; bounds inclusive."""
    age = F.lit(now) - F.col("ts")
    spans = {"today": 86400, "week": 7 * 86400, "month": 30 * 86400}
    return ledger.agg(*[F.sum(F.when(age <= s, F.col("cost")).otherwise(0.0)).alias(k) for k, s in spans.items()], F.sum("cost").alias("all_time"), F.count("*").alias("calls"))


def expired(cache: DataFrame, now: int, days: int) -> DataFrame:
    """Cache files that clearing by age removes: those last written more than ``days`` before ``now``."""
    return cache.where(F.lit(now) - F.col("created") > days * 86400)


def running_cost(ledger: DataFrame) -> DataFrame:
    """(command, day, cost, total): daily cost and the running total of each command; days are summed before they meet."""
    days = ledger.groupBy("command", F.floor(F.col("ts") / 86400).alias("day")).agg(F.sum("cost").alias("cost"))
    return days.withColumn("total", F.sum("cost").over(Window.partitionBy("command").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def cost_by_command(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("command").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))


def ttl(command: Column) -> Column:
    pairs = [v for k, x in W.TTL.items() for v in (F.lit(k), F.lit(x))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), command), F.lit(W.DEFAULT_TTL))


def fresh(cache: DataFrame, now: int) -> DataFrame:
    """Latest body of each key, with whether it is still fresh."""
    latest = cache.groupBy("key", "command").agg(F.max("created").alias("created"), F.max_by("size", "created").alias("size"))
    return latest.withColumn("fresh", F.lit(now) - F.col("created") <= ttl(F.col("command")))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("command").agg(F.count("*").alias("entries"), F.count_if("fresh").alias("fresh_entries"), F.sum("size").alias("bytes"))


def cache_key(command: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", command, payload), 256)


def tail(events: DataFrame, group: str, n: int = 20, since=None, kind: str | None = None) -> DataFrame:
    """The last n events of each group after the filters."""
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if kind:
        events = events.where(F.col("type") == kind)
    return events.withColumn("back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("back") <= n)
