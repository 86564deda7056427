"""Access-log lines: parsing, crawler detection and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import words as W
from pagelode.functions.text import once

MARK = "\x01"


def bot(agent: Column) -> Column:
    """Name of the first signature in the lower-cased agent; null for others."""
    low = F.lower(agent)
    out = F.lit(None).cast("string")
    for name, signature in reversed(W.BOTS):
        out = F.when(F.contains(low, F.lit(signature)), name).otherwise(out)
    return out


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of combined-format lines; parsed is false for others. Blank lines are dropped."""
    line = F.col(column)
    kept = [c for c in lines.columns if c != column]
    # one pass of the pattern yields all fields, parted by a mark that lines don't hold
    fields = F.regexp_replace(F.translate(line, MARK, ""), rf"(?s){W.LOG_LINE}.*\z", MARK.join(["", "$1", "$2", "$3", "$6"]))
    split = once(lines.where(F.trim(line) != ""), kept, {"_f": F.split(fields, MARK)})
    parsed = F.size("_f") == 5
    part = lambda i: F.when(parsed, F.get("_f", F.lit(i))).otherwise("")
    split = once(split, kept, {"_f": F.col("_f"), "_path": F.coalesce(F.try_element_at(F.split(part(2), " "), F.lit(2)), F.lit("/"))})
    path = F.col("_path")
    return split.select(
        *kept,
        parsed.alias("parsed"),
        F.substring(part(1), 1, 11).alias("day"),
        F.try_to_timestamp(part(1), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
        path.alias("path"),
        F.contains(path, F.lit("?")).alias("has_params"),
        part(3).alias("status"),
        part(4).alias("agent"),
        bot(part(4)).alias("bot"),
    )


def by_bot(parsed: DataFrame) -> DataFrame:
    """(bot, hits, share_pct, param_pct), one decimal; shares are of all crawler hits."""
    grouped = parsed.where("parsed and bot is not null").groupBy("bot").agg(F.count("*").alias("hits"), F.count_if("has_params").alias("params"))
    total = F.sum("hits").over(Window.partitionBy())  # a row a bot
    return grouped.select("bot", "hits", (F.floor(F.col("hits") * 1000.0 / total + 0.5) / 10).alias("share_pct"), (F.floor(F.col("params") * 1000.0 / F.col("hits") + 0.5) / 10).alias("param_pct"))


def by_status(parsed: DataFrame) -> DataFrame:
    return parsed.where("parsed and bot is not null").groupBy("bot", "status").agg(F.count("*").alias("hits"))


def daily(parsed: DataFrame) -> DataFrame:
    return parsed.where("parsed and bot is not null").groupBy("day").agg(F.count("*").alias("hits"), F.min(F.to_date("ts")).alias("date"))


def top_paths(parsed: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent paths of each bot, ties by path."""
    counted = parsed.where("parsed and bot is not null").groupBy("bot", "path").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("bot").orderBy(F.desc("hits"), "path"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def totals(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("lines"), F.count_if(~F.col("parsed")).alias("unparsed"), F.count_if(F.col("parsed") & F.col("bot").isNotNull()).alias("bot_hits"))
