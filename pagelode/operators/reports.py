"""Lines and tables that reports print, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_line(f: DataFrame) -> DataFrame:
    """(url, line) of findings for a terminal."""
    return f.select("url", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_id", F.lit(" ("), "category", F.lit(")")).alias("line"))


def annotation_escaped(text: Column, property_: bool = False) -> Column:
    marks = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if property_ else [])
    for a, b in marks:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotation(f: DataFrame, file: str = "url") -> DataFrame:
    """(file, line) of findings as workflow annotations: critical and high are errors, medium warnings, the rest notices."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    return f.select(F.col(file).alias("file"), F.concat(F.lit("::"), level, F.lit(" file="), annotation_escaped(F.col(file), True), F.lit(",title="), annotation_escaped(F.col("rule_id"), True), F.lit("::"), annotation_escaped(F.concat_ws(" ", "category", "rule_id"))).alias("line"))


def change_table(gated: DataFrame) -> DataFrame:
    """(path, line): one row of a markdown table for each changed file; path orders them."""
    before = F.coalesce(F.col("before_score").cast("string"), F.lit("new"))
    delta = F.col("after_score") - F.col("before_score")
    shown = F.when(delta.isNull(), "").when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))
    cells = [F.col("path").cast("string"), before, F.col("after_score").cast("string"), shown, F.array_join("reasons", ", ")]
    return gated.select("path", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def metric_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def chart_rows(drift: DataFrame) -> DataFrame:
    """(label, value) rows of a drift chart, from its counts."""
    names = [c for c, _ in drift.dtypes]
    return drift.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select(metric_label(F.col("x.name")).alias("label"), "x.value")


def score_colour(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "amber").otherwise("red")


def severity_counts(markdown: Column) -> Column:
    """struct of how often each severity stands alone in a table cell or in a badge of a report."""
    cells = []
    for name in ("critical", "high", "medium", "low"):
        cell = F.regexp_count(markdown, F.lit(rf"(?i)\|\s*{name}\s*\|"))
        badge = F.regexp_count(markdown, F.lit(rf'(?i)class="[^"]*badge[^"]*"[^>]*>{name}'))
        cells.append((cell + badge).cast("int").alias(name))
    return F.struct(*cells)


#: Ways in which a report gives its score, the first that fits counts.
SCORES = (
    r"(?i)(?:overall|total|score|rating)[:\s]*([0-9]{1,3}(?:\.[0-9]+)?)\s*(?:/\s*100|out of 100)?",
    r"(?i)(?<![0-9.])([0-9]{1,3}(?:\.[0-9]+)?)\s*/\s*100",
    r"(?i)(?<![0-9.])([0-9]{1,3}(?:\.[0-9]+)?)\s*out of\s*100",
)


def report_score(markdown: Column) -> Column:
    """Overall score of a report, 0 to 100; null if it gives none."""
    found = [F.regexp_extract(markdown, p, 1).try_cast("double") for p in SCORES]
    return F.coalesce(*[F.when(x.between(0, 100), x) for x in found])


def cell(value: Column, limit: int = 0) -> Column:
    """A table cell on one line, with pipes escaped, of at most ``limit`` characters if given; a dash if there is nothing."""
    flat = F.trim(F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    short = F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat) if limit else flat
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("—"))


def short_url(url: Column, limit: int = 48) -> Column:
    """An address without its scheme, of at most ``limit`` characters."""
    bare = F.regexp_replace(url, "^(https://)?(http://)?", "")
    return F.when(F.length(bare) > limit, F.concat(F.substring(bare, 1, limit - 1), F.lit("…"))).otherwise(bare)


def path_label(url: Column, limit: int = 28) -> Column:
    """An address's path, / if it has none, of at most ``limit`` characters."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    shown = F.when(path == "", "/").otherwise(path)
    return F.when(F.length(shown) > limit, F.concat(F.substring(shown, 1, limit - 1), F.lit("…"))).otherwise(shown)


def humanised(name: Column) -> Column:
    """Words of a rule's name, the first one capitalised."""
    words = F.lower(F.translate(name, "-_", "  "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def shown_date(seconds: Column, time: bool = False) -> Column:
    """Day of a unix time as 05 Jan 2026, with hours and minutes if wanted; a dash without a time."""
    shown = F.date_format(F.timestamp_seconds(seconds), "dd MMM yyyy HH:mm" if time else "dd MMM yyyy")
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "—").otherwise(shown)


def health_delta(snapshots: DataFrame, group: str) -> DataFrame:
    """(group, latest, previous, delta) of the last two snapshots by ts; rows: group, ts, health."""
    last = F.max(F.struct("ts", "health"))
    newest = snapshots.groupBy(group).agg(last.alias("l"))
    older = snapshots.join(newest, group).where(F.col("ts") < F.col("l.ts")).groupBy(group).agg(F.max(F.struct("ts", "health")).alias("p"))
    out = newest.join(older, group, "left").select(group, F.col("l.health").alias("latest"), F.col("p.health").alias("previous"))
    return out.withColumn("delta", F.round(F.col("latest") - F.col("previous"), 1))
