"""Linting of what changed between two versions of a site's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import tags
from pagelode.operators.store import fresh_path
from pagelode.plans import rules


def folder_files(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, digest, content) of the files below a folder, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/+", "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return raw.select(F.substring(path, F.length(root) + 2, F.length(path)).alias("path"), F.sha2("content", 256).alias("digest"), "content")


def lint_files(files: DataFrame) -> DataFrame:
    """(path, digest, score, rules) of files under all rules that need no fetch."""
    pages = files.select("path", "digest", F.lit("").alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    found = rules.lint(tags.page_records(pages).withColumn("status", F.lit(200)), rules.load_rules(local=True), ["path", "digest"])
    return found.select("path", "digest", "score", F.col("findings.rule_id").alias("rules"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of the files of both versions: added, changed, removed or same, told by content digests only."""
    old, new = before.select("path", F.col("digest").alias("was")), after.select("path", F.col("digest").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return old.join(new, "path", "full").select("path", change.alias("change"))


def lint_changes(before: DataFrame, after: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, rule_id, state), results) of a new version; only added and changed files are linted.

    ``known`` has the results (path, digest, score, rules) of the version before.
    Results of files that stayed the same are carried over; state is new, fixed
    or carried for each finding. Findings of removed files are fixed.
    """
    told = changes(before, after)
    touched = after.join(told.where("change in ('added', 'changed')"), "path", "left_semi")
    to = fresh_path(before.sparkSession, "lint")
    lint_files(touched).write.parquet(to)
    linted = before.sparkSession.read.parquet(to)
    results = known.join(told.where("change = 'same'"), "path", "left_semi").unionByName(linted)
    old = known.select("path", F.explode("rules").alias("rule_id"), F.lit(True).alias("was"))
    new = results.select("path", F.explode("rules").alias("rule_id"), F.lit(True).alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "fixed").otherwise("carried")
    return old.join(new, ["path", "rule_id"], "full").select("path", "rule_id", state.alias("state")), results
