"""Readers for the inputs the engine knows: HTML files, logs, JSON lines, snapshots, API payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.sources.payloads import location as normalise_location  # noqa: F401 - part of the readers' interface

EVENTS = "domain string, ts long, type string, summary string, seq long"
COSTS = "ts long, command string, cost double, detail string"
RECOMMENDATIONS = "domain string, seq long, ts long, event string, id string, status string, severity string"


def html_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """(url, html) of all files below a folder, one row a file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only log; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Snapshot files named by their second, with that second as ts; other names are left out."""
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    stamp = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1)
    return raw.withColumn("stamp", stamp).where("stamp <> ''").withColumn("ts", F.col("stamp").cast("long")).drop("stamp")


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 if the first file below ``path`` begins with its mark, else UTF-8."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 2).alias("b")).first()
    return "UTF-16" if first and bytes(first["b"]) in (b"\xff\xfe", b"\xfe\xff") else "UTF-8"


def crawl_file(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Pages of a crawl document {summary, pages[]}."""
    schema = "pages array<struct<url string, status int, depth int, title string, internal_outlinks array<struct<url string, anchor string>>>>"
    return spark.read.schema(schema).option("multiLine", "true").option("encoding", encoding or text_encoding(spark, path)).json(path).select(F.explode("pages").alias("p")).select("p.*")


def edges_of(pages: DataFrame) -> DataFrame:
    """(src, pos, dst, anchor) of the internal links of crawled pages that answered 200."""
    return pages.where("status = 200").select(F.col("url").alias("src"), F.posexplode("internal_outlinks").alias("pos", "l")).select("src", "pos", F.col("l.url").alias("dst"), F.col("l.anchor").alias("anchor"))


ITEM = "struct<keyword:string,url:string,rank_group:int,rank_absolute:int,position:int,search_volume:long,title:string,type:string>"


def ranking_items(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(keyword, position, url, search_volume) of saved ranking responses, whose results may be nested once more."""
    flat = F.from_json(column, f"struct<result:array<struct<items:array<{ITEM}>>>>")
    deep = F.from_json(column, f"struct<result:array<array<struct<items:array<{ITEM}>>>>>")
    depth = F.col(column).rlike(r'"result"\s*:\s*\[\s*\[')
    kept = [c for c in payloads.columns if c != column]
    results = F.when(depth, F.flatten(deep["result"])).otherwise(flat["result"])
    items = payloads.select(*kept, F.explode(F.flatten(F.transform(results, lambda r: F.coalesce(r["items"], F.array().cast(f"array<{ITEM}>"))))).alias("i"))
    position = F.coalesce(F.nullif("i.rank_group", F.lit(0)), F.nullif("i.rank_absolute", F.lit(0)), F.nullif("i.position", F.lit(0)))
    return items.select(*kept, F.col("i.keyword").alias("keyword"), position.alias("position"), F.col("i.url").alias("url"), F.col("i.search_volume").alias("search_volume"))


def task_errors(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(status_code, status_message) of tasks that didn't succeed (code 20000)."""
    tasks = F.from_json(column, "struct<tasks:array<struct<status_code:int,status_message:string>>>")["tasks"]
    return payloads.select(F.explode(F.filter(tasks, lambda t: t["status_code"] != 20000)).alias("t")).select("t.*")


def cached_or_fetched(requests: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Answers of requests: fresh cache rows first, fetched rows for the misses."""
    hits = requests.join(cache.where("fresh"), "key").select("key", "body", F.lit(True).alias("from_cache"))
    missed = requests.join(cache.where("fresh"), "key", "left_anti").join(fetched, "key").select("key", "body", F.lit(False).alias("from_cache"))
    return hits.unionByName(missed)


def project_entities(spark: SparkSession, project: dict) -> DataFrame:
    """(name, type, url, known) entity registry of a project profile, defaults filled in; nameless or typeless ones are not known."""
    rows = [(e.get("name", ""), e.get("type", ""), e.get("url", "")) for e in project.get("entities", [])]
    out = spark.createDataFrame(rows, "name string, type string, url string")
    return out.withColumn("known", (F.col("name") != "") & (F.col("type") != ""))


def write_log(rows: DataFrame, path: str, by: str = "domain", form: str = "json") -> None:
    """Append rows to a log partitioned by domain."""
    rows.write.mode("append").partitionBy(by).format(form).save(path)


def indexnow_payload(urls: DataFrame, host: str, key: str, limit: int = 1000) -> DataFrame:
    """Submission bodies of at most ``limit`` addresses each, which is the protocol's batch size."""
    from pyspark.sql import Window

    listed = urls.select("url").where(F.col("url").isNotNull()).distinct()
    batch = F.pmod(F.xxhash64("url"), F.lit(64)).cast("int")
    numbered = listed.withColumn("cell", batch).withColumn("part", F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("url")) - 1) / limit))
    grouped = numbered.groupBy("cell", "part").agg(F.sort_array(F.collect_list("url")).alias("urlList"))
    return grouped.select(F.to_json(F.struct(F.lit(host).alias("host"), F.lit(key).alias("key"), F.col("urlList"))).alias("body"), F.size("urlList").alias("n"))


def submission_urls(given: DataFrame, listed: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(url) of all addresses to submit, from the call, a file and a sitemap, each once."""
    trimmed = lambda d: d.select(F.trim(d.columns[0]).alias("url"))
    return trimmed(given).unionByName(trimmed(listed)).unionByName(trimmed(sitemap)).where("url <> ''").distinct()


def write_snapshot(rows: DataFrame, path: str, ts: int) -> int:
    """Write a snapshot below ``path`` under its second; a taken second moves on to the next free one, which is returned."""
    spark = rows.sparkSession
    jvm = spark._jvm
    while True:
        to = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/ts={ts}")
        if not to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to):
            break
        ts += 1
    rows.withColumn("_saved_at", F.lit(ts)).write.parquet(f"{path.rstrip('/')}/ts={ts}")
    return ts


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.write.mode("overwrite").json(path)


def schedule_lines(command: str, daily: str = "0 7 * * *", weekly: str = "0 7 * * 1") -> list[str]:
    """Lines of a scheduler's table that run a command's daily and weekly profile."""
    return [f"{daily} {command} --profile daily", f"{weekly} {command} --profile weekly"]


def project_problems(profiles: DataFrame) -> DataFrame:
    """(client, problems) of profiles that fail their check: a missing address, no competitors, entities without name or type.

    profiles: client, url, competitors array<string>, entities array<struct<name,type>>.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    entities = F.coalesce("entities", F.array().cast("array<struct<name:string,type:string>>"))
    found = F.array_compact(
        F.array(
            F.when(blank(F.col("url")), "site.url is missing"),
            F.when(F.coalesce(F.size(F.filter("competitors", lambda c: ~blank(c))), F.lit(0)) <= 0, "competitors is empty"),
            F.when(F.exists(entities, lambda e: blank(e["name"])), "an entity has no name"),
            F.when(F.exists(entities, lambda e: blank(e["type"])), "an entity has no type"),
        )
    )
    return profiles.select("client", found.alias("problems")).where(F.size("problems") > 0)
