from pyspark.sql import functions as F

from pagelode.operators import recommendations
from pagelode.plans import inputs
from pagelode.streaming import streams

SF = "/root/testdata/sf0.001"


def drained(query_df, name, mode):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return query_df.sparkSession.table(name)


def staged(spark, rows, path, parts=3):
    rows.repartition(parts).write.parquet(str(path))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_daily_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", F.col("event_type").alias("type"), "value", "user_id")
    out = drained(streams.daily_counts(staged(spark, e, tmp_path / "e"), late="60 days"), "daily", "complete")
    batch = {(r.day, r.type): r.n for r in e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "type").agg(F.count("*").alias("n")).collect()}
    assert {(r.day, r.type): r.n for r in out.collect()} == batch


def test_session_stream_counts_every_event(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id", "value")
    out = drained(streams.sessions(staged(spark, e, tmp_path / "s"), late="60 days"), "sessions", "complete")
    assert out.agg(F.sum("n")).first()[0] == e.count()


def test_replay_stream_equals_batch(spark, tmp_path):
    events = inputs.recommendation_events(spark, SF)
    files = events.withColumn("id", F.col("id").cast("string")).orderBy("seq").coalesce(1)
    stream = staged(spark, files, tmp_path / "r", parts=1)
    out = drained(streams.replay_stream(stream), "replay", "update")
    last = {r.id: (r.status, r.times_raised, r.created, r.updated, r.severity) for r in out.collect()}
    batch = {str(r.id): (r.status, r.times_raised, r.created, r.updated, r.severity) for r in recommendations.replay(events, ["id"]).collect()}
    assert last == batch


def test_timeline_stream_goes_on_from_its_state(spark, tmp_path):
    """Events of one key over several runs of the stream: each run goes on where the last one stopped."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds, at = "id string, seq long, ts long, event string, status string", str(tmp_path)
    try:
        for n, rows in enumerate(([("a", 1, 1, "raise", ""), ("b", 2, 2, "status", "done")], [("a", 3, 3, "status", "done"), ("a", 4, 4, "status", "bogus")], [("a", 5, 5, "raise", ""), ("b", 6, 6, "raise", ""), ("a", 7, 7, "raise", None)])):
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{at}/in")
            streams.timeline_stream(spark.readStream.schema(kinds).parquet(f"{at}/in")).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = [(r.id, r.seq, r.kind, r.status) for r in spark.read.parquet(f"{at}/out").orderBy("seq").collect()]
    assert got == [("a", 1, "rec_raised", "open"), ("a", 3, "rec_status", "done"), ("a", 5, "rec_reopened", "open"), ("b", 6, "rec_raised", "open"), ("a", 7, "raised_again", "open")]
