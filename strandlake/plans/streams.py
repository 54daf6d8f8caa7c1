"""Queries on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.base import query, table
from strandlake.sources.scratch import fresh_path
from strandlake.streaming import ticker


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its input ends; what it gives lies in the shared folder. A batch that is run again replaces what it wrote."""
    spark = df.sparkSession
    path = fresh_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(path)
    return found.select("batch", *df.columns) if mode == "update" else found.select(df.columns)


@query("w5_r2_running_totals", """SELECT user_id AS key, event_id, count(*) OVER w AS done, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticker.running_totals(_events(spark, sf_dir)).withColumn("total", F.round("total", 6))


@query("r2_running_totals_stream", """SELECT user_id AS key, event_id, count(*) OVER w AS done, round(sum(value) OVER w, 6) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals from a stateful stream."""
    s = _streamed(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", "value")
    return _run(ticker.running_totals_stream(s), "append").withColumn("total", F.round("total", 6))


@query("r1_event_windows_stream", """SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of event time, as a stream in update mode: the watermark drops the state of old windows, and a window's last update counts."""
    w = _run(ticker.windowed(_streamed(spark, sf_dir).select("ts", "event_type", "value")), "update")
    w = w.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("m")).select("start", "event_type", "m.n", "m.total")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("f17_s10_compact_events", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, to_json({'t': event_type, 'i': event_id}) AS compact FROM events""")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller event: a field of its payload, and two of its own as JSON."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"), F.col("event_id").alias("i"))).alias("compact"))


_PASSES = """WITH c AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS pass FROM events) SELECT user_id, pass::BIGINT AS pass, max(event_id) AS last_event, round(sum(value), 6) AS total FROM c GROUP BY 1, 2 HAVING count(*) = 10"""


@query("r3_pass_completion_stream", _PASSES)
def passes_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same passes from a stream that keeps each user's unfinished pass as state."""
    s = _streamed(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", "value")
    return _run(ticker.passes_stream(s), "append").select(F.col("key").alias("user_id"), "pass", "last_event", F.round("total", 6).alias("total"))


@query("r3_pass_completion", _PASSES)
def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete passes of ten events of a user."""
    c = table(spark, sf_dir, "events").withColumn("pass", F.expr("(row_number() over (partition by user_id order by event_id) - 1) div 10"))
    return c.groupBy("user_id", "pass").agg(F.max("event_id").alias("last_event"), F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("n")).where("n = 10").drop("n")


@query("r1_r8_strand_events_stream", """WITH e AS (SELECT user_id AS key, date_trunc('day', ts) AS pass, ts, event_id, event_type = 'error' AS drop, event_type <> 'error' AND value < 50 AS ok FROM events),
closed AS (SELECT * FROM e WHERE pass + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
s AS (SELECT 's' AS t, key, pass, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY key, pass) AS n, event_id, drop, ok, row_number() OVER w AS done, sum(ok::INT) OVER w AS oks, sum(drop::INT) OVER w AS drops FROM closed WINDOW w AS (PARTITION BY key, pass ORDER BY ts, event_id)),
f AS (SELECT 'file' AS t, key, pass, count(*) AS i, count(*) AS n, NULL::BIGINT AS event_id, false AS drop, bool_and(ok) AS ok, count(*) AS done, sum(ok::INT) AS oks, sum(drop::INT) AS drops FROM closed GROUP BY key, pass)
SELECT t, key, strftime(pass, '%Y-%m-%d') AS pass, i::INT AS i, n::INT AS n, event_id, drop, ok, done::INT AS done, oks::INT AS oks, drops::INT AS drops FROM (SELECT * FROM s UNION ALL SELECT * FROM f)""")
def strand_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a pass: an event for each strand, dropouts among them, with the totals so far, and one for the file, once the watermark is beyond the day."""
    strands = _streamed(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_type") == "error", 0).otherwise(3).alias("reads"), F.coalesce(F.col("value") < 50, F.lit(False)).alias("ok"),
    )
    with ticker.rocksdb(spark):
        out = _run(ticker.strand_events_stream(strands), "append")
    return out.withColumn("pass", F.date_format("pass", "yyyy-MM-dd"))
