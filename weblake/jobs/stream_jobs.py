"""Queries that run a stream over stored files to its end and return what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.functions.pages import gate_pages
from weblake.jobs.join_jobs import JOINED, entities
from weblake.jobs.query import query
from weblake.jobs.url_jobs import VARIED, normalized_sql, varied
from weblake.operators.frontier import planned_releases
from weblake.operators.storage import shared_folder
from weblake.sources.tables import table
from weblake.streaming import queue, streams


def drained(source: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 1000) -> DataFrame:
    """The rows that the stream ``make`` writes for ``source``, which is stored first as the stream's files, ``files`` of them a batch."""
    spark = source.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{folder}/in")
    stream = make(streams.read_stream(spark, f"{folder}/in", source.schema, files))
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"WITH {VARIED}, {normalized_sql('v')} SELECT DISTINCT n AS url_key FROM norm")
def x1_stream_unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(varied(spark, sf_dir), lambda s: streams.stream_unseen_urls(s, "u", normalized=True)).select("url_key")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts::TIMESTAMP) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
  r AS (SELECT event_id, user_id, us, 60000000 * (i // 2) AS waits, max(us - 60000000 * (i // 2)) OVER (PARTITION BY user_id, i % 2 ORDER BY i) AS least FROM e)
  SELECT event_id AS index, user_id::VARCHAR AS "group", make_timestamp(CASE WHEN user_id IS NULL THEN us ELSE least + waits END) AS release FROM r""")
def x2_stream_throttled_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event may start, with two a minute for each user."""
    found = drained(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), lambda s: streams.stream_throttled_frontier(s, "user_id", "event_id", "ts", throttle=60.0, parallelism=2))
    return found.select("index", "group", F.timestamp_micros(F.round(F.col("release") * 1000000).cast("long")).cast("timestamp_ntz").alias("release"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts::TIMESTAMP) AS us, 1000000 * (60 + event_id % 1000) AS lasts FROM events),
  s AS (SELECT *, sum(lasts + 30000000) OVER w - lasts - 30000000 AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id AS index, user_id::VARCHAR AS "group", make_timestamp(CASE WHEN user_id IS NULL THEN us
    ELSE (before + max(us - before) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT END) AS release FROM s""")
def x2_stream_released_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that timers release: each event lasts a while, its acknowledgement comes with the stream, one a user at a time."""
    lasts = 1_000_000 * (60 + F.col("event_id") % 1000)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), lasts.alias("lasts"))
    planned = planned_releases(events, "user_id", "event_id", "at", "lasts", 30_000_000)
    acknowledged = planned.select("event_id", "user_id", (F.col("release") + F.col("lasts")).alias("at"), F.lit(True).alias("finished"))
    rows = events.select("event_id", "user_id", "at", F.lit(False).alias("finished")).unionByName(acknowledged)
    # A last row, of a day later, lets the watermark pass all others.
    end = rows.agg((F.max("at") + 86_400_000_000).alias("at")).select(F.lit(-1).cast(rows.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), "at", F.lit(False).alias("finished"))
    timed = rows.unionByName(end).withColumn("at", F.timestamp_micros("at"))
    with queue.timers_allowed(spark):
        # One batch, however many files: that last row would make the rows of a second batch late.
        found = drained(timed, lambda s: queue.stream_released_jobs(s, "user_id", "event_id", "at", "finished", throttle=30.0, period=864_000.0), files=2**31 - 1)
    return found.where("index >= 0").select("index", "group", F.timestamp_micros(F.round(F.col("release") * 1000000).cast("long")).cast("timestamp_ntz").alias("release"))


@query("""WITH top AS (SELECT max(ts) AS t FROM events) SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS count FROM events, top
  GROUP BY 1, 2, t HAVING date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= t - INTERVAL 1 HOUR""")
def x3_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    found = drained(events, lambda s: streams.stream_counts(s, "ts", "event_type", "1 day"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "count")


@query(f"WITH {JOINED} SELECT page_id, entity FROM joined")
def x4_stream_join_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = varied(spark, sf_dir)
    source.write.parquet(f"{folder}/in")
    stream = streams.read_stream(spark, f"{folder}/in", source.schema, 1000)
    sink = lambda batch, n: batch.select("page_id", "entity").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    writer = streams.stream_join_by_url(stream, "u", entities(spark, sf_dir), "site", "entity", sink)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "entity")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'invalid-status' END AS gate_error FROM pages")
def x5_stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "500").otherwise("200").alias("http_status"), F.col("html").alias("body"))
    return drained(report, lambda s: streams.stream_enrich(s, gate_pages)).select("page_id", "gate_error")
