"""Streams of URLs, jobs and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weblake.functions import urls
from weblake.operators.joins import join_by_url


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_unseen_urls(stream: DataFrame, url: str, ts: str | None = None, watermark: str | None = None, normalized: bool = False) -> DataFrame:
    """Each URL once. With a watermark state is bounded and a URL may come again after it; without, it is exact."""
    key = urls.normalize_url if normalized else urls.canonicalize_url
    keyed = stream.withColumn("url_key", key(F.col(url)))
    if watermark:
        return keyed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url_key"])
    return keyed.dropDuplicates(["url_key"])


def stream_counts(stream: DataFrame, ts: str, key: str, granularity: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Counts per period and key, given out once the watermark has passed the period's end; later rows are dropped."""
    counts = stream.withWatermark(ts, watermark).groupBy(F.window(ts, granularity).alias("w"), key).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "count")


def stream_throttled_frontier(stream: DataFrame, group: str, index: str, ts: str, throttle: float = 0.2, parallelism: int = 1, watermark: str | None = None) -> DataFrame:
    """index, group, release: when each job may start, in event time (seconds).

    The jobs of a group take its ``parallelism`` slots in turn; each starts at its own time or ``throttle``
    seconds after the slot's last job, whichever is later. Jobs of one batch go in order of time, then index;
    without a time they start when their slot is free. Jobs without a group start at once and keep no state.
    The state is the time from which each slot is free, the next one first. With a watermark it ends when the
    watermark passes the last of them (no job can wait for it then), and jobs later than the watermark are
    dropped; without, every job is released and a group's state stays.
    """
    gap = round(throttle * 1_000_000)

    def release(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        jobs = pd.concat(list(frames)).sort_values(["at", "index"])
        at = jobs["at"].to_numpy()
        if jobs["group"].isna().all():
            start = at
        else:
            free = list(state.get[0]) if state.exists else [0] * parallelism
            start = np.empty(len(at), np.int64)
            for slot, since in enumerate(free):
                # start = max(at, previous start + gap): less its turn's gaps, a running maximum.
                turns = np.arange(len(at[slot::parallelism])) * gap
                start[slot::parallelism] = np.maximum(np.maximum.accumulate(at[slot::parallelism] - turns), since) + turns
                free[slot] = int(start[slot::parallelism][-1]) + gap if len(turns) else since
            turn = len(at) % parallelism
            free = free[turn:] + free[:turn]
            state.update((free,))
            if watermark:
                state.setTimeoutTimestamp(max(max(free) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"index": jobs["index"], "group": jobs["group"], "release": start / 1_000_000})

    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("event_time", watermark)
    jobs = timed.select(F.col(index).cast("long").alias("index"), F.col(group).cast("string").alias("group"), F.coalesce(F.unix_micros("event_time"), F.lit(0)).alias("at"), "event_time")
    keyed = jobs.withColumn("key", F.coalesce(F.col("group"), F.concat(F.lit("\u0001"), F.col("index").cast("string"))))
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return keyed.groupBy("key").applyInPandasWithState(release, "index long, group string, release double", "free array<bigint>", "append", timeout)


def stream_join_by_url(stream: DataFrame, url: str, entities: DataFrame, entity_url: str, order: str, sink: Callable[[DataFrame, int], None]):
    """A writer that joins each batch with the entities on the longest URL prefix and hands it to ``sink``."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(join_by_url(entities, entity_url, batch, url, order), n))


def stream_enrich(stream: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stateless operator of batches on a stream: the checkpoint is what ``resume`` is to a batch."""
    return operator(stream)
