"""Counts and sums over reports, events, frontiers and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblake.operators.storage import stored


def sum_pageviews(pages: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Total views per input row, 0 where there are none."""
    return pages.join(items.groupBy(key).agg(F.sum("views").alias("views")), key, "left").withColumn("views", F.coalesce("views", F.lit(0)))


def count_by_bucket(df: DataFrame, query: str, ts: str, granularity: str = "1 day") -> DataFrame:
    """start, end, count per query and period of time."""
    counts = df.groupBy(query, F.window(ts, granularity).alias("w")).agg(F.count("*").alias("count"))
    return counts.select(query, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def fetch_stats(report: DataFrame) -> DataFrame:
    """Rows per status, per error code, and filtered: name, count, place (statuses, then names, then filtered)."""
    name = F.coalesce(F.col("http_status").cast("string"), F.col("fetch_error"), F.lit("filtered"))
    counts = report.groupBy(name.alias("name")).agg(F.count("*").alias("count"))
    return counts.withColumn("place", F.when(F.col("name").rlike("^[0-9]+$"), 0).when(F.col("name") == "filtered", 2).otherwise(1))


def crawl_counts(frontier: DataFrame, parallelism: int = 1) -> DataFrame:
    """Per group: jobs to do, being done, done, and how many more may start."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = frontier.groupBy("group").agg(n("todo").alias("todo"), n("doing").alias("doing"), n("done").alias("done"))
    return counts.withColumn("allowed", F.greatest(F.lit(0), F.lit(parallelism) - F.col("doing")))


def crawl_degree(jobs: DataFrame) -> DataFrame:
    """``jobs`` and degree: the jobs that each led to."""
    led = jobs.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("degree"))
    return jobs.join(led, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def webentity_degrees(links: DataFrame, pages: DataFrame) -> DataFrame:
    """webentity, indegree, outdegree, degree, undirected_degree, pages.

    links: source_webentity, target_webentity; pages: webentity, a row per page. Pairs are made
    distinct first, so hubs cost their neighbours, not their links.
    """
    pairs = stored(links.where("source_webentity <> target_webentity").select(F.col("source_webentity").alias("s"), F.col("target_webentity").alias("t")).distinct())
    out = pairs.groupBy(F.col("s").alias("webentity")).agg(F.count("*").alias("outdegree"))
    into = pairs.groupBy(F.col("t").alias("webentity")).agg(F.count("*").alias("indegree"))
    either = pairs.unionByName(pairs.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
    both = either.groupBy(F.col("s").alias("webentity")).agg(F.count("*").alias("undirected_degree"))
    counts = pages.groupBy("webentity").agg(F.count("*").alias("pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = counts.join(into, "webentity", "left").join(out, "webentity", "left").join(both, "webentity", "left")
    return joined.select("webentity", zero("indegree"), zero("outdegree"), (F.coalesce("indegree", F.lit(0)) + F.coalesce("outdegree", F.lit(0))).alias("degree"), zero("undirected_degree"), "pages")


def webentity_corpus_stats(corpus: DataFrame) -> DataFrame:
    """status, entities, prefixes, start_pages."""
    n = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != ""))
    status = F.when(F.trim(F.coalesce("STATUS", F.lit(""))) == "", "IN").otherwise(F.col("STATUS"))
    return corpus.groupBy(status.alias("status")).agg(F.count("*").alias("entities"), F.sum(n("PREFIXES")).alias("prefixes"), F.sum(n("START_PAGES")).alias("start_pages"))


def collapse_captions(lines: DataFrame, keys: list[str], start: str, text: str) -> DataFrame:
    """One row per track: its lines joined by newline in order of start."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.col(text).alias("text"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
