"""Queries of table formats: what is written is read again, so the rows are the answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.jobs.query import query
from weblake.operators import bodies, tables
from weblake.operators.storage import shared_folder
from weblake.sources.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, 'a \"b\", ' || o_orderpriority || chr(10) || 'c' AS note, CASE WHEN o_orderkey % 2 = 0 THEN 'x|' || o_orderstatus END AS plural FROM orders")
def s1_s5_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas and line breaks, and a column of lists."""
    note = F.concat(F.lit('a "b", '), F.col("o_orderpriority"), F.lit("\nc"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"), F.col("o_orderstatus"))).alias("plural"))
    folder = _folder(spark)
    tables.write_table(rows, folder)
    return tables.read_table(spark, folder)


@query("SELECT page_id, html FROM pages")
def s6_write_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    tables.write_bodies(table(spark, sf_dir, "pages").select("page_id", "html"), folder, (F.col("page_id") % 3).cast("string"))
    return spark.read.parquet(folder).select("page_id", "html")


@query("SELECT page_id AS job_id, url, CASE WHEN page_id % 4 = 0 THEN 'hot' ELSE 'cold' END AS spider FROM pages")
def s7_write_crawl_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    spider = F.when(F.col("page_id") % 4 == 0, "hot").otherwise("cold")
    tables.write_crawl_data(table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("job_id"), spider.alias("spider")), folder)
    return spark.read.parquet(folder).select("job_id", "url", "spider")


@query("SELECT conv_id, turn, text FROM conversations")
def s4_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with whatever they hold, one JSON document per line."""
    folder = _folder(spark)
    tables.write_ndjson(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), folder)
    return tables.read_payloads(spark, folder).select(F.from_json("payload", table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").schema).alias("r")).select("r.*")


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS new_o_orderstatus FROM orders")
def s10_keep_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], "new_", ("o_orderstatus",))


@query("SELECT url, row_number() OVER (ORDER BY url) - 1 AS original_index FROM (SELECT DISTINCT url FROM pages)")
def s11_index_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_original_index(table(spark, sf_dir, "pages").select("url").distinct(), "url")


@query("""SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 4 = 0 THEN html END AS body, CASE WHEN page_id % 5 <> 0 AND page_id % 4 <> 0 THEN 'file-not-found' END AS body_error FROM pages
  UNION ALL SELECT o_orderkey AS page_id, (SELECT html FROM pages WHERE page_id = 4) AS body, NULL AS body_error FROM orders""")
def s3_s6_body_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of a quarter of the pages in a store; a report that names all but a fifth, and one page as often as there are orders."""
    folder = _folder(spark)
    name = f"bodies_{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    file = lambda c: F.concat(F.col(c).cast("string"), F.lit(".html"))
    bodies.write_body_store(pages.where("page_id % 4 = 0").select(F.concat(F.lit("in/"), file("page_id")).alias("path"), F.col("html").alias("body")), name, folder, 64)
    report = pages.select("page_id", F.when(F.col("page_id") % 5 != 0, file("page_id")).alias("path"))
    often = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("4.html").alias("path"))
    return bodies.attach_from_store(report.unionByName(often), name, 64, "in").select("page_id", "body", "body_error")
