"""A store of page bodies that reports are joined with where it lies: bodies are never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "its part"
#: A path that more rows name, and more than this part of all rows, is hot. Bodies of hot paths come to the rows if
#: they are so many bytes at most; else they are copied for so many salts.
HOT_ROWS, HOT_PARTS = 10_000, 1000
BROADCAST_BYTES, SALTS = 64_000_000, 128


def _bucket(path: Column, buckets: int) -> Column:
    """The bucket in which Spark's own bucketing puts a path."""
    return F.pmod(F.hash(path), F.lit(buckets)).cast("int")


def write_body_store(bodies: DataFrame, table: str, location: str, buckets: int = 1024, mode: str = "errorifexists") -> None:
    """Writes ``bodies`` (path and any other columns) as a table of ``buckets`` buckets of path, each a folder of its own.

    Bodies are shuffled this once; ``append`` adds files to the buckets. Of a path that is null nobody can ask: left out.
    """
    rows = bodies.where("path is not null").withColumn(PART, _bucket(F.col("path"), buckets)).repartition(buckets, "path")
    rows.write.partitionBy(PART).bucketBy(buckets, "path").sortBy("path").mode(mode).option("path", location).saveAsTable(table)


def open_body_store(spark: SparkSession, table: str, location: str, schema: str, buckets: int = 1024) -> None:
    """Names a store that an earlier session wrote. schema: its columns, path included."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}, `{PART}` INT) USING parquet PARTITIONED BY (`{PART}`) CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{location}'")
    spark.catalog.recoverPartitions(table)


def attach_from_store(report: DataFrame, table: str, buckets: int = 1024, input_dir: str = "") -> DataFrame:
    """``report`` with the ``body`` that its ``path`` names in a store, and ``body_error``: ``file-not-found`` or null.

    Only buckets that a path falls in are read (their numbers, at most ``buckets``, filter the folders), and only
    the report is shuffled, to where the bodies are. Rows without a path stay and meet nothing. Of hot paths there
    are at most HOT_PARTS: their bodies are broadcast if their measured size is at most BROADCAST_BYTES, else each comes in
    SALTS copies, so that its rows are spread. A path that the store holds twice gives two rows; a body column of
    the report is replaced.
    """
    rows = report.drop("body").withColumn("file", F.concat(F.lit(f"{input_dir.rstrip('/')}/" if input_dir else ""), F.col("path")))
    named = rows.where("file is not null")
    counts = named.groupBy("file").agg(F.count("*").alias("n"))
    summed = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.collect_set(_bucket(F.col("file"), buckets)).alias("hit")).head()
    held = report.sparkSession.table(table).where(F.col(PART).isin(*summed["hit"]) if summed["hit"] else F.lit(False)).select(F.col("path").alias("file path"), "body")
    least = max(HOT_ROWS, summed["total"] // HOT_PARTS)
    if summed["most"] <= least:
        met = named.join(held, F.col("file") == F.col("file path"), "left")
    else:
        hot = F.broadcast(counts.where(F.col("n") > least).select(F.col("file").alias("hot file")))
        asked = held.join(hot, F.col("file path") == F.col("hot file"), "left_semi")
        often = named.join(hot, F.col("file") == F.col("hot file"), "left_semi")
        if asked.agg(F.coalesce(F.sum(F.octet_length("body") + F.octet_length("file path")), F.lit(0))).head()[0] <= BROADCAST_BYTES:
            often = often.join(F.broadcast(asked), F.col("file") == F.col("file path"), "left")
        else:
            copies = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            often = often.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
            often = often.join(copies, (F.col("file") == F.col("file path")) & (F.col("salt") == F.col("copy")), "left").drop("salt", "copy")
        seldom = named.join(hot, F.col("file") == F.col("hot file"), "left_anti")
        met = often.unionByName(seldom.join(held, F.col("file") == F.col("file path"), "left"))
    found = met.unionByName(rows.where("file is null"), allowMissingColumns=True)
    missing = F.when(F.col("path").isNotNull() & F.col("file path").isNull(), "file-not-found")
    return found.withColumn("body_error", missing).drop("file", "file path")
