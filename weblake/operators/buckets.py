"""Tables stored in hash buckets of a key, of which a job reads only the buckets it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column by which files are laid out; the number of buckets is a parameter of the store.
BUCKET = "its bucket"


def bucket_of(key: Column | str, buckets: int) -> Column:
    """The bucket of a key: null keys are in bucket 0."""
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, key: str, path: str, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Writes ``df`` below ``path``, a folder for each bucket of ``key``; ``append`` adds files to the folders."""
    rows = df.withColumn(BUCKET, bucket_of(key, buckets))
    rows.repartition(BUCKET).write.partitionBy(BUCKET).mode(mode).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: str, wanted: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """The stored rows in the buckets that the keys of ``wanted`` fall in; other buckets' files are not opened.

    The numbers of these buckets, at most ``buckets``, become a filter on the folders. schema: of the
    stored rows. A store that was never written to is empty.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    hit = [r[0] for r in wanted.select(bucket_of(key, buckets)).distinct().collect()]
    rows = spark.read.schema(f"{schema}, `{BUCKET}` int").parquet(path)
    return rows.where(F.col(BUCKET).isin(*hit) if hit else F.lit(False)).drop(BUCKET)


def lookup_in_buckets(wanted: DataFrame, key: str, path: str, schema: str, buckets: int = 256, how: str = "inner") -> DataFrame:
    """``wanted`` joined with the stored rows of its keys."""
    return wanted.join(read_buckets(wanted.sparkSession, path, schema, wanted, key, buckets), key, how)
