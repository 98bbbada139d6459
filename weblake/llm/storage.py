"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of ``numbered``.
ROW, CONTENT = "weblake row", "weblake content"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only on a local master, as in tests, a temporary folder stands in where that is unset; on a
    cluster, where executors would each write to a disk of their own, that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("weblake.scratch", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("weblake.scratch", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    This cuts the lineage: a lost executor costs a new read of files, not a new computation, and
    each row is computed once (a checkpoint() would compute its last stage twice).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weblake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df``, stored, with a number of its own for each row, and a hash of its values.

    They tell rows apart that share an id or have none. The number is fixed once it is stored; the
    hash does not depend on files, so that an order by it is the same in every run.
    """
    hashed = F.xxhash64(*df.columns, *(F.isnull(c) for c in df.columns))
    return stored(df.withColumn(CONTENT, hashed).withColumn(ROW, F.monotonically_increasing_id()))


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
