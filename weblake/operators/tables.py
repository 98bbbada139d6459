"""Reading, writing and shaping tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblake.operators.storage import stored


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns text, NUL characters left out; .gz files are read as they are."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.select(*(F.translate(F.col(f"`{c}`"), "\0", "").alias(c) for c in df.columns))


def read_page_files(spark: SparkSession, folder: str, pattern: str = "*.html*") -> DataFrame:
    """path, body (bytes) and error of page files under a folder; gzip is undone. A broken file has no body and the error ``bad-gzip``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    def unpacked(batches):
        import gzip
        import zlib

        import pyarrow as pa

        def plain(path, content):
            try:
                return gzip.decompress(content) if path.endswith(".gz") else content
            except (OSError, EOFError, zlib.error):
                return None

        for b in batches:
            bodies = [plain(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            errors = ["bad-gzip" if x is None else None for x in bodies]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], names=["path", "body", "error"])

    return files.select("path", "content").mapInArrow(unpacked, "path string, body binary, error string")


def attach_bodies(report: DataFrame, files: DataFrame, input_dir: str = "") -> DataFrame:
    """Bodies of the files that report rows name; a missing file is an error of the row."""
    full = F.concat(F.lit(f"{input_dir.rstrip('/')}/" if input_dir else ""), F.col("path"))
    bodies = files.select(F.col("path").alias("file path"), F.col("body"))
    joined = report.withColumn("file", full).join(bodies, F.col("file") == F.col("file path"), "left")
    missing = F.when(F.col("path").isNotNull() & F.col("file path").isNull(), "file-not-found")
    return joined.withColumn("body_error", missing).drop("file", "file path")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, as text."""
    return spark.read.text(path).where("trim(value) <> ''").withColumnRenamed("value", "payload")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)


def joined_plurals(df: DataFrame, separator: str = "|") -> DataFrame:
    """Arrays as joined text, for CSV."""
    return df.select(*(F.array_join(F.col(f"`{f.name}`").cast("array<string>"), separator).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def write_table(df: DataFrame, path: str, plural_separator: str = "|") -> None:
    joined_plurals(df, plural_separator).write.csv(path, header=True, emptyValue="", nullValue="", escape='"')


def write_bodies(pages: DataFrame, path: str, bucket: Column, salt: Column | None = None, files: int = 16) -> None:
    """Bodies as Parquet in a folder per bucket: one file per page does not scale.

    A bucket is dealt to ``files`` tasks by ``salt`` (default: all columns), so a hot one is no single task.
    """
    dealt = F.pmod(F.xxhash64(*pages.columns) if salt is None else salt, F.lit(files))
    pages.withColumn("bucket", bucket).repartition("bucket", dealt).write.partitionBy("bucket").parquet(path)


def write_crawl_data(df: DataFrame, path: str) -> None:
    df.select("job_id", *(c for c in df.columns if c != "job_id")).write.partitionBy("spider").parquet(path)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti").select(*todo.columns)


def explode_cells(df: DataFrame, column: str, separator: str = "|") -> DataFrame:
    """One row per value of a cell of several values."""
    return df.withColumn(column, F.explode(F.split(F.col(column), rf"\Q{separator}\E")))


def keep_columns(df: DataFrame, columns: list[str] | None = None, prefix: str = "", added: tuple[str, ...] = ()) -> DataFrame:
    """The named input columns (None: all) and the added ones, these with a prefix."""
    kept = [c for c in df.columns if c not in added and (columns is None or c in columns)]
    return df.select(*kept, *(F.col(c).alias(prefix + c) for c in added))


def numbered_by(df: DataFrame, order: list[Column | str], name: str, start: int = 0, within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` and a gapless number in an order: ranges of it are numbered each on its own, after the rows of those before.

    As many ranges as the session has shuffle partitions; their counts alone are added up in one place. With
    ``within`` each group of these columns (not null) has its own numbers; a hot group is as many ranges as its rows need.
    """
    ranges = stored(df.repartitionByRange(*within, *order).withColumn("its range", F.spark_partition_id()))
    parts = [*within, "its range"]
    before = Window.partitionBy(*within).orderBy("its range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy(*parts).agg(F.count("*").alias("n")).select(*parts, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows before"))
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    numbered = ranges.withColumn("place in range", place).join(offsets, parts)
    return numbered.withColumn(name, F.col("rows before") + F.col("place in range") - 1 + start).select(*df.columns, name)


def with_original_index(df: DataFrame, order_by: str, name: str = "original_index") -> DataFrame:
    """0-based index by a unique key of any type that has an order."""
    return numbered_by(df, [F.asc(order_by)], name)
