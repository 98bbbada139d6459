"""Gapless ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def ranked(rows: DataFrame, group: str, order: list[Column], salt: Column, extra: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` and ``rank``, 0, 1, ... within each value of ``group``.

    Rows are dealt to ``buckets`` by ``salt``; a rank is the rows in the buckets before plus the row
    number in the bucket, so a hot group is spread over that many sorts. ``extra`` (one row per
    group) adds its columns by way of the small table of bucket counts.
    """
    dealt = rows.withColumn("bucket", F.pmod(salt, F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if extra is not None:
        offsets = offsets.join(extra, group)
    within = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order))
    return (
        dealt.withColumn("within", within)
        .join(offsets, [group, "bucket"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
        .drop("bucket", "within", "before")
    )
