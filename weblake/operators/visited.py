"""A set of visited keys that stays on disk and is added to a batch at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.operators.storage import stored

#: Bits of a Bloom filter for each key, and places that a key sets: about one key in 400 that is not there seems to be.
BITS, PLACES = 16, 4
WORD = 64
PART = "its part"


class VisitedSet:
    """Keys (strings) in hash buckets below ``path``, each addition a part of its own, with Bloom filters beside them.

    A batch first asks the filters, which are a fortieth of keys of 80 bytes; only the bucket of a part for which
    a filter answers maybe is opened, and its keys decide. So a batch of new keys reads almost no keys. Filters are as
    large as their keys are many: nothing is fixed, and no answer is a guess. ``compact`` makes one part of all.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _stored(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def keys(self) -> DataFrame:
        """All keys of the parts that are complete."""
        parts = self._sizes().select(F.col("part").alias(PART)).distinct()
        return self._stored("keys", f"key string, bucket int, `{PART}` string").join(parts, PART, "left_semi").select("key")

    def _sizes(self) -> DataFrame:
        """part, bucket and the words of its filter: a row each."""
        return self._stored("sizes", "part string, bucket int, words long")

    @staticmethod
    def _places(key: Column, words: Column) -> Column:
        """The bits that a key sets in a filter of so many words."""
        first, step = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
        bits = words * WORD
        return F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.pmod(F.pmod(first, bits) + i * F.pmod(step, bits), bits))

    def maybe(self, keys: DataFrame) -> DataFrame:
        """key, bucket and part of each of ``keys`` (key, bucket) that a part's filter doesn't rule out."""
        asked = keys.join(self._sizes(), "bucket").withColumn("place", F.explode(self._places(F.col("key"), F.col("words"))))
        asked = asked.select("key", "part", "bucket", F.floor(F.col("place") / WORD).alias("word"), (F.col("place") % WORD).cast("int").alias("bit"))
        words = self._stored("filters", "part string, bucket int, word long, bits long")
        hit = asked.join(words, ["part", "bucket", "word"]).where(F.expr("(shiftrightunsigned(bits, bit) & 1) = 1"))
        return hit.groupBy("key", "part", "bucket").agg(F.count("*").alias("n")).where(F.col("n") == PLACES).select("key", "part", "bucket")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (key; distinct, not null) that are not in the set. ``last_read``: the parts' buckets that were opened for it."""
        rows = keys.select("key", self._bucket(F.col("key")).alias("bucket"))
        maybe = stored(self.maybe(rows))
        opened = [(r["part"], r["bucket"]) for r in maybe.select("part", "bucket").distinct().collect()]
        self.last_read = opened
        if not opened:
            return keys.select("key")
        parts = F.array_contains(F.array(*(F.lit(f"{p}/{b}") for p, b in opened)), F.concat(F.col(PART), F.lit("/"), F.col("bucket").cast("string")))
        held = self._stored("keys", f"key string, bucket int, `{PART}` string").where(F.col(PART).isin(*{p for p, _ in opened}) & F.col("bucket").isin(*{b for _, b in opened}) & parts)
        return keys.select("key").join(held.select("key"), "key", "left_anti")

    def _write(self, keys: DataFrame, name: str, mode: str = "append") -> None:
        rows = keys.select("key", self._bucket(F.col("key")).alias("bucket"), F.lit(name).alias(PART))
        rows.repartition("bucket").write.partitionBy(PART, "bucket").mode(mode).parquet(f"{self.path}/keys")
        sizes = stored(rows.groupBy("bucket").agg(F.ceil(F.count("*") * BITS / WORD).alias("words")).select(F.lit(name).alias("part"), "bucket", "words"))
        set_ = rows.join(sizes.select("bucket", "words"), "bucket").select("bucket", F.explode(self._places(F.col("key"), F.col("words"))).alias("place"))
        words = set_.groupBy("bucket", F.floor(F.col("place") / WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")).alias("bits"))
        words.select(F.lit(name).alias("part"), "bucket", "word", "bits").write.mode(mode).parquet(f"{self.path}/filters")
        sizes.write.mode(mode).parquet(f"{self.path}/sizes")

    def add(self, batch: DataFrame, key: str) -> DataFrame:
        """Adds the batch's keys; returns those that are new, each once (column ``key``). Null keys are left out.

        The part counts once its sizes are written, which is the last step: a batch that was lost before can be added again.
        """
        keys = batch.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        new = stored(self.unseen(stored(keys)))
        if not new.isEmpty():
            self._write(new, uuid.uuid4().hex)
        return new

    def compact(self, path: str) -> VisitedSet:
        """The same set in one part, at another path."""
        other = VisitedSet(self.spark, path, self.buckets)
        other._write(self.keys().distinct(), uuid.uuid4().hex)
        return other
