"""A stored index of a table's keys, so that a batch is checked without reading the table.

Keys are dealt by hash into buckets. A bucket has its keys in files of their own, and
per load one Bloom filter of fixed size. A batch meets the filters first, in a join on
the bucket; most new keys, and most lost parents, end there. Only keys that a filter
may hold are looked up exactly, in the files of their buckets.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of a filter: at about ten a key, a bucket of KEYS keys has 1 % false hits.
BITS = 1 << 20
KEYS = 100_000
PROBES = 7
FILTERS = "bucket int, bits binary"
# Buckets that one exact look-up may name in its plan; beyond it reads them all.
NAMED_BUCKETS = 20_000


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key's text."""
    text = key.cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("second")).alias("h2")]


def _probes(h1: pd.Series, h2: pd.Series, bits: int) -> np.ndarray:
    """The bits of each key, one row per key."""
    first = h1.to_numpy(np.int64).view(np.uint64)[:, None]
    step = h2.to_numpy(np.int64).view(np.uint64)[:, None] | np.uint64(1)
    return ((first + step * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), key.cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def _filters(keys: DataFrame, size: int) -> DataFrame:
    """One filter per bucket of rows (bucket, h1, h2); a task builds one after the other."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bits = None, np.zeros(0, bool)
        for batch in batches:
            for bucket, rows in batch.groupby("bucket", sort=False):
                if bucket != current:
                    if current is not None:
                        yield _packed(current, bits)
                    current, bits = bucket, np.zeros(size, bool)
                bits[_probes(rows["h1"], rows["h2"], size).ravel()] = True
        if current is not None:
            yield _packed(current, bits)

    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(build, FILTERS)


def _packed(bucket: int, bits: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [bucket], "bits": [np.packbits(bits).tobytes()]})


class KeyIndex:
    """The index of one table's key below a folder in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row = spark.read.schema("about string").json(f"{path}/about").first()
        about = json.loads(row["about"])
        self.buckets: int = about["buckets"]
        self.bits: int = about["bits"]
        self.kind: str = about["kind"]

    @classmethod
    def create(
        cls, table: DataFrame, key: str, path: str, keys_per_bucket: int = KEYS, bits: int = BITS
    ) -> KeyIndex:
        """The index of a table; the number of buckets is chosen once, from its size.

        ``bits`` is the size of a filter, a multiple of 8.
        """
        spark = table.sparkSession
        buckets = max(1, math.ceil(table.count() / keys_per_bucket))
        about = json.dumps({"buckets": buckets, "bits": bits, "kind": table.schema[key].dataType.simpleString()})
        spark.createDataFrame([(about,)], "about string").write.json(f"{path}/about")
        index = cls(spark, path)
        index.append(table, key)
        return index

    def append(self, table: DataFrame, key: str) -> None:
        """Adds the keys of further rows; NULL is no key."""
        value = F.col(key)
        keys = table.where(value.isNotNull()).select(value.alias("key")).distinct()
        placed = keys.select("key", _bucket(F.col("key"), self.buckets), *_hashes(F.col("key")))
        placed.select("key", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/keys")
        _filters(placed.select("bucket", "h1", "h2"), self.bits).write.mode("append").parquet(f"{self.path}/filters")

    def _may_hold(self, asked: DataFrame) -> DataFrame:
        """The asked keys (key, bucket, h1, h2) that a filter of their bucket may hold."""
        size = self.bits
        filters = self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters")

        # Filters come first in each bucket; then its keys stream past them.
        # Their hashes are 0 and not NULL, which would turn the column into doubles.
        nothing = [F.lit(0).cast("long").alias(h) for h in ("h1", "h2")]
        both = filters.select("bucket", "bits", F.lit(None).cast("string").alias("key"), *nothing).unionByName(
            asked.select("bucket", F.lit(None).cast("binary").alias("bits"), F.col("key").cast("string").alias("key"), "h1", "h2")
        )

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, held = None, []
            for batch in batches:
                for bucket, rows in batch.groupby("bucket", sort=False):
                    if bucket != current:
                        current, held = bucket, []
                    known = rows["bits"].notna()
                    held += [np.frombuffer(b, np.uint8) for b in rows["bits"][known]]
                    keys = rows[~known]
                    if not len(keys):
                        continue
                    probes = _probes(keys["h1"], keys["h2"], size)
                    hit = np.zeros(len(keys), bool)
                    for bits in held:
                        hit |= ((bits[probes >> 3] >> (7 - (probes & 7))) & 1).all(axis=1)
                    found = keys[hit]
                    if len(found):
                        yield pd.DataFrame({"key": found["key"], "bucket": bucket})

        ordered = both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
        return ordered.mapInPandas(test, "key string, bucket int")

    def held(self, batch: DataFrame, key: str) -> DataFrame:
        """The distinct keys of a batch that the index holds, exactly."""
        value = F.col(key).cast(self.kind)
        asked = batch.where(F.col(key).isNotNull()).select(value.alias("key")).distinct()
        placed = asked.select("key", _bucket(F.col("key"), self.buckets), *_hashes(F.col("key")))
        likely = self._may_hold(placed).select(F.col("key").cast(self.kind).alias("key"), "bucket")
        # At most as many numbers as there are buckets; they name the files to read.
        touched = [r["bucket"] for r in likely.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
        stored = self.spark.read.schema(f"key {self.kind}, bucket int").parquet(f"{self.path}/keys")
        if len(touched) <= NAMED_BUCKETS:
            stored = stored.where(F.col("bucket").isin(touched)) if touched else stored.where(F.lit(False))
        return likely.join(stored, ["bucket", "key"], "left_semi").select(F.col("key").alias(key))

