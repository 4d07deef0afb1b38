"""The response cache as a Parquet table in shards of its keys: lookups and upserts touch the shards of their keys alone.

A shard is a folder, ``pmod(xxhash64(key), shards)``; the number of shards is part of the column's name, so that a table can't be
read with another one. Within a shard, rows are sorted by key and files carry Parquet's Bloom filters of keys: a handful of requests
is pushed to the scan as well. What the driver sees is the list of touched shards, ``shards`` numbers at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cache

#: So many requested keys at most are pushed to the scan as values (Spark passes ten to Parquet's Bloom filters, more as a range).
FEW_KEYS = 10


@dataclass(frozen=True)
class CacheTable:
    """A folder that driver and executors share. One writer at a time."""

    spark: SparkSession
    path: str
    shards: int = 256

    @property
    def column(self) -> str:
        return f"shard_{self.shards}"

    def shard(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The shards of the rows' keys; null keys have none."""
        return sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(self.shard(key)).distinct().collect())

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The cache, or some shards of it; a table that isn't there yet is empty."""
        try:
            rows = self.spark.read.schema(f"{cache.SCHEMA}, {self.column} int").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return cache.empty(self.spark)
        if other := [c for c in rows.columns if c.startswith("shard_") and c != self.column]:
            raise ValueError(f"the table at {self.path} is in {other[0]}, not {self.column}")
        if only is not None:
            rows = rows.where(F.col(self.column).isin(list(only)))
        return rows.drop(self.column)

    def look_up(self, requests: DataFrame, now: float, ttl: float | None = None, version: int = cache.VERSION) -> DataFrame:
        """``cache.look_up`` of valid rows, reading the requests' shards alone. Runs a job for their list."""
        rows = cache.valid(self.read(self.touched(requests, "cache_key")), now, ttl, version)
        few = [r[0] for r in requests.where("cache_key is not null").select("cache_key").distinct().limit(FEW_KEYS + 1).collect()]
        return cache.look_up(requests, rows.where(F.col("key").isin(few)) if len(few) <= FEW_KEYS else rows)

    def upsert(self, new: DataFrame) -> None:
        """``cache.upsert`` of the shards that new rows touch; other shards are neither read nor written.

        Shards are staged and then replaced one after another: where a job dies between two, the same call makes it whole. Rows with a
        null key are refused, for no lookup could find them. Columns beside the cache's are dropped.
        """
        new = new.select(*self.columns())
        shards = self.touched(new, "key")
        if new.where("key is null").limit(1).count():
            raise ValueError("a row of the cache needs a key")
        if shards:
            self._write(cache.upsert(self.read(shards), new), shards)

    def prune(self, now: float, older_than: float) -> None:
        """``cache.pruned``: shards that hold a row too old are written again, the others stay as they are. A shard keeps one row at least:
        its newest, however old (an emptied folder can't be replaced); ``look_up`` has its own ttl."""
        old = self.read().where(F.col("created_at") < now - older_than)
        shards = self.touched(old, "key")
        if shards:
            rows = self.read(shards).withColumn("__s", self.shard("key"))
            newest = rows.groupBy("__s").agg(F.max_by("key", F.struct("created_at", "key")).alias("__newest"))
            kept = rows.join(newest, "__s").where((F.col("created_at") >= now - older_than) | (F.col("key") == F.col("__newest")))
            self._write(kept.select(*self.columns()), shards)

    @staticmethod
    def columns() -> list[str]:
        return [c.split()[0] for c in cache.SCHEMA.split(", ")]

    def _write(self, rows: DataFrame, shards: Sequence[int]) -> None:
        # A hint, so that a large shard is split among tasks and small ones share one.
        dealt = rows.withColumn(self.column, self.shard("key")).hint("rebalance", self.column).sortWithinPartitions(self.column, "key")
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column)
        writer.option("parquet.bloom.filter.enabled#key", "true").parquet(self.path)
