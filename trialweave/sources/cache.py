"""The response cache as a table: lookups are joins, writes are upserts of the newest row.

Columns: key, schema_version, provider, model, role, payload, created_at (seconds), hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
SCHEMA = "key string, schema_version int, provider string, model string, role string, payload string, created_at double, hits long"


def empty(spark: SparkSession) -> DataFrame:
    """A cache that never hits."""
    return spark.createDataFrame([], SCHEMA)


def valid(cache: DataFrame, now: float, ttl: float | None = None, version: int = VERSION) -> DataFrame:
    """Rows of this version, and no older than ttl seconds."""
    fresh = F.lit(True) if ttl is None else F.lit(now) - F.col("created_at") <= ttl
    return cache.where((F.col("schema_version") == version) & fresh)


def look_up(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (cache_key) with payload, null on a miss, and ``cached``."""
    rows = requests.join(cache.select(F.col("key").alias("cache_key"), "payload"), "cache_key", "left")
    return rows.withColumn("cached", F.col("payload").isNotNull())


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each key, with the most hits that any of its rows had."""
    both = cache.unionByName(new)
    by = Window.partitionBy("key")
    newest = F.row_number().over(by.orderBy(F.desc("created_at"), F.desc("payload")))
    return both.withColumn("hits", F.max("hits").over(by)).withColumn("__n", newest).where("__n = 1").drop("__n")


def pruned(cache: DataFrame, now: float, older_than: float) -> DataFrame:
    """What stays when rows created before now - older_than go."""
    return cache.where(F.col("created_at") >= now - older_than)


def summary(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.sum("hits").alias("hits"))


def by_model(cache: DataFrame, most: int = 20) -> DataFrame:
    """A report of the ``most`` models with most entries."""
    return cache.groupBy("provider", "model").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "provider", "model").limit(most)


def run_stats(looked_up: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a lookup."""
    hits, n = F.count_if("cached"), F.count("*")
    return looked_up.agg(hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hit_rate"))


def traffic(requests: DataFrame, cache: DataFrame, answered: DataFrame, now: float, ttl: float | None = None, version: int = VERSION) -> DataFrame:
    """A run's use of a cache: hits, misses, stale_drops (misses whose row is too old or of another version), writes (answered keys that were misses) and hit rate."""
    fresh = valid(cache, now, ttl, version).select(F.col("key").alias("cache_key"), F.lit(True).alias("fresh"))
    there = cache.select(F.col("key").alias("cache_key"), F.lit(True).alias("there")).distinct()
    done = answered.select("cache_key", F.lit(True).alias("answered")).distinct()
    rows = requests.select("cache_key").join(fresh, "cache_key", "left").join(there, "cache_key", "left").join(done, "cache_key", "left")
    hit, n = F.col("fresh").isNotNull(), F.count("*")
    written = F.count_distinct(F.when(~hit & F.col("answered").isNotNull(), F.col("cache_key")))
    counts = (F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(~hit & F.col("there").isNotNull()).alias("stale_drops"), written.alias("writes"))
    return rows.agg(*counts, F.coalesce(F.try_divide(F.count_if(hit), n), F.lit(0.0)).alias("hit_rate"))
