"""The cache in shards, against the cache as one table."""

import os

import pytest
from pyspark.sql import functions as F

from trialweave.sources import cache
from trialweave.sources.cache_table import CacheTable


def _rows(spark, lo, hi, at, payload="p"):
    i = F.col("id")
    return spark.range(lo, hi).select(F.sha2(i.cast("string"), 256).alias("key"), (F.lit(1) + (i % 7 == 0).cast("int")).alias("schema_version"), F.lit("x").alias("provider"), F.lit("m").alias("model"), F.lit("r").alias("role"), F.concat(F.lit(payload), i.cast("string")).alias("payload"), F.lit(float(at)).alias("created_at"), i.alias("hits"))


def _sorted(df):
    return sorted(tuple(r) for r in df.select(*CacheTable.columns()).collect())


def _files(path):
    return {f for d, _, fs in os.walk(path) for f in (os.path.join(d, x) for x in fs) if f.endswith(".parquet")}


def test_upserts_and_lookups_equal_those_of_one_table(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "c"), 16)
    requests = spark.range(0, 400, 3).select("id", F.sha2(F.col("id").cast("string"), 256).alias("cache_key")).union(spark.createDataFrame([(-1, None)], "id long, cache_key string"))
    assert table.read().count() == 0 and table.look_up(requests, 100.0).where("cached").count() == 0
    first, second = _rows(spark, 0, 200, 10), _rows(spark, 150, 300, 20, "q")
    table.upsert(first.withColumn("more", F.lit(1)))
    table.upsert(second)
    whole = cache.upsert(first, second)
    assert _sorted(table.read()) == _sorted(whole)
    for ttl in (None, 85.0):
        got, want = table.look_up(requests, 100.0, ttl), cache.look_up(requests, cache.valid(whole, 100.0, ttl))
        assert sorted(map(tuple, got.select("id", "payload", "cached").collect())) == sorted(map(tuple, want.select("id", "payload", "cached").collect()))
    table.upsert(second.limit(0))
    table.upsert(second)
    assert _sorted(table.read()) == _sorted(whole)


def test_few_keys_touch_few_shards(spark, tmp_path):
    path = str(tmp_path / "c")
    table = CacheTable(spark, path, 16)
    table.upsert(_rows(spark, 0, 200, 10))
    before = _files(path)
    table.upsert(_rows(spark, 5, 6, 20, "new"))
    changed = {os.path.dirname(f) for f in before - _files(path)}
    assert len(changed) == 1 and table.read().count() == 200
    requests = spark.range(5, 6).select(F.sha2(F.col("id").cast("string"), 256).alias("cache_key"))
    found = table.look_up(requests, 100.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shard = table.touched(requests, "cache_key")
    assert f"{table.column}#" in plan and f"PartitionFilters: [isnotnull({table.column}" in plan and "EqualTo(key," in plan and len(shard) == 1
    assert [r["payload"] for r in found.collect()] == ["new5"]


def test_pruning_faults_and_names(spark, tmp_path):
    path = str(tmp_path / "c")
    table = CacheTable(spark, path, 4)
    table.upsert(_rows(spark, 0, 50, 10))
    table.upsert(_rows(spark, 50, 100, 90))
    table.prune(100.0, 50.0)
    assert _sorted(table.read()) == _sorted(_rows(spark, 50, 100, 90))
    table.prune(1000.0, 50.0)
    assert table.read().count() == 4
    with pytest.raises(ValueError, match="needs a key"):
        table.upsert(_rows(spark, 0, 1, 1).withColumn("key", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="shard_4"):
        CacheTable(spark, path, 8).read()
