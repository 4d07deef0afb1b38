"""A live view of a run: the leaderboard of record files as they arrive, by window of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIAL = ["model_id", "task_id", "case_id", "sample_index"]


def windowed_leaderboard(records: DataFrame, time: str = "ts", window: str = "1 hour", lateness: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Trials, errors and mean score of each model and window, of a stream (or table) of records.

    A trial that is sent again within the lateness counts once.
    """
    rows = records.withWatermark(time, lateness) if records.isStreaming else records
    rows = rows.dropDuplicatesWithinWatermark(keys or TRIAL) if records.isStreaming else rows.dropDuplicates(keys or TRIAL)
    return rows.groupBy(F.window(time, window).alias("w"), "model_id").agg(F.count("*").alias("trials"), F.count_if(F.col("status") != "ok").alias("errors"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score_sum")).select(F.col("w.start").alias("window_start"), "model_id", "trials", "errors", "score_sum")


def progress(records: DataFrame, total: int, started: float, now: Column | None = None) -> DataFrame:
    """One row: done, ok, errors, cache_hits, cost_usd of records (a table, or a stream in complete mode), with rate_per_s and eta_s.

    total: trials that the run has; started: when it began, in seconds; now: the time, by default when it is asked.
    """
    at = F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now
    ok, n = F.col("status") == "ok", F.count("*")
    sums = records.agg(n.alias("done"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.count_if("cached").alias("cache_hits"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    spent = at - F.lit(float(started))
    rate = F.when(spent > 0, F.col("done") / spent).otherwise(0.0)
    return sums.withColumn("rate_per_s", rate).withColumn("eta_s", F.when(F.col("rate_per_s") > 0, (F.lit(total) - F.col("done")) / F.col("rate_per_s")).otherwise(0.0))
