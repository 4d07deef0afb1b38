"""Outcomes as state that merges: sums by case and by model, and KLL sketches of latencies.

``case_state`` and ``model_state`` of some records merge with those of any others into what
all records together would give, so that a leaderboard follows a growing run from its new
files alone, and percentiles of latencies need no more than a few kilobytes a model.

An ``OutcomeState`` keeps them in a folder, a part for each batch. A batch that is added
again replaces itself: foreachBatch of a stream, or a job that is tried again, counts once.
``compact`` merges all parts into a new generation, which is used once it is written whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .outcomes import ok

CASE, MODEL = ("model_id", "task_id", "case_id"), ("model_id",)
#: What sketches keep: the share of ranks that an estimate is off by is at most rank_error(K), 19 times in 20 and more.
K = 400
_SUMS = ("trials", "errors", "score_sum", "passed_sum")
_MODEL_SUMS = ("trials", "errors", "cost_usd", "input_tokens", "output_tokens", "cache_hits", "retries")


def rank_error(k: int = K) -> float:
    """The error of a rank, as a share, of KLL sketches of this size (as their authors have measured it)."""
    return 2.296 / k**0.9723


def case_state(records: DataFrame, *keys: str) -> DataFrame:
    """Trials, errors, sums of scores and passes, and tags of each case. Errors score nothing."""
    score, passed = F.when(ok(), F.coalesce("score", F.lit(0.0))), F.when(ok(), F.coalesce(F.col("passed").cast("double"), F.lit(0.0)))
    sums = F.count("*").alias("trials"), F.count_if(~ok()).alias("errors"), F.coalesce(F.sum(score), F.lit(0.0)).alias("score_sum"), F.coalesce(F.sum(passed), F.lit(0.0)).alias("passed_sum")
    return records.groupBy(*(keys or CASE)).agg(*sums, F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


def merge_cases(states: DataFrame, *keys: str) -> DataFrame:
    return states.groupBy(*(keys or CASE)).agg(*(F.sum(c).alias(c) for c in _SUMS), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


def outcomes_of(state: DataFrame, errors: str = "zero") -> DataFrame:
    """collapse_cases() of the records that a state of cases is of."""
    if errors not in ("zero", "exclude"):
        raise ValueError(f"errors is {errors!r}, not zero or exclude")
    n = F.col("trials") if errors == "zero" else F.col("trials") - F.col("errors")
    keys = [c for c in state.columns if c not in (*_SUMS, "tags")]
    return state.where(n > 0).select(*keys, (F.col("score_sum") / n).alias("score"), (F.col("passed_sum") / n).alias("passed"), n.alias("samples"), "errors", "tags")


def model_state(records: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """Sums over the trials of each model (or other keys) and ``latency``, the sketch of answers that weren't cached (null without any)."""
    live = F.when(ok() & ~F.col("cached"), F.col("latency_ms"))
    sketch = F.kll_sketch_agg_double(live, F.lit(k))
    return records.groupBy(*(keys or MODEL)).agg(
        F.count("*").alias("trials"), F.count_if(~ok()).alias("errors"), F.sum("cost_usd").alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if("cached").alias("cache_hits"), F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"), F.when(F.count(live) > 0, sketch).alias("latency"),
    )


def merge_models(states: DataFrame, *keys: str, k: int = K) -> DataFrame:
    merged = F.when(F.count("latency") > 0, F.kll_merge_agg_double("latency", F.lit(k)))
    return states.groupBy(*(keys or MODEL)).agg(*(F.sum(c).alias(c) for c in _MODEL_SUMS), merged.alias("latency"))


def percentile(sketch: Column, share: float) -> Column:
    """The value that about this share of a sketch's values don't exceed; null of none."""
    return F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def latencies(states: DataFrame, shares: Sequence[float] = (0.5, 0.95), k: int = K) -> DataFrame:
    """states with p0, p1 .. of the latencies, ``measured`` (how many there are) and ``rank_error``: 0 where a sketch still holds every value."""
    n = F.coalesce(F.kll_sketch_get_n_double("latency"), F.lit(0))
    error = F.when(n <= k, 0.0).otherwise(rank_error(k))
    return states.select("*", *(percentile(F.col("latency"), s).alias(f"p{i}") for i, s in enumerate(shares)), n.alias("measured"), error.alias("rank_error"))


def leaderboard(cases: DataFrame, models: DataFrame, errors: str = "zero", k: int = K) -> DataFrame:
    """outcomes.leaderboard() from merged states, with percentiles from sketches and their ``rank_error``."""
    by_model = outcomes_of(cases, errors).groupBy("model_id").agg(F.count("*").alias("cases"), F.avg("score").alias("score"), F.avg("passed").alias("pass_rate"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    trials = latencies(models, k=k).select(
        "model_id", *_MODEL_SUMS, zero("p0").alias("latency_p50_ms"), zero("p1").alias("latency_p95_ms"), "rank_error", (F.col("errors") / F.col("trials")).alias("error_rate"), (F.col("cache_hits") / F.col("trials")).alias("cache_hit_rate")
    )
    return trials.join(by_model, "model_id", "left")


class OutcomeState:
    """States of cases and models in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, k: int = K):
        self.spark, self.path, self.k = spark, path.rstrip("/"), k

    def _generation(self) -> int:
        """The newest generation that is complete; 0 is, from the start."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = jvm_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        while files.exists(jvm_path(f"{self.path}/generation={n + 1}/models/_SUCCESS")):  # models are written last
            n += 1
        return n

    def _parts(self, kind: str) -> str:
        return f"{self.path}/generation={self._generation()}/{kind}"

    def _write(self, states: DataFrame, folder: str, batch: str) -> None:
        states.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    def add(self, records: DataFrame, batch: str | int) -> None:
        """Counts new records in; a batch of the same name is replaced. Fits foreachBatch."""
        self._write(case_state(records), self._parts("cases"), f"b{batch}")
        self._write(model_state(records, k=self.k), self._parts("models"), f"b{batch}")

    def cases(self) -> DataFrame:
        return merge_cases(self.spark.read.parquet(self._parts("cases")))

    def models(self) -> DataFrame:
        return merge_models(self.spark.read.parquet(self._parts("models")), k=self.k)

    def compact(self, batch: str = "merged") -> None:
        """Merges all parts into one. Batches that are in it must not be added again under their names."""
        cases, models, to = self.cases(), self.models(), f"{self.path}/generation={self._generation() + 1}"
        self._write(cases, f"{to}/cases", batch)
        self._write(models, f"{to}/models", batch)

    def leaderboard(self, errors: str = "zero") -> DataFrame:
        return leaderboard(self.cases(), self.models(), errors, self.k)
