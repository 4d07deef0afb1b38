"""From trial records to case outcomes, and their summaries by task, tag, model and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ok() -> Column:
    return F.col("status") == "ok"


def collapse_cases(records: DataFrame, errors: str = "zero", *keys: str) -> DataFrame:
    """One row for each model, task and case: mean score and share passed over its trials.

    errors: ``zero`` counts an error as 0; ``exclude`` leaves errors out, and cases of errors alone with them.
    """
    if errors not in ("zero", "exclude"):
        raise ValueError(f"errors is {errors!r}, not zero or exclude")
    score = F.when(ok(), F.coalesce("score", F.lit(0.0)))
    passed = F.when(ok(), F.coalesce(F.col("passed").cast("double"), F.lit(0.0)))
    if errors == "zero":
        score, passed = F.coalesce(score, F.lit(0.0)), F.coalesce(passed, F.lit(0.0))
    out = records.groupBy(*(keys or ("model_id", "task_id", "case_id"))).agg(
        F.avg(score).alias("score"),
        F.avg(passed).alias("passed"),
        (F.count("*") if errors == "zero" else F.count_if(ok())).alias("samples"),
        F.count_if(~ok()).alias("errors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    return out.where("samples > 0")


def observations(outcomes: DataFrame, metric: str = "score", cluster_by: str = "task") -> DataFrame:
    """unit, cluster and value of each outcome; clusters are tasks or the cases themselves."""
    unit = F.concat_ws("/", "task_id", "case_id")
    value = F.col("passed" if metric == "pass" else "score")
    return outcomes.select("model_id", unit.alias("unit"), (F.col("task_id") if cluster_by == "task" else unit).alias("cluster"), value.alias("value"))


def task_stats(records: DataFrame, errors: str = "zero") -> DataFrame:
    """Cases, mean score, share passed, and error trials by model and task."""
    cases = collapse_cases(records, errors).groupBy("model_id", "task_id").agg(F.count("*").alias("cases"), F.avg("score").alias("score"), F.avg("passed").alias("pass_rate"))
    failed = records.where(~ok()).groupBy("model_id", "task_id").agg(F.count("*").alias("errors"))
    return cases.join(failed, ["model_id", "task_id"], "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def tag_stats(records: DataFrame, errors: str = "zero") -> DataFrame:
    """Mean score by model and tag."""
    cases = collapse_cases(records, errors).select("model_id", "score", F.explode("tags").alias("tag"))
    return cases.groupBy("model_id", "tag").agg(F.count("*").alias("cases"), F.avg("score").alias("score"))


def trial_stats(records: DataFrame, *keys: str, percentiles: bool = True) -> DataFrame:
    """What is summed over trials: counts, tokens, cost, cache hits, retries, latency of answers not cached."""
    live = F.when(ok() & ~F.col("cached"), F.col("latency_ms"))
    n = F.count("*")
    return records.groupBy(*keys).agg(
        n.alias("trials"),
        F.count_if(~ok()).alias("errors"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if("cached").alias("cache_hits"),
        *((F.coalesce(F.percentile(live, p), F.lit(0.0)).alias(f"latency_{name}_ms") for p, name in ((0.5, "p50"), (0.95, "p95"))) if percentiles else ()),
        F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)).alias("retries"),
        (F.count_if(~ok()) / n).alias("error_rate"),
        (F.count_if("cached") / n).alias("cache_hit_rate"),
    )


def ranked_percentiles(rows: DataFrame, value: str, shares: Sequence[float], *keys: str) -> DataFrame:
    """Exact percentiles (type 7) p0, p1 .. of each group's values without holding a group's values in one place.

    Values are counted by bins of about 1 % of their size; only the bins that hold a wanted rank, and the next value after
    it, are counted by distinct value and ranked. The result is that of percentile(); nulls don't count.
    """
    x = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs(x) + 1) * 64).cast("int")
    rows = rows.where(x.isNotNull()).select(*keys, x.alias("__x"), F.when(x < 0, -1 - size).otherwise(size).alias("__bin"))
    bins = rows.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*keys)
    bins = bins.withColumn("__before", F.sum("__n").over(by.orderBy("__bin")) - F.col("__n")).withColumn("__all", F.sum("__n").over(by))
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("__all") - 1)).alias("at")) for i, s in enumerate(shares))))
    wanted = bins.select("*", places.alias("w")).select(*keys, "__bin", "__before", "__n", "w.*", F.explode(F.array(F.floor("w.at"), F.ceil("w.at"))).alias("rank")).where("rank >= __before and rank < __before + __n")
    held = rows.join(wanted.select(*keys, "__bin", "__before").distinct(), [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__x").agg(F.count("*").alias("m"))
    run = Window.partitionBy(*keys, "__bin").orderBy("__x")
    ranked = held.withColumn("first", F.col("__before") + F.sum("m").over(run) - F.col("m"))
    found = wanted.select(*keys, "__bin", "i", "at", "rank").join(ranked.select(*keys, "__bin", "__x", "first", "m"), [*keys, "__bin"]).where("rank >= first and rank < first + m")
    ends = found.groupBy(*keys, "i", "at").agg(F.min("__x").alias("low"), F.max("__x").alias("high"))
    part = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return ends.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, part)).alias(f"p{i}") for i in range(len(shares))))


def leaderboard(records: DataFrame, errors: str = "zero", by_ranks: bool = False) -> DataFrame:
    """One row for each model: its outcomes and its trials.

    by_ranks: latencies' percentiles come from ranked_percentiles(), for models with more distinct latencies than one task
    holds; partial.leaderboard() takes them from sketches, which merge.
    """
    cases = collapse_cases(records, errors).groupBy("model_id").agg(F.count("*").alias("cases"), F.avg("score").alias("score"), F.avg("passed").alias("pass_rate"))
    trials = trial_stats(records, "model_id", percentiles=not by_ranks)
    if by_ranks:
        live = records.where(ok() & ~F.col("cached"))
        ranks = ranked_percentiles(live, "latency_ms", [0.5, 0.95], "model_id")
        trials = trials.join(ranks, "model_id", "left").withColumns({f"latency_{p}_ms": F.coalesce(c, F.lit(0.0)) for p, c in (("p50", "p0"), ("p95", "p1"))}).drop("p0", "p1")
    return trials.join(cases, "model_id", "left")


def run_totals(records: DataFrame) -> DataFrame:
    """Trials, errors and cost of each model and, with a null model, of the run."""
    return records.rollup("model_id").agg(F.count("*").alias("trials"), F.count_if(~ok()).alias("errors"), F.sum("cost_usd").alias("cost_usd"))


def run_notes(records: DataFrame, intervals: DataFrame, errors: str = "zero", most_errors: float = 0.05) -> DataFrame:
    """note and detail of a run: failed trials and how they count, more of them than a share, models without an interval.

    intervals: model_id and method, as of bootstrap.intervals().
    """
    share = F.col("failed") / F.col("n")
    counts = records.agg(F.count_if(~ok()).alias("failed"), F.count("*").alias("n")).where("failed > 0")
    how = "count as 0" if errors == "zero" else "are left out"
    lone = intervals.where(F.col("method").isin("empty", "degenerate")).agg(F.array_sort(F.collect_list("model_id")).alias("models")).where("size(models) > 0")
    return (
        counts.select(F.lit("errors").alias("note"), F.format_string(f"%d trials failed (%.1f%%); they {how}", "failed", share * 100).alias("detail"))
        .union(counts.where(share > most_errors).select(F.lit("many errors"), F.lit("scores are provisional: resume the run first")))
        .union(lone.select(F.lit("no interval"), F.concat(F.array_join("models", ", "), F.lit(": two clusters are needed at least"))))
    )


def below(board: DataFrame, least: float, of: str = "score") -> DataFrame:
    """The models of a leaderboard that a gate on their point score stops."""
    return board.where(F.col(of) < least)


def notes(records: DataFrame, most_errors: float = 0.05) -> DataFrame:
    """By model, what a reader should know: whether there are errors, and more of them than a share."""
    rate = F.count_if(~ok()) / F.count("*")
    return records.groupBy("model_id").agg(F.when(rate > most_errors, "many_errors").when(rate > 0, "errors").otherwise("none").alias("note"))


def best_models(board: DataFrame, of: str = "score") -> DataFrame:
    """board with ``best``: whether a model ties the best score, if that is over 0 and there are several models."""
    best = F.max(of).over(Window.partitionBy())  # a row for each model
    return board.withColumn("best", (F.col(of) == best) & (best > 0) & (F.count("*").over(Window.partitionBy()) > 1))


def failures(records: DataFrame, errors_only: bool = False) -> Column:
    """The condition of the rows to show."""
    return ~ok() if errors_only else ~ok() | ~F.coalesce("passed", F.lit(False))


def latest(records: DataFrame, order: str) -> DataFrame:
    """Of the records of one trial, the last by ``order``: the alternative to counting a resumed trial's error as well."""
    by = Window.partitionBy("run_id", "model_id", "task_id", "case_id", "sample_index").orderBy(F.desc(order))
    return records.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
