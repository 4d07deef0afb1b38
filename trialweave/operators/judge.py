"""Judge polls: one row for each trial, criterion and sample, to medians, scores and disagreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_code_fence, strip_thinking


def poll_scores(polls: DataFrame, reply: str = "reply", path: str = "$.scores") -> DataFrame:
    """polls with ``score`` read from a JSON reply that has {criterion: number} at path; null if it isn't a number."""
    value = F.try_variant_get(F.try_parse_json(reply), path, "map<string,variant>")[F.col("criterion")]
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return polls.withColumn("score", F.when(numeric, value.cast("string").try_cast("double")))


def parsed(reply: Column) -> Column:
    """The JSON value (a variant) of a reply: of all of it, of what is in its fence, or of its widest braces; null without any."""
    inner = strip_code_fence(strip_thinking(reply))
    return F.coalesce(F.try_parse_json(reply), F.try_parse_json(inner), F.try_parse_json(F.regexp_extract(inner, r"(?s)\{.*\}", 0)))


def read_replies(replies: DataFrame, rubric: Sequence[tuple[str, float]], scale: int = 4, reply: str = "reply") -> DataFrame:
    """replies with ``poll``, struct<scores array<struct<criterion, weight, score>>, rationale>, and ``parse_error``, one of them null.

    A reply counts as a whole: it needs an object ``scores`` with a number for every criterion (name, weight) of the rubric.
    Scores are clamped to the scale; a rationale (or reason) is cut to 600 characters.
    """
    rows = replies.withColumn("__v", parsed(F.col(reply)))
    rows = rows.withColumn("__s", F.try_variant_get("__v", "$.scores", "map<string,variant>"))
    value = lambda name: F.col("__s")[name]
    numeric = lambda name: F.coalesce(F.schema_of_variant(value(name)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    clamp = lambda x: F.least(F.lit(float(scale)), F.greatest(F.lit(0.0), x))
    scores = F.array(*(F.struct(F.lit(c).alias("criterion"), F.lit(float(w)).alias("weight"), clamp(value(c).cast("string").try_cast("double")).alias("score")) for c, w in rubric))
    error = F.when(F.col("__v").isNull(), "no JSON").when(F.col("__s").isNull(), "no object scores")
    for c, _ in rubric:
        error = error.when(value(c).isNull(), f"no criterion {c}").when(~numeric(c), f"no number for {c}")
    said = F.coalesce(F.nullif(F.try_variant_get("__v", "$.rationale", "string"), F.lit("")), F.try_variant_get("__v", "$.reason", "string"), F.lit(""))
    rows = rows.withColumn("parse_error", error)
    return rows.withColumn("poll", F.when(F.col("parse_error").isNull(), F.struct(scores.alias("scores"), F.left(said, F.lit(600)).alias("rationale")))).drop("__v", "__s")


def judgements(replies: DataFrame, rubric: Sequence[tuple[str, float]], *keys: str, scale: int = 4, threshold: float = 0.6, order: str = "sample_index") -> DataFrame:
    """One row for each key: status, score, passed, samples, samples_requested, disagreement, rationale, error.

    status is error, and the score null, where no reply could be read: a broken judge is no score of 0.
    """
    read = read_replies(replies, rubric, scale)
    usable = F.col("poll").isNotNull()
    whole = read.groupBy(*keys).agg(
        F.count_if(usable).alias("samples"), F.count("*").alias("samples_requested"),
        F.coalesce(F.min_by(F.nullif("poll.rationale", F.lit("")), F.when(F.col("poll.rationale") != "", F.col(order))), F.lit("")).alias("rationale"),
        F.max_by("parse_error", F.when(~usable, F.col(order))).alias("last_error"),
    )
    polls = read.where(usable).select(*keys, F.explode("poll.scores").alias("s")).select(*keys, "s.*", F.lit(scale).alias("scale"))
    scored = scores(criteria(polls, *keys), *keys, threshold=threshold)
    none = F.col("samples") == 0
    return whole.join(scored, list(keys), "left").select(
        *keys, F.when(none, "error").otherwise("ok").alias("status"), "score", "passed", "samples", "samples_requested", "disagreement", "rationale",
        F.when(none, F.concat(F.lit("no reply of the judge could be read; the last: "), "last_error")).alias("error"),
    )


def clamped(polls: DataFrame) -> DataFrame:
    return polls.withColumn("score", F.least(F.col("scale").cast("double"), F.greatest(F.lit(0.0), F.col("score").cast("double"))))


def criteria(polls: DataFrame, *keys: str) -> DataFrame:
    """Median and spread (largest less smallest) of each criterion over its usable samples."""
    usable = clamped(polls.where("score is not null"))
    return usable.groupBy(*keys, "criterion").agg(F.median("score").alias("median"), (F.max("score") - F.min("score")).alias("spread"), F.max("weight").alias("weight"), F.max("scale").alias("scale"), F.count("*").alias("samples"))


def scores(per_criterion: DataFrame, *keys: str, threshold: float = 0.6) -> DataFrame:
    """Weighted score in [0, 1], pass, and disagreement (the largest spread over the scale) by key."""
    weighted = F.sum(F.col("median") * F.col("weight")) / F.nullif(F.sum(F.col("weight") * F.col("scale")), F.lit(0.0))
    plain = F.sum("median") / F.sum("scale")
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(weighted, plain)))
    return per_criterion.groupBy(*keys).agg(value.alias("score"), (value >= threshold).alias("passed"), F.max(F.col("spread") / F.col("scale")).alias("disagreement"))


def most_disagreed(scored: DataFrame, *keys: str, most: int = 10) -> DataFrame:
    """A report of the ``most`` keys that samples disagree on most."""
    return scored.orderBy(F.desc("disagreement"), *keys).limit(most)


def first_rationale(polls: DataFrame, *keys: str) -> DataFrame:
    return polls.groupBy(*keys).agg(F.min_by("rationale", "sample_index").alias("rationale"))


def costs(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, cache hits and cost (of calls not cached) of a call log."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count_if("cached").alias("cache_hits"), F.sum(F.when(~F.col("cached"), F.col("cost_usd")).otherwise(0.0)).alias("cost_usd"))
