"""A judge's calls through the response cache: looked up, made once where they miss, kept and costed like any other.

Prompts become requests with keys; those that a valid row of the cache answers are hits. Of the
others every key is asked once, however many rows share it (the rest are hits of what the run
itself has just asked); answers are written back, failures are not, so that they are asked
again. Requests of one key are one call of the judge at any scale: keys are counted and joined,
never gathered in a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import cache_key, cost_usd
from ..sources import cache as responses

#: What a cached judge reply holds.
PAYLOAD = "reply string, input_tokens long, output_tokens long"


@dataclass(frozen=True)
class Endpoint:
    """The judge: what goes into keys, and prices for a million tokens."""

    provider: str
    model: str
    params: str = "{}"
    input_per_mtok: float = 0.0
    output_per_mtok: float = 0.0


@dataclass(frozen=True)
class Calls:
    """replies: the prompts with cache_key, reply (null where the call failed), cached, input_tokens, output_tokens and cost_usd; cache: the table with what was learned, and hits counted; answered: what was asked."""

    replies: DataFrame
    cache: DataFrame
    answered: DataFrame

    def stats(self) -> DataFrame:
        """One row: calls, hits, misses, failed, tokens and cost_usd."""
        miss, failed = ~F.col("cached"), F.col("reply").isNull()
        tokens = F.col("input_tokens") + F.col("output_tokens")
        return self.replies.agg(
            F.count("*").alias("calls"), F.count_if("cached").alias("hits"), F.count_if(miss).alias("misses"), F.count_if(failed).alias("failed"),
            F.coalesce(F.sum(F.when(miss, tokens)), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        )


def requests(prompts: DataFrame, endpoint: Endpoint) -> DataFrame:
    """prompts (prompt, sample_index and perhaps system) with ``cache_key``: of the judge's role, so that no candidate's answer is taken for one."""
    system = F.col("system") if "system" in prompts.columns else F.lit(None).cast("string")
    fields = {"provider": F.lit(endpoint.provider), "model": F.lit(endpoint.model), "params": F.lit(endpoint.params), "role": F.lit("judge"), "system": system, "prompt": F.col("prompt"), "sample": F.col("sample_index").cast("long")}
    return prompts.withColumn("cache_key", cache_key(fields))


def _kept(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def call(
    prompts: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], endpoint: Endpoint, order: Sequence[str],
    now: float = 0.0, ttl: float | None = None, keep: Callable[[DataFrame], DataFrame] = _kept,
) -> Calls:
    """The judge's replies to prompts.

    ask: from requests (cache_key, prompt, sample_index, system if there is one) to the same with reply (null: failed),
    input_tokens and output_tokens. order: columns that tell prompts apart; of those that share a missing key the first by
    them is the call. keep: what holds answers so that none is asked twice; by default Spark's cache, which asks again what
    a lost executor held: for a judge that costs, write a table and read it.
    """
    rows = requests(prompts, endpoint)
    valid = responses.valid(cache, now, ttl)
    looked = responses.look_up(rows, valid)
    first = F.struct(*order)
    sent = [c for c in ("prompt", "sample_index", "system") if c in rows.columns]
    # One row for each missing key, the first call's; partial sums are taken before keys are dealt out.
    missing = looked.where(~F.col("cached")).groupBy("cache_key").agg(F.min(first).alias("__first"), *(F.min_by(c, first).alias(c) for c in sent))
    answered = keep(ask(missing.drop("__first")).select("cache_key", *(F.col(c) for c in ("reply", "input_tokens", "output_tokens"))))
    asked = missing.select("cache_key", "__first").join(answered.select("cache_key", *(F.col(c).alias(f"__{c}") for c in ("reply", "input_tokens", "output_tokens"))), "cache_key", "left")
    both = looked.join(asked, "cache_key", "left").withColumn("__p", F.from_json("payload", PAYLOAD))
    hit = F.col("cached") | (F.col("__first").isNotNull() & (F.col("__first") != first))
    of = lambda c: F.when(F.col("cached"), F.col(f"__p.{c}")).otherwise(F.col(f"__{c}"))
    tokens = {c: F.coalesce(of(c), F.lit(0).cast("long")) for c in ("input_tokens", "output_tokens")}
    cost = cost_usd(tokens["input_tokens"], tokens["output_tokens"], F.lit(endpoint.input_per_mtok), F.lit(endpoint.output_per_mtok), hit)
    replies = both.select(*prompts.columns, "cache_key", of("reply").alias("reply"), hit.alias("cached"), *(x.alias(c) for c, x in tokens.items()), cost.alias("cost_usd"))
    made = F.to_json(F.struct("reply", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens")))
    new = answered.where("reply is not null").select(
        F.col("cache_key").alias("key"), F.lit(responses.VERSION).alias("schema_version"), F.lit(endpoint.provider).alias("provider"), F.lit(endpoint.model).alias("model"), F.lit("judge").alias("role"),
        made.alias("payload"), F.lit(float(now)).alias("created_at"), F.lit(0).cast("long").alias("hits"),
    )
    used = replies.where("cached").groupBy(F.col("cache_key").alias("key")).agg(F.count("*").alias("__used"))
    table = responses.upsert(cache, new).join(used, "key", "left").withColumn("hits", F.col("hits") + F.coalesce("__used", F.lit(0))).select(*cache.columns)
    return Calls(replies, table, answered)
